"""Delimited and JSON files as DataFrames. Files are read by Spark's own readers; only a header is looked at first."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyward.operators.prepare import clean_headers

DELIMITERS = ",;\t|"
WRAPPERS = ("data", "rows", "records", "items")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")

# Spark reads ISO-8859-1; cp1252 differs in these bytes.
_PAIRS = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_C1, _CP1252 = ("".join(p[i] for p in _PAIRS if p[1]) for i in (0, 1))


def _head(spark: SparkSession, path: str, size: int = 65536) -> bytes:
    """About the first bytes of the files at a path: their first lines as Latin-1, so every byte stays what it is."""
    lines, used = [], 0
    for r in spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").csv(path, sep="\u0001", quote="", escape="", schema="value string").limit(200).collect():
        lines.append((r["value"] or "").encode("latin-1", "replace"))
        used += len(lines[-1]) + 1
        if used >= size:
            break
    return b"\n".join(lines)[:size]


def sniff(head: bytes) -> tuple[str, str]:
    """(delimiter, encoding) of a delimited file, the header deciding where the sniffer does not."""
    encoding = "UTF-8"
    for e in ENCODINGS:
        try:
            text = head.decode(e)
            encoding = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8"}.get(e, e)
            break
        except UnicodeDecodeError as err:
            if err.start > len(head) - 4 and e.startswith("utf-8"):  # a character cut at the end
                text = head[: err.start].decode(e)
                break
    try:
        return csv.Sniffer().sniff(text, DELIMITERS).delimiter, encoding
    except csv.Error:
        line = text.partition("\n")[0]
        return max(DELIMITERS, key=line.count) if any(d in line for d in DELIMITERS) else ",", encoding


def read_delimited(spark: SparkSession, path: str, *, strict: bool = True, multiline: bool = True) -> DataFrame:
    """All columns as text; surplus values fail the read if strict, short rows give empty text.

    Quoted values may hold line breaks; without them (multiline false) large files are split among tasks.
    """
    delimiter, encoding = sniff(_head(spark, path))
    single = encoding in ("cp1252", "latin-1")
    reader = spark.read.options(sep=delimiter, header=True, encoding="ISO-8859-1" if single else encoding, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", inferSchema=False)
    schema = reader.csv(path).schema
    extra = "_surplus"
    while extra in schema.fieldNames():
        extra = f"_{extra}"
    # one column more than the header names holds what a row has beyond them
    df = reader.schema(StructType([*schema.fields, StructField(extra, StringType())])).csv(path)
    if strict:
        df = df.where(F.when(F.col(extra).isNotNull(), F.raise_error(F.lit("a row has more values than the header")).cast("boolean")).otherwise(True))
    df = clean_headers(df.drop(extra))
    text = lambda c: F.translate(c, _C1, _CP1252) if encoding == "cp1252" else c
    return df.select(*[F.coalesce(text(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns, arrays as JSON text."""

    def walk(schema: StructType, prefix: str = "") -> list:
        out = []
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            path = ".".join(f"`{p}`" for p in name.split("."))
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, f"{name}.")
            else:
                c = F.to_json(F.col(path)) if isinstance(f.dataType, ArrayType) else F.col(path)
                out.append(c.alias(name))
        return out

    return df.select(*walk(df.schema))


def read_json(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """JSON lines, an array of objects, or an object that wraps one under data, rows, records or items; flattened."""
    df = spark.read.json(path, multiLine=not lines, mode="FAILFAST")
    wrapped = [c for c in WRAPPERS if c in df.columns and isinstance(df.schema[c].dataType, ArrayType)]
    if wrapped and not lines:
        if not isinstance(df.schema[wrapped[0]].dataType.elementType, StructType):
            raise ValueError(f"{wrapped[0]} must hold objects")
        df = df.select(F.explode(wrapped[0]).alias("r")).select("r.*")
    return flatten(df)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        return read_delimited(spark, path)
    if kind in ("jsonl", "ndjson"):
        return read_json(spark, path, lines=True)
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        from tallyward.sources.workbook import read_workbook

        return read_workbook(spark, path)
    raise ValueError(f"no reader for .{kind}")


def guard(df: DataFrame, *, most_columns: int = 2000, most_record: int = 4 << 20) -> DataFrame:
    """df if it is narrow enough; rows of more than most_record characters fail the job where they occur."""
    if len(df.columns) > most_columns:
        raise ValueError(f"{len(df.columns)} columns; {most_columns} at most")
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return df.where(F.when(size <= most_record, True).otherwise(F.raise_error(F.lit(f"a record is longer than {most_record}")).cast("boolean")))


def batch_ids(df: DataFrame, row_id: str, rows: int = 5000, cells: int = 100_000) -> DataFrame:
    """df with batch_id: bounded by rows and by cells."""
    n = max(1, min(rows, cells // max(1, len(df.columns))))
    return df.withColumn("batch_id", F.floor((F.col(row_id) - 1) / n))


def upload_problem(df: DataFrame, *, most_rows: int = 200_000, most_columns: int = 200) -> DataFrame:
    """One row (rows, columns, problem): what forbids df as an upload, null if nothing does."""
    width, nested = len(df.columns), nested_columns(df)
    n = F.col("rows")
    problem = F.when(F.lit(not 1 <= width <= most_columns), "COLUMNS").when(F.lit(len(set(df.columns)) < width), "DUPLICATE_COLUMNS").when(F.lit(bool(nested)), "NESTED").when((n < 1) | (n > most_rows), "ROWS")
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(width).alias("columns"), problem.alias("problem"))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """CSV, XLSX or a JSON array of flat records, within the limits of an upload; anything else is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "xlsx", "json"):
        raise ValueError("only CSV, XLSX and JSON files are accepted")
    if kind == "json":
        if not _head(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["):
            raise ValueError("JSON must hold an array of records")
        df = spark.read.json(path, multiLine=True, mode="FAILFAST")
    else:
        df = load(spark, path)
    if kind == "xlsx":
        first = df.first()
        df = df.select(*[F.col("fields")[c].alias(c) for c in (first["fields"] if first else ())])
    found = upload_problem(df).first()["problem"]
    if found:
        raise ValueError(f"the upload is refused: {found}")
    return df


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (StructType, ArrayType))]
