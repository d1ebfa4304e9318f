"""Line dedup by site-relative frequency.

A line's frequency on a site is the number of the site's pages that contain it over the number of
all pages of the site. Lines above the boilerplate ratio go from the site's pages; the other lines
stay in their order. The host of a page is a column (the source of documents) or comes from a URL.

Lines are compared after trimming; blank lines always stay. Null text stays null and counts as a
page without lines; pages with a null host form one site; repeated rows are pages of their own,
a line that repeats within one counts once. A line needs min_pages pages at least, as one page of a
site with few pages is a large share. A page of boilerplate alone loses all lines, or, with
keep_whole, none: where near-duplicate removal follows, that then keeps one of such pages that are
equal. Very long texts are pages like any other. Empty tables give no rows. Extra columns are kept
whatever their names; the two columns added get more underscores where theirs are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import Scratch, table, unused

#: Boilerplate: on more than this share of a site's pages, and on so many pages at least.
RATIO, MIN_PAGES = 0.01, 5
_TRIM = " \t\r\x0b\x0c"


def host_of_url(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    """128 bits that stand for a line; null for a blank one."""
    t = F.btrim(line, F.lit(_TRIM))
    return F.when(t != "", F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b")))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, marks): per site the lines above the ratio.

    Every page sends each of its lines once, and map tasks add up before the shuffle, so a hot site
    or line costs a row per task. A site has at most (mean lines per page) / ratio such lines.
    """
    own = pages.select(host.alias("host"), F.array_distinct(F.filter(F.transform(_lines(text), _mark), lambda m: m.isNotNull())).alias("marks"))
    lines = own.select("host", F.explode("marks").alias("m")).groupBy("host", "m").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sites = own.groupBy("host").agg(F.count("*").alias("pages"))
    s = sites.select(F.col("host").alias("site"), "pages")
    many = lines.join(s, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > ratio * F.col("pages"))
    return many.groupBy("host").agg(F.collect_set("m").alias("marks"))


def drop_lines(
    pages: DataFrame, *, host: Column | None = None, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """pages with text_col without its site's boilerplate, and _n_lines and _n_dropped as last columns."""
    host = F.col("source") if host is None else host
    scratch = scratch or Scratch(pages.sparkSession, "lines")
    found = scratch.save(boilerplate(pages, host, F.col(f"`{text_col}`"), ratio, min_pages), "boilerplate")
    # one row per site that has such lines at all, of bounded width; Catalyst broadcasts it while it is small
    b = found.select(F.col("host").alias("site"), "marks")
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host.alias("host"))
    d = own.join(b, F.col("host").eqNullSafe(F.col("site")), "left")
    text = F.col("page").getField(text_col)
    lines = _lines(text)
    kept = F.when(F.col("marks").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("marks"), _mark(x)), F.lit(False))))
    d = d.withColumn("kept", kept)
    if keep_whole:
        d = d.withColumn("kept", F.when(F.exists("kept", lambda x: F.btrim(x, F.lit(_TRIM)) != ""), F.col("kept")).otherwise(lines))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    return d.select(
        *[(F.array_join("kept", "\n") if c == text_col else F.col("page").getField(c)).alias(c) for c in pages.columns],
        n.alias(unused(pages.columns, "_n_lines")),
        F.when(text.isNull(), 0).otherwise(n - F.size("kept")).alias(unused(pages.columns, "_n_dropped")),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs).select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.md5("text").alias("kept_md5"))


_SQL = f"""
with l as (
  select doc_id, source, pos, x, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as t
  from (select doc_id, source, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
),
s as (select source, count(*) as pages from documents group by source),
b as (
  select l.source, l.t from l join s on l.source is not distinct from s.source where l.t <> ''
  group by l.source, l.t, s.pages having count(distinct l.doc_id) >= {MIN_PAGES} and count(distinct l.doc_id) > {RATIO} * s.pages
),
m as (select l.*, b.t is not null as gone from l left join b on l.source is not distinct from b.source and l.t = b.t),
k as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, coalesce(string_agg(x, chr(10) order by pos) filter (where not gone), '') as kept from m group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_dropped, 0) as n_dropped, case when d.text is not null then md5(k.kept) end as kept_md5
from documents d left join k using (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL = {"op4_line_dedup": _SQL}
