"""Rule packs: a small safe expression language compiled to columns, and effective-dated evaluation.

Expressions know and/or/not, unary minus, single comparisons, + - * / % **, abs, log, round, column
names and constants; everything else is rejected. Nothing is evaluated in Python.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"critical": 100, "high": 75, "medium": 45, "low": 20}


class RuleError(ValueError):
    pass


def _number(c: Column) -> Column:
    """NaN becomes null, as comparisons with it are false."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def _modulo(a: Column, b: Column) -> Column:
    return ((a % b) + b) % b  # the sign of the divisor, as in Python


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: _modulo, ast.Pow: F.pow}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b}
_CALLS = {"abs": F.abs, "log": F.log, "round": F.bround}


def columns_of(expression: str) -> set[str]:
    return {n.id for n in ast.walk(ast.parse(expression, mode="eval")) if isinstance(n, ast.Name) and n.id not in _CALLS}


def compile_rule(expression: str, types: dict[str, str]) -> Column:
    """A boolean column, false where a value is missing (but != is true there)."""

    def value(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and node.id in types:
            c = F.col(f"`{node.id}`")
            return c if types[node.id] in ("string", "boolean") else _number(c)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            args = [value(x) for x in node.args[:1]]
            if node.func.id == "round" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant):
                return F.bround(args[0], int(node.args[1].value))
            if len(node.args) == 1:
                return _CALLS[node.func.id](args[0])
        raise RuleError(f"not allowed in a rule: {ast.dump(node)[:80]}")

    def truth(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [truth(x) for x in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(node.op, ast.And) else (out | p)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~truth(node.operand)
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1:
                raise RuleError("comparisons do not chain")
            a, b = value(node.left), value(node.comparators[0])
            if isinstance(node.ops[0], ast.NotEq):
                return F.coalesce(a != b, F.lit(True))
            if type(node.ops[0]) in _COMPARE:
                return F.coalesce(_COMPARE[type(node.ops[0])](a, b), F.lit(False))
            raise RuleError("unknown comparison")
        if isinstance(node, ast.Name) and types.get(node.id) == "boolean":
            return F.coalesce(F.col(f"`{node.id}`"), F.lit(False))
        return F.coalesce(value(node) != 0, F.lit(True))  # a number: NaN counts as true

    try:
        tree = ast.parse(expression, mode="eval")
    except SyntaxError as e:
        raise RuleError(str(e)) from e
    return truth(tree.body)


@dataclass(frozen=True)
class Rule:
    id: str
    expression: str
    severity: str
    effective_from: date = date.min
    effective_to: date = date.max

    def in_force(self, day: date) -> bool:
        return self.effective_from <= day <= self.effective_to


@dataclass(frozen=True)
class RulePack:
    name: str
    version: str
    rules: tuple[Rule, ...]

    def split(self, columns: list[str], day: date) -> tuple[list[Rule], list[Rule]]:
        """Rules in force whose columns exist, and those skipped for a missing column."""
        live = [r for r in self.rules if r.in_force(day)]
        fit = [r for r in live if columns_of(r.expression) <= set(columns)]
        return fit, [r for r in live if r not in fit]


def load_pack(text: str) -> RulePack:
    """A pack from YAML where PyYAML is installed, else from JSON."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        import json

        raw = json.loads(text)
    day = lambda v, default: date.fromisoformat(str(v)) if v else default
    return RulePack(raw["name"], str(raw["version"]), tuple(Rule(r["id"], r["expression"], r["severity"], day(r.get("effective_from"), date.min), day(r.get("effective_to"), date.max)) for r in raw["rules"]))


def rules_in_force(day: Column, pack: RulePack) -> Column:
    """Ids of the rules of a pack that are in force on a day, both ends included."""
    return F.array_compact(F.array(*[F.when(day.between(F.lit(r.effective_from.isoformat()).cast("date"), F.lit(r.effective_to.isoformat()).cast("date")), F.lit(r.id)) for r in pack.rules]))


def evaluate(df: DataFrame, pack: RulePack, day: date) -> DataFrame:
    """df with rule_score (the largest severity that fired, else 0) and fired (rule ids in pack order)."""
    fit, _ = pack.split(df.columns, day)
    types = dict(df.dtypes)
    hits = [(r, compile_rule(r.expression, types)) for r in fit]
    if not hits:
        return df.withColumns({"rule_score": F.lit(0), "fired": F.array().cast("array<string>")})
    score = F.greatest(F.lit(0), *[F.when(c, SEVERITY[r.severity]).otherwise(0) for r, c in hits])
    return df.withColumns({"rule_score": score, "fired": F.array_compact(F.array(*[F.when(c, r.id) for r, c in hits]))})


def dry_run(df: DataFrame, pack: RulePack, day: date) -> DataFrame:
    """Hits per rule, all rules in one pass."""
    fit, _ = pack.split(df.columns, day)
    types = dict(df.dtypes)
    wide = df.agg(*[F.count_if(compile_rule(r.expression, types)).alias(r.id) for r in fit])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(f"`{r.id}`").alias("hits")) for r in fit])).alias("x")).select("x.*")
