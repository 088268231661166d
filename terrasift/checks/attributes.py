"""Rules on attribute columns. All row rules of a layer are flags of one aggregation; rows are fetched only for rules that fail."""

from __future__ import annotations

import numbers
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasift.checks.base import Results, is_null, row_issues, status_for
from terrasift.config import AttributesRule, Domain
from terrasift.model import FID, CheckResult, Issue, LayerFrame, Severity, Status

#: Text that counts as a number: what both Python's and Spark's casts read alike.
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|Inf(inity)?|NaN|nan)\s*$"
#: Syntax that Python's re has and Java's patterns read otherwise, or not at all.
PYTHON_ONLY = re.compile(r"\(\?P|\(\?\(|\\Z|\(\?[aLu]|\\[wdsbWDSB]|\\N\{")


def as_number(df: DataFrame, column: str) -> Column:
    """A column as double, null where it isn't a number. NaN counts as none."""
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind == "string":
        n = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    elif kind in ("timestamp", "timestamp_ntz", "date"):
        n = F.unix_micros(c.cast("timestamp")).cast("double") * 1000
    elif kind in ("binary",) or kind.startswith(("array", "map", "struct")):
        return F.lit(None).cast("double")
    else:
        n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text, booleans as True and False."""
    c = F.col(f"`{column}`")
    return F.when(c, "True").otherwise("False") if dict(df.dtypes)[column] == "boolean" else c.cast("string")


def allowed_here(df: DataFrame, column: str, values: list[Any]) -> Column:
    """Membership as between Python values: text never equals numbers, 1 equals 1.0 and true."""
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind == "string":
        fit = [v for v in values if isinstance(v, str)]
    elif kind == "boolean" or kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        fit = [float(v) for v in values if isinstance(v, numbers.Real)]
        c = c.cast("double") if kind != "boolean" else c.cast("int").cast("double")
    else:
        fit, c = [str(v) for v in values], c.cast("string")
    return c.isin(fit) if fit else F.lit(False)


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text matches. Patterns that Java reads as Python does stay in the JVM."""
    re.compile(pattern)
    if PYTHON_ONLY.search(pattern):
        @F.pandas_udf("boolean")
        def full(col: pd.Series) -> pd.Series:
            own = re.compile(pattern)
            return col.map(lambda v: None if v is None else bool(own.fullmatch(v)))

        return full(text)
    return text.rlike(rf"\A(?:{pattern})\z")


def violation(df: DataFrame, column: str, rule: Domain) -> tuple[Column, str]:
    """One flag for all of a domain's constraints, and their description. Nulls violate none."""
    bad, said = F.lit(False), []
    if rule.allowed is not None:
        bad |= ~allowed_here(df, column, rule.allowed)
        said.append(f"allowed={rule.allowed}")
    number = as_number(df, column)
    if rule.min is not None:
        bad |= F.coalesce(number < rule.min, F.lit(False))
        said.append(f"min={rule.min}")
    if rule.max is not None:
        bad |= F.coalesce(number > rule.max, F.lit(False))
        said.append(f"max={rule.max}")
    if rule.regex is not None:
        bad |= ~matches(as_text(df, column), rule.regex)
        said.append(f"regex={rule.regex!r}")
    return ~is_null(df, column) & F.coalesce(bad, F.lit(False)), ", ".join(said) or "no constraints"


def run(frame: LayerFrame, layer: str, source: str, rule: AttributesRule) -> list[CheckResult]:
    if not rule.enabled:
        return []
    df, out = frame.df, Results("attributes", layer, source, rule.severity)
    have = set(df.columns) - {FID}
    asked = [*rule.not_null, *rule.max_null_fraction]
    domains = {c: violation(df, c, d) for c, d in rule.domains.items() if c in have}
    flags = {f"null:{c}": is_null(df, c) for c in asked if c in have} | {f"domain:{c}": bad for c, (bad, _) in domains.items()}
    counts = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias(k) for k, bad in flags.items()]).first()
    total = counts["rows"]

    def absent(column: str) -> bool:
        if column in have:
            return False
        status = Status.WARN if rule.severity == Severity.WARN else Status.FAIL
        out.add(f"missing[{column}]", f"Configured column '{column}' does not exist in this layer.", n_failed=1, status=status, issues=[Issue(f"column '{column}' not found")])
        return True

    if rule.required:
        lost = [c for c in rule.required if c not in have]
        message = f"Missing required column(s): {', '.join(lost)}." if lost else "All required columns present."
        out.add("required", message, total, len(lost), issues=[Issue(f"missing column '{c}'") for c in lost])
    for c in rule.not_null:
        if not absent(c):
            n, bad = counts[f"null:{c}"], flags[f"null:{c}"]
            message = f"Column '{c}' has {n} null value(s)." if n else f"Column '{c}' has no nulls."
            out.add(f"not_null[{c}]", message, total, n, issues=row_issues(df, bad, f"null in '{c}'") if n else [], failing=df.where(bad).select(FID))
    for c, limit in rule.max_null_fraction.items():
        if not absent(c):
            n = counts[f"null:{c}"]
            share = n / total if total else 0.0
            over = n if share > limit else 0
            out.add(f"completeness[{c}]", f"Column '{c}' null fraction {share:.1%} (limit {limit:.0%}).", total, over, status_for(int(share > limit), rule.severity))
    for c in rule.unique:
        if not absent(c):
            _unique(df, c, total, out)
    for c in rule.domains:
        if not absent(c):
            (bad, said), n = domains[c], counts[f"domain:{c}"]
            message = f"Column '{c}' has {n} value(s) outside domain ({said})." if n else f"Column '{c}' conforms to domain ({said})."
            out.add(f"domain[{c}]", message, total, n, issues=row_issues(df, bad, f"out-of-domain value in '{c}'", c) if n else [], failing=df.where(bad).select(FID))
    return out.found


def _unique(df: DataFrame, c: str, total: int, out: Results) -> None:
    """Redundant copies are counted by a hash aggregation; the rows of repeated values are fetched by a semi join."""
    rows = df.where(~is_null(df, c)).select(FID, F.col(f"`{c}`").alias("__v"))
    again = rows.groupBy("__v").agg(F.count("*").alias("n")).where("n > 1")
    n = again.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first().n
    members = rows.join(again.select("__v"), "__v", "left_semi")
    issues = [Issue(f"duplicate value in '{c}'", r["__v"], fid=r[FID]) for r in members.orderBy(FID).limit(200).collect()] if n else []
    message = f"Column '{c}' has {n} duplicate value(s)." if n else f"Column '{c}' values are unique."
    out.add(f"unique[{c}]", message, total, n, issues=issues, failing=members.select(FID))


def keep_first(df: DataFrame, column: str) -> DataFrame:
    """df less the rows that repeat an earlier row's value."""
    nth = F.row_number().over(W.partitionBy(column).orderBy(FID))
    return df.withColumn("__n", nth).where((F.col("__n") == 1) | F.col(column).isNull()).drop("__n")
