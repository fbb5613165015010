"""Data checks; each answers with rows (check, subject, count or share)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import tables
from tidemark.sources import scratch


def contract(df: DataFrame, expected: T.StructType) -> list[tuple[str, str]]:
    """(problem, column): missing and extra columns and wrong types; reads no data."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in expected}
    number = (T.NumericType,)
    fits = lambda a, b: a == b or (isinstance(a, number) and isinstance(b, number) and (isinstance(b, T.FractionalType) or isinstance(a, T.IntegralType)))
    return [("missing", c) for c in want if c not in have] + [("extra", c) for c in have if c not in want] + [("type", c) for c in want if c in have and not fits(have[c], want[c])]


def forbidden_columns(schema: T.StructType, prefix: str = "") -> list[str]:
    """Columns, nested ones too, that must not leave the device."""
    found: list[str] = []
    for f in schema.fields:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if f.name.startswith("raw_") or f.name in ("window_title_raw", "typed_text", "clipboard_content", "full_url"):
            found.append(prefix + f.name)
        if isinstance(kind, T.StructType):
            found += forbidden_columns(kind, f"{prefix}{f.name}.")
    return found


def _long(df: DataFrame, aggregates: dict) -> DataFrame:
    row = df.agg(*[c.cast("double").alias(k) for k, c in aggregates.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k.split("|")[0]).alias("check"), F.lit(k.split("|")[1]).alias("subject"), F.col(f"`{k}`").alias("value")) for k in aggregates]))
    return row.select(pairs.alias("x")).select("x.*")


def column_checks(df: DataFrame, required: Sequence[str], optional: Sequence[str], ranges: Mapping[str, tuple] = tables.RANGES, missing_limit: float = 0.5) -> DataFrame:
    """Nulls in required columns, missing rates beyond the limit, values out of range; one scan."""
    checks = {f"null|{c}": F.count_if(F.col(c).isNull()) for c in required}
    checks |= {f"missing|{c}": F.avg(F.col(c).isNull().cast("int")) for c in optional}
    for c, (low, high) in ranges.items():
        if c in df.columns:
            below = F.col(c) < low if low is not None else F.lit(False)
            above = F.col(c) > high if high is not None else F.lit(False)
            checks[f"range|{c}"] = F.count_if(below | above)
    return _long(df, checks).where(F.when(F.col("check") == "missing", F.col("value") > missing_limit).otherwise(F.col("value") > 0))


def bucket_ends(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Rows whose end is not one bucket after their start."""
    return df.agg(F.count_if(F.unix_seconds("bucket_end_ts") - F.unix_seconds("bucket") != seconds).alias("wrong_ends"))


def monotonic(df: DataFrame, keys: Sequence[str], order: str, ts: str = "bucket") -> DataFrame:
    """Rows that go back in time in the given order, for each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_back", F.col(ts) < F.lag(ts).over(w))
    return marked.groupBy(*keys).agg(F.count_if("_back").alias("backward"))


def short_session_gaps(df: DataFrame, keys: Sequence[str], seconds: int, session: str = "session_start") -> DataFrame:
    """First change of session of each key with a gap of at most one bucket."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    gap = F.unix_seconds("bucket") - F.unix_seconds(F.lag("bucket").over(w))
    changed = df.withColumns({"_gap": gap, "_new": F.col(session) != F.lag(session).over(w)}).where(F.col("_new") & (F.col("_gap") <= seconds))
    return changed.groupBy(*keys).agg(F.min("bucket").alias("bucket"), F.min_by("_gap", "bucket").alias("gap"))


def constant_columns(df: DataFrame, columns: Sequence[str], share: float = 0.9) -> DataFrame:
    """Numeric columns with one value, or with a value in more than ``share`` of the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(each.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    shares = counts.groupBy("column").agg(F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("top_share"))
    return shares.select("column", F.when(F.col("distinct") == 1, "constant").when(F.col("top_share") > share, "dominant").alias("finding"), F.round("top_share", 4).alias("top_share")).where("finding IS NOT NULL")


def invalid_spans(spans: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Spans with an unknown label, an end not after the start, or a confidence out of [0, 1]."""
    good_end = F.when(F.col("extend_forward"), F.col("end_ts") >= F.col("start_ts")).otherwise(F.col("end_ts") > F.col("start_ts"))
    reason = F.when(~F.col("label").isin(*labels), "label").when(~good_end, "end").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence")
    return spans.withColumn("reason", reason).where("reason IS NOT NULL")


def rare_classes(df: DataFrame, labels: Sequence[str], share: float = 0.05) -> DataFrame:
    from tidemark.operators.metrics import class_distribution

    return class_distribution(df, labels).where(F.col("fraction") < share)


def validate(df: DataFrame, keys: Sequence[str], required: Sequence[str], optional: Sequence[str], seconds: int) -> DataFrame:
    """All findings of a feature table as (check, subject, value); an empty table is one finding.

    The columns that are checked are written once: the checks scan them five times, and a feature table is dear to make.
    """
    checked = dict.fromkeys([*keys, "bucket", "bucket_end_ts", "session_start", *required, *optional, *(c for c in tables.RANGES if c in df.columns)])
    path = scratch.folder(df.sparkSession, "validated")
    df.select(*checked).write.parquet(path)
    df = df.sparkSession.read.parquet(path)
    column = column_checks(df, required, optional)
    ends = bucket_ends(df, seconds).where("wrong_ends > 0").select(F.lit("bucket_end").alias("check"), F.lit("").alias("subject"), F.col("wrong_ends").cast("double").alias("value"))
    gaps = short_session_gaps(df, keys, seconds).select(F.lit("session_gap").alias("check"), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("subject"), F.col("gap").cast("double").alias("value"))
    flat = constant_columns(df, optional).select(F.col("finding").alias("check"), F.col("column").alias("subject"), F.col("top_share").alias("value"))
    empty = df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty").alias("check"), F.lit("").alias("subject"), F.lit(0.0).alias("value"))
    return column.unionByName(ends).unionByName(gaps).unionByName(flat).unionByName(empty)
