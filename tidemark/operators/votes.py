"""Votes of an interval's buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Most frequent label; the first to occur wins a tie."""
    per = df.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return per.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("n"), F.col("first"))).alias("winner"))


def confidence_weighted(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Label with most confidence in sum; the first to occur wins a tie."""
    per = df.groupBy(*keys, "label").agg(F.sum("confidence").alias("n"), F.min(order).alias("first"))
    return per.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("n"), F.col("first"))).alias("winner"))


def highest_probability(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Class with the highest summed probability; the lowest class wins a tie."""
    per = df.select(*keys, F.posexplode("probs").alias("c", "p")).groupBy(*keys, "c").agg(F.sum("p").alias("n"))
    names = F.array(*map(F.lit, labels))
    return per.groupBy(*keys).agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("c")).select(*keys, F.get(names, F.col("c")).alias("winner"))


def aggregate_interval(df: DataFrame, keys: Sequence[str], strategy: str = "majority", labels: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """(winner, confidence): mean confidence of the buckets that predict the winner, else the first bucket's."""
    winners = {"majority": lambda: majority(df, keys, order), "confidence_weighted": lambda: confidence_weighted(df, keys, order), "highest_probability": lambda: highest_probability(df, keys, labels)}[strategy]()
    joined = df.join(winners, list(keys))
    mean = F.avg(F.when(F.col("label") == F.col("winner"), F.col("confidence")))
    return joined.groupBy(*keys, "winner").agg(F.round(F.coalesce(mean, F.min_by("confidence", order)), 6).alias("confidence"))
