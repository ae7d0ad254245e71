"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readq.functions.numeric import round_binary


def describe(df: DataFrame, group: str, value: Column) -> DataFrame:
    """count, mean and the linear percentiles 5, 25, 50, 75, 95 of a value for each group. Percentiles are exact: they are found from
    counts per different value, which are combined before the shuffle."""
    rows = df.select(F.col(group), value.alias("v")).where("v IS NOT NULL").groupBy(group, "v").agg(F.count("*").alias("n"))
    p = F.expr("percentile(v, array(0.05, 0.25, 0.5, 0.75, 0.95), n)")
    got = rows.groupBy(group).agg(F.sum("n").alias("count"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), p.alias("p"))
    return got.select(group, "count", "mean", *[F.col("p")[i].alias(f"p{k}") for i, k in enumerate((5, 25, 50, 75, 95))])


def nearest_rank(df: DataFrame, group: str, value: Column, percents: tuple[int, ...] = (75, 90)) -> DataFrame:
    """min, max and the value at place min(floor(n * p / 100), n - 1) of the sorted values, from counts per different value."""
    rows = df.select(F.col(group), value.alias("v")).where("v IS NOT NULL").groupBy(group, "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy("v")
    placed = rows.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    at = {p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1) for p in percents}
    hit = [F.min(F.when(F.col("upto") > at[p], F.col("v"))).alias(f"p{p}") for p in percents]
    return placed.groupBy(group).agg(F.max("total").alias("count"), F.min("v").alias("min"), *hit, F.max("v").alias("max"))


def top_values(df: DataFrame, value: Column, n: int = 8) -> DataFrame:
    """The n most frequent values, ties in alphabetical order."""
    return df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def group_sizes(df: DataFrame, group: str, member: str) -> DataFrame:
    """(groups, members, singles, largest, mean_size): how many different members each group has."""
    sizes = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct().groupBy(F.md5(group).alias("g")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.count(F.when(F.col("n") == 1, 1)).alias("singles"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))


def stats_block(df: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, count, min, median, mean, p75, p90, max) to one decimal: the middle value, or the mean of the two; p75 and p90 by nearest rank."""
    ranks = nearest_rank(df, group, value)
    rows = df.select(F.col(group), value.alias("v")).where("v IS NOT NULL").groupBy(group, "v").agg(F.count("*").alias("n"))
    middle = rows.groupBy(group).agg(F.expr("percentile(v, 0.5, n)").alias("median"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    shown = [round_binary(F.col(c).cast("double"), 1).alias(c) for c in ("min", "median", "mean", "p75", "p90", "max")]
    return ranks.join(middle.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).select(group, "count", *shown)


def small_numbers(df: DataFrame, group: str, value: Column, share: Column) -> DataFrame:
    """(group, min, max, mean, percent): of a small whole number, and of a share in whole percents, cut off towards 0, the mean."""
    rows = df.select(F.col(group), value.alias("v"), share.alias("s"))
    return rows.groupBy(group).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.avg((F.col("s") * 100).cast("int")).alias("percent"))


def best_epoch(df: DataFrame, epoch: str = "epoch", score: str = "score") -> DataFrame:
    """(epoch, score): the epoch of the best score, the first of equal ones; no row if no epoch has a score."""
    best = F.max_by(F.struct(epoch, score), F.struct(score, -F.col(epoch))).alias("b")
    return df.where(F.col(score).isNotNull() & ~F.isnan(score)).agg(best).where("b IS NOT NULL").select("b.*")
