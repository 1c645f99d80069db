"""Reports: metric aggregates, label distributions, wins, nulls, lengths, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.durable import durable
from pageloom.schema import CRITERIA, LABELS, METRICS


def ranked_values(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before, total): distinct values with how often they stand, the values below them and the group's size.

    Values are parted by ranges, so that a group of any size spreads over tasks;
    the parts, of which there are few, are summed and their offsets added.
    """
    counts = long.groupBy(*by, value).agg(F.count("*").alias("n"))
    d = durable(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = d.groupBy("_part", *by).agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*by)
    offsets = sums.select("_part", *by, F.sum("_n").over(group).alias("total"), (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.sum("n").over(Window.partitionBy("_part", *by).orderBy(value)) - F.col("n")
    placed = d.withColumn("_within", within).join(offsets, ["_part", *by])
    return placed.select(*by, value, "n", (F.col("_before") + F.col("_within")).alias("before"), "total")


def quantile(p: float, value: str) -> Column:
    """Aggregate over ranked_values(): the exact quantile, between two values in proportion."""
    at = F.lit(p) * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    stands = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
    share = F.max(at - low)
    return stands(low) + (stands(high) - stands(low)) * share


def metric_summary(scores: DataFrame, by: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(by, metric, mean, median, std): exact median, population deviation; nulls are left out."""
    long = scores.unpivot([by], list(metrics), "metric", "value").where("value is not null")
    middle = ranked_values(long, [by, "metric"], "value").groupBy(by, "metric").agg(quantile(0.5, "value").alias("median"))
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).join(middle, [by, "metric"]).select(by, "metric", "mean", "median", "std")


def box_summary(scores: DataFrame, by: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(by, metric, n, low, q1, median, q3, high): what a box plot shows."""
    long = scores.unpivot([by], list(metrics), "metric", "value").where("value is not null")
    q = [quantile(p, "value").alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return ranked_values(long, [by, "metric"], "value").groupBy(by, "metric").agg(F.sum("n").alias("n"), F.min("value").alias("low"), *q, F.max("value").alias("high"))


def histogram(scores: DataFrame, by: str, metric: str, width: float) -> DataFrame:
    """(by, bin, n): counts in bins of equal width, what a density plot is drawn from."""
    return scores.where(F.col(metric).isNotNull()).groupBy(by, F.floor(F.col(metric) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def log_clamped(value: Column, least: float = 1e-5) -> Column:
    """A value for a logarithmic axis."""
    return F.greatest(value, F.lit(least))


def label_distribution(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, criterion, label_0, label_1, label_2): counts, zero where a label does not occur; other labels and nulls are left out."""
    counts = [F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"label_{k}") for k in LABELS]
    return long.where(F.col("label").isin(*LABELS)).groupBy(*by, "criterion").agg(*counts)


def win_tally(distribution: DataFrame, a: str, b: str) -> DataFrame:
    """(system, criterion, wins, contests): a side wins a criterion of a pair by more labels; a tie is nobody's."""
    d = distribution
    one = d.select(F.col(a).alias("system"), "criterion", (F.col("label_1") > F.col("label_2")).cast("int").alias("win"))
    two = d.select(F.col(b).alias("system"), "criterion", (F.col("label_2") > F.col("label_1")).cast("int").alias("win"))
    return one.unionByName(two).groupBy("system", "criterion").agg(F.sum("win").alias("wins"), F.count("*").alias("contests"))


def win_rates(tally: DataFrame) -> DataFrame:
    return tally.withColumn("rate", F.col("wins") / F.nullif(F.col("contests"), F.lit(0)))


def null_report(rows: DataFrame, by: list[str], column: Column) -> DataFrame:
    """(by, nulls) where there is any null."""
    return rows.groupBy(*by).agg(F.sum(column.isNull().cast("int")).alias("nulls")).where("nulls > 0")


def length_listing(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return df.select(*key, F.length(text).alias("length")).orderBy("length", *key)


def last_wins(long: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One label per key and criterion: that of the last file; nulls do not overwrite."""
    return long.where("label is not null").groupBy(*keys, "criterion").agg(F.max_by("label", order).alias("label"))


def label_matrix(long: DataFrame, keys: list[str], criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Wide labels again, one column per criterion."""
    return long.groupBy(*keys).pivot("criterion", list(criteria)).agg(F.max("label"))


def first_seen_mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, value, n): the commonest value, of equally common ones the first seen."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = c.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_b"))
    return best.select(*by, f"_b.{value}", "_b.n")


def running_offset(df: DataFrame, key: list[str], order: str, length: Column) -> DataFrame:
    """df with `offset`: the lengths of the rows before, within the key."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))
