"""Page datasets: strict joins, merging with renumbering, splits, training records."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.durable import durable
from pageloom.functions.text import hash_unit

INSTRUCTION = "Clean the following OCR text:"  # fixed value: the training records' instruction


def subset(df: DataFrame, key: str, keys: list[int] | DataFrame) -> DataFrame:
    """Rows whose key is in the list, or in the table's first column."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")
    return df.where(F.col(key).isin(keys))


def hash_sample(df: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    """A Bernoulli sample by the hash of the key: the same rows on every run and engine."""
    return df.where(hash_unit(F.lit(seed), key) < fraction)


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left key must have its partner; a missing one fails the job when the row is read."""
    marked = right.withColumn("_there", F.lit(True))
    joined = left.join(marked, key, "left")
    return joined.where(F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("no partner for key "), F.col(key).cast("string"))).cast("boolean"))).drop("_there")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has; an empty result is a one-to-one merge."""
    a, b = (d.select(key).distinct().withColumn(m, F.lit(True)) for d, m in ((left, "_l"), (right, "_r")))
    return a.join(b, key, "full").where("_l is null or _r is null").select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def shared_keys(*tables: DataFrame, key: str) -> DataFrame:
    """Keys that all tables have."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key).distinct(), key, "left_semi")
    return out


def with_defaults(keys: DataFrame, sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, one column per source): the source's value, empty where it has none."""
    out = keys
    for name, d in sources.items():
        out = out.join(d.select(key, F.col(value).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `new_id` from 0 in the given order; rows equal in it stand in any order.

    Rows are parted by ranges of the whole order and numbered within their part;
    the parts, of which there are few, are counted and their offsets added.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_i", place)
    d = durable(d)  # sampled ranges may differ from run to run
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(offsets), "_part").withColumn("new_id", F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def merge_datasets(parts: list[DataFrame], key: str) -> DataFrame:
    """All parts, one after the other, with new ids from 0."""
    out = None
    for n, d in enumerate(parts):
        d = d.withColumn("part_no", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return numbered(out, ["part_no", key])


def merge_paired_datasets(clean: list[DataFrame], noisy: list[DataFrame], key: str, clean_text: str = "text", noisy_text: str = "text") -> DataFrame:
    """(part_no, key, new_id, clean, noisy) of datasets given twice: both texts of a page get the same new id.

    A page that only one side has, or has twice, fails the job.
    """
    if len(clean) != len(noisy):
        raise ValueError("as many clean as noisy datasets are needed")
    parts = []
    for c, n in zip(clean, noisy):
        both = c.select(key, F.lit(1).alias("c"), F.lit(0).alias("n"), F.col(clean_text).alias("clean"), F.lit(None).cast("string").alias("noisy"))
        both = both.unionByName(n.select(key, F.lit(0).alias("c"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("clean"), F.col(noisy_text).alias("noisy")))
        g = both.groupBy(key).agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max("clean").alias("clean"), F.max("noisy").alias("noisy"))
        one = F.when((F.col("c") == 1) & (F.col("n") == 1), True).otherwise(F.raise_error(F.concat(F.lit("not one clean and one noisy page: "), F.col(key).cast("string"))).cast("boolean"))
        parts.append(g.where(one).select(key, "clean", "noisy"))
    return merge_datasets(parts, key)


def hash_split(df: DataFrame, key: str, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `split`, train or test, of exact sizes: the first n(1 - ratio) of the n keys by hash are for training.

    The place of the cut is found from counts by the hash's first four digits, then
    by the next four within them, and by rank among the few keys left; no other
    row is ranked. All rows of a key are on one side.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    keys = df.select(F.col(key).alias("_key"), h.alias("_h")).distinct()

    def reached(counted: DataFrame, at: str, before: Column) -> DataFrame:
        """(at, _before, _cut): the value of `at` in whose rows the cut falls, and the rows before it."""
        upto = F.sum("_n").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
        c = counted.withColumn("_before", before + upto - F.col("_n"))
        return c.where((F.col("_before") < F.col("_cut")) & (F.col("_cut") <= F.col("_before") + F.col("_n"))).select(at, "_before", "_cut")

    cut = keys.agg(F.floor(F.count("*") * F.lit(1 - test_ratio) + F.lit(1e-9)).alias("_cut"))
    one = keys.groupBy(F.substring("_h", 1, 4).alias("_a")).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(cut))  # at most 65,536 rows
    one = reached(one, "_a", F.lit(0))
    within = keys.withColumn("_a", F.substring("_h", 1, 4)).join(F.broadcast(one.withColumnRenamed("_before", "_past")), "_a")
    two = within.groupBy("_a", "_past", "_cut", F.substring("_h", 5, 4).alias("_b")).agg(F.count("*").alias("_n"))
    two = reached(two, "_b", F.col("_past"))
    last = within.drop("_past", "_cut").withColumn("_b", F.substring("_h", 5, 4)).join(F.broadcast(two), "_b")
    last = last.withColumn("_rank", F.col("_before") + F.row_number().over(Window.orderBy("_h", "_key"))).where("_rank = _cut")
    edge = last.agg(F.max(F.struct("_h", "_key")).alias("_edge"))  # one row, null where nothing is for training
    d = df.crossJoin(F.broadcast(edge))
    train = F.coalesce(F.struct(h.alias("_h"), F.col(key).alias("_key")) <= F.col("_edge"), F.lit(False))
    return d.withColumn("split", F.when(train, "train").otherwise("test")).drop("_edge")


def shuffled_split(keys: list, test_ratio: float = 0.2, seed: int = 42) -> tuple[list, list]:
    """(train, test) of a list by the seeded shuffle of Python's generator; for small key lists whose published split must come out again."""
    order = list(keys)
    random.Random(seed).shuffle(order)
    n = int(len(order) * (1 - test_ratio))
    return order[:n], order[n:]


def sft_records(df: DataFrame, noisy: str, clean: str) -> DataFrame:
    """(instruction, input, output) of page pairs that have both sides."""
    both = df.where(F.col(noisy).isNotNull() & F.col(clean).isNotNull())
    return both.select(F.lit(INSTRUCTION).alias("instruction"), F.col(noisy).alias("input"), F.col(clean).alias("output"))


def positional_pairs(a: Column, b: Column) -> Column:
    """array<struct<a, b>> of two arrays, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.transform(F.slice(a, 1, n), lambda x, i: F.struct(x.alias("a"), F.get(b, i).alias("b")))


def latest_by_suffix(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, name): the name with the largest numeric suffix; names without one count as 0, ties by name."""
    n = F.coalesce(F.nullif(F.regexp_extract(name, r"([0-9]+)$", 1), F.lit("")).cast("bigint"), F.lit(0))
    return df.groupBy(*by).agg(F.max(F.struct(n.alias("n"), F.col(name).alias("name"))).alias("b")).select(*by, F.col("b.name").alias(name))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)
