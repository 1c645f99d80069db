"""Judgements and agreement: label parsing, order swaps, the winner rule, kappa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import hash_unit, pair_sides
from pageloom.schema import CRITERIA, LABELS


def parsed_label(label: Column, raw: Column, criterion: str) -> Column:
    """The label, or the one in the raw answer: an object, an object as text, in a code fence or quoted; null if there is none."""
    found = F.regexp_extract(F.regexp_extract(F.regexp_replace(raw, r'\\+"', '"'), r"(?s)\{.*\}", 0), rf'"{criterion}"\s*:\s*"?(-?[0-9]{{1,3}})\b', 1)
    return F.coalesce(label.cast("int"), F.nullif(found, F.lit("")).cast("int"))


def judgements(rows: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """rows with every criterion parsed; labels as they were given, out of range included. The object in the raw answer is looked for once a row."""
    found = F.regexp_extract(F.regexp_replace("raw", r'\\+"', '"'), r"(?s)\{.*\}", 0)
    label = lambda o, c: F.nullif(F.regexp_extract(o, rf'"{c}"\s*:\s*"?(-?[0-9]{{1,3}})\b', 1), F.lit("")).cast("int")
    read = F.get(F.transform(F.array(found), lambda o: F.struct(*[label(o, c).alias(c) for c in criteria])), F.lit(0))
    d = rows.withColumn("_read", F.when(F.col("raw").isNotNull(), read))
    return d.select(*[c for c in rows.columns if c not in criteria], *[F.coalesce(F.col(c).cast("int"), F.col(f"_read.{c}")).alias(c) for c in criteria])


def long_labels(rows: DataFrame, keys: list[str], criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """(keys, criterion, label) of wide labels, nulls kept."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("int").alias("label")) for c in criteria])).alias("x")).select(*keys, "x.criterion", "x.label")


def sided(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with side_a and side_b, the systems' own names in alphabetical order, and flipped where the pair names them the other way round.

    names: (alias, sys_name) in lower case, a table of fixed size. Rows whose
    pair names an unknown system are dropped.
    """
    s = pair_sides(F.lower("pair"))
    n = F.broadcast(names)
    d = rows.withColumn("_a", s["a"]).withColumn("_b", s["b"])
    d = d.join(n.select(F.col("alias").alias("_a"), F.col("sys_name").alias("_x")), "_a").join(n.select(F.col("alias").alias("_b"), F.col("sys_name").alias("_y")), "_b")
    return d.withColumn("side_a", F.least("_x", "_y")).withColumn("side_b", F.greatest("_x", "_y")).withColumn("flipped", F.col("_x") > F.col("_y")).drop("_a", "_b", "_x", "_y")


def swapped(label: Column, swap: Column) -> Column:
    """A label with 1 and 2 interchanged where the order was swapped."""
    return F.when(swap & label.isin(1, 2), 3 - label).otherwise(label)


def order_coin(seed: int, *key: Column) -> Column:
    """Whether to show two systems in swapped order, by hash."""
    return hash_unit(F.lit(seed), *key) >= 0.5


def winner(faithfulness: Column, fluency: Column, completeness: Column, no_hallucinations: Column, coin: Column) -> Column:
    """The overall winner of four criteria: the side with more of them; on a tie the first decided of fluency, faithfulness, no hallucinations, completeness; the coin if none is."""
    marks = (faithfulness, fluency, completeness, no_hallucinations)
    ones, twos = (sum((F.when(m == k, 1).otherwise(0) for m in marks), F.lit(0)) for k in (1, 2))
    first = F.coalesce(*[F.nullif(m, F.lit(0)) for m in (fluency, faithfulness, no_hallucinations, completeness)])
    return F.when(ones > twos, 1).when(twos > ones, 2).otherwise(F.coalesce(first, F.when(coin, 1).otherwise(2)))


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", weight: str | None = None) -> DataFrame:
    """(by, n, kappa): unweighted kappa of two label columns; null below two pairs, or where chance agreement is whole.

    weight: how many pairs a row stands for. One aggregate over the cells, however many pairs there are.
    """
    count = F.sum(weight) if weight else F.count("*")
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(count.alias("_n"))
    rows = cells.groupBy(*by, F.col("_a").alias("_k")).agg(F.sum("_n").alias("_ra"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_d"))
    cols = cells.groupBy(*by, F.col("_b").alias("_k")).agg(F.sum("_n").alias("_rb"))
    both = rows.join(cols, [*by, "_k"], "full").fillna(0, ["_ra", "_rb", "_d"])
    g = both.groupBy(*by).agg(F.sum("_ra").alias("n"), F.sum("_d").alias("_d"), F.sum(F.col("_ra") * F.col("_rb")).alias("_e"))
    po, pe = F.col("_d") / F.col("n"), F.col("_e") / (F.col("n") * F.col("n"))
    return g.select(*by, "n", F.when((F.col("n") > 1) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))


def kappa_with_overall(pairs: DataFrame, by: str, a: str = "a", b: str = "b", weight: str | None = None) -> DataFrame:
    """kappa per value of `by` and, as 'all', over all of them."""
    return kappa(pairs, [by], a, b, weight).unionByName(kappa(pairs.withColumn(by, F.lit("all")), [by], a, b, weight))


def in_range(label: Column) -> Column:
    return label.isin(*LABELS)
