"""Error statistics: character frequencies, shares, merged counters, the common errors by one-dimensional clustering."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.align import SHAPES

#: Distinct values that are clustered, in the driver; more raise.
CLUSTER_VALUES = 2_000_000


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """(symbol, n): characters of the texts joined by blanks without line ends, and the shapes of two letters at every position.

    Blanks between texts are counted as one less than the texts; no text is put
    together with another.
    """
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\n\r]", "")
    one = lambda symbol, n: F.struct(symbol.alias("symbol"), n.cast("bigint").alias("n"))
    chars = F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c: one(c, F.lit(1)))
    more = F.array(one(F.lit(" "), F.lit(1)), *[one(F.lit(two), overlapping_count(F.col("t"), two)) for two, _ in SHAPES])
    seen = df.select(flat.alias("t")).select(F.explode(F.concat(chars, more)).alias("x")).select("x.*")
    # a blank for every text is one too many, and an empty table has none: one is taken off where there is any
    none = df.sparkSession.createDataFrame([(" ", 0), *[(two, 0) for two, _ in SHAPES]], "symbol string, n bigint")
    n = F.sum("n")
    return seen.unionByName(none).groupBy("symbol").agg(F.when((F.col("symbol") == " ") & (n > 0), n - 1).otherwise(n).alias("n"))


def overlapping_count(text: Column, shape: str) -> Column:
    """Positions where a shape stands, overlapping ones included, in one pass."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(shape)})"))


def shares(counts: DataFrame, within: list[str] | None = None) -> DataFrame:
    """counts with `share`, of the whole or within the given columns; null where the whole is 0.

    The total is an aggregate joined back, so no partition holds all rows.
    """
    keys = within or []
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))
    return joined.withColumn("share", F.col("n") / F.nullif(F.col("_total"), F.lit(0))).drop("_total")


def letter_shares(errors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(kind, gt_char, ocr_char, n, rate): errors of a symbol by its occurrences in the clean text, to three places; errors never seen are dropped."""
    occ = symbols.select(F.col("symbol").alias("gt_char"), F.col("n").alias("_occ"))
    return errors.where("n <> 0").join(occ, "gt_char").withColumn("rate", F.bround(F.col("n") / F.nullif(F.col("_occ"), F.lit(0)), 3)).drop("_occ")


def merged(*counters: DataFrame) -> DataFrame:
    """Sum of counters with columns kind, gt_char, ocr_char and n; what does not stay above 0 is dropped."""
    out = counters[0]
    for c in counters[1:]:
        out = out.unionByName(c)
    return out.groupBy("kind", "gt_char", "ocr_char").agg(F.sum("n").alias("n")).where("n > 0")


def space_totals(errors: DataFrame) -> DataFrame:
    """(kind, n) of blanks added and removed, 0 for a kind that does not occur."""
    kinds = errors.sparkSession.createDataFrame([("space_added",), ("space_removed",)], "kind string")
    sums = errors.where("kind in ('space_added', 'space_removed')").groupBy("kind").agg(F.sum("n").alias("n"))
    return kinds.join(sums, "kind", "left").fillna(0, ["n"])


def cluster_breaks(values: np.ndarray, weights: np.ndarray, k: int) -> list[float]:
    """Smallest values of the clusters of an exact one-dimensional k-means over sorted distinct values.

    Dynamic programming in which the best start of the last cluster never moves back
    as values are added, so that halving the range finds all starts in n log n steps.
    """
    n = len(values)
    if n <= k:
        return values.tolist()
    w, wx, wxx = (np.concatenate([[0], np.cumsum(a)]) for a in (weights, weights * values, weights * values**2))

    def cost(i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        return wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / np.maximum(w[j] - w[i], 1e-300)

    best = np.concatenate([[0.0], cost(np.zeros(n, dtype=int), np.arange(1, n + 1))])
    back = []
    for _ in range(k - 1):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        open_ = [(1, n, 0, n - 1)]  # ends lo..hi whose clusters start at a..b
        while open_:
            lo, hi, a, b = open_.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            new[mid], arg[mid] = total[at], i[at]
            open_ += [(lo, mid - 1, a, arg[mid]), (mid + 1, hi, arg[mid], b)]
        best = new
        back.append(arg)
    starts, j = [], n
    for arg in reversed(back):
        j = arg[j]
        starts.append(j)
    return sorted({float(values[min(s, n - 1)]) for s in [0, *starts]})


def common_errors(errors: DataFrame, value: str, clusters: int, top: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    """errors of the `top` clusters with the largest values, with their cluster's rank (1 = largest).

    kinds: errors of these kinds, each kind with clusters of its own. Only distinct
    values come to the driver, CLUSTER_VALUES of a kind at most.
    """
    valued = errors.where(F.col(value).isNotNull())
    if kinds:
        valued = valued.where(F.col("kind").isin(*kinds))
    kind = F.col("kind") if kinds else F.lit("")
    v = valued.groupBy(kind.alias("kind"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    of: dict[str, list] = {}
    for r in v.limit(CLUSTER_VALUES * max(1, len(kinds)) + 1).collect():
        of.setdefault(r["kind"], []).append((r["v"], float(r["w"])))
    if any(len(rows) > CLUSTER_VALUES for rows in of.values()):
        raise ValueError(f"more than {CLUSTER_VALUES} distinct values; round them")
    if not of:
        return errors.withColumn("cluster", F.lit(None).cast("int")).limit(0)
    rank = None
    for k, rows in of.items():
        values, weights = (np.array(x) for x in zip(*sorted(rows)))
        own = sum((F.when(F.col(value) < b, 1).otherwise(0) for b in cluster_breaks(values, weights, clusters)), F.lit(0)) + 1
        rank = own if rank is None else F.when(kind == k, own).otherwise(rank)
    return valued.withColumn("cluster", rank.cast("int")).where(F.col("cluster") <= top)


def error_distribution(errors: DataFrame, drop: tuple[tuple[str, str], ...] = ((" ", "\n"),), clusters: int = 5, top: int = 3) -> DataFrame:
    """Common errors per kind: shares within the kind, the dropped pairs taken out after that, then the top clusters, largest first."""
    d = shares(errors, ["kind"])
    for a, b in drop:
        d = d.where(~((F.col("gt_char") == a) & (F.col("ocr_char") == b)))
    return common_errors(d, "share", clusters, top, ("sub", "ins", "del")).orderBy("kind", F.col("share").desc(), "gt_char", "ocr_char")


def most_frequent(errors: DataFrame, n: int) -> DataFrame:
    """The n most frequent errors with their rank; ties by symbol."""
    w = Window.orderBy(F.col("n").desc(), "kind", "gt_char", "ocr_char")
    return errors.orderBy(F.col("n").desc(), "kind", "gt_char", "ocr_char").limit(n).withColumn("rank", F.row_number().over(w))
