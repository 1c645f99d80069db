"""Problem 2: one ranking from pairwise votes.

Votes between two items give a log-odds margin with its inverse variance as
weight; the strengths are the weighted least-squares solution on the comparison
graph, that is of the system of its Laplacian, by conjugate gradient. What the
strengths leave of the margins is cyclic inconsistency.

Votes with a null item or label, labels outside 0..2 and votes of an item
against itself are not usable. Items without a usable vote have no strength and
rank last. Items of parts of the graph that never met are each centred on 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import durable
from pageloom.operators.agreement import in_range, judgements, sided, swapped
from pageloom.operators.datasets import numbered
from pageloom.plans.queries import system_aliases
from pageloom.schema import CRITERIA

#: Distinct meeting pairs up to which the system is solved in the driver's memory; beyond it, by distributed steps.
DRIVER_EDGES = 200_000


def usable_votes(votes: DataFrame, systems: DataFrame, label: str) -> DataFrame:
    """(a, b, page_id, label): one row per vote, a < b and label 1 = a is better; repeats of a row count once, in whatever spelling of the pair.

    A digest of the row's labels and raw answer tells votes apart, so that no answer is shuffled.
    """
    told = F.xxhash64("raw", *[F.col(c).cast("int") for c in CRITERIA]).alias("told")
    v = sided(votes.select("pair", "page_id", "judged_at", "raw", told, label), system_aliases(systems)).where("side_a <> side_b")
    v = judgements(v, (label,)).select("side_a", "side_b", "flipped", "page_id", "judged_at", "told", label).distinct().where(in_range(F.col(label)))
    return v.select(F.col("side_a").alias("a"), F.col("side_b").alias("b"), "page_id", swapped(F.col(label), F.col("flipped")).alias("label"))


def margins(votes: DataFrame, prior: float = 0.5) -> DataFrame:
    """(a, b, n, margin, weight): smoothed log-odds that a beats b, a tie being half a win for each, and its inverse variance."""
    wins_a = F.sum(F.when(F.col("label") == 1, 1.0).when(F.col("label") == 0, 0.5).otherwise(0.0)) + prior
    wins_b = F.sum(F.when(F.col("label") == 2, 1.0).when(F.col("label") == 0, 0.5).otherwise(0.0)) + prior
    return votes.groupBy("a", "b").agg(F.count("*").alias("n"), wins_a.alias("wa"), wins_b.alias("wb")).select(
        "a", "b", "n", F.log(F.col("wa") / F.col("wb")).alias("margin"), (F.col("wa") * F.col("wb") / (F.col("wa") + F.col("wb"))).alias("weight")
    )


def laplacian_cg(a: np.ndarray, b: np.ndarray, margin: np.ndarray, weight: np.ndarray, n: int, tol: float = 1e-20) -> np.ndarray:
    """Strengths by conjugate gradient on the weighted Laplacian of the edges (a, b)."""

    def apply(x: np.ndarray) -> np.ndarray:
        flow = weight * (x[a] - x[b])
        return np.bincount(a, flow, n) - np.bincount(b, flow, n)

    r = np.bincount(a, weight * margin, n) - np.bincount(b, weight * margin, n)
    x, p, rr = np.zeros(n), r.copy(), float(r @ r)
    stop = tol * max(rr, 1e-300)
    for _ in range(steps_for(n)):
        if rr <= stop:
            return x
        q = apply(p)
        step = rr / float(p @ q)
        x, r = x + step * p, r - step * q
        rr, old = float(r @ r), rr
        p = r + rr / old * p
    raise RuntimeError(f"the residual is still {rr} after {steps_for(n)} steps")


def steps_for(items: int) -> int:
    """Steps after which the iteration counts as failed: as many as there are items suffice but for rounding."""
    return 10 * items + 10


def distributed_cg(edges: DataFrame, tol: float = 1e-20) -> DataFrame:
    """(item, strength) by the same iteration, to the same tolerance, with the vectors as tables; for graphs beyond the driver's bound.

    A step joins the arcs with the vector, whose hot items adaptive execution
    splits, and sums them per item map-side first; it leaves one table in the
    checkpoint folder.
    """
    arcs = durable(
        edges.select(F.col("a").alias("item"), F.col("b").alias("other"), "weight", "margin").unionByName(
            edges.select(F.col("b").alias("item"), F.col("a").alias("other"), "weight", (-F.col("margin")).alias("margin"))
        )
    )
    state = arcs.groupBy("item").agg(F.sum("weight").alias("deg"), F.sum(F.col("weight") * F.col("margin")).alias("r"))
    state = durable(state.withColumn("x", F.lit(0.0)).withColumn("p", F.col("r")))
    first = state.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("n")).first()
    rr, n = first["rr"] or 0.0, first["n"]
    stop = tol * max(rr, 1e-300)
    for _ in range(steps_for(n)):
        if rr <= stop:
            return state.select("item", F.col("x").alias("strength"))
        flows = arcs.join(state.select(F.col("item").alias("other"), F.col("p").alias("po")), "other").groupBy("item").agg(F.sum(F.col("weight") * F.col("po")).alias("wp"))
        q = durable(state.join(flows, "item").withColumn("q", F.col("deg") * F.col("p") - F.col("wp")).drop("wp"))
        step = rr / q.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = q.select("item", "deg", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        now = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state, rr = moved.withColumn("p", F.col("r") + (now / rr) * F.col("p")), now
    raise RuntimeError(f"the residual is still {rr} after {steps_for(n)} steps")


def strengths(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(item, strength); edges as margins() gives them."""
    edges = durable(edges)
    spark = edges.sparkSession
    if edges.limit(driver_edges + 1).count() > driver_edges:
        return distributed_cg(edges)
    rows = edges.orderBy("a", "b").collect()
    items = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {s: k for k, s in enumerate(items)}
    a, b = (np.array([at[r[c]] for r in rows], dtype=np.int64) for c in "ab")
    x = laplacian_cg(a, b, *(np.array([r[c] for r in rows], dtype=float) for c in ("margin", "weight")), len(items)) if rows else []
    return spark.createDataFrame([(s, float(v)) for s, v in zip(items, x)], "item string, strength double")


def residuals(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """(a, b, n, margin, fitted, residual, share): what the ranking leaves of each margin, and its share of all weighted squares left."""
    x, y = ranked.select(F.col("item").alias("a"), F.col("strength").alias("sa")), ranked.select(F.col("item").alias("b"), F.col("strength").alias("sb"))
    e = edges.join(x, "a").join(y, "b").withColumn("fitted", F.col("sa") - F.col("sb")).withColumn("residual", F.col("margin") - F.col("fitted"))
    square = F.col("weight") * F.col("residual") * F.col("residual")
    total = e.agg(F.sum(square).alias("total"))
    return e.crossJoin(F.broadcast(total)).select("a", "b", "n", "margin", "fitted", "residual", F.when(F.col("total") > 0, square / F.col("total")).otherwise(0.0).alias("share"))


def bands(items: DataFrame, ranked: DataFrame, name: str, n: int) -> DataFrame:
    """(name, strength, band): every item of the table, cut into n bands of equal size, the first ones larger by one where they can't be; ties fall by name."""
    all_ = items.select(name).distinct().join(ranked.withColumnRenamed("item", name), name, "left")
    placed = numbered(all_.withColumn("_order", -F.coalesce("strength", F.lit(float("-inf")))), ["_order", name])
    size = F.broadcast(all_.agg(F.count("*").alias("_all")))  # one row
    q, r, at = F.floor(F.col("_all") / n), F.col("_all") % n, F.col("new_id")
    band = F.when(at < (q + 1) * r, F.floor(at / (q + 1))).otherwise(r + F.floor((at - (q + 1) * r) / F.greatest(q, F.lit(1)))) + 1
    return placed.crossJoin(size).select(name, "strength", band.cast("int").alias("band"))
