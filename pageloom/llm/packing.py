"""Problem 7: filling fixed-capacity containers with texts.

Texts are spread over hash partitions of bounded size; each partition is packed
by best-fit decreasing, and a lower bound from dual-feasible functions certifies
its container count. Partitions above their bound put their texts together with
those of other such partitions in new groups and are packed again; the better
packing of that set stays.

A text is split, into pieces of full capacity and a rest, only if it alone
exceeds the capacity. Null, empty and blank texts have size 0 and take no
container (container null). Repeated rows of one id count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pageloom.llm.common import WS, durable

#: Texts in one packing group; bounds the memory of a task at any input size.
GROUP_ROWS = 20_000
PIECES = "id long, piece long, size int, pieces int, grp string, bin int, bins int, bound int"


def word_tokens(text: Column) -> Column:
    """Tokens of a text: longest runs of letters, digits and underscores, or of other characters without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]+")), F.lit(0))


def public_tokens(path: str) -> Column:
    """Counter of tokens of a public tokenizer file (JSON of the tokenizers library): use as public_tokens(path)(column)."""

    @F.pandas_udf(IntegerType())
    def count(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return pd.Series([len(e.ids) for e in t.encode_batch(text.fillna("").tolist(), add_special_tokens=False)])

    return count


def lower_bound(sizes: np.ndarray, capacity: int, ks: int = 30) -> int:
    """Largest container bound over two families of dual-feasible functions.

    The threshold family counts large sizes whole and drops small ones; the
    rounding family rounds (k+1)x/C down to full k-ths.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    below, mass = np.cumsum(n), np.cumsum(n * x)
    eps = np.arange(0, capacity // 2 + 1)
    big = below[-1] - below[capacity - eps]
    middle = mass[capacity - eps] - np.where(eps > 0, mass[np.maximum(eps - 1, 0)], 0)
    best = int(np.max(big + -(-middle // capacity)))
    for k in range(1, ks + 1):
        whole = (x * (k + 1)) % capacity == 0
        weight = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)
        best = max(best, int(-(-int((n * weight).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size; the open containers are kept by free space, in one bit set."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if room > s:
            if not free[room - s]:
                mask |= 1 << (room - s)
            free[room - s].append(b)
    return out


def _packer(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = rows["size"].to_numpy(np.int64)
        rows["bin"] = best_fit_decreasing(sizes, capacity)
        rows["bins"] = int(rows["bin"].max()) + 1
        rows["bound"] = lower_bound(sizes, capacity)
        return rows[["id", "piece", "size", "pieces", "grp", "bin", "bins", "bound"]]

    return pack


def pack_containers(df: DataFrame, key: str, size: Column, capacity: int, group_rows: int = GROUP_ROWS, rounds: int = 2) -> DataFrame:
    """(id, piece, size, pieces, container, bins, bound): the container of each text or piece.

    size: token count as an integer column. Only ids and sizes are shuffled. bins and
    bound: how many containers the text's partition takes, and the fewest that any
    packing of it could take; null without container.
    """
    sized = df.select(F.col(key).cast("long").alias("id"), size.cast("int").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    pieces = durable(
        sized.withColumn("pieces", parts)
        .select("id", "pieces", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces").cast("long"))).alias("piece"))
        .select("id", "piece", F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(F.col("n") - (F.col("pieces") - 1) * capacity).cast("int").alias("size"), "pieces")
    )
    rows = pieces.count()
    groups = max(1, -(-rows // group_rows))
    sizable = pieces.where("size > 0")

    def packed(d: DataFrame, n: int, turn: int) -> DataFrame:
        grp = F.concat_ws("-", F.lit(str(turn)), F.pmod(F.xxhash64("id", "piece", F.lit(turn)), F.lit(n)).cast("string"))
        return durable(d.select("id", "piece", "size", "pieces", grp.alias("grp")).groupBy("grp").applyInPandas(_packer(capacity), PIECES))

    def used(d: DataFrame) -> tuple[int, int]:
        r = d.select("grp", "bins", "bound").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("b"), F.count(F.when(F.col("bins") > F.col("bound"), 1)).alias("gaps")).first()
        return r["b"], r["gaps"]

    done = packed(sizable, groups, 0)
    gaps = used(done)[1]
    for turn in range(1, rounds + 1):
        if gaps < 2:  # a single open partition has no partner
            break
        open_ = done.where("bins > bound")
        again = packed(open_.select("id", "piece", "size", "pieces"), gaps, turn)
        before, (after, left) = used(open_)[0], used(again)
        if after >= before:
            break
        done, gaps = done.where("bins <= bound").unionByName(again), left
    placed = done.select("id", "piece", "size", "pieces", F.concat_ws(":", "grp", F.col("bin").cast("string")).alias("container"), "bins", "bound")
    empty = pieces.where("size = 0").select("*", F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("bins"), F.lit(None).cast("int").alias("bound"))
    return placed.unionByName(empty)


def certificates(packed: DataFrame) -> DataFrame:
    """(part, texts, tokens, bins, bound): per partition of pack_containers() its containers and the bound that certifies them; equal ones are the fewest possible."""
    part = F.substring_index("container", ":", 1)
    return packed.where("container is not null").groupBy(part.alias("part")).agg(F.count("*").alias("texts"), F.sum("size").alias("tokens"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
