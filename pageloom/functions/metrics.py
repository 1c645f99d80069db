"""Text metrics: character and word error rates as native expressions, n-gram overlap natively or stemmed.

A metric whose reference is empty or null is null; overlap with an empty side
is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pageloom.functions import text as tx
from pageloom.functions.stem import stem

#: Distinct words that code points beyond the first plane hold; pairs of texts with more go to Python.
_ALPHABET_LIMIT = 0xFFFFF


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over code points of the stripped texts, by the reference's length."""
    r = tx.strip(reference)
    return F.levenshtein(r, tx.strip(hypothesis)) / F.nullif(F.length(r), F.lit(0))


def _let(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of a struct of the values, each of them computed once per row however often f uses it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), f), F.lit(0))


def _encoded_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays: every distinct word of the two becomes one code point of a string."""

    def encode(ws: Column, vocabulary: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0xFFFF), 8, "0")), "UTF-32")), "")

    def distance(s: Column) -> Column:
        d = F.levenshtein(encode(s["a"], s["v"]), encode(s["b"], s["v"]))
        return F.when(F.size(s["v"]) < _ALPHABET_LIMIT, d)

    return _let({"a": a, "b": b, "v": F.array_distinct(F.concat(a, b))}, distance)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays of any vocabulary; a Python stage takes the pairs that code points can't hold."""
    native = _encoded_distance(a, b)
    large = F.size(F.array_distinct(F.concat(a, b))) >= _ALPHABET_LIMIT
    return F.coalesce(native, _word_distance(F.when(large, a), F.when(large, b)))


@F.pandas_udf(IntegerType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b)])


def edit_distance(a: list | str, b: list | str) -> int:
    """Unit-cost edit distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance by the number of reference words; whatever the number of different words."""
    words = {"r": tx.wer_words(reference), "h": tx.wer_words(hypothesis)}
    native = _let(words, lambda s: _encoded_distance(s["r"], s["h"]) / F.nullif(F.size(s["r"]), F.lit(0)))
    r, h = words.values()
    large = F.size(F.array_distinct(F.concat(r, h))) >= _ALPHABET_LIMIT
    # only texts of a million words can have so many different ones: others are not counted a second time
    large = (F.length(reference) + F.length(hypothesis) >= 2 * _ALPHABET_LIMIT) & large
    return F.coalesce(native, _word_distance(F.when(large, r), F.when(large, h)) / F.nullif(F.size(r), F.lit(0)))


def overlap(reference: Column, hypothesis: Column, n: int) -> Column:
    """struct<p, r, f> of clipped n-gram overlap of two token arrays, without stemming.

    The k-th of equal n-grams is numbered k on both sides: then the overlap is that of sets.
    """

    def numbered(grams: Column) -> Column:
        def first(s: Column) -> Column:
            """Of a sorted array, where the run of equal values begins that an element belongs to: the largest such place so far, by doubling steps."""
            at = F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i).otherwise(0))
            steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(s), F.lit(1)))).cast("int"))
            return F.aggregate(steps, at, lambda m, k: F.transform(m, lambda x, i: F.greatest(x, F.coalesce(F.get(m, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))))

        placed = _let({"s": F.array_sort(grams)}, lambda v: F.struct(v["s"].alias("s"), first(v["s"]).alias("f")))
        return _let({"v": placed}, lambda v: F.transform(v["v"]["s"], lambda x, i: F.concat_ws("\u0001", x, (i - F.get(v["v"]["f"], i)).cast("string"))))

    def rates(s: Column) -> Column:
        p, r = F.coalesce(s["h"] / F.nullif(s["m"], F.lit(0)), F.lit(0.0)), F.coalesce(s["h"] / F.nullif(s["n"], F.lit(0)), F.lit(0.0))
        return F.struct(p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))

    grams = _let({"x": reference, "y": hypothesis}, lambda s: F.struct(tx.ngrams(s["x"], n).alias("x"), tx.ngrams(s["y"], n).alias("y")))
    placed = _let({"g": grams}, lambda s: F.struct(numbered(s["g"]["x"]).alias("a"), numbered(s["g"]["y"]).alias("b")))
    counts = _let({"p": placed}, lambda s: F.struct(F.size(F.array_intersect(s["p"]["a"], s["p"]["b"])).alias("h"), F.size(s["p"]["a"]).alias("n"), F.size(s["p"]["b"]).alias("m")))
    return _let({"c": counts}, lambda s: rates(s["c"]))


_TOKEN = re.compile("[^a-z0-9]+")


def stemmed_tokens(text: str | None) -> list[str]:
    """Lower-case tokens; those of more than three characters are stemmed."""
    return [stem(t) if len(t) > 3 else t for t in _TOKEN.sub(" ", (text or "").lower()).split()]


def _prf(hits: int, reference: int, hypothesis: int) -> tuple[float, float, float]:
    p, r = hits / hypothesis if hypothesis else 0.0, hits / reference if reference else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def ngram_overlap(a: list[str], b: list[str], n: int) -> tuple[float, float, float]:
    x, y = (Counter(zip(*(t[k:] for k in range(n)))) for t in (a, b))
    return _prf(sum((x & y).values()), sum(x.values()), sum(y.values()))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit per token of a."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        m = places.get(t, 0)
        u = v & m
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


_FIELDS = [f"{m}_{k}" for m in ("rouge1", "rouge2", "rougeL") for k in "prf"]


@F.pandas_udf(StructType([StructField(f, DoubleType()) for f in _FIELDS]))
def stemmed_overlap(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Precision, recall and F of unigrams, bigrams and the longest common subsequence, stemmed."""
    out = []
    for r, h in zip(reference, hypothesis):
        a, b = stemmed_tokens(r), stemmed_tokens(h)
        out.append((*ngram_overlap(a, b, 1), *ngram_overlap(a, b, 2), *_prf(common_subsequence(a, b), len(a), len(b))))
    return pd.DataFrame(out, columns=_FIELDS)


def preference(first: Column, second: Column) -> Column:
    """1 if the first is larger, 2 if the second is, 0 for equal ones."""
    return F.when(first > second, 1).when(second > first, 2).otherwise(0)


def with_scores(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """df with the seven score columns; the one Python stage is the stemmer's."""
    r, h = F.col(reference), F.col(hypothesis)
    d = df.withColumn("_o", stemmed_overlap(r, h))
    return d.select(
        *df.columns, F.col("_o.rouge1_p").alias("unigram_precision"), F.col("_o.rouge1_r").alias("unigram_recall"), F.col("_o.rouge1_f").alias("unigram_f1"),
        cer(r, h).alias("cer"), wer(r, h).alias("wer"), F.length(tx.strip(r)).alias("length_clean"), F.length(tx.strip(h)).alias("length_ocr"),
    )


#: Metrics by name; "ALL" gives the whole score.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cer": cer, "wer": wer, "length": lambda r, h: F.length(tx.strip(h)), "rouge1": lambda r, h: stemmed_overlap(r, h)["rouge1_f"],
    "rouge2": lambda r, h: stemmed_overlap(r, h)["rouge2_f"], "rougeL": lambda r, h: stemmed_overlap(r, h)["rougeL_f"],
}


def evaluate(df: DataFrame, reference: str, hypothesis: str, metric: str | Callable[[Column, Column], Column] = "ALL") -> DataFrame:
    """df with one metric as column `score`, or with all of them; unknown names raise."""
    if metric == "ALL":
        return with_scores(df, reference, hypothesis)
    if isinstance(metric, str):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; known: ALL, {', '.join(METRICS)}")
        metric = METRICS[metric]
    return df.withColumn("score", metric(F.col(reference), F.col(hypothesis)))
