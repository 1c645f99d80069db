"""Problem 3: cutting oversized texts at natural boundaries.

One regular expression per text: its alternatives, ordered by the strength of
the boundary they end on (paragraph, sentence, clause, white space), each
consume up to the limit; a run of characters is the last resort. Pieces after
the first look back by the overlap, so every piece keeps to the limit.

Null texts give no piece; texts within the limit, the empty text included, give
one piece. Offsets count code points from 0 in the text as stored; end is
exclusive. White space at both ends belongs to no piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import running_sums
from pageloom.llm.common import WS, settled, stripped


def cut_pattern(limit: int, least: int) -> str:
    """Alternatives by boundary strength; each but the last leaves at least `least` characters in the piece."""
    dot = r"[\x{0}-\x{10FFFF}]"
    return "|".join(
        (
            rf"{dot}{{1,{limit}}}\z",
            rf"{dot}{{{least},{limit - 1}}}\n(?=[{WS}]*\n)",
            rf"{dot}{{{least},{limit - 6}}}[.!?][”’\"')\]]{{0,3}}[{WS}]",
            rf"{dot}{{{least},{limit - 3}}}[,;:—][{WS}]?",
            rf"{dot}{{1,{limit - 1}}}[{WS}]",
            rf"{dot}{{1,{limit}}}",
        )
    )


def longest_run_exceeds(text: Column, limit: int) -> Column:
    """Whether more than `limit` consecutive characters stand without white space."""
    return text.rlike(rf"[^{WS}]{{{limit + 1}}}")


def split_texts(df: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """The columns of df and piece_no, piece, piece_start, piece_end, cut_kind (whole, natural or forced).

    Columns of df with one of these names are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    step = limit - overlap
    d = df.drop("piece_no", "piece", "piece_start", "piece_end", "cut_kind").where(F.col(text).isNotNull())
    body = stripped(F.col(text))
    lead = F.length(F.regexp_extract(F.col(text), rf"^[{WS}]*", 0))
    d = settled(d, _b=body, _lead=F.when(F.length(body) == 0, 0).otherwise(lead))
    long_ = F.length("_b") > limit
    # the first piece looks back on nothing: it may take the whole limit
    pattern = rf"\A(?:{cut_pattern(limit, limit // 2)})|{cut_pattern(step, step // 2)}"
    segments = F.when(long_, F.regexp_extract_all("_b", F.lit(pattern), F.lit(0))).otherwise(F.array("_b"))
    d = settled(settled(d, _s=segments), _ends=F.concat(F.array(F.lit(0)), running_sums(F.transform("_s", F.length))))
    at = F.transform(
        "_s",
        lambda s, i: F.struct(
            i.alias("no"),
            F.greatest(F.get("_ends", i) - F.when(i > 0, overlap).otherwise(0), F.lit(0)).alias("a"),
            F.get("_ends", i + 1).alias("z"),
        ),
    )
    kind = F.when(~long_, "whole").when(longest_run_exceeds(F.col("_b"), limit), "forced").otherwise("natural")
    return d.withColumn("cut_kind", kind).withColumn("_p", F.explode(at)).select(
        *[c for c in d.columns if not c.startswith("_") or c in df.columns],
        F.col("_p.no").alias("piece_no"),
        F.substring("_b", F.col("_p.a") + 1, F.col("_p.z") - F.col("_p.a")).alias("piece"),
        (F.col("_p.a") + F.col("_lead")).alias("piece_start"),
        (F.col("_p.z") + F.col("_lead")).alias("piece_end"),
        "cut_kind",
    )
