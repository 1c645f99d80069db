"""Problem 6: texts cut off by field limits or in transfer.

Per source and column, the histogram of the lengths of texts that end no
sentence, in characters and in bytes, is tested for spikes: a length that far
more of them have than the lengths around it is a field limit. Texts at a limit
without terminal punctuation are cut, unless the reference text stops there as
well. Cuts in transfer have no common length and make no spike; for them two
records of the full length count where they are given: a recorded length larger
than the stored text's, and a reference text that goes on where the text stops.

Null and blank texts are not cut. A text that stops just where its reference
stops, or that ends past it, is not cut. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import settled, stripped

#: End of a finished sentence: a mark, then closing quotation marks or brackets.
TERMINAL = r"(?:[.!?…]|&c\.)[”’»\"')\]]*$"
#: A last line that holds a page number only.
PAGE_END = r"\s*\n[^\p{L}\d\n]*(?:p\.\s*)?(?:\d+|[ivxlc]+)[^\p{L}\d\n]*$"


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


#: Characters at a text's end whose letters are compared before whole texts are.
_TAIL = 60


def body(reference: Column) -> Column:
    """A reference text without a page number at its end; reference without white space at the ends."""
    last = F.substring_index(reference, "\n", -1)
    number = (F.length(last) < F.length(reference)) & F.concat(F.lit("\n"), last).rlike(PAGE_END)
    return F.when(number, stripped(F.left(reference, F.length(reference) - F.length(last) - 1))).otherwise(reference)


def finished(text: Column) -> Column:
    """Whether a text ends a sentence."""
    return F.right(text, F.lit(12)).rlike(TERMINAL)


def same_end(text: Column, reference: Column, letters_: int = 24) -> Column:
    """Whether both texts end in the same letters."""
    a, b = (F.right(letters(F.right(x, F.lit(_TAIL))), F.lit(letters_)) for x in (text, reference))
    return (F.length(a) == letters_) & (a == b)


def misread_end(reversed_text: Column, reversed_reference: Column, done: Column, width: int = 24, end: int = 12) -> Column:
    """Whether a text goes on to the reference's end with other letters for some of the last `end`.

    The `width` letters before those stand in the text. What follows them there is
    compared: a beginning of the reference's last letters is a text that stops
    among them, and so is one whose own last letters stand there before the end.
    Else it is the end misread if few letters differ, or if the text is done, that
    is ends a sentence in its own words.
    """
    at = F.call_function("locate", F.substring(reversed_reference, end + 1, width), reversed_text)
    want = F.substring(reversed_reference, 1, end)
    rest = F.substring(reversed_text, F.greatest(at - end, F.lit(1)), F.least(at - 1, F.lit(end)))
    missing = end - (at - 1)
    last = F.substring(reversed_text, 1, 3)
    stands = [(missing + k > 0) & (F.substring(want, missing + k + 1, F.lit(3)) == last) for k in (-2, -1, 0, 1, 2)]
    stops = (missing > 0) & (F.substring(want, missing + 1, F.length(rest)) == rest)
    for x in stands:
        stops = stops | ((at > 3) & x & (last != F.substring(want, 1, 3)))
    alike = (F.abs(missing) <= 2) & (F.levenshtein(rest, want, 4) >= 0)
    return (F.length(reversed_reference) >= width + end) & (at > 0) & ~stops & (alike | (missing <= 0) | done)


def remainder(reversed_text: Column, reversed_reference: Column, done: Column, width: int = 24, step: int = 9, steps: int = 5) -> Column:
    """Letters of the reference after the place where the text stops; null if that place can't be found, 0 if the text holds the reference's end.

    Both hold letters only, in reverse; done: whether the text ends a sentence.
    Only the reference's own last letters, or misread ones in their place, are its
    end. The place is where the last `width` letters stand in the reference; windows
    further back, and half as wide, stand in where the last words differ, and then
    windows at doubling distances over the whole text.
    """

    def after(w: int, back: Column) -> Column:
        part = F.substring(reversed_text, back + 1, F.lit(w))
        found = F.call_function("locate", part, reversed_reference)
        return F.when((F.length(part) == w) & (found > 0), F.greatest(found - 1 - back, F.lit(0)))

    tail = F.substring(reversed_reference, 1, width)
    reached = (F.length(tail) == width) & (F.call_function("locate", tail, reversed_text) > 0)
    doublings = F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(F.length(reversed_text), F.lit(1)) / (step * steps))), F.lit(0)).cast("int"))
    far = F.aggregate(doublings, F.lit(None).cast("int"), lambda acc, k: F.coalesce(acc, after(width, F.lit(step * steps) * F.pow(F.lit(2), k).cast("int"))))
    near = [after(w, F.lit(k * step)) for w in (width, width // 2) for k in range(steps)]
    return F.when(reached | misread_end(reversed_text, reversed_reference, done, width), 0).otherwise(F.coalesce(*near, far))


def spikes(lengths: DataFrame, by: list[str], around: int = 20, ratio: float = 5.0, least: int = 8) -> DataFrame:
    """(by, unit, length, n): lengths at least `least` texts have, and `ratio` times as many as is usual within `around`.

    lengths: (by, unit, length). One aggregate, and windows over the distinct
    lengths of one source only.
    """
    from pyspark.sql import Window

    h = lengths.groupBy(*by, "unit", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy(*by, "unit").orderBy("length").rangeBetween(-around, around)
    h = h.withColumn("other", F.sum("n").over(near) - F.col("n"))
    return h.where((F.col("n") >= least) & (F.col("n") > ratio * F.greatest(F.col("other") / F.lit(2.0 * around), F.lit(1.0)))).select(*by, "unit", "length", "n")


def length_limits(measured: DataFrame, by: list[str], **spike) -> DataFrame:
    """(by, unit, length, n): the field limits of each source (and column), from the texts that end no sentence."""
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])
    return spikes(measured.where("unfinished").select(*by, F.explode(units).alias("x")).select(*by, "x.unit", "x.length"), by, **spike)


def letters_left(text: Column, reference: Column) -> Column:
    """remainder() of two texts as body() gives them; equal ends are told without looking at the whole."""
    # in a lambda, the letters of both are taken once
    pair = F.array(F.struct(F.reverse(letters(text)).alias("t"), F.reverse(letters(reference)).alias("r"), finished(text).alias("done")))
    return F.when(same_end(text, reference), 0).otherwise(F.get(F.transform(pair, lambda x: remainder(x["t"], x["r"], x["done"])), F.lit(0)))


def measure(df: DataFrame, text: str, reference: str | None = None) -> DataFrame:
    """df with chars, bytes, own (length without white space at the ends), unfinished, goes_on (letters of the reference left) and stops_too (the reference ends no sentence).

    Columns of these names are replaced. Nothing after this needs the texts.
    """
    t = stripped(F.col(text))
    d = settled(df, _t=body(t), _r=body(stripped(F.col(reference))) if reference else F.lit(None).cast("string"), chars=F.length(text), bytes=F.octet_length(text), own=F.coalesce(F.length(t), F.lit(0)))
    left = F.when(F.col("own") > 0, letters_left(F.col("_t"), F.col("_r")))
    return settled(d, unfinished=(F.col("own") > 0) & ~finished(F.col("_t")), stops_too=F.coalesce(~finished(F.col("_r")), F.lit(False)), goes_on=left).drop("_t", "_r")


def detect_cuts(measured: DataFrame, by: list[str], recorded: str | None = None, **spike) -> DataFrame:
    """measured with evidence (limit, recorded or reference, the first that shows a cut, or null) and cut.

    measured: as measure() gives it, a repeated text in one row; by: the source,
    and the column where texts of several are measured. Each limit holds for its
    source only; the table of limits has one row per source. The reference stands
    against a limit or a recorded length where the text reaches its end.
    """
    d = measured.drop("evidence", "cut")
    limits = length_limits(d, by, **spike)
    per = limits.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"_{u}") for u in ("chars", "bytes")])
    d = d.join(per, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    at_limit = F.coalesce(F.array_contains("_chars", F.col("chars")) | F.array_contains("_bytes", F.col("bytes")), F.lit(False)) & F.col("unfinished")
    more = F.coalesce(F.col(recorded) - F.col("own") >= 3, F.lit(False)) & (F.col("own") > 0) if recorded else F.lit(False)
    left = F.coalesce("goes_on", F.lit(1)) > 0
    by_reference = F.coalesce((F.col("goes_on") >= 3) | ((F.col("goes_on") >= 1) & F.col("unfinished") & ~F.col("stops_too")), F.lit(False))
    d = d.withColumn("evidence", F.when(at_limit & left, "limit").when(more & left, "recorded").when(by_reference, "reference"))
    return d.withColumn("cut", F.col("evidence").isNotNull()).drop("_chars", "_bytes", *[f"_{c}" for c in by])


def cut_rates(detected: DataFrame, source: str) -> DataFrame:
    """Per source: texts, cut texts and their share."""
    return detected.groupBy(source).agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("int")).alias("cut_texts")).withColumn("share", F.col("cut_texts") / F.col("texts"))
