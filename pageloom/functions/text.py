"""Column functions on texts: stripping, tokenising, sentence chunks, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Text without Unicode white space at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """Words between runs of Unicode white space, without empty ones."""
    return F.filter(F.split(text, rf"{_SPACE}+"), lambda w: w != "")


def wer_words(text: Column) -> Column:
    """Words as word error rates count them: two or more white space characters are one blank, and only blanks part words."""
    return F.filter(F.split(F.regexp_replace(strip(text), rf"{_SPACE}{_SPACE}+", " "), " "), lambda w: w != "")


def overlap_tokens(text: Column) -> Column:
    """Tokens for n-gram overlap: lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams of a token array, joined by blanks."""
    if n == 1:
        return tokens
    last = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def running_sums(values: Column) -> Column:
    """Sums up to and with each element of an integer array, by doubling steps: n log n additions."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(steps, values, step)


def sentence_chunks(text: Column) -> Column:
    """array<struct<text, start, end>>: parts at '. ', the full stop kept; offsets run over the parts without the blanks between."""
    parts = F.split(text, r"\. ", -1)
    n = F.size(parts)
    dotted = F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, F.lit("."))).otherwise(p))
    both = F.array(F.struct(dotted.alias("d"), running_sums(F.transform(dotted, F.length)).alias("e")))
    return F.get(F.transform(both, lambda s: F.transform(s["d"], lambda p, i: F.struct(p.alias("text"), (F.get(s["e"], i) - F.length(p)).alias("start"), F.get(s["e"], i).alias("end")))), F.lit(0))


def merge_chunks(chunks: Column) -> Column:
    """Chunks put together by start, in stable order, with blanks between; chunks: array<struct<ord, text, start, end>>."""
    by_start = F.array_sort(F.transform(chunks, lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["text"].alias("text"))))
    return F.array_join(F.transform(by_start, lambda c: c["text"]), " ")


def path_name(model: Column) -> Column:
    """A model name as it stands in file names."""
    return F.regexp_replace(model, "/", "-")


def file_stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pair_sides(pair: Column) -> Column:
    """struct<a, b> of a pair's name in any spelling of its separator; b null without one."""
    clean = F.regexp_replace(F.trim(pair), r"(?i)\.json$", "")
    parts = F.split(clean, "(?i)_(?:against|vs)_", 2)
    return F.struct(F.trim(parts[0]).alias("a"), F.trim(F.get(parts, F.lit(1))).alias("b"))


# Endings and separators of file names, and the marker before a model's answer.
def scores_file(path: Column) -> Column:
    return F.concat(file_stem(path), F.lit("_classic_scores.json"))


def denoised_file(path: Column, model: Column) -> Column:
    return F.concat(file_stem(path), F.lit("_denoised_"), path_name(model), F.lit(".json"))


def judgement_file(a: Column, b: Column) -> Column:
    return F.concat(file_stem(a), F.lit("_Against_"), file_stem(b), F.lit(".json"))


def preference_file(pair: Column) -> Column:
    return F.concat(file_stem(pair), F.lit("_rouge_comparison.json"))


def after_marker(output: Column, marker: str = "\n\nDenoised text:") -> Column:
    """Stripped text after the last marker, the whole where there is none."""
    return strip(F.element_at(F.split(strip(output), F.lit(marker.replace(".", r"\."))), -1))


def alias(name: Column, names: dict[str, str]) -> Column:
    """Short name of a model; itself where it has none."""
    if not names:
        return name
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), name), name)


def known_model(name: Column, models: dict[str, str]) -> Column:
    """Identifier of a model family; unknown names raise."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in models.items() for x in kv]), name), F.raise_error(F.concat(F.lit("unknown model: "), name)))


def is_json(text: Column) -> Column:
    """Whether a text parses as JSON; scalars do."""
    return F.try_parse_json(text).isNotNull()


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the parts, the same on every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
