"""Problem 9: one consistent form for texts that look the same.

The form is a confusables skeleton: decompose canonically, replace every
character by the prototype of its look-alike class, decompose again. Texts with
the same skeleton look the same. Only characters drawn alike are in one class;
letters that merely can be misread for each other (l and 1, m and rn), dashes
of different length, quotation marks and accents stay apart.

Nulls have no form and join no class. The empty text and texts of invisible
characters only share the empty skeleton. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pageloom.llm.common import durable

# Characters drawn like an ASCII character, in the order of the ASCII characters.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹⅭ", "D": "Ⅾ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀⅠ", "J": "ЈͿ",
    "K": "КΚ", "L": "Ⅼ", "M": "МΜϺⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս",
    "V": "ѴⅤ", "W": "Ԝ", "X": "ХΧⅩ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "а", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іⅰ", "j": "јϳ", "l": "ӏⅼ", "m": "ⅿ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵνⅴ", "w": "ԝ", "x": "хⅹ", "y": "уү",
    "-": "‐‑",
}
#: Ranges of characters that leave no mark, as first and last code points.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
SPACES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def prototypes() -> dict[str, str]:
    """Every look-alike character with its prototype; full-width forms by their fixed distance from ASCII."""
    out = {chr(0xFF00 + k): chr(0x20 + k) for k in range(1, 95)}
    out |= {c: p for p, many in LOOK_ALIKES.items() for c in many}
    out |= {chr(c): " " for a, b in SPACES for c in range(a, b + 1)}
    out |= {chr(c): "" for a, b in INVISIBLE for c in range(a, b + 1)}
    return out


_PROTOTYPES = prototypes()
_ALIKE = re.compile("[" + re.escape("".join(_PROTOTYPES)) + "]")


def skeleton(text: str) -> str:
    """The consistent form of one text."""
    if text.isascii():
        return text
    text = _ALIKE.sub(lambda m: _PROTOTYPES[m[0]], unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFD", text)


@F.pandas_udf(StringType())
def _skeletons(text: pd.Series) -> pd.Series:
    return text.map(skeleton, na_action="ignore")


@F.pandas_udf(StringType())
def _skeleton_keys(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.md5(skeleton(t).encode("utf-8", "surrogatepass")).hexdigest(), na_action="ignore")


def _plain(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7f]*$")


def consistent_form(text: Column) -> Column:
    """Skeleton of a string column; ASCII texts are their own form and never leave the JVM."""
    return F.when(_plain(text), text).otherwise(_skeletons(F.when(~_plain(text), text)))


def skeleton_key(text: Column) -> Column:
    """128-bit digest of the skeleton, without sending the skeleton back from Python."""
    return F.when(_plain(text), F.md5(text)).otherwise(_skeleton_keys(F.when(~_plain(text), text)))


def look_alike_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, look, exact): digests of the skeleton and of the characters of each text; null texts are left out."""
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), skeleton_key(F.col(text)).alias("look"), F.md5(F.col(text)).alias("exact"))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per class of same-looking texts: class id (smallest member), members, different texts."""
    per_text = look_alike_members(df, key, text).groupBy("look", "exact").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return per_text.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("texts")).drop("look")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: texts that look the same and are different characters.

    Digests are kept once. Different texts of one look are paired, not their
    copies; copies come in by their text, so that equal texts, however many
    there are, never meet each other. Classes of one text drop out in an
    aggregate before that.
    """
    members = durable(look_alike_members(df, key, text).distinct())
    texts = members.groupBy("look", "exact").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("look").agg(F.count("*").alias("texts")).where("texts > 1").select("look")
    texts = texts.join(mixed, "look").select("look", "exact")
    differing = texts.select("look", F.col("exact").alias("e1")).join(texts.select("look", F.col("exact").alias("e2")), "look").where("e1 < e2").select("e1", "e2")
    one, two = (members.select(F.col("id").alias(i), F.col("exact").alias(e)) for i, e in (("x", "e1"), ("y", "e2")))
    pairs = differing.join(one, "e1").join(two, "e2").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
