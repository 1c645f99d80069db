"""Synthetic scan noise from an error table.

All draws are hashes of a seed, the text's key and the position, so that a run
gives the same noise on any partitioning and after any retry.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import hash_unit

# Fixed value: symbols that strew into a text.
SYMBOLS = "~!$%&*+=?|"
#: Characters of uniform noise.
UNIFORM = "".join(map(chr, range(33, 127)))
#: Errors a noise model takes; more are too many for a table that every task holds.
MODEL_ROWS = 50_000


def model_of(errors: DataFrame) -> dict:
    """The noise model of an error table with kind, gt_char, ocr_char and share: substitutions and deletions by character, insertions by the inserted character, which is the one it follows, shapes."""
    rows = errors.select("kind", "gt_char", "ocr_char", "share").limit(MODEL_ROWS + 1).collect()
    if len(rows) > MODEL_ROWS:
        raise ValueError(f"a noise model holds at most {MODEL_ROWS} errors; take the common ones")
    model: dict = {"sub": {}, "del": {}, "ins": {}, "visual": []}
    for r in sorted(rows, key=lambda r: (-r["share"], r["kind"], r["gt_char"], r["ocr_char"])):
        if r["kind"] == "sub":
            model["sub"].setdefault(r["gt_char"], []).append((r["ocr_char"], r["share"]))
        elif r["kind"] == "del":
            model["del"][r["gt_char"]] = r["share"]
        elif r["kind"] == "ins":
            model["ins"][r["ocr_char"]] = r["share"]
        elif r["kind"] == "visual":
            model["visual"].append((r["gt_char"], r["ocr_char"], r["share"]))
    return model


def rng_of(*parts: object) -> random.Random:
    return random.Random(int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:8], "big"))


def perturb(text: str, model: dict, rng: random.Random, symbol_p: float = 0.005, uniform_p: float = 0.005) -> str:
    """Noisy copy of a text.

    A character meets, in this order: uniform noise, a shape, deletion, each of which
    ends its turn; then substitution, an insertion of the same character five to
    fifteen places back, where there are more places than that, and a stray symbol.
    """
    out: list[str] = []
    draw, sub, dele, ins = rng.random, model["sub"], model["del"], model["ins"]
    visual = {c: [v for v in model["visual"] if not v[0] or v[0][0] == c] for c in set(text)}
    i = 0
    while i < len(text):
        c = text[i]
        if draw() < uniform_p:
            out.append(rng.choice(UNIFORM))
            i += 1
            continue
        for a, b, p in visual[c]:
            if text.startswith(a, i) and draw() < p:
                out.append(b)
                i += len(a)
                break
        else:
            i += 1
            if c in dele and draw() < dele[c]:
                continue
            for t, p in sub.get(c, ()):
                if draw() < p:
                    out.append(t)
                    break
            else:
                out.append(c)
            if c in ins and draw() < ins[c]:
                back = rng.randint(5, 15)
                if back < len(out):
                    out.insert(len(out) - back, c)
            if draw() < symbol_p:
                out.append(rng.choice(SYMBOLS))
    return "".join(out)


def random_chunks(text: str, rng: random.Random, least: int = 1000, most: int = 2000, around: int = 100) -> list[str]:
    """Chunks of random length, each ended at the full stop nearest its drawn end within `around` characters, the last one too; blank ones are skipped."""
    out, start = [], 0
    while start < len(text):
        end = min(start + rng.randint(least, most), len(text))
        dots = [k for k in range(max(start, end - around), min(len(text), end + around)) if text[k] == "."]
        if dots:
            end = min(dots, key=lambda k: abs(k - end)) + 1
        piece = text[start:end]
        if piece.strip():
            out.append(piece)
        start = end
    return out


def noisy_corpus(df: DataFrame, key: str, text: str, model: dict, seed: int = 42, **chunking) -> DataFrame:
    """(key, chunk_no, clean, noisy): chunks of each text, numbered from 0, with a noisy copy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                rng = rng_of(seed, k)
                rows += [(k, n, c, perturb(c, model, rng)) for n, c in enumerate(random_chunks(t, rng, **chunking))]
            yield pd.DataFrame(rows, columns=["k", "chunk_no", "clean", "noisy"])

    kind = dict(df.dtypes)[key]
    src = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"k {kind}, chunk_no int, clean string, noisy string").withColumnRenamed("k", key)


def substitute(text: Column, key: Column, pairs: dict[str, tuple[str, float]], seed: int = 7) -> Column:
    """Substitution noise as a native expression: each character of `pairs` becomes its partner with the given probability."""
    table = F.create_map(*[F.lit(x) for k, (t, p) in pairs.items() for x in (k, t)])
    chance = F.create_map(*[F.lit(x) for k, (t, p) in pairs.items() for x in (k, float(p))])
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        # the draw is made for the characters of the table only
        hit = F.when(F.map_contains_key(table, c), hash_unit(F.lit(seed), key, i) < F.try_element_at(chance, c)).otherwise(False)
        return F.when(hit, F.try_element_at(table, c)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")
