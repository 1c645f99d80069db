"""Alignment of clean and noisy texts and the errors it shows.

The Python functions state the algorithms; the DataFrame operators run them in
Arrow batches, one text pair per row, and give long tables of counts. The
alignment of chunks runs in the executors' JVM (jvm/Alignment.java), or in
Python where a session takes no Java. Columns
are named gt_char and ocr_char throughout, whichever side an algorithm calls
source.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from pageloom.jvm import java_function

# Shapes read for one another, two letters and the one they look like.
SHAPES = (("rn", "m"), ("cl", "d"), ("vv", "w"))


def chunk_clean_text(text: str, target: int = 200) -> list[str]:
    """Chunks of about `target` characters that end on a full stop, or else on the next blank or full stop."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = start + target
        stop = min(end + target // 3 + 1, n)
        dot = text.find(".", end, stop) if end < n else -1
        if dot >= 0:
            end = dot
        else:
            end = stop if end < n else end
            limit = min(end + target // 10 + 1, n)
            while end < limit and text[end] not in " .":
                end += 1
        out.append(text[start : end + 1].strip())
        start = end + 1
    return out


def _places(text: str, c: str, n: int) -> list[int]:
    out, at = [], -1
    for _ in range(n):
        out.append(at := text.index(c, at + 1))
    return out


def matching_blocks(a: str, b: str, least: int = 0, places: dict[str, list[int] | None] | None = None) -> list[tuple[int, int, int]] | None:
    """(place in a, place in b, length) of the blocks that difflib's SequenceMatcher(None, a, b) finds, in order, adjacent ones not joined; None as soon as they can't hold `least` characters.

    Only characters that are not popular in b begin a block where b has 200
    characters or more. places: the characters of a, filled in with their places
    as they are looked up, for calls with the same a.
    """
    seeds = None
    if len(b) >= 200:
        most, seeds = len(b) // 100 + 1, []
        places = dict.fromkeys(a) if places is None else places
        for c, own in places.items():
            if 0 < (n := b.count(c)) <= most:
                if own is None:
                    own = places[c] = _places(a, c, a.count(c))
                theirs = _places(b, c, n)
                seeds += [(x, theirs) for x in own]
        seeds.sort()
    possible = min(len(a), len(b))
    out, open_ = [], [(0, len(a), 0, len(b), possible, seeds)]
    while open_:
        if possible < least:
            return None
        alo, ahi, blo, bhi, hope, seeds = open_.pop()
        possible -= hope
        i, j, size = alo, blo, 0
        if seeds is None:
            part, x = b[blo:bhi], alo
            while x + size < ahi:
                while x + size < ahi and a[x : x + size + 1] in part:
                    i, size = x, size + 1
                x += 1
            j = blo + part.index(a[i : i + size])
            x, y = i + size, j + size
            left = right = None
        else:
            runs, before = {}, -2
            for x, theirs in seeds:
                last, runs = runs if x == before + 1 else {}, {}
                before = x
                for y in theirs:
                    if blo <= y < bhi:
                        runs[y] = k = last[y - 1] + 1 if y - 1 in last else 1
                        if k > size:
                            i, j, size = x - k + 1, y - k + 1, k
            x, y = i + size, j + size
            while i - 16 >= alo and j - 16 >= blo and a[i - 16 : i] == b[j - 16 : j]:
                i, j = i - 16, j - 16
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            while x + 16 <= ahi and y + 16 <= bhi and a[x : x + 16] == b[y : y + 16]:
                x, y = x + 16, y + 16
            while x < ahi and y < bhi and a[x] == b[y]:
                x, y = x + 1, y + 1
            left, right = [s for s in seeds if s[0] < i], [s for s in seeds if s[0] >= x]
        if x == i:
            continue
        out.append((i, j, x - i))
        possible += x - i
        # a part without seeds has nothing but a common beginning, which only the first part can have
        if alo < i and blo < j and (left or left is None or alo == blo == 0):
            hope = min(i - alo, j - blo)
            open_.append((alo, i, blo, j, hope, left))
            possible += hope
        if x < ahi and y < bhi and (right or right is None):
            hope = min(ahi - x, bhi - y)
            open_.append((x, ahi, y, bhi, hope, right))
            possible += hope
    return None if possible < least else sorted(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Runs of q (3 at most) characters as one number each."""
    n = max(0, len(codes) - q + 1)
    out = codes[:n]
    for k in range(1, q):
        out = (out << 21) | codes[k : k + n]
    return out


class NoisyText:
    """A noisy text with its characters and short runs numbered, to be searched many times."""

    def __init__(self, text: str):
        self.text, codes = text, _codes(text)
        known, self.ids = np.unique(codes, return_inverse=True)
        self.numbers = {chr(c): x for x, c in enumerate(known.tolist())}
        self.grams = [(q, *np.unique(_grams(codes, q), return_inverse=True)) for q in (2, 3)]

    def most_shared(self, clean: str, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Most characters that blocks of clean can share with the pieces of the given ascending starts and lengths.

        m characters in blocks with gaps between hold at least m - (q - 1) blocks
        of the runs of q characters, and each further block costs a character
        that is left out of one of both texts.
        """
        codes, first, out = _codes(clean), int(starts[0]), lengths.copy()
        for q, known, ids in self.grams:
            if not len(known):
                continue
            own = _grams(codes, q)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            met = np.zeros(len(known), dtype=bool)
            met[at[known[at] == own]] = True
            sums = np.concatenate([[0], np.cumsum(met[ids[first : int(starts[-1]) + len(clean)]])])
            here, there = (np.minimum(x - first, len(sums) - 1) for x in (starts, np.maximum(starts, starts + lengths - q + 1)))
            out = np.minimum(out, (sums[there] - sums[here] + (q - 1) * (1 + len(clean) + lengths)) // (2 * q - 1))
        return out

    def subsequences(self, clean: str, starts: np.ndarray, reach: int) -> np.ndarray:
        """Length of the longest common subsequence of clean and each piece of `reach` characters, bit-parallel over all pieces.

        A piece is a field of bits in one long number, with bits above it that count
        what is carried out of it: one for every character of the subsequence.
        """
        own = [c for c in dict.fromkeys(clean) if c in self.numbers]
        none, width = len(own), reach + len(clean).bit_length()
        if len(starts) > (most := max(1, 8_000_000 // (width * max(none, 1)))):
            return np.concatenate([self.subsequences(clean, starts[k : k + most], reach) for k in range(0, len(starts), most)])
        small = np.full(len(self.numbers), none, dtype=np.uint8 if none < 256 else np.int32)
        small[[self.numbers[c] for c in own]] = np.arange(none)
        first = int(starts[0])
        zone = small[self.ids[first : int(starts[-1]) + reach]]
        fields = np.concatenate([zone, np.full(width + reach, none, dtype=small.dtype)])[(starts - first)[:, None] + np.arange(width)]
        fields[:, reach:] = none
        full = np.zeros(fields.shape, dtype=bool)
        full[:, :reach] = True
        number = lambda bits: int.from_bytes(np.packbits(bits.reshape(-1), bitorder="little").tobytes(), "little")
        v = every = number(full)
        masks = {c: (m := number(fields == x), every ^ m) for x, c in enumerate(own)}
        for c in clean:
            if c in masks:
                met, rest = masks[c]
                v = (v + (v & met)) | (v & rest)
        bits = np.frombuffer(v.to_bytes((full.size + 7) // 8, "little"), dtype=np.uint8)
        return np.unpackbits(bits, bitorder="little", count=full.size).reshape(full.shape)[:, reach:] @ (1 << np.arange(width - reach))

    def most_common(self, clean: str, starts: np.ndarray, group: int = 20) -> np.ndarray:
        """No less than the longest common subsequence of clean and the piece of its length at each start; starts within `group` characters share one figure."""
        leads: list[int] = []
        for k in starts.tolist():
            if not leads or k >= leads[-1] + group:
                leads.append(k)
        found = self.subsequences(clean, np.array(leads), len(clean) + group - 1)
        return found[np.searchsorted(leads, starts, side="right") - 1]


def best_match(clean: str, ocr: str | NoisyText, hint: int = 0, window: int = 1000, stride: int = 5, accept: float = 0.6) -> tuple[str | None, float, int]:
    """(region or None, ratio, position after the best region) of the noisy text around the hint; the earliest of equally good regions counts.

    The ratio is difflib's. Regions are compared only where two bounds on what
    they share with the clean text leave them a chance, the likeliest first.
    """
    noisy = ocr if isinstance(ocr, NoisyText) else NoisyText(ocr)
    n, text, first = len(clean), noisy.text, max(0, hint - window // 2)
    starts = np.arange(first, min(len(text), first + window), stride)
    best, at, region = 0.0, hint, ""
    places = dict.fromkeys(clean)

    def compare(k: int) -> None:
        nonlocal best, at, region
        piece = text[k : k + n]
        total = n + len(piece)
        least = max(0, int(best * total / 2) - 1)
        while 2.0 * least / total < best or k > at and 2.0 * least / total == best:
            least += 1
        blocks = matching_blocks(clean, piece, least, places)
        if blocks:
            best, at, region = 2.0 * sum(size for _, _, size in blocks) / total, k, piece

    if not n and len(starts):
        best, at = 1.0, first  # nothing is like nothing
    elif len(starts):
        lengths = np.minimum(n, len(text) - starts)
        most = noisy.most_shared(clean, starts, lengths)
        bound = 2.0 * most / (n + lengths)
        likeliest = int(starts[np.argmax(bound)])
        compare(likeliest)
        open_ = ((bound > best) | (bound == best) & (starts < at)) & (starts != likeliest)
        starts, lengths, most, bound = (x[open_] for x in (starts, lengths, most, bound))
        if len(starts) > 3:
            bound = 2.0 * np.minimum(most, noisy.most_common(clean, starts)) / (n + lengths)
        for x in np.argsort(-bound, kind="stable").tolist():
            if bound[x] < best:
                break
            if bound[x] > best or starts[x] < at:
                compare(int(starts[x]))
    return (region if best > accept else None), best, at + len(region)


def align_document(clean: str, ocr: str, target: int = 200, window: int = 1000, stride: int = 5) -> list[tuple[str, str | None]]:
    """Every chunk of the clean text with its region of the noisy text, or None; the search goes on from the last best region."""
    out, cursor, noisy = [], 0, NoisyText(ocr)
    for chunk in chunk_clean_text(clean, target):
        region, _, cursor = best_match(chunk, noisy, cursor, window, stride)
        out.append((chunk, region))
    return out


def character_errors(clean: str, ocr: str) -> Counter:
    """Counts of (kind, gt_char, ocr_char), kind sub, ins or del, of the differing spans; what a longer span has over is deleted or inserted."""
    out: Counter = Counter()
    a = c = 0
    for b, d, size in [*matching_blocks(clean, ocr), (len(clean), len(ocr), 0)]:
        left, right = clean[a:b], ocr[c:d]
        a, c = b + size, d + size
        shared = min(len(left), len(right))
        out.update(("sub", x, y) for x, y in zip(left, right) if x != y)
        out.update(("del", x, "") for x in left[shared:])
        out.update(("ins", "", y) for y in right[shared:])
    return out


def _table(outer: str, inner: str) -> list[list[int]]:
    """Edit distances of every beginning of outer (rows) and every beginning of inner."""
    row = list(range(len(inner) + 1))
    out = [row]
    for k, x in enumerate(outer, 1):
        diagonal, left, new = k - 1, k, [k]
        for j, y in enumerate(inner, 1):
            up = row[j]
            if x != y:
                if left < diagonal:
                    diagonal = left
                if up < diagonal:
                    diagonal = up
                diagonal += 1
            left = diagonal
            new.append(left)
            diagonal = up
        row = new
        out.append(row)
    return out


def _traced(d: list[list[int]], gt: str, ocr: str, turned: bool = False) -> list[tuple[str, str, str]]:
    """The script that edit_script gives, from a table of distances whose rows are beginnings of gt, or of ocr where it is turned; it may go on beyond both."""
    out, i, j = [], len(gt), len(ocr)
    while i or j:
        if turned:
            here, up, dia = d[j][i], d[j][i - 1], d[j - 1][i - 1]
        else:
            here, up, dia = d[i][j], d[i - 1][j], d[i - 1][j - 1]
        if i and j and here == dia + (gt[i - 1] != ocr[j - 1]):
            if gt[i - 1] != ocr[j - 1]:
                out.append(("sub", gt[i - 1], ocr[j - 1]))
            i, j = i - 1, j - 1
        elif i and here == up + 1:
            out.append(("del", gt[i - 1], ""))
            i -= 1
        else:
            out.append(("ins", "", ocr[j - 1]))
            j -= 1
    return out[::-1]


def edit_script(gt: str, ocr: str) -> list[tuple[str, str, str]]:
    """Substitutions, deletions and insertions of one shortest script; traced from the end, a match or substitution before a deletion before an insertion."""
    return _traced(_table(gt, ocr), gt, ocr)


def shape_errors(gt: str, ocr: str) -> Counter:
    """Counts of (visual, gt shape, ocr shape) at equal positions of both words."""
    out: Counter = Counter()
    for two, one in SHAPES:
        for i in range(min(len(gt), len(ocr))) if two in gt or two in ocr else ():
            if ocr[i : i + 2] == two and gt[i] == one:
                out[("visual", one, two)] += 1
            if gt[i : i + 2] == two and ocr[i] == one:
                out[("visual", two, one)] += 1
    return out


def _distance(a: str, b: str) -> int:
    return _table(a, b)[-1][-1]


def align_words(gt: list[str], ocr: list[str]) -> tuple[Counter, list[tuple[str, str, str]]]:
    """(error counts, examples) of two word lists walked side by side.

    At each step two words are paired, or one ground-truth word with two noisy
    ones (a blank added), or two with one (a blank lost), whichever is nearest;
    ties are pairs. What is left over when one list ends is dropped.
    """
    counts: Counter = Counter()
    examples: list[tuple[str, str, str]] = []
    i = j = 0
    while i < len(gt) and j < len(ocr):
        a, b = gt[i], ocr[j]
        if a == b:
            i, j = i + 1, j + 1
            continue
        # one table holds both distances: the shorter word goes on into the next one
        x, y, step, turned = a, b, (1, 1), len(a) > len(b)
        if turned and j + 1 < len(ocr):
            d = _table(b + ocr[j + 1], a)
            if d[-1][-1] < d[len(b)][-1]:
                y, step = b + ocr[j + 1], (1, 2)
                counts[("space_added", "", " ")] += 1
                examples.append(("space_added", a, f"{b} {ocr[j + 1]}"))
        elif len(b) > len(a) and i + 1 < len(gt):
            d = _table(a + gt[i + 1], b)
            if d[-1][-1] < d[len(a)][-1]:
                x, step = a + gt[i + 1], (2, 1)
                counts[("space_removed", " ", "")] += 1
                examples.append(("space_removed", f"{a} {gt[i + 1]}", b))
        else:
            d, turned = _table(a, b), False
        counts.update(e for e in _traced(d, x, y, turned) if e[0] == "sub")
        counts.update(shape_errors(x, y))
        i, j = i + step[0], j + step[1]
    return counts, examples


_COUNTS = ArrayType(StructType([StructField("kind", StringType()), StructField("gt_char", StringType()), StructField("ocr_char", StringType()), StructField("n", LongType())]))
_PAIRS = ArrayType(StructType([StructField("clean_chunk", StringType()), StructField("ocr_chunk", StringType())]))


def _rows(counter: Counter) -> list[tuple]:
    return [(*k, n) for k, n in sorted(counter.items())]


@F.pandas_udf(ArrayType(StringType()))
def _chunks(text: pd.Series) -> pd.Series:
    return text.map(chunk_clean_text, na_action="ignore")


@F.pandas_udf(_PAIRS)
def _aligned(clean: pd.Series, ocr: pd.Series) -> pd.Series:
    return pd.Series([align_document(a, b) if a is not None and b is not None else None for a, b in zip(clean, ocr)])


@F.pandas_udf(_COUNTS)
def _character_errors(clean: pd.Series, ocr: pd.Series) -> pd.Series:
    return pd.Series([_rows(character_errors(a, b)) if a is not None and b is not None else None for a, b in zip(clean, ocr)])


@F.pandas_udf(_COUNTS)
def _word_errors(clean: pd.Series, ocr: pd.Series) -> pd.Series:
    return pd.Series([_rows(align_words(a.split(), b.split())[0]) if a is not None and b is not None else None for a, b in zip(clean, ocr)])


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("gt_words", StringType()), StructField("ocr_words", StringType())])))
def _space_examples(clean: pd.Series, ocr: pd.Series) -> pd.Series:
    return pd.Series([align_words(a.split(), b.split())[1] if a is not None and b is not None else None for a, b in zip(clean, ocr)])


def clean_chunks(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, chunk_no, chunk) of each text."""
    return df.select(*key, F.posexplode(_chunks(F.col(text))).alias("chunk_no", "chunk"))


def aligned_chunks(df: DataFrame, key: list[str], clean: str, ocr: str) -> DataFrame:
    """(key, chunk_no, clean_chunk, ocr_chunk); ocr_chunk null where nothing matches well enough."""
    aligned = java_function(df.sparkSession, "Alignment", "Chunks", _PAIRS.simpleString()) or _aligned
    return df.select(*key, F.posexplode(aligned(F.col(clean), F.col(ocr))).alias("chunk_no", "x")).select(*key, "chunk_no", "x.*")


def aligned_count(chunks: DataFrame) -> DataFrame:
    """Chunks and aligned chunks of a table of aligned chunks."""
    return chunks.agg(F.count("*").alias("chunks"), F.count("ocr_chunk").alias("aligned"))


def _summed(rows: DataFrame, errors: Column) -> DataFrame:
    return rows.select(F.explode(errors).alias("x")).groupBy("x.kind", "x.gt_char", "x.ocr_char").agg(F.sum("x.n").alias("n"))


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """(kind, gt_char, ocr_char, n) over aligned chunks; chunks without partner are passed over."""
    return _summed(chunks.where("ocr_chunk is not null"), _character_errors(F.col("clean_chunk"), F.col("ocr_chunk")))


def document_errors(df: DataFrame, clean: str, ocr: str) -> DataFrame:
    """chunk_errors of the texts' aligned chunks, which are not built as a table."""
    errors = java_function(df.sparkSession, "Alignment", "Errors", _COUNTS.simpleString())
    return _summed(df, errors(F.col(clean), F.col(ocr))) if errors else chunk_errors(aligned_chunks(df, [], clean, ocr))


def word_errors(df: DataFrame, clean: str, ocr: str) -> DataFrame:
    """(kind, gt_char, ocr_char, n) of words walked side by side: substitutions, blanks added and removed, shapes."""
    return _summed(df, _word_errors(F.col(clean), F.col(ocr)))


def space_examples(df: DataFrame, key: list[str], clean: str, ocr: str) -> DataFrame:
    return df.select(*key, F.explode(_space_examples(F.col(clean), F.col(ocr))).alias("x")).select(*key, "x.*")


def shape_counts(gt: Column, ocr: Column) -> Column:
    """array<struct<gt_shape, ocr_shape, n>>: shapes read for one another at equal positions of both texts, natively, in one pass over their characters."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    both = F.array(F.struct(chars(gt).alias("g"), chars(ocr).alias("o")))

    def counts(s: Column) -> Column:
        n = F.least(F.size(s["g"]), F.size(s["o"]))
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        stands = lambda c, shape, i: (F.get(c, i) == shape[0]) & ((F.get(c, i + 1) == shape[1]) if len(shape) > 1 else F.lit(True))
        rows = []
        for two, one in SHAPES:
            for left, right in ((one, two), (two, one)):
                rows.append((left, right, F.size(F.filter(at, lambda i: F.coalesce(stands(s["g"], left, i) & stands(s["o"], right, i), F.lit(False))))))
        return F.array(*[F.struct(F.lit(a).alias("gt_shape"), F.lit(b).alias("ocr_shape"), c.alias("n")) for a, b, c in rows])

    return F.get(F.transform(both, counts), F.lit(0))
