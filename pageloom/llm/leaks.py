"""Problem 8: evaluation texts leaking into training texts.

Wu-Manber multi-pattern search: the patterns are the first `width` letters from
each word of each evaluation item. Documents are reduced to letters and digits.
At an end of a window the hash of its last block looks up how far the window may
jump, since no pattern ends before; where it may not, a table of suffix and
prefix hashes selects the patterns, and direct comparison confirms them. The
windows of many stretches of a batch jump at once. Occurrences that follow each
other are then joined over misread and inserted words to the longest run of
consecutive item words.

Null and empty texts hold nothing. Items with fewer than `min_words` words can't
be found. Words of a notice, that is of at least `notice_words` words that also
stand in another item, do not count; notices are looked for among all items
before the search. Documents are read whole, and no document is compared with
another. Items are searched for in blocks of at most `block_letters` letters, so
that their tables have a bounded size; each block takes a pass over the documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pageloom.llm.common import durable
from pageloom.llm.skeleton import LOOK_ALIKES, skeleton

BLOCK = 5
BITS = 22
#: Letters of the items searched for in one pass; more are searched for in further passes.
BLOCK_LETTERS = 8_000_000
#: Letters of documents searched at once, and stretches whose windows jump at once.
BATCH_LETTERS = 4_000_000
LANES = 8_192
#: Letters that may stand between two matching stretches of a run, in the item and in the document: misread or inserted words.
GAP_ITEM, GAP_DOC = 80, 110
#: Letters by which the one gap may be longer than the other: an inserted or lost word or two.
DRIFT = 30
#: Misread words that count at each end of a run.
END_WORDS = 3
_MARKS = re.compile(r"[\W_]+")
#: Small letters whose capitals look like a Latin one: as capitals and small letters are one here, they are too.
_PARTNERS = {c.casefold(): p.casefold() for p, many in LOOK_ALIKES.items() for c in many if c.isalpha() and not c.casefold().isascii()}
_PARTNER = re.compile("|".join(map(re.escape, _PARTNERS)))
_ASCII_MARKS = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())


def letters(text: str) -> bytes:
    """Lower-case letters and digits of a text in plain form, of any script, without anything between them."""
    if not text.isascii():
        plain = _PARTNER.sub(lambda m: _PARTNERS[m[0]], unicodedata.normalize("NFKD", skeleton(text)).casefold())
        return _MARKS.sub("", plain).encode("utf-8", "ignore")
    return text.lower().encode().translate(None, _ASCII_MARKS)


def item_words(text: str | None) -> list[bytes]:
    return [w for w in (letters(p) for p in (text or "").split()) if w]


def _eight(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros after the end."""
    return np.ndarray((len(x),), dtype="<u8", buffer=np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,))


def _block_hash(eight: np.ndarray) -> np.ndarray:
    """Hash of the first BLOCK of eight bytes."""
    return ((eight & np.uint64((1 << 8 * BLOCK) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _alike(left: bytes, right: bytes, least: float) -> bool:
    """Whether the matching blocks of both make up at least this share of their letters; their longest common subsequence, which bounds it, is taken first, one bit a letter."""
    need = least * (len(left) + len(right)) / 2
    if min(len(left), len(right)) < need:
        return False
    places: dict[int, int] = {}
    for i, c in enumerate(left):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(left)) - 1
    v = full
    for c in right:
        u = v & places.get(c, 0)
        if u:
            v = (v + u | v - u) & full
    return len(left) - v.bit_count() >= need and SequenceMatcher(None, left, right, autojunk=False).ratio() >= least


class Items:
    """Evaluation items with the search tables; rows: (id, text, numbers of the words that belong to a notice)."""

    def __init__(self, rows: list[tuple[int, str, list[int]]], width: int, min_words: int):
        self.width, self.min_words = width, min_words
        self.ids, self.text, self.starts, self.notice = [], [], [], []
        for i, t, notice in sorted(rows):
            words = item_words(t)
            if len(words) < min_words:
                continue
            self.ids.append(i)
            self.text.append(b"".join(words))
            self.starts.append(np.concatenate([[0], np.cumsum([len(w) for w in words])]).tolist())
            self.notice.append(set(notice))
        # letters between the last hit of a stretch and its end, and between its begin and the first hit
        self.reach = width + 2 * max((b - a for s in self.starts for a, b in zip(s, s[1:])), default=0)
        self.where: dict[bytes, list[tuple[int, int]]] = {}
        own: set[bytes] = set()
        for k, (t, s) in enumerate(zip(self.text, self.starts)):
            for j, a in enumerate(s[:-1]):
                if len(t) - a >= width:
                    self.where.setdefault(t[a : a + width], []).append((k, a))
                    if any(w not in self.notice[k] for w in range(j, bisect_left(s, a + width))):
                        own.add(t[a : a + width])
        names = sorted(self.where)
        self.patterns = np.array(names, dtype=f"S{width}")
        flat = [self.where[p] for p in names]
        #: Patterns that lie in notices only: however many items share them, they begin no run.
        self.shared = np.array([p not in own for p in names], dtype=bool)
        self.count = np.array([len(f) for f in flat], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.owner = np.array([k for f in flat for k, _ in f], dtype=np.int64)
        self.place = np.array([a for f in flat for _, a in f], dtype=np.int64)
        # number of the word each occurrence begins with, and of the last word that a stretch may hold whose last hit it is: its next words begin within `width` letters
        self.word = np.array([bisect_left(self.starts[k], a) for f in flat for k, a in f], dtype=np.int64)
        self.upto = np.array([bisect_left(self.starts[k], self.starts[k][j + 1] + width) - 1 for (k, _), j in zip((x for f in flat for x in f), self.word.tolist())], dtype=np.int64)
        self.inner = min_words - 2 * END_WORDS
        self.shared_at: dict[int, dict[int, list[int]]] = {}
        for q in np.flatnonzero(self.shared).tolist():
            by_item = self.shared_at[q] = {}
            for x in range(self.first[q], self.first[q] + self.count[q]):
                by_item.setdefault(int(self.owner[x]), []).append(x)
        self.shift = np.full(1 << BITS, width - BLOCK + 1, dtype=np.uint8)
        self.both = np.zeros(1 << BITS, dtype=bool)
        if len(self.patterns):
            h = _block_hash(_eight(np.frombuffer(b"".join(names), dtype=np.uint8))).reshape(-1, width)
            for j in range(width - BLOCK + 1):
                np.minimum.at(self.shift, h[:, j], width - BLOCK - j)
            self.both[self._pair(h[:, width - BLOCK], h[:, 0])] = True

    @staticmethod
    def _pair(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (last * np.uint64(40503) ^ first) & np.uint64((1 << BITS) - 1)

    def _stops(self, x: np.ndarray) -> np.ndarray:
        """Window ends where the shift is 0; every stretch's window jumps by the shift its last block allows."""
        w, n, eight = self.width, len(x), _eight(x)
        lanes = max(1, min(LANES, (n - w) // (4 * w)))
        bounds = np.linspace(w - 1, n, lanes + 1).astype(np.int64)
        at, to = bounds[:-1].copy(), bounds[1:]
        out = []
        while len(at):
            step = self.shift[_block_hash(eight[at - BLOCK + 1])]
            hit = step == 0
            if hit.any():
                out.append(at[hit])
            at += np.maximum(step, 1)
            open_ = at < to
            if not open_.all():
                at, to = at[open_], to[open_]
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)

    def occurrences(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern number) of every occurrence in the bytes of a batch."""
        w = self.width
        if len(x) < w or not len(self.patterns):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        end, eight = self._stops(x), _eight(x)
        end = end[self.both[self._pair(_block_hash(eight[end - BLOCK + 1]), _block_hash(eight[end - w + 1]))]]
        windows = np.lib.stride_tricks.sliding_window_view(x, w)
        out_at, out_pattern = [], []
        for k in range(0, len(end), 1 << 20):
            at = end[k : k + (1 << 20)] - w + 1
            text = np.ascontiguousarray(windows[at]).view(f"S{w}").ravel()
            p = np.minimum(np.searchsorted(self.patterns, text), len(self.patterns) - 1)
            ok = self.patterns[p] == text
            out_at.append(at[ok])
            out_pattern.append(p[ok])
        return np.concatenate(out_at or [np.empty(0, np.int64)]), np.concatenate(out_pattern or [np.empty(0, np.int64)])

    def longest_run(self, k: int, doc: bytes, hits: list[tuple[int, int]]) -> int:
        """Most consecutive words of item k, notices left out, that doc holds along the hits (position in item, position in doc)."""
        item, w = self.text[k], self.width
        segments: list[tuple[int, int, int]] = []  # item from, item to, doc from
        reach: dict[int, int] = {}  # by diagonal, how far the item stands there
        for a, b in sorted(hits):
            if a < reach.get(b - a, -1):
                continue
            z, y, diagonal = a + w, b + w, b - a
            while z < len(item) and y < len(doc) and item[z] == doc[y]:
                z, y = z + 1, y + 1
            while a and b and item[a - 1] == doc[b - 1]:
                a, b = a - 1, b - 1
            segments.append((a, z, b))
            reach[diagonal] = z
        starts = self.starts[k]
        enough = self.inner
        if bisect_left(starts, max(s[1] for s in segments)) - bisect_left(starts, min(s[0] for s in segments)) < enough:
            return 0
        best = 0
        runs: list[tuple[int, int, int, int]] = []  # item from, item to, doc from, doc to
        changed: list[int] = []  # when each run was last met
        ends: dict[int, list[int]] = defaultdict(list)  # runs by the stretch of doc they end in
        wide = GAP_DOC + 1
        for now, (a, z, b) in enumerate(sorted(segments)):
            near = {r for e in range((b - GAP_DOC) // wide, (b + 8) // wide + 1) for r in ends.get(e, ())}
            r = next((r for r in sorted(near, key=lambda r: -changed[r]) if self._joins(item[runs[r][1] : a], doc[runs[r][3] : b], a - runs[r][1], b - runs[r][3])), None)
            if r is None:
                r = len(runs)
                runs.append((a, z, b, b + z - a))
                changed.append(now)
                ends[runs[r][3] // wide].append(r)
            elif z > runs[r][1]:
                ends[runs[r][3] // wide].remove(r)
                runs[r] = (runs[r][0], z, runs[r][2], b + z - a)
                ends[runs[r][3] // wide].append(r)
            changed[r] = now
        for a, z, b, y in runs:
            if bisect_left(starts, z) - bisect_left(starts, a) >= enough:
                best = max(best, self._words(k, a, z, b, y, doc))
        return best

    @staticmethod
    def _joins(left: bytes, right: bytes, n: int, m: int) -> bool:
        """Whether the letters between two matching stretches are misread or inserted words only; stretches may touch or overlap by a few letters."""
        if n < 0 or m < 0:
            return min(n, m) >= -8 and abs(n - m) <= 14
        if n <= 3 and m <= 24 or m <= 3 and n <= 3:
            return True
        if n > GAP_ITEM or m > GAP_DOC or abs(n - m) > DRIFT:
            return False
        return _alike(left, right, (0.5 if n <= 24 else 0.62) - (0.1 if m > n + 3 else 0))

    def _words(self, k: int, a: int, z: int, b: int, y: int, doc: bytes) -> int:
        """Words of the run [a, z) of item k, with at most END_WORDS misread words at each end."""
        starts, item = self.starts[k], self.text[k]
        lo, hi = bisect_left(starts, a), bisect_left(starts, z + 1) - 1
        first, last = lo - END_WORDS, hi + END_WORDS
        while lo > max(0, first):  # the word before may be misread
            s = starts[lo - 1]
            word = item[s : starts[lo]]
            from_ = b - (a - starts[lo]) - len(word)
            if from_ < 0 or SequenceMatcher(None, word, doc[max(0, from_ - 1) : from_ + len(word)], autojunk=False).ratio() < 0.6:
                break
            lo, a, b = lo - 1, s, from_
        while hi < min(len(starts) - 1, last):
            s = starts[hi]
            word = item[s : starts[hi + 1]]
            from_ = y - (z - s)
            if SequenceMatcher(None, word, doc[from_ : from_ + len(word) + 1], autojunk=False).ratio() < 0.6:
                break
            hi, y, z = hi + 1, from_ + len(word), starts[hi + 1]
        return sum(j not in self.notice[k] for j in range(lo, hi))


def _may_chain(hits: list[tuple[int, int, int, int]], reach: int, words: int) -> bool:
    """Whether hits (place in item, place in document, word, last word) may follow each other over so many words; whatever longest_run() joins, does."""
    begin: list[int] = []
    for i, (a, p, first, upto) in enumerate(hits):
        for j in range(i):
            b, q = hits[j][:2]
            if b < a <= b + reach and -DRIFT <= p - a - q + b <= DRIFT and begin[j] < first:
                first = begin[j]
        if upto - first + 1 >= words:
            return True
        begin.append(first)
    return False


def find_in_batch(items: Items, docs: list[str | None]) -> list[tuple[int, int, int]]:
    """(document number, item id, words) of one batch."""
    parts = [letters(t) if t else b"" for t in docs]
    gap = b"\0" * items.width
    offsets = np.cumsum([0] + [len(p) + len(gap) for p in parts])
    at, pattern = items.occurrences(np.frombuffer(gap.join(parts) + gap, dtype=np.uint8))
    if not len(at):
        return []
    doc_of = np.searchsorted(offsets, at, side="right") - 1
    mine = ~items.shared[pattern]
    many = items.count[pattern[mine]]
    which = np.repeat(items.first[pattern[mine]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    p, d = np.repeat(at[mine], many), np.repeat(doc_of[mine], many)
    p -= offsets[d]
    if (~mine).any():  # patterns of notices count for the items that are met otherwise in the document
        own = np.isin(doc_of, np.unique(d)) & ~mine
        met = defaultdict(set)
        for n, o in zip(d.tolist(), items.owner[which].tolist()):
            met[n].add(o)
        extra = [(n, x, where - offsets[n]) for q, where, n in zip(pattern[own].tolist(), at[own].tolist(), doc_of[own].tolist()) for o in met[n] for x in items.shared_at[q].get(o, ())]
        if extra:
            d, which, p = (np.concatenate([x, y]) for x, y in zip((d, which, p), np.array(extra, dtype=np.int64).T))
    # hits that no run can bridge fall apart: neighbours in a run are near in the document and in the item, and drift little
    group = d * len(items.ids) + items.owner[which]
    for turn in range(6):
        if not len(d):
            return []
        a = items.place[which]
        value, most = ((p - a, DRIFT), (p, GAP_DOC + items.reach), (a, GAP_ITEM + items.reach))[turn % 3]
        order = np.lexsort((value, group))
        d, which, p, group, value = (x[order] for x in (d, which, p, group, value))
        new = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(value) > most)])
        words = np.maximum.reduceat(items.upto[which], new) - np.minimum.reduceat(items.word[which], new) + 1
        size = np.diff(np.r_[new, len(d)])
        enough = np.repeat(words >= items.inner, size)
        group = np.repeat(np.arange(len(new)), size)[enough]
        d, which, p = (x[enough] for x in (d, which, p))
    if not len(d):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    hits = list(zip(items.place[which].tolist(), p.tolist(), items.word[which].tolist(), items.upto[which].tolist()))
    best: dict[tuple[int, int], int] = {}
    for lo, hi in zip(new.tolist(), np.r_[new[1:], len(d)].tolist()):
        key, these = (int(d[lo]), int(items.owner[which[lo]])), hits[lo:hi]
        if len(these) <= 40 and not _may_chain(sorted(these), GAP_ITEM + items.reach, items.inner):
            continue
        n = items.longest_run(key[1], parts[key[0]], [h[:2] for h in these])
        if n >= items.min_words:
            best[key] = max(best.get(key, 0), n)
    return [(n, items.ids[o], words) for (n, o), words in sorted(best.items())]


_GRAMS = ArrayType(StructType([StructField("j", IntegerType()), StructField("h", LongType())]))


def _grams(n: int):
    @F.pandas_udf(_GRAMS)
    def grams(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            words = item_words(t)
            out.append([(j, int.from_bytes(hashlib.blake2b(b" ".join(words[j : j + n]), digest_size=8).digest(), "little", signed=True)) for j in range(len(words) - n + 1)])
        return pd.Series(out)

    return grams


def with_notices(items: DataFrame, n: int) -> DataFrame:
    """(i, t, notice): items with the numbers of the words in stretches of n words that also stand in another item."""
    g = items.select("i", F.explode(_grams(n)(F.col("t"))).alias("x")).select("i", "x.j", "x.h")
    shared = g.groupBy("h").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo <> hi").select("h")
    per = g.join(shared.hint("merge"), "h").groupBy("i").agg(F.collect_set("j").alias("js"))
    words = F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + n - 1))))
    return items.join(per.hint("merge"), "i", "left").select("i", "t", F.coalesce(words, F.array().cast("array<int>")).alias("notice"))


def find_leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = 25, width: int = 16, notice_words: int = 14, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(doc, item, words): documents with at least min_words consecutive words of an item, and the longest such run."""
    spark = docs.sparkSession
    keyed = items.where(f"{item_text} is not null").select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    noticed = durable(with_notices(keyed, notice_words))
    total = noticed.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-total // block_letters))
    texts = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).cast("long").alias("doc"), F.col(doc_text).alias("t"))
    if texts.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few files, as only small tables have: else texts stay where they are read
        texts = texts.repartition(spark.sparkContext.defaultParallelism)
    out = None
    for n in range(passes):
        rows = [(r["i"], r["t"], r["notice"]) for r in noticed.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n).collect()]
        shared = spark.sparkContext.broadcast((rows, width, min_words))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tables = Items(*shared.value)
            for b in batches:
                ids, text = b["doc"].tolist(), b["t"].tolist()
                cut = np.cumsum(np.fromiter(map(len, text), np.int64, len(text))) // BATCH_LETTERS
                for k, z in zip(*(lambda e: (np.r_[0, e].tolist(), np.r_[e, len(ids)].tolist()))(np.flatnonzero(np.diff(cut)) + 1)):
                    found = find_in_batch(tables, text[k:z])
                    yield pd.DataFrame([(ids[k + d], i, w) for d, i, w in found], columns=["doc", "item", "words"])

        one = texts.mapInPandas(search, "doc long, item long, words int")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc", "item").agg(F.max("words").alias("words"))


def leaked_items(leaks: DataFrame) -> DataFrame:
    """(item, docs, words): every leaked item, how many documents hold it, and its longest run."""
    return leaks.groupBy("item").agg(F.count("*").alias("docs"), F.max("words").alias("words"))
