import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.operators import align as al
from pageloom.operators import errors as er
from pageloom.operators import noise as ns

letters = st.text(alphabet="abrnmcl ", max_size=14)


def test_replaced_spans():
    assert al.character_errors("abc", "axyc") == {("sub", "b", "x"): 1, ("ins", "", "y"): 1}
    assert al.character_errors("abc", "ac") == {("del", "b", ""): 1}


@settings(max_examples=80, deadline=None)
@given(letters, letters)
def test_edit_script_is_shortest(a, b):
    script = al.edit_script(a, b)
    assert len(script) == al._distance(a, b)
    assert len(a) - sum(k == "del" for k, *_ in script) + sum(k == "ins" for k, *_ in script) == len(b)


def test_word_alignment_ties_and_blanks():
    counts, examples = al.align_words(["garden", "the", "cat"], ["gar", "den", "thc", "cat"])
    assert counts[("space_added", "", " ")] == 1 and counts[("sub", "e", "c")] == 1
    assert examples == [("space_added", "garden", "gar den")]
    counts, _ = al.align_words(["in", "the", "end"], ["inthe", "end"])
    assert counts[("space_removed", " ", "")] == 1
    assert al.align_words([], ["a"])[0] == {}


def test_shapes_native_and_python(spark):
    pairs = [("modern", "rnodem"), ("clad", "dad"), ("w", "vv"), ("", "x")]
    d = spark.createDataFrame(pairs, "g string, o string")
    for (g, o), r in zip(pairs, d.select(al.shape_counts(F.col("g"), F.col("o")).alias("c")).collect()):
        want = {(a, b): n for (_, a, b), n in al.shape_errors(g, o).items()}
        assert {(x["gt_shape"], x["ocr_shape"]): x["n"] for x in r["c"] if x["n"]} == want


def test_chunks_cover_the_text():
    random.seed(1)
    text = " ".join(random.choice(["word", "other.", "long-word", "x"]) for _ in range(300))
    chunks = al.chunk_clean_text(text, 50)
    assert "".join("".join(c.split()) for c in chunks) == "".join(text.split())
    assert max(map(len, chunks)) <= 50 + 50 // 3 + 50 // 10 + 3
    assert al.chunk_clean_text("") == []


def test_best_match_against_plain_search():
    random.seed(2)
    for _ in range(20):
        clean = "".join(random.choice("abc d") for _ in range(40))
        noisy = "".join(random.choice("abc d") for _ in range(30)) + clean.replace("a", "o", 2) + "".join(random.choice("abc d") for _ in range(30))
        best, at, region = 0.0, 0, ""
        for k in range(0, min(len(noisy), 200), 5):
            s = SequenceMatcher(None, clean, noisy[k : k + 40]).ratio()
            if s > best:
                best, at, region = s, k, noisy[k : k + 40]
        assert al.best_match(clean, noisy, 0, 200, 5) == ((region if best > 0.6 else None), best, at + len(region))


def test_aligned_chunks_and_errors(spark):
    d = spark.createDataFrame([(1, "The cat sat on the mat. " * 20, "Tbe cat sat on the rnat. " * 20), (2, None, "x"), (3, "abc", "zzz")], "id int, c string, o string")
    rows = al.aligned_chunks(d, ["id"], "c", "o").collect()
    assert {r["id"] for r in rows} == {1, 3}
    assert [r["ocr_chunk"] for r in rows if r["id"] == 3] == [None]
    got = {(r["kind"], r["gt_char"], r["ocr_char"]): r["n"] for r in al.chunk_errors(al.aligned_chunks(d, ["id"], "c", "o")).collect()}
    assert got[("sub", "h", "b")] >= 10


def test_character_counts(spark):
    d = spark.createDataFrame([("rn\nm",), ("vvv",), (None,)], "t string")
    got = {r["symbol"]: r["n"] for r in er.character_counts(d, "t").collect()}
    assert got["rn"] == 1 and got[" "] == 2 and got["v"] == 3 and got["m"] == 1
    assert d.select(er.overlapping_count(F.lit("vvv"), "vv")).first()[0] == 2


def test_shares_rates_and_merging(spark):
    e = spark.createDataFrame([("sub", "a", "b", 3), ("sub", "a", "c", 1), ("ins", "", "x", 2), ("del", "q", "", 0)], "kind string, gt_char string, ocr_char string, n bigint")
    assert {(r["kind"], r["ocr_char"]): r["share"] for r in er.shares(e, ["kind"]).collect() if r["kind"] != "del"} == {("sub", "b"): 0.75, ("sub", "c"): 0.25, ("ins", "x"): 1.0}
    sym = spark.createDataFrame([("a", 8), ("q", 5)], "symbol string, n bigint")
    assert {r["ocr_char"]: r["rate"] for r in er.letter_shares(e, sym).collect()} == {"b": 0.375, "c": 0.125}
    assert {r["n"] for r in er.merged(e, e).collect()} == {6, 2, 4}
    assert {r["kind"]: r["n"] for r in er.space_totals(e).collect()} == {"space_added": 0, "space_removed": 0}


def test_clusters_against_all_partitions():
    values = np.array([0.0, 0.1, 0.2, 5.0, 5.2, 9.0])
    best = min(
        (sum(((values[i:j] - values[i:j].mean()) ** 2).sum() for i, j in ((0, a), (a, b), (b, 6))), (0.0, values[a], values[b]))
        for a in range(1, 5) for b in range(a + 1, 6)
    )
    assert tuple(er.cluster_breaks(values, np.ones(6), 3)) == best[1]
    assert er.cluster_breaks(values[:2], np.ones(2), 5) == [0.0, 0.1]


def test_common_errors(spark):
    e = spark.createDataFrame([(i, v) for i, v in enumerate([0.9, 0.88, 0.1, 0.11, 0.09, None])], "id int, v double")
    assert {r["id"] for r in er.common_errors(e, "v", 2, 1).collect()} == {0, 1}
    assert er.common_errors(e.limit(0), "v", 2, 1).count() == 0


def test_noise_is_reproducible_and_null_safe(spark):
    model = {"sub": {"e": [("c", 0.5)]}, "del": {"x": 0.5}, "ins": {"i": 0.05}, "visual": [("rn", "m", 0.5)]}
    a = ns.perturb("the modern example exists here", model, ns.rng_of(1, 2))
    assert a == ns.perturb("the modern example exists here", model, ns.rng_of(1, 2)) != ns.perturb("the modern example exists here", model, ns.rng_of(1, 3))
    d = spark.createDataFrame([(1, "One sentence here. " * 200), (2, None), (3, "  ")], "id int, t string")
    rows = ns.noisy_corpus(d, "id", "t", model).collect()
    assert {r["id"] for r in rows} == {1}
    assert "".join(r["clean"] for r in sorted(rows, key=lambda r: r["chunk_no"])) == ("One sentence here. " * 200).rstrip()  # the blank after the last full stop is a blank chunk
    assert sorted(rows) == sorted(ns.noisy_corpus(d.repartition(3), "id", "t", model).collect())
    same = d.where("id = 1").select(ns.substitute(F.col("t"), F.col("id"), {"e": ("c", 1.0)})).first()[0]
    assert same == ("One sentence here. " * 200).replace("e", "c")


class Script:
    """A generator that gives what is written down."""

    def __init__(self, *draws):
        self.draws = list(draws)

    def random(self):
        return self.draws.pop(0)

    randint = choice = lambda self, *_: self.draws.pop(0)


MODEL = {"sub": {"e": [("c", 0.1), ("o", 0.2)]}, "del": {"x": 0.5}, "ins": {"i": 0.3, "x": 0.3}, "visual": [("rn", "m", 0.4)]}


@pytest.mark.parametrize("text, draws, out", [
    ("a", (0.0, "#"), "#"),  # uniform noise ends the turn
    ("rna", (0.9, 0.1, 0.9, 0.9), "ma"),  # so does a shape, which takes both letters
    ("rn", (0.9, 0.6, 0.9, 0.9, 0.9), "rn"),
    ("xa", (0.9, 0.4, 0.9, 0.9), "a"),  # a deleted character has no insertion and no stray symbol
    ("e", (0.9, 0.5, 0.15, 0.9), "o"),  # the first substitution that is drawn counts
    ("e", (0.9, 0.5, 0.5, 0.9), "e"),
    ("i", (0.9, 0.1, 5, 0.9), "i"),  # an insertion needs more places than it goes back
    ("aaaai", (0.9, 0.9) * 4 + (0.9, 0.1, 5, 0.9), "aaaai"),
    ("aaaaai", (0.9, 0.9) * 5 + (0.9, 0.1, 5, 0.9), "aiaaaai"),
    ("a", (0.9, 0.001, "~"), "a~"),
])
def test_every_branch_of_the_noise(text, draws, out):
    script = Script(*draws)
    assert ns.perturb(text, MODEL, script) == out and not script.draws


def test_random_chunks_end_at_full_stops():
    text = "a" * 50 + ". " + "b" * 70 + ". ccc"
    assert ns.random_chunks(text, Script(60, 60, 60), 60, 60, 20) == ["a" * 50 + ".", " " + "b" * 70 + ".", " ccc"]
    # the last chunk is drawn back to a full stop near its end as well
    assert ns.random_chunks("d" * 30 + ". ee", Script(90, 90), 90, 90, 20) == ["d" * 30 + ".", " ee"]
    assert ns.random_chunks("", Script()) == [] and ns.random_chunks("  ", Script(5, 5)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 5)), min_size=1, max_size=24, unique_by=lambda x: x[0]), st.integers(1, 5))
def test_clusters_are_the_best_ones(pairs, k):
    """Against all ways to part the values."""
    from itertools import combinations

    pairs.sort()
    v, w = np.array([float(a) for a, _ in pairs]), np.array([float(b) for _, b in pairs])

    def cost(starts):
        ends = [*starts[1:], len(v)]
        return sum((w[i:j] * (v[i:j] - np.average(v[i:j], weights=w[i:j])) ** 2).sum() for i, j in zip(starts, ends))

    if len(v) <= 10:
        best = min(cost((0, *c)) for n in range(min(k, len(v))) for c in combinations(range(1, len(v)), n))
        got = [int(np.flatnonzero(v == b)[0]) for b in er.cluster_breaks(v, w, k)]
        assert len(got) <= k and cost(got) == pytest.approx(best, abs=1e-6)


def test_many_values_are_clustered_exactly(spark):
    d = spark.range(20_000).select(F.col("id"), (F.col("id") / 1000 + F.when(F.col("id") >= 15_000, 100).otherwise(0)).alias("v"))
    assert er.common_errors(d, "v", 2, 1).count() == 5_000


def joined(blocks):
    out = []
    for i, j, size in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, size = out[-1][0], out[-1][1], out.pop()[2] + size
        out.append((i, j, size))
    return out


def misread(rng, text, alphabet, share):
    return "".join(rng.choice(alphabet) if rng.random() < share else c for c in text if rng.random() > share / 3)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc .", "abcdefghijklmnop  eee\n", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789 eee é😀"])
def test_blocks_are_those_of_difflib(alphabet):
    """With and without popular characters, which difflib leaves out of texts of 200 characters or more."""
    rng = random.Random(6)
    for n in (0, 1, 30, 199, 200, 201, 260, 420):
        for share in (0.05, 0.3, 1.0):
            a = "".join(rng.choice(alphabet) for _ in range(n))
            b = misread(rng, a, alphabet, share)
            want = [tuple(m) for m in SequenceMatcher(None, a, b).get_matching_blocks()[:-1]]
            assert joined(al.matching_blocks(a, b)) == want
            total = sum(size for *_, size in want)
            assert joined(al.matching_blocks(a, b, total)) == want and al.matching_blocks(a, b, total + 1) is None


def test_best_match_against_plain_search_of_any_window():
    rng = random.Random(7)
    for alphabet in ("ab", "abcdefghijklmnop  eee\n", "abcdefghijklmnopqrstuvwxyzABC eee é😀"):
        for n, share in ((0, 0.1), (3, 0.1), (120, 0.2), (230, 0.05), (230, 0.4), (230, 1.0)):
            text = "".join(rng.choice(alphabet) for _ in range(900))
            clean, noisy = text[400 : 400 + n], misread(rng, text, alphabet, share)
            for hint, window, stride in ((0, 1000, 5), (420, 1000, 5), (420, 90, 3), (899, 300, 7), (2000, 1000, 5), (10, 0, 5)):
                best, at, region = 0.0, hint, ""
                first = max(0, hint - window // 2)
                for k in range(first, min(len(noisy), first + window), stride):
                    score = SequenceMatcher(None, clean, noisy[k : k + n]).ratio()
                    if score > best:
                        best, at, region = score, k, noisy[k : k + n]
                assert al.best_match(clean, noisy, hint, window, stride) == ((region if best > 0.6 else None), best, at + len(region))


def test_few_regions_are_compared_whole(monkeypatch):
    """aligned_chunk_count: of the 200 regions around the hint only those that can be the best are compared character by character."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz"[: rng.randint(6, 26)]) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = " ".join(rng.choice(vocabulary) for _ in range(500))
    noisy = misread(rng, text, "etaoinc1l", 0.03)
    compared, plain = [], al.matching_blocks
    monkeypatch.setattr(al, "matching_blocks", lambda *a: compared.append(1) or plain(*a))
    chunks = al.align_document(text, noisy)
    assert sum(region is not None for _, region in chunks) > 0.8 * len(chunks) and len(compared) < 50 * len(chunks)


def test_character_errors_against_difflib(monkeypatch):
    """chunk_error_counts: the errors between difflib's blocks, found by one search for the blocks of a pair."""
    rng, searches, plain = random.Random(9), [], al.matching_blocks
    monkeypatch.setattr(al, "matching_blocks", lambda *a: searches.append(1) or plain(*a))
    for n in range(0, 300, 23):
        clean = "".join(rng.choice("abcdefghijklmnop  eee\n") for _ in range(n))
        ocr = misread(rng, clean, "abcxyz ", 0.2)
        want = {}
        for tag, a, b, c, d in SequenceMatcher(None, clean, ocr).get_opcodes():
            both = min(b - a, d - c)
            found = [("sub", x, y) for x, y in zip(clean[a:b], ocr[c:d]) if x != y] + [("del", x, "") for x in clean[a + both : b]] + [("ins", "", y) for y in ocr[c + both : d]]
            for e in found if tag != "equal" else ():
                want[e] = want.get(e, 0) + 1
        assert al.character_errors(clean, ocr) == want
    assert len(searches) == len(range(0, 300, 23))


def test_a_page_is_prepared_once(monkeypatch):
    """aligned_chunks: what the search needs to know of a page is gathered once for all its chunks."""
    made = []

    class Counted(al.NoisyText):
        def __init__(self, text):
            made.append(text)
            super().__init__(text)

    monkeypatch.setattr(al, "NoisyText", Counted)
    clean = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ  .") for _ in range(900))
    assert all(region is not None for _, region in al.align_document(clean, clean.replace("c", "e"))) and len(made) == 1
    assert al.align_document("", "x") == [] and al.align_document("abc", "") == [("abc", None)] and al.align_document("   ", "x") == [("", "")]


def test_one_table_of_distances_for_each_step_of_words(monkeypatch):
    """synthetic_pages: a step of the words takes one table, from which both distances and the script are read."""
    made, plain, rng = [], al._table, random.Random(10)
    monkeypatch.setattr(al, "_table", lambda *a: made.append(1) or plain(*a))
    counts, examples = al.align_words(["garden", "in", "the", "cat"], ["gar", "den", "inthe", "cot"])
    assert len(made) == 3 and counts == {("space_added", "", " "): 1, ("space_removed", " ", ""): 1, ("sub", "a", "o"): 1}
    for _ in range(300):
        a, b = ("".join(rng.choice("rnmcl") for _ in range(rng.randint(0, 7))) for _ in range(2))
        turned = al._traced(plain(b + "rn", a), a, b, True)
        assert turned == al._traced(plain(a + "m", b), a, b) == al.edit_script(a, b)


def test_search_is_much_faster_than_comparing_every_region():
    """common_error_distribution, whose time is that of the search: the same regions as comparing all of them, in an eighth of the time at most."""
    import time

    rng = random.Random(12)
    clean = " ".join("".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz"[: rng.randint(6, 26)]) for _ in range(rng.randint(2, 9))) for _ in range(240))
    ocr = misread(rng, clean, "etaoinc1l", 0.03)
    began, want, cursor = time.thread_time(), [], 0
    for chunk in al.chunk_clean_text(clean):
        first = max(0, cursor - 500)
        scores = [(SequenceMatcher(None, chunk, ocr[k : k + len(chunk)]).ratio(), -k) for k in range(first, min(len(ocr), first + 1000), 5)]
        best, k = max(scores)
        want.append((chunk, ocr[-k : -k + len(chunk)] if best > 0.6 else None))
        cursor = -k + len(ocr[-k : -k + len(chunk)])
    plain, began = time.thread_time() - began, time.thread_time()
    assert al.align_document(clean, ocr) == want
    assert time.thread_time() - began < plain / 8


def noisy_documents(spark, seed):
    """Clean and noisy texts of many lengths and alphabets, real characters beyond 16 bits among them, and nulls."""
    rng, rows = random.Random(seed), [(None, "x"), ("x", None), ("", "x"), ("abc", ""), ("   ", "x"), ("x" * 300, "y" * 300)]
    for alphabet in ("ab", "abc .", "abcdefghijklmnop  eee\n", "abcdefghijklmnopqrstuvwxyzABC 0123 eee é😀.\x1c　\x85"):
        for n, share in ((5, 0.1), (199, 0.1), (201, 0.02), (420, 0.1), (700, 0.4), (900, 0.05)):
            clean = "".join(rng.choice(alphabet) for _ in range(n))
            rows += [(clean, misread(rng, clean, alphabet, share)), (clean, clean[n // 2 :] + clean)]
    return [(i, *r) for i, r in enumerate(rows)], spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, clean string, ocr string")


def without_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "pageloom_alignment" in plan


def test_errors_of_documents_in_the_jvm(spark):
    """chunk_error_counts: no work in Python, no second search for the blocks, the counts of character_errors over all chunks with a region."""
    rows, df = noisy_documents(spark, 21)
    errors = al.document_errors(df, "clean", "ocr")
    want = Counter()
    for _, clean, ocr in rows:
        for chunk, region in al.align_document(clean, ocr) if clean is not None and ocr is not None else ():
            want.update(al.character_errors(chunk, region) if region is not None else {})
    assert without_python(errors) and {(r.kind, r.gt_char, r.ocr_char): r.n for r in errors.collect()} == want


def test_aligned_chunks_in_the_jvm(spark, monkeypatch):
    """aligned_chunks: no work in Python, the chunks and regions of align_document, also where a session takes no Java."""
    rows, df = noisy_documents(spark, 22)
    aligned = al.aligned_chunks(df, ["id"], "clean", "ocr")
    want = [(i, k, *x) for i, clean, ocr in rows if clean is not None and ocr is not None for k, x in enumerate(al.align_document(clean, ocr))]
    assert without_python(aligned) and sorted(map(tuple, aligned.collect()), key=lambda r: r[:2]) == want
    monkeypatch.setattr(al, "java_function", lambda *_: None)
    plain = al.aligned_chunks(df, ["id"], "clean", "ocr")
    assert plain.schema == aligned.schema and sorted(map(tuple, plain.collect()), key=lambda r: r[:2]) == want


def test_common_errors_without_python_search(spark, monkeypatch, tmp_path):
    """common_error_distribution: the whole query without the search in Python, the distribution of the counts of character_errors."""
    from pageloom.plans.queries import QUERIES
    from pageloom.plans import texts  # noqa: F401  (registers its queries)

    rng, want, pages, triples = random.Random(23), Counter(), [], []
    for k in range(12):
        clean = "".join(rng.choice("abcdefghijklmnop  eee") for _ in range(rng.randint(30, 700)))
        pages.append(("d", k, "en", ocr := misread(rng, clean, "abcxyz ", 0.1)))
        triples += [("a_vs_b", k, "m", "n", clean)] * 2
        for chunk, region in al.align_document(clean, ocr):
            want.update(al.character_errors(chunk, region) if region is not None else {})
    spark.createDataFrame(pages, "dataset string, page_id long, lang string, text string").write.parquet(f"{tmp_path}/ocr_pages.parquet")
    spark.createDataFrame(triples, "pair string, page_id long, model1 string, model2 string, ground_truth string").write.parquet(f"{tmp_path}/annotation_triples.parquet")
    counts = spark.createDataFrame([(*k, n) for k, n in want.items()], "kind string, gt_char string, ocr_char string, n long")
    monkeypatch.setattr(al, "_aligned", None)
    monkeypatch.setattr(al, "_character_errors", None)
    assert QUERIES["common_error_distribution"](spark, str(tmp_path)).collect() == er.error_distribution(counts).collect() != []


def test_few_pieces_are_measured_in_the_jvm(spark):
    """common_error_distribution, whose time is that of the search: groups of regions are measured together, single ones only while they are the likeliest; chunks that fill words of bits among the texts."""
    rng, texts = random.Random(25), []
    for _ in range(20):
        clean = " ".join("".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz"[: rng.randint(6, 26)]) for _ in range(rng.randint(2, 9))) for _ in range(120))
        texts.append((clean, misread(rng, clean, "etaoinc1l", 0.03)))
    odd = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n)) for n in (62, 63, 64, 126, 127, 189, 190, 252, 253, 288, 289, 290, 600)]
    rows = texts + [(clean, misread(rng, clean, "abcxyz", 0.1)) for clean in odd]
    aligned = al.aligned_chunks(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, clean string, ocr string"), ["id"], "clean", "ocr")
    want = [(i, k, *x) for i, (clean, ocr) in enumerate(rows) for k, x in enumerate(al.align_document(clean, ocr))]
    assert sorted(map(tuple, aligned.collect()), key=lambda r: r[:2]) == want

    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    page = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("pageloom.Alignment$Page")
    kinds, pair, none = array(jvm.java.lang.Class, 2), array(jvm.java.lang.Object, 2), array(jvm.java.lang.Object, 0)
    kinds[0] = kinds[1] = jvm.java.lang.Class.forName("java.lang.String")
    made, step, measured = page.getDeclaredConstructor(kinds), page.getDeclaredMethod("next", array(jvm.java.lang.Class, 0)), page.getDeclaredField("measured")
    for x in (made, step, measured):
        x.setAccessible(True)
    pieces = chunks = 0
    for pair[0], pair[1] in texts:
        one = made.newInstance(pair)
        while step.invoke(one, none):
            chunks += 1
        pieces += measured.get(one)
    assert pieces < 85 * chunks


def test_kinds_of_errors_are_clustered_in_one_job(spark, monkeypatch):
    """common_error_distribution: the counts are read once for all kinds, each kind has clusters of its own, also one that is empty; the bound holds for each kind."""
    rng = random.Random(26)
    rows = [(kind, chr(97 + i), chr(97 + j), rng.randint(1, 900)) for kind, n in (("sub", 9), ("del", 3), ("other", 4)) for i in range(n) for j in range(n)]
    d = er.shares(spark.createDataFrame(rows, "kind string, gt_char string, ocr_char string, n long"), ["kind"])
    got = er.error_distribution(d.drop("share"))
    own = [er.common_errors(d.where(F.col("kind") == k), "share", 5, 3) for k in ("sub", "ins", "del")]
    want = sorted((r for p in own for r in p.collect()), key=lambda r: (r.kind, -r.share, r.gt_char, r.ocr_char))
    assert got.schema == own[0].schema and not got.schema["cluster"].nullable and got.collect() == want != []
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    most = max(len({r[3] for r in rows if r[0] == k}) for k in ("sub", "del"))
    monkeypatch.setattr(er, "CLUSTER_VALUES", most)
    assert er.error_distribution(d.drop("share")).count() == len(want)
    monkeypatch.setattr(er, "CLUSTER_VALUES", most - 1)
    with pytest.raises(ValueError):
        er.error_distribution(d.drop("share"))
