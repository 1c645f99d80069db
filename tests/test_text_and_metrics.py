import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import metrics as mx
from pageloom.functions import text as tx
from pageloom.functions.stem import stem

words = st.lists(st.sampled_from(["the", "a", "cat", "sat", "mat", "on"]), max_size=12)


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))


def test_first_golden(spark):
    r = mx.with_scores(one(spark, c="THE LANTERN;", n="THE LANTERN"), "c", "n").first()
    assert r["cer"] == pytest.approx(1 / 12) and r["wer"] == 0.5
    assert (r["unigram_precision"], r["unigram_recall"], r["unigram_f1"]) == (1, 1, 1)
    assert (r["length_clean"], r["length_ocr"]) == (12, 11)


def test_word_error_tokens(spark):
    got = one(spark, t=" a b\nc  d \n\n e ").select(tx.wer_words(F.col("t")).alias("w")).first()["w"]
    assert got == ["a", "b\nc", "d", "e"]


def test_null_and_empty_references(spark):
    d = spark.createDataFrame([("", "x"), (None, "x"), ("x", None)], "c string, n string")
    assert [r["cer"] for r in d.select(mx.cer(F.col("c"), F.col("n")).alias("cer")).collect()] == [None, None, None]
    assert [r["wer"] for r in d.select(mx.wer(F.col("c"), F.col("n")).alias("wer")).collect()] == [None, None, None]


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_common_subsequence_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    assert mx.common_subsequence(a, b) == t[-1][-1]


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_edit_distance_symmetry(a, b):
    assert mx.edit_distance(a, b) == mx.edit_distance(b, a)
    assert (mx.edit_distance(a, b) == 0) == (a == b)


def test_native_word_distance_against_python(spark):
    rows = [("a b c", "a c"), ("x", "y z"), ("a a b", "b a a"), ("é ü", "é u")]
    d = spark.createDataFrame(rows, "c string, n string")
    got = [r[0] for r in d.select(mx.word_distance(F.split("c", " "), F.split("n", " "))).collect()]
    assert got == [mx.edit_distance(a.split(), b.split()) for a, b in rows]
    fast = [r[0] for r in d.select(mx.wer(F.col("c"), F.col("n"))).collect()]
    assert fast == [mx.edit_distance(a.split(), b.split()) / len(a.split()) for a, b in rows]


@pytest.mark.parametrize("word, expected", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("digitizer", "digit"), ("formaliti", "formal"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("clustering", "cluster"), ("clustered", "cluster")])
def test_stemmer_examples_of_the_paper(word, expected):
    assert stem(word) == expected


def test_unstemmed_overlap_native(spark):
    d = one(spark, c="the cat the mat", n="The cat, the cat!")
    o = d.select(mx.overlap(tx.overlap_tokens(F.col("c")), tx.overlap_tokens(F.col("n")), 1).alias("o")).first()["o"]
    assert (o["p"], o["r"], o["f"]) == (0.75, 0.75, 0.75)
    o = d.select(mx.overlap(tx.overlap_tokens(F.col("c")), tx.overlap_tokens(F.col("n")), 2).alias("o")).first()["o"]
    assert o["p"] == pytest.approx(2 / 3)


def test_preference_and_dispatch(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0)], "a double, b double")
    assert [r[0] for r in d.select(mx.preference(F.col("a"), F.col("b"))).collect()] == [2, 1, 0]
    with pytest.raises(ValueError):
        mx.evaluate(d, "a", "b", "nonsense")
    s = one(spark, c="abc", n="abd")
    assert mx.evaluate(s, "c", "n", "cer").first()["score"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("text, parts", [("A. B. C", ["A.", "B.", "C"]), ("plain", ["plain"]), ("A. ", ["A.", ""]), ("", [""])])
def test_sentences_and_merge(spark, text, parts):
    r = one(spark, t=text).select(tx.sentence_chunks(F.col("t")).alias("c")).first()["c"]
    assert [x["text"] for x in r] == parts
    assert [x["end"] - x["start"] for x in r] == [len(p) for p in parts]
    chunks = F.transform(tx.sentence_chunks(F.col("t")), lambda x, i: F.struct(i.alias("ord"), x["text"].alias("text"), x["start"].alias("start")))
    assert one(spark, t=text).select(tx.merge_chunks(chunks)).first()[0] == " ".join(parts)


def test_names(spark):
    d = one(spark, p=" a/x_AGAINST_b.json", q="x_vs_y", f="/d/e/book.json")
    r = d.select(tx.pair_sides(F.col("p")).alias("p"), tx.pair_sides(F.col("q")).alias("q"), tx.file_stem(F.col("f")).alias("f"), tx.denoised_file(F.col("f"), F.lit("o/m")).alias("n"), tx.judgement_file(F.col("f"), F.lit("z.json")).alias("j")).first()
    assert (r["p"]["a"], r["p"]["b"], r["q"]["a"], r["q"]["b"]) == ("a/x", "b", "x", "y")
    assert (r["f"], r["n"], r["j"]) == ("book", "book_denoised_o-m.json", "book_Against_z.json")
    m = one(spark, t="x\n\nDenoised text: a\n\nDenoised text: b ").select(tx.after_marker(F.col("t"))).first()[0]
    assert m == "b"
    assert d.select(tx.alias(F.lit("k"), {"k": "short"})).first()[0] == "short"
    with pytest.raises(Exception):
        d.select(tx.known_model(F.lit("zzz"), {"gemma": "g"})).collect()


def test_overlap_of_repeated_grams(spark):
    rows = [("a a a b", "a a b b"), ("", "a"), ("x " * 300, "x " * 200 + "y"), (None, "a")]
    d = spark.createDataFrame(rows, "r string, h string").select(mx.overlap(tx.overlap_tokens(F.col("r")), tx.overlap_tokens(F.col("h")), 1).alias("o"))
    got = [r["o"] for r in d.collect()]
    assert [got[0]["p"], got[0]["r"]] == [0.75, 0.75] and got[1]["f"] == 0.0 and [got[2]["p"], got[2]["r"]] == pytest.approx([200 / 201, 200 / 300])


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 7, 64, 500)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", tx.running_sums(F.col("a")).alias("s")).collect():
        assert r["s"] == [sum(r["a"][: k + 1]) for k in range(len(r["a"]))]


def test_word_error_rate_of_many_different_words(spark):
    """More different words than one plane of code points has, and, with a lower limit, than all have: the rate is never null."""
    a = " ".join(f"w{k}" for k in range(3000))
    b = " ".join(f"w{k}" if k % 1000 else f"v{k}" for k in range(3000))
    d = spark.createDataFrame([(a, b)], "r string, h string")
    assert d.select(mx.wer(F.col("r"), F.col("h"))).first()[0] == pytest.approx(0.001)
    old = mx._ALPHABET_LIMIT
    mx._ALPHABET_LIMIT = 2500
    try:
        assert d.select(mx.wer(F.col("r"), F.col("h"))).first()[0] == pytest.approx(0.001)
    finally:
        mx._ALPHABET_LIMIT = old
