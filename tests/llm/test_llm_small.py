"""Splitting, packing, look-alikes, ranking and consensus on small cases."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import consensus, packing, ranking, skeleton, splitting

# ---- splitting


def pieces(spark, texts, limit=20, overlap=4):
    d = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "id int, text string, piece_no int")
    return splitting.split_texts(d, "text", limit, overlap).orderBy("id", "piece_no").collect()


def test_pieces_rebuild_the_text(spark):
    random.seed(5)
    texts = ["".join(random.choice(["a", "bc. ", "d, ", "efghij", "\n\n", " ", "é", "𝄞"]) for _ in range(random.randrange(1, 60))) for _ in range(60)] + ["x" * 75, "  lead " + "word " * 9]
    rows = pieces(spark, texts)
    for i, t in enumerate(texts):
        own = [r for r in rows if r["id"] == i]
        body = t.strip()
        lead = len(t) - len(t.lstrip()) if body else 0
        assert all(len(r["piece"]) <= 20 and r["piece"] == t[r["piece_start"] : r["piece_end"]] for r in own)
        if len(body) > 20:
            assert own[0]["piece_start"] == lead and own[-1]["piece_end"] == lead + len(body)
            assert all(b["piece_start"] == a["piece_end"] - 4 for a, b in zip(own, own[1:]))
            assert {r["cut_kind"] for r in own} == {"forced" if re.search(r"\S{21}", body) else "natural"}
        else:
            assert [r["piece"] for r in own] == [body] and own[0]["cut_kind"] == "whole"


def test_split_edges(spark):
    rows = pieces(spark, [None, "", "   ", "a ", "word " * 4000])
    assert {r["id"] for r in rows} == {1, 2, 3, 4}
    assert [r["piece"] for r in rows if r["id"] == 3] == ["a"]
    natural = [r for r in rows if r["id"] == 4]
    assert len(natural) > 1000 and all(r["piece"].startswith((" ", "word")) or r["piece_no"] for r in natural)
    with pytest.raises(ValueError):
        pieces(spark, ["x"], 10, 10)
    assert pieces(spark, []) == []


def test_sentence_ends_are_preferred(spark):
    got = [r["piece"] for r in pieces(spark, ["abc def gh. ijk lmn opq rst"], 20, 0)]
    assert got[0] == "abc def gh. "


# ---- packing

sizes = st.lists(st.integers(1, 50), max_size=60)


@settings(max_examples=80, deadline=None)
@given(sizes)
def test_bound_and_packing(xs):
    a = np.array(xs, dtype=np.int64)
    bound, bins = packing.lower_bound(a, 50), packing.best_fit_decreasing(a, 50)
    if not xs:
        assert bound == 0 and len(bins) == 0
        return
    used = np.bincount(bins, a)
    assert used.max() <= 50 and bound <= len(used) <= 11 / 9 * max(bound, 1) + 4
    assert bound >= -(-sum(xs) // 50)


def test_best_fit_against_plain_search():
    random.seed(6)
    xs = [random.randrange(1, 40) for _ in range(200)]
    free, plain = [], {}
    for i in sorted(range(200), key=lambda i: -xs[i]):
        fits = [b for b in range(len(free)) if free[b] >= xs[i]]
        b = min(fits, key=lambda b: free[b]) if fits else len(free)
        if not fits:
            free.append(40)
        free[b] -= xs[i]
        plain[i] = b
    bins = packing.best_fit_decreasing(np.array(xs), 40)
    assert bins.max() + 1 == len(free)
    assert sorted(np.bincount(bins, xs)) == sorted(40 - f for f in free)


def test_pack_containers(spark):
    rows = [(1, "a b c"), (2, "x " * 25), (3, None), (4, ""), (5, " ,, .. "), (6, "d e"), (6, "d e"), (7, "f"), (None, "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack_containers(d, "doc_id", packing.word_tokens(F.col("text")), 10, group_rows=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert [sorted(r["size"] for r in by[2]), {r["pieces"] for r in by[2]}] == [[5, 10, 10], {3}]
    assert len(by[6]) == 1 and by[3][0]["container"] is None and by[4][0]["container"] is None
    fill = {}
    for r in got:
        if r["container"]:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 10
    assert packing.pack_containers(d.limit(0), "doc_id", packing.word_tokens(F.col("text")), 10).count() == 0


def test_tokens(spark):
    texts = ["a_1 b-c", "“né” x!!", "é", None, "a b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(packing.word_tokens(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t)) if t else 0 for t in texts]


def test_public_tokenizer(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    d = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(packing.public_tokens(path)(F.col("t"))).collect()] == [2, 0, 0]


def test_partitions_with_gaps_exchange(spark):
    random.seed(7)
    rows = [(i, random.choice([26, 27, 34, 35, 13])) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, n int")
    one = packing.pack_containers(d, "id", F.col("n"), 100, group_rows=10, rounds=0).select("container").distinct().count()
    two = packing.pack_containers(d, "id", F.col("n"), 100, group_rows=10, rounds=2).select("container").distinct().count()
    assert two <= one


# ---- look-alikes


def test_skeleton_classes():
    same = [("ｆｕｌｌ，", "full,"), ("cаfé", "café"), ("a b​c", "a bc"), ("ⅼіne", "line"), ("Å", "Å")]
    for a, b in same:
        assert skeleton.skeleton(a) == skeleton.skeleton(b)
    for a, b in [("ſ", "s"), ("é", "e"), ("l", "1"), ("m", "rn"), ("“", '"'), ("-", "—"), ("a,", "a")]:
        assert skeleton.skeleton(a) != skeleton.skeleton(b)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_skeleton_is_stable(t):
    s = skeleton.skeleton(t)
    assert skeleton.skeleton(s) == s == unicodedata.normalize("NFD", s)


def test_look_alike_pairs(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, ""), (6, "​"), (7, "x y"), (8, "x y"), (8, "x y"), (9, "solo")]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("look", F.lit(1))
    assert {tuple(r) for r in skeleton.look_alike_pairs(d, "doc_id", "text").collect()} == {(1, 2), (2, 3), (5, 6), (7, 8)}
    classes = {r["class_id"]: (r["members"], r["texts"]) for r in skeleton.look_alike_classes(d, "doc_id", "text").collect()}
    assert classes[1] == (3, 2) and classes[9] == (1, 1)
    assert skeleton.look_alike_pairs(d.limit(0), "doc_id", "text").count() == 0
    forms = [r[0] for r in d.orderBy("doc_id").select(skeleton.consistent_form(F.col("text"))).collect()]
    assert forms[1] == "abc" and forms[3] is None


# ---- ranking

NAMES = [("s-a", "s/a", "A1"), ("s-b", "s/b", "B1"), ("s-c", "s/c", "C1"), ("lonely", "lonely", None)]


def votes_table(spark, rows):
    schema = "pair string, page_id long, faithfulness byte, fluency byte, completeness byte, no_hallucinations byte, overall_winner byte, raw string, judged_at timestamp, loaded_at timestamp"
    full = []
    for n, (pair, label, raw) in enumerate(rows):
        full.append((pair, n, None, None, None, None, label, raw, None, None))
    return spark.createDataFrame(full, schema)


def test_cg_solves_the_laplacian():
    rng = np.random.default_rng(1)
    a, b = np.array([0, 0, 1, 2, 3]), np.array([1, 2, 2, 3, 0])
    s, w = rng.normal(size=4), rng.uniform(1, 5, size=5)
    x = ranking.laplacian_cg(a, b, s[a] - s[b], w, 4)
    assert np.allclose(x - x.mean(), s - s.mean(), atol=1e-6)
    assert np.allclose(ranking.laplacian_cg(a, b, np.zeros(5), w, 4), 0)


def test_ranking_of_messy_votes(spark):
    rows = [("s-a_AGAINST_s-b", 1, None)] * 30 + [(" S/A_against_b1.json", 2, None)] * 5 + [("s-b_vs_s-a", 2, None)] * 10
    rows += [("s-b_AGAINST_s-c", None, '```json\n{"overall_winner": 1}\n```')] * 20 + [("s-b_AGAINST_s-c", None, '{"overall_winner": "2"}')] * 4
    rows += [("s-a_AGAINST_s-a", 1, None), ("s-a_AGAINST_s-b", 9, None), ("s-a_AGAINST_unknown", 1, None), (None, 1, None), ("s-a_AGAINST_s-b", None, "error")]
    systems = spark.createDataFrame(NAMES, "sys_name string, hub_path string, short_alias string")
    v = ranking.usable_votes(votes_table(spark, rows), systems, "overall_winner")
    assert v.count() == 69
    edges = ranking.margins(v)
    ranked = ranking.strengths(edges)
    order = [r["item"] for r in ranked.orderBy(F.col("strength").desc()).collect()]
    assert order == ["s-a", "s-b", "s-c"]
    far = {r["item"]: r["strength"] for r in ranking.strengths(edges, driver_edges=0).collect()}
    near = {r["item"]: r["strength"] for r in ranked.collect()}
    assert all(abs(near[k] - far[k]) < 1e-3 for k in near)
    got = {r["sys_name"]: r["band"] for r in ranking.bands(systems, ranked, "sys_name", 4).collect()}
    assert got == {"s-a": 1, "s-b": 2, "s-c": 3, "lonely": 4}
    res = ranking.residuals(edges, ranked).collect()
    assert all(abs(r["residual"]) < 1e-6 for r in res)  # a tree has no cycle
    empty = ranking.strengths(ranking.margins(v.limit(0)))
    assert empty.count() == 0 and ranking.bands(systems, empty, "sys_name", 4).count() == 4


def test_repeated_votes_count_once(spark):
    systems = spark.createDataFrame(NAMES, "sys_name string, hub_path string, short_alias string")
    t = votes_table(spark, [("s-a_AGAINST_s-b", 1, None)])
    assert ranking.usable_votes(t.unionByName(t), systems, "overall_winner").count() == 1


# ---- consensus


def test_consensus_and_faults(spark):
    random.seed(8)
    rows, truth = [], {}
    for i in range(150):
        t = truth[i] = random.choice([0, 1, 2])
        for who in ("a", "b", "c", "d"):
            rows.append((i, who, t if random.random() < 0.9 else random.choice([0, 1, 2]), 1))
        rows.append((i, "swap", {0: 0, 1: 2, 2: 1}[t], 1))
        rows.append((i, "rand", random.choice([0, 1, 2]), 1))
        rows.append((i, "same", 1, 1))
    rows += [(i, "a", truth[i], 2) for i in range(5)] + [(0, "b", None, 3), (1, "b", 7, 3), (None, "a", 1, 1), (3, None, 1, 1), (999, "a", 2, 1)]
    d = spark.createDataFrame(rows, "item int, who string, overall int, at int")
    labels = consensus.latest_labels(d, ["item"], "who", ["overall"], ["at"])
    assert labels.where("item = 0 and annotator = 'b'").count() == 0  # the latest row has no usable label
    post, params = consensus.fit(labels, ["item"])
    got = {r["item"]: r for r in consensus.consensus(post, ["item"]).collect()}
    assert sum(got[i]["label"] == t for i, t in truth.items()) >= 140 and got[999]["label"] == 2 and got[999]["agreement"] is None
    report = consensus.annotator_report(post, params)
    assert {r["annotator"]: r["fault"] for r in consensus.faults(report).collect()} == {"swap": "swapped", "rand": "random", "same": "constant"}
    skill = {r["annotator"]: r["competence"] for r in report.collect()}
    assert min(skill[w] for w in "abcd") > 0.7 > 0.3 > max(skill[w] for w in ("swap", "rand", "same"))


def test_consensus_of_nothing(spark):
    d = spark.createDataFrame([], "item int, who string, overall int, at int")
    post, params = consensus.fit(consensus.latest_labels(d, ["item"], "who", ["overall"], ["at"]), ["item"])
    assert consensus.consensus(post, ["item"]).count() == 0 and consensus.faults(consensus.annotator_report(post, params)).count() == 0


@pytest.mark.parametrize("others", [0, 300])
def test_both_ways_of_a_round_agree(spark, others):
    """Parameters in arrays and in tables: the same probabilities and the same next parameters."""
    rng = random.Random(14)
    rows = [(i, w, t if rng.random() < p else rng.choice([0, 1, 2]), 1) for i in range(60) for t in [rng.choice([0, 1, 2])] for w, p in (("a", 0.9), ("b", 0.7), ("c", 0.1), ("d", 0.8))]
    rows += [(k % 60, f"once{k}", k % 3, 1) for k in range(others)]
    labels = consensus.latest_labels(spark.createDataFrame(rows, "item int, who string, overall int, at int"), ["item"], "who", ["overall"], ["at"]).cache()
    outs = []
    for few in (1000, 0):
        post, params = consensus.fit(labels, ["item"], few=few, tol=2.0)  # one round
        outs.append(({(r["annotator"], r["k"]): (r["c"], r["g"]) for r in params.collect()}, {r["item"]: [r["p0"], r["p1"], r["p2"]] for r in post.collect()}))
    for x, y in zip(*outs):
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k]) for k in x)


def test_extrapolation_keeps_the_fixed_point():
    """Parameters that approach a limit by a constant factor are taken to it."""
    at = lambda d: {("o", "a", t): (0.6 + d, (0.5 + d, 0.3 - d, 0.2)[t]) for t in range(3)}
    out = consensus._ahead(at(0.08), at(0.04), at(0.02), 3)
    assert all(out[k] == pytest.approx(v, abs=1e-9) for k, v in at(0.0).items())
    assert consensus._ahead(at(0.1), at(0.1), at(0.1), 3) == at(0.1)


def test_one_rule_to_stop(spark):
    labels = spark.createDataFrame([("o", i, w, i % 3) for i in range(30) for w in "abc"], "criterion string, item int, annotator string, label int")
    with pytest.raises(RuntimeError):
        consensus.fit(labels, ["item"], rounds=1)
    with pytest.raises(RuntimeError):
        consensus.fit(labels, ["item"], rounds=1, few=0)


def test_agreement_beyond_chance(spark):
    """Against the definition over all pairs of labels of an item."""
    rng = random.Random(15)
    rows = [("o", i, w, rng.choice([0, 1, 2]) if rng.random() < 0.5 else i % 3) for i in range(40) for w in "abcde"[: rng.randrange(1, 6)]]
    d = spark.createDataFrame(rows, "criterion string, item int, annotator string, label int")
    items = {}
    for _, i, _, v in rows:
        items.setdefault(i, []).append(v)
    items = {i: v for i, v in items.items() if len(v) > 1}
    n = sum(map(len, items.values()))
    seen = sum(sum(a != b for j, a in enumerate(v) for b in v[:j] + v[j + 1 :]) / (len(v) - 1) for v in items.values()) / n
    pool = [x for v in items.values() for x in v]
    chance = sum(a != b for j, a in enumerate(pool) for b in pool[:j] + pool[j + 1 :]) / (n * (n - 1))
    r = consensus.chance_corrected_agreement(d, ["item"]).first()
    assert (r["items"], r["labels"]) == (len(items), n) and r["alpha"] == pytest.approx(1 - seen / chance)
    assert consensus.chance_corrected_agreement(d.withColumn("label", F.lit(1)), ["item"]).first()["alpha"] is None
    assert consensus.chance_corrected_agreement(d.limit(0), ["item"]).count() == 0


@pytest.mark.parametrize("size", [0, 1, 3, 4, 6, 17])
def test_bands_are_even(spark, size):
    items = spark.createDataFrame([(f"s{k:02}",) for k in range(size)], "name string")
    ranked = spark.createDataFrame([(f"s{k:02}", float(k % 5)) for k in range(size) if k != 2], "item string, strength double")
    got = {r["name"]: r["band"] for r in ranking.bands(items, ranked, "name", 4).collect()}
    order = sorted(got, key=lambda s: (s == "s02", -(int(s[1:]) % 5), s))
    assert [got[s] for s in order] == sorted(got.values()) and len(got) == size
    assert [sum(b == k for b in got.values()) for k in range(1, 5)] == [size // 4 + (k < size % 4) for k in range(4)]


def test_long_chains_of_comparisons(spark):
    """A graph that needs more than sixty steps: both ways to solve it reach the tolerance."""
    n = 90
    rng = random.Random(5)
    margins = [rng.uniform(-1, 1) for _ in range(n - 1)]
    a, b = np.arange(n - 1), np.arange(1, n)
    x = ranking.laplacian_cg(a, b, np.array(margins), np.array([rng.uniform(0.01, 10) for _ in range(n - 1)]), n)
    assert np.allclose(x[a] - x[b], margins, atol=1e-6)
    with pytest.raises(RuntimeError):
        ranking.laplacian_cg(a, b, np.array(margins), np.ones(n - 1), n, tol=-1.0)


def test_long_chains_in_tables(spark):
    n = 66
    edges = spark.createDataFrame([(f"i{k:03}", f"i{k + 1:03}", 1, 0.5, 1.0) for k in range(n - 1)], "a string, b string, n int, margin double, weight double")
    got = {r["item"]: r["strength"] for r in ranking.strengths(edges, driver_edges=0).collect()}
    assert all(got[f"i{k:03}"] - got[f"i{k + 1:03}"] == pytest.approx(0.5, abs=1e-6) for k in range(n - 1))
