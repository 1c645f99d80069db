import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import agreement as ag
from pageloom.operators import datasets as ds
from pageloom.operators import denoise as dn
from pageloom.operators import summary as sm
from pageloom.schema import CRITERIA


def plain_kappa(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    pe = sum(sum(a == k for a, _ in pairs) * sum(b == k for _, b in pairs) for k in {x for p in pairs for x in p}) / n**2
    return (po - pe) / (1 - pe) if pe < 1 and n > 1 else None


def test_kappa(spark):
    random.seed(3)
    rows = [(random.choice("xy"), random.choice([0, 1, 2]), random.choice([0, 1, 2])) for _ in range(200)] + [("z", 1, 1), ("w", 1, 1), ("w", 1, 1), ("x", None, 1)]
    d = spark.createDataFrame(rows, "k string, a int, b int")
    got = {r["k"]: r["kappa"] for r in ag.kappa_with_overall(d, "k").collect()}
    for k in "xy":
        assert got[k] == pytest.approx(plain_kappa([(a, b) for x, a, b in rows if x == k and a is not None]))
    assert got["all"] == pytest.approx(plain_kappa([(a, b) for _, a, b in rows if a is not None]))
    assert got["z"] is None and got["w"] is None


def test_labels_from_wrapped_answers(spark):
    raws = ['{"fluency": 1}', '"{\\"fluency\\": \\"2\\"}"', '```json\n{"fluency": 0}\n```', "\n{\"fluency\": 1", "error 503", "", None]
    d = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [r[0] for r in d.select(ag.parsed_label(F.lit(None), F.col("raw"), "fluency")).collect()]
    assert got == [1, 2, 0, None, None, None, None]


def test_winner_rule(spark):
    cases = [((1, 2, 0, 0), 2), ((1, 1, 2, 0), 1), ((2, 0, 1, 0), 2), ((0, 0, 1, 2), 2), ((0, 0, 0, 0), 1)]
    for c, want in cases:
        assert spark.range(1).select(ag.winner(*map(F.lit, c), coin=F.lit(True))).first()[0] == want


def test_swap_is_its_own_inverse(spark):
    d = spark.createDataFrame([(x, s) for x in (0, 1, 2, None) for s in (True, False)], "x int, s boolean")
    once = ag.swapped(F.col("x"), F.col("s"))
    assert all(r["x"] == r["y"] for r in d.select("x", ag.swapped(once, F.col("s")).alias("y")).collect())


def test_metric_summary(spark):
    d = spark.createDataFrame([("m", 1.0, 0.0), ("m", 3.0, None), ("m", 8.0, 4.0)], "s string, cer double, wer double")
    got = {r["metric"]: r for r in sm.metric_summary(d, "s", ("cer", "wer")).collect()}
    assert (got["cer"]["mean"], got["cer"]["median"]) == (4.0, 3.0)
    assert got["cer"]["std"] == pytest.approx((26 / 3) ** 0.5)
    assert (got["wer"]["mean"], got["wer"]["median"], got["wer"]["std"]) == (2.0, 2.0, 2.0)


def test_distribution_and_wins(spark):
    rows = [("a", "b", "c", x) for x in (1, 1, 2, 0, 9, None)] + [("b", "d", "c", 2)]
    long = spark.createDataFrame(rows, "x string, y string, criterion string, label int")
    dist = sm.label_distribution(long, ["x", "y"])
    assert {(r["x"], r["label_0"], r["label_1"], r["label_2"]) for r in dist.collect()} == {("a", 1, 2, 1), ("b", 0, 0, 1)}
    rates = {r["system"]: (r["wins"], r["contests"], r["rate"]) for r in sm.win_rates(sm.win_tally(dist, "x", "y")).collect()}
    assert rates == {"a": (1, 1, 1.0), "b": (0, 2, 0.0), "d": (1, 1, 1.0)}


def test_matrix_last_wins_mode_and_offset(spark):
    long = spark.createDataFrame([(1, c, k % 3, k) for k, c in enumerate(CRITERIA)] + [(1, "fluency", None, 9), (1, "fluency", 2, 8)], "page int, criterion string, label int, f int")
    assert sm.label_matrix(long, ["page"]).first()["fluency"] == 2
    assert {r["criterion"]: r["label"] for r in sm.last_wins(long, ["page"], "f").collect()}["fluency"] == 2
    v = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 3), (1, "b", 2)], "k int, v string, o int")
    assert sm.first_seen_mode(v, ["k"], "v", "o").first()["v"] == "b"
    assert [r["offset"] for r in sm.running_offset(v, ["k"], "o", F.length("v")).orderBy("o").collect()] == [0, 1, 2, 3]


def test_strict_join_fails_on_a_missing_partner(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string"), spark.createDataFrame([(1, "z")], "k int, u string")
    assert ds.strict_join(b, a, "k").count() == 1
    with pytest.raises(Exception, match="no partner"):
        ds.strict_join(a, b, "k").collect()
    assert {(r["k"], r["side"]) for r in ds.unmatched(a, b, "k").collect()} == {(2, "left")}


def test_merge_numbers_all_rows(spark):
    a = spark.createDataFrame([(5,), (1,)], "page_id int")
    b = spark.createDataFrame([(1,), (0,)], "page_id int")
    rows = ds.merge_datasets([a, b], "page_id").orderBy("new_id").collect()
    assert [(r["part_no"], r["page_id"], r["new_id"]) for r in rows] == [(0, 1, 0), (0, 5, 1), (1, 0, 2), (1, 1, 3)]
    assert ds.merge_datasets([a.limit(0)], "page_id").count() == 0


@pytest.mark.parametrize("n, ratio", [(0, 0.2), (1, 0.2), (10, 0.2), (101, 0.5), (7, 0.0), (7, 1.0)])
def test_hash_split_sizes(spark, n, ratio):
    got = ds.hash_split(spark.range(n).withColumnRenamed("id", "k"), "k", ratio)
    assert got.where("split = 'train'").count() == int(n * (1 - ratio) + 1e-9) and got.count() == n


def test_published_split():
    _, test = ds.shuffled_split(list(range(48)), 0.5, 42)
    assert test == [20, 22, 47, 44, 0, 19, 16, 42, 13, 38, 45, 2, 27, 37, 5, 34, 6, 8, 14, 15, 17, 1, 7, 40]


def test_small_dataset_operators(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert [r["s"] for r in ds.with_defaults(keys, {"s": a}, "k", "t").orderBy("k").collect()] == ["x", "", ""]
    assert ds.subset(keys, "k", [1, 9]).count() == ds.subset(keys, "k", a.select("k").limit(1)).count() == 1
    assert ds.shared_keys(keys, a, key="k").count() == 2
    assert ds.sft_records(a.withColumn("c", F.lit("y")), "t", "c").count() == 1
    assert {r["t"] for r in ds.upsert(a, spark.createDataFrame([(2, "n")], "k int, t string"), "k").collect()} == {"x", "n"}
    names = spark.createDataFrame([("g", "run-9"), ("g", "run-10"), ("g", "final")], "g string, n string")
    assert ds.latest_by_suffix(names, ["g"], "n").first()["n"] == "run-10"
    z = spark.range(1).select(ds.positional_pairs(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("z")).first()["z"]
    assert [(x["a"], x["b"]) for x in z] == [(1, 3)]


def test_majority_vote(spark):
    d = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a c"), (1, 2, "a b d"), (2, 0, None), (2, 1, ""), (3, 0, "x y z"), (3, 1, "q")], "k int, att int, t string")
    got = {r["k"]: r["voted"] for r in dn.majority_text(d, ["k"], "att", "t").collect()}
    assert got == {1: "a b", 2: "", 3: "x y z"}


def test_denoise_with_votes(spark):
    d = spark.createDataFrame([(1, "Tbe cat. On tbe mat"), (2, None)], "k int, t string")
    out = dn.denoise(d, ["k"], "t", dn.dictionary_backend({"Tbe": "The", "tbe": "the"}), attempts=3, mode="complex", shots=(("a", "b"),))
    # the complex mode labels its inputs, and this backend answers with the whole message
    assert {r["k"]: r["denoised"] for r in out.collect()} == {1: "Input: The cat. Input: On the mat"}
    with pytest.raises(ValueError):
        dn.messages(F.lit("x"), "strange")


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("503")
        return "ok"

    assert dn.with_retry(call, lambda e: "503" in str(e), sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(ZeroDivisionError):
        dn.with_retry(lambda: 1 / 0, lambda e: False)
    with pytest.raises(RuntimeError):
        dn.with_retry(lambda: (_ for _ in ()).throw(OSError("503")), lambda e: True, retries=1, sleep=waits.append)


def test_numbering_over_many_parts(spark):
    d = spark.range(5000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b"), F.lit("x").alias("other")).repartition(8)
    got = ds.numbered(d, ["a", "b"]).collect()
    assert [r["new_id"] for r in sorted(got, key=lambda r: (r["a"], r["b"]))] == list(range(5000))
    assert ds.numbered(d.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("ratio", [0.0, 0.2, 0.5, 1.0])
def test_split_has_exact_sizes_and_keeps_keys_together(spark, ratio):
    d = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    rows = ds.hash_split(d, "k", ratio).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r["k"], set()).add(r["split"])
    assert len(rows) == 3000 and all(len(s) == 1 for s in sides.values())
    assert sum("train" in s for s in sides.values()) == int(1000 * (1 - ratio) + 1e-9)
    assert ds.hash_split(d.limit(0), "k", ratio).count() == 0


def test_quantiles_against_numpy(spark):
    import numpy as np

    from pageloom.operators import summary as sm

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=999).tolist(), "b": [1.0] * 50 + [2.0], "c": [5.0], "d": np.round(rng.exponential(size=400), 1).tolist()}
    d = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "s string, cer double").repartition(6)
    got = {r["s"]: r for r in sm.box_summary(d, "s", ("cer",)).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert [got[k][c] for c in ("n", "low", "q1", "median", "q3", "high")] == pytest.approx([len(vs), *np.quantile(vs, [0, 0.25, 0.5, 0.75, 1])])
    assert {r["s"]: r["median"] for r in sm.metric_summary(d, "s", ("cer",)).collect()} == pytest.approx({k: np.median(v) for k, v in values.items()})


def test_paired_merge_is_strict(spark):
    c = spark.createDataFrame([(2, "two"), (1, "one")], "page_id int, text string")
    n = spark.createDataFrame([(1, "0ne"), (2, "tw0")], "page_id int, text string")
    got = ds.merge_paired_datasets([c, c], [n, n], "page_id").orderBy("new_id").collect()
    assert [(r["part_no"], r["page_id"], r["new_id"], r["clean"], r["noisy"]) for r in got] == [(0, 1, 0, "one", "0ne"), (0, 2, 1, "two", "tw0"), (1, 1, 2, "one", "0ne"), (1, 2, 3, "two", "tw0")]
    for other in (n.limit(1), n.unionByName(n)):
        with pytest.raises(Exception, match="not one clean and one noisy page"):
            ds.merge_paired_datasets([c], [other], "page_id").collect()
    with pytest.raises(ValueError):
        ds.merge_paired_datasets([c], [], "page_id")


def test_votes_in_arrays_and_rows(spark):
    cases = [(["a b", "a c", "a b d"], "a b"), (["x", None, None], "x"), ([None, None], None), (["", " ", "a"], ""), (["b a", "c a", "c b"], "c a"), ([], None)]
    d = spark.createDataFrame(cases, "a array<string>, want string")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", dn.majority_of(F.col("a"))).collect())


def test_judge_turns_labels_back(spark):
    rows = spark.createDataFrame([(k, "clean", "ocr", "long answer" if k % 2 else "x", "short") for k in range(20)] + [(99, None, None, None, None)], "k int, c string, o string, a string, b string")
    got = {r["k"]: r for r in dn.judge(rows, ["k"], "c", "o", "a", "b", dn.length_judge).collect()}
    assert all(got[k]["fluency"] == (1 if k % 2 else 2) for k in range(20)) and got[99]["overall_winner"] == 0
    broken = dn.judge(rows, ["k"], "c", "o", "a", "b", lambda: lambda ps: ["no json" if i % 2 else '{"fluency": 7}' for i, _ in enumerate(ps)])
    assert {r["fluency"] for r in broken.collect()} == {None}


def test_backend_is_asked_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def backend(prompts):
            with open(log, "a") as f:
                f.write("x")
            if len(open(log).read()) < 3:
                raise TimeoutError
            return [p[-1]["content"] for p in prompts]

        return backend

    d = spark.createDataFrame([(1, "t")], "k int, text string").coalesce(1)
    out = dn.denoise(d, ["k"], "text", factory, transient=lambda e: isinstance(e, TimeoutError), retries=2)
    assert [tuple(r) for r in out.collect()] == [(1, "t")]
