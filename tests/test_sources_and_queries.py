import datetime
import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pageloom.sources import pages as src
from pageloom.streaming import scores

SF = "/root/testdata/sf0.001"


def test_page_objects_round_trip(spark, tmp_path):
    (tmp_path / "book.json").write_text('{"10": "b\\nc", "2": "a", "2": "last", "3": null}')
    (tmp_path / "broken.json").write_text('["no object"')
    rows = {r["page_id"]: r["text"] for r in src.read_pages(spark, str(tmp_path)).collect()}
    assert rows == {10: "b\nc", 2: "last", 3: None}
    out = str(tmp_path / "out")
    src.write_pages(src.read_pages(spark, str(tmp_path / "book.json")).select("page_id", "text").where("text is not null"), out)
    text = "".join(open(f).read() for f in glob.glob(out + "/part-*"))
    assert json.loads(text) == {"10": "b\nc", "2": "last"}


def test_judgements_of_every_kind(spark, tmp_path):
    body = {"0": {"faithfulness": 1, "fluency": 2, "completeness": 0, "no_hallucinations": 1, "overall_winner": 1}, "1": '\n{"faithfulness": 2, "overall_winner": 2}', "2": None, "3": "no json"}
    (tmp_path / "a_AGAINST_b.json").write_text(json.dumps(body))
    got = {r["page_id"]: (r["faithfulness"], r["overall_winner"]) for r in src.read_judgements(spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (None, None), 3: (None, None)}


def test_other_sinks(spark, tmp_path):
    (tmp_path / "tale.txt").write_text("one\ntwo")
    assert src.read_book(spark, str(tmp_path / "tale.txt")).first()["text"] == "one\ntwo"
    long = spark.createDataFrame([(1, "fluency", 2), (1, "faithfulness", None)], "page_id int, criterion string, label int")
    src.write_by_criterion(long, str(tmp_path / "c"))
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "c" / "criterion=*"))) == ["criterion=faithfulness", "criterion=fluency"]
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    src.register(str(tmp_path / "r.json"), "a", {"x": 1})
    assert src.register(str(tmp_path / "r.json"), "a", {"x": 2}) == {"a": {"x": 2}}
    spark.createDataFrame([("o", "c")], "text string, corrected_text string").write.parquet(str(tmp_path / "p"))
    assert src.read_paired_corpus(spark, str(tmp_path / "p"), 1.0).first()["clean"] == "c"
    src.write_records(spark.createDataFrame([("i", "a", "b")], "instruction string, input string, output string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["input"] == "a"


def test_stream_scores_and_windows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, "abc", "abd", t), (1, "abc", "abd", t), (2, "xy", "xy", t + datetime.timedelta(days=20))]
    d = spark.createDataFrame(rows, "k int, c string, n string, at timestamp")
    d.write.parquet(str(tmp_path / "in"))
    s = scores.answers_stream(spark, str(tmp_path / "in"), d.schema)
    scores.run_available(scores.native_scores(scores.without_repeats(s, ["k"], "at"), "c", "n"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {(r["k"], round(r["cer"], 3)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0.333), (2, 0.0)}
    w = scores.windowed_counts(scores.answers_stream(spark, str(tmp_path / "in"), d.schema), "at", ["k"])
    scores.run_available(w, str(tmp_path / "wo"), str(tmp_path / "wc"))
    assert {(r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "wo")).collect()} == {(1, 2)}


def _names():
    from pageloom.plans import queries, texts  # noqa: F401

    return sorted(queries.ORACLES)


def _canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    f = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(f(r[i]) for i in order) for r in rows], key=repr), sorted(columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", _names())
def test_query_against_sql(spark, name):
    from pageloom.plans import queries

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    want = _canon(cur.fetchall(), [c[0] for c in cur.description])
    assert _canon([tuple(r) for r in got.collect()], got.columns) == want


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).select(F.count("*")).first()[0] > 0


def test_report_of_a_scan(spark, tmp_path):
    from pageloom.sources import pages as src

    for name, text in (("a.json", '{"0": "x", "1": "y"}'), ("b.json", "{}"), ("c.json", "[1")):
        (tmp_path / name).write_text(text)
    got = {r["file"]: (r["status"], r["entries"]) for r in src.object_report(spark, str(tmp_path), ["a", "b", "c", "d"]).collect()}
    assert got == {"a": ("ok", 2), "b": ("empty", 0), "c": ("broken", 0), "d": ("missing", 0)}


def test_command_line(spark, tmp_path):
    import json

    from pageloom.__main__ import main

    def folder(name, pages):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.json").write_text(json.dumps(pages))
        return str(tmp_path / name)

    clean, noisy = folder("clean", {"0": "The cat sat.", "1": "On it."}), folder("noisy", {"0": "Tbe cat sat.", "1": "On it."})
    out = str(tmp_path / "out")
    main(["merge_datasets", out, "--clean", clean, clean, "--noisy", noisy, noisy])
    assert json.loads(spark.read.text(f"{out}/noisy").first()[0]) == {"0": "Tbe cat sat.", "1": "On it.", "2": "Tbe cat sat.", "3": "On it."}
    main(["denoise", noisy, out + "2", "--backend", "tests.backends:echo"])
    assert json.loads(spark.read.text(out + "2").first()[0]) == {"0": "Tbe cat sat.", "1": "On it."}
    main(["evaluate_metrics", clean, noisy, out + "3"])
    assert {r["page_id"]: round(r["wer"], 3) for r in spark.read.json(out + "3").collect()} == {0: 0.333, 1: 0.0}
    main(["evaluate_judge", clean, noisy, clean, noisy, out + "4", "--judge", "pageloom.operators.denoise:length_judge"])
    assert {r["fluency"] for r in spark.read.json(out + "4").collect()} == {0}
