"""Named queries over the whole test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.durable import durable, fresh_folder
from pageloom.functions import metrics as mx
from pageloom.functions import text as tx
from pageloom.operators import agreement as ag
from pageloom.operators import align as al
from pageloom.operators import datasets as ds
from pageloom.operators import denoise as dn
from pageloom.operators import errors as er
from pageloom.operators import noise as ns
from pageloom.operators import summary as sm
from pageloom.plans.stemsql import overlaps
from pageloom.schema import CRITERIA, METRICS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Tasks for stages that work long on little data, which adaptive execution would put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def system_aliases(systems: DataFrame) -> DataFrame:
    base = [F.lower("sys_name"), F.lower("hub_path"), F.lower("short_alias")]
    names = F.array_distinct(F.array(*base, *[tx.path_name(c) for c in base]))
    return systems.select("sys_name", F.explode(names).alias("alias")).where("alias is not null").distinct()


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page once, with text."""
    return table(spark, d, "ocr_pages").where("text is not null").select("dataset", "page_id", "lang", "text").distinct()


def triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_triples").select("pair", "page_id", "model1", "model2", "ground_truth").distinct()


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_rows").drop("loaded_at").distinct()


def votes(spark: SparkSession, d: str) -> DataFrame:
    return ag.sided(table(spark, d, "judge_rows").drop("loaded_at").distinct(), system_aliases(table(spark, d, "systems")))


def judge_labels(spark: SparkSession, d: str) -> DataFrame:
    """(side_a, side_b, page_id, judged_at, criterion, label): parsed, and turned so that 1 means side_a."""
    v = ag.judgements(votes(spark, d))
    v = v.select("side_a", "side_b", "page_id", "judged_at", *[ag.swapped(F.col(c), F.col("flipped")).alias(c) for c in CRITERIA])
    return ag.long_labels(v, ["side_a", "side_b", "page_id", "judged_at"])


def human_labels(spark: SparkSession, d: str) -> DataFrame:
    """The latest label of each annotator on a triple, long, turned so that 1 means side_a."""
    rows = table(spark, d, "human_rows").where("annotator_id is not null")
    last = rows.groupBy("pair", "page_id", "annotator_id").agg(F.max(F.struct("labelled_at", "loaded_at", *CRITERIA)).alias("r")).select("pair", "page_id", "annotator_id", "r.*")
    v = ag.sided(last, system_aliases(table(spark, d, "systems")))
    v = v.select("side_a", "side_b", "page_id", "annotator_id", *[ag.swapped(F.col(c).cast("int"), F.col("flipped")).alias(c) for c in CRITERIA])
    return ag.long_labels(v, ["side_a", "side_b", "page_id", "annotator_id"])


# SQL shared by the oracles
_NAMES = """names AS (
    SELECT DISTINCT sys_name, unnest([lower(sys_name), lower(hub_path), lower(short_alias), replace(lower(sys_name), '/', '-'), replace(lower(hub_path), '/', '-'), replace(lower(short_alias), '/', '-')]) AS alias FROM systems)"""
_SIDES = r"regexp_split_to_array(regexp_replace(trim(lower(pair)), '\.json$', ''), '_(?:against|vs)_')"
_PARSE = ", ".join(rf"""coalesce({c}::INT, try_cast(nullif(regexp_extract(regexp_extract(regexp_replace(raw, '\\+"', '"', 'g'), '(?s)\{{.*\}}', 0), '"{c}"\s*:\s*"?(-?[0-9]{{1,3}})\b', 1), '') AS INT)) AS {c}""" for c in CRITERIA)
_TURN = ", ".join(f"CASE WHEN flipped AND {c} IN (1, 2) THEN 3 - {c} ELSE {c} END AS {c}" for c in CRITERIA)
_JUDGE = rf"""{_NAMES},
rows_ AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM judge_rows),
sided AS (SELECT r.*, least(x.sys_name, y.sys_name) AS side_a, greatest(x.sys_name, y.sys_name) AS side_b, x.sys_name > y.sys_name AS flipped
    FROM (SELECT *, {_SIDES} AS sides FROM rows_) r JOIN names x ON x.alias = trim(r.sides[1]) JOIN names y ON y.alias = trim(r.sides[2])),
parsed AS (SELECT * EXCLUDE ({", ".join(CRITERIA)}), {_PARSE} FROM sided),
turned AS (SELECT side_a, side_b, page_id, judged_at, {_TURN} FROM parsed),
judge_long AS ({" UNION ALL ".join(f"SELECT side_a, side_b, page_id, judged_at, '{c}' AS criterion, {c} AS label FROM turned" for c in CRITERIA)})"""
_HUMAN = rf"""last_ AS (SELECT pair, page_id, annotator_id, {", ".join(f"{c}::INT AS {c}" for c in CRITERIA)} FROM human_rows WHERE annotator_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY pair, page_id, annotator_id ORDER BY labelled_at DESC NULLS LAST, loaded_at DESC NULLS LAST, {", ".join(f"{c} DESC NULLS LAST" for c in CRITERIA)}) = 1),
h_sided AS (SELECT r.*, least(x.sys_name, y.sys_name) AS side_a, greatest(x.sys_name, y.sys_name) AS side_b, x.sys_name > y.sys_name AS flipped
    FROM (SELECT *, {_SIDES} AS sides FROM last_) r JOIN names x ON x.alias = trim(r.sides[1]) JOIN names y ON y.alias = trim(r.sides[2])),
h_turned AS (SELECT side_a, side_b, page_id, annotator_id, {_TURN} FROM h_sided),
human_long AS ({" UNION ALL ".join(f"SELECT side_a, side_b, page_id, annotator_id, '{c}' AS criterion, {c} AS label FROM h_turned" for c in CRITERIA)})"""
_KAPPA = """cells AS (SELECT {by}, a, b, count(*) AS n FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
ra AS (SELECT {by}, a AS k, sum(n) AS ra, sum(CASE WHEN a = b THEN n ELSE 0 END) AS d FROM cells GROUP BY ALL),
rb AS (SELECT {by}, b AS k, sum(n) AS rb FROM cells GROUP BY ALL),
g AS (SELECT {by}, sum(coalesce(ra, 0)) AS n, sum(coalesce(d, 0)) AS d, sum(coalesce(ra, 0) * coalesce(rb, 0)) AS e FROM ra FULL JOIN rb USING ({by}, k) GROUP BY ALL)
SELECT {by}, n::BIGINT AS n, CASE WHEN n > 1 AND e / (n * n) < 1 THEN round((d / n - e / (n * n)) / (1 - e / (n * n)), 9) END AS kappa FROM g"""
_METRICS = "m AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM metric_rows), long AS (UNPIVOT m ON " + ", ".join(METRICS) + " INTO NAME metric VALUE value)"
_PAGES = "p AS (SELECT DISTINCT dataset, page_id, lang, text FROM ocr_pages WHERE text IS NOT NULL)"
_TRIPLES = "t AS (SELECT DISTINCT pair, page_id, model1, model2, ground_truth FROM annotation_triples)"
_DIGITS = 9


def _r(name: str, digits: int = _DIGITS):
    return F.round(name, digits).alias(name)


# ---- scores and their summaries


@query(f"WITH {_METRICS} SELECT sys_name, metric, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(stddev_pop(value), 9) AS std FROM long WHERE value IS NOT NULL GROUP BY ALL")
def metric_summary(spark, d):
    return sm.metric_summary(metric_rows(spark, d), "sys_name").select("sys_name", "metric", _r("mean"), _r("median"), _r("std"))


@query(f"WITH {_METRICS} SELECT sys_name, metric, count(*) AS n, min(value) AS low, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3, max(value) AS high FROM long WHERE value IS NOT NULL GROUP BY ALL")
def metric_boxes(spark, d):
    return sm.box_summary(metric_rows(spark, d), "sys_name").select("sys_name", "metric", "n", "low", _r("q1"), _r("median"), _r("q3"), "high")


@query("WITH m AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM metric_rows) SELECT sys_name, floor(greatest(cer, 1e-5) / 0.05)::BIGINT AS bin, count(*) AS n FROM m WHERE cer IS NOT NULL GROUP BY ALL")
def cer_histogram(spark, d):
    m = metric_rows(spark, d).where("cer is not null").withColumn("cer", sm.log_clamped(F.col("cer")))
    return sm.histogram(m, "sys_name", "cer", 0.05)


def answers(spark, d) -> DataFrame:
    """(pair, page_id, side, sys_name, answer, ground_truth): both answers of each triple, in rows of their own."""
    sides = [F.struct(F.lit(n).alias("side"), F.col(f"model{n}").alias("answer")) for n in (1, 2)]
    t = triples(spark, d).where("ground_truth is not null").select("pair", "page_id", "ground_truth", F.explode(F.array(*sides)).alias("x"))
    name = tx.pair_sides(F.col("pair"))
    return t.select("pair", "page_id", "x.side", F.when(F.col("x.side") == 1, name["a"]).otherwise(name["b"]).alias("sys_name"), "x.answer", "ground_truth").distinct()


def _scored(spark, d) -> DataFrame:
    return mx.evaluate(answers(spark, d).repartition(parts(spark), "pair", "page_id"), "ground_truth", "answer")


_SP = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_ANSWERS = """a AS (SELECT DISTINCT pair, page_id, side, ground_truth, answer FROM (
    SELECT pair, page_id, 1 AS side, ground_truth, model1 AS answer FROM annotation_triples UNION ALL SELECT pair, page_id, 2, ground_truth, model2 FROM annotation_triples) WHERE ground_truth IS NOT NULL)"""


# the words that both texts begin and end with are taken off; then one reference word a step, for all texts at once, a running minimum taking the insertions
_WER = rf"""w AS (SELECT id, pair, page_id, side, answer, regexp_replace(regexp_replace(ground_truth, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}{_SP}+', ' ', 'g') AS r, regexp_replace(regexp_replace(answer, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}{_SP}+', ' ', 'g') AS h FROM numbered),
s AS (SELECT id, list_filter(string_split(r, ' '), lambda z: z <> '') AS x, list_filter(string_split(h, ' '), lambda z: z <> '') AS y FROM w),
f AS (SELECT *, least(len(x), len(y)) AS n, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) AS a FROM s WHERE y IS NOT NULL),
g AS (SELECT id, x, y, a, coalesce(list_position(list_transform(range(0, n - a), lambda i: x[len(x) - i] = y[len(y) - i]), false) - 1, n - a) AS z FROM f),
m AS (SELECT id, x[a + 1 : len(x) - z] AS x, y[a + 1 : len(y) - z] AS y FROM g),
t AS (SELECT id, 0 AS i, len(x) AS nx, list_transform(x, lambda q: list_position(x, q)) AS xs, list_transform(y, lambda q: coalesce(list_position(x, q), 0)) AS ys FROM m),
xw AS MATERIALIZED (SELECT id, generate_subscripts(xs, 1) AS i, unnest(xs) AS c FROM t),
d AS (SELECT id, 0 AS i, 0 AS j, 0 AS v, -1 AS c FROM t UNION ALL SELECT id, 0, generate_subscripts(ys, 1), generate_subscripts(ys, 1), unnest(ys) FROM t),
r AS (SELECT id, i, j, v, c FROM d UNION ALL
 SELECT id, i, j, j + min(q - j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING), c FROM (
   SELECT r.id, r.i + 1 AS i, r.j, r.c, least(r.v + 1, coalesce(lag(r.v) OVER (PARTITION BY r.id ORDER BY r.j) + (xw.c <> r.c)::INT, r.i + 1)) AS q FROM r JOIN xw ON xw.id = r.id AND xw.i = r.i + 1)),
dist AS (SELECT r.id, r.v FROM r JOIN t ON t.id = r.id AND r.i = t.nx AND r.j = len(t.ys)),
wer AS (SELECT id, dist.v / nullif(len(s.x), 0) AS wer FROM s LEFT JOIN dist USING (id))"""
_NUMBERED = _ANSWERS + ", numbered AS (SELECT row_number() OVER () AS id, * FROM a)"


@query(f"WITH RECURSIVE {_NUMBERED}, {_WER} SELECT pair, page_id, side, round(wer, 9) AS wer FROM numbered JOIN wer USING (id)")
def page_word_error_rates(spark, d):
    return answers(spark, d).select("pair", "page_id", "side", F.round(mx.wer(F.col("ground_truth"), F.col("answer")), 9).alias("wer"))


# every character of a pair of texts is given one byte, as the edit distance there goes by bytes
_CER = f"""cs AS (SELECT id, regexp_replace(ground_truth, '^{_SP}+|{_SP}+$', '', 'g') AS r, regexp_replace(answer, '^{_SP}+|{_SP}+$', '', 'g') AS h FROM numbered),
ck AS (SELECT *, list_distinct(string_split(r || coalesce(h, ''), '')) AS abc FROM cs),
ce AS (SELECT *, list_reduce(list_prepend('', list_transform(string_split(r, ''), lambda c: chr(list_position(abc, c)::INT))), lambda x, y: x || y) AS er, list_reduce(list_prepend('', list_transform(string_split(h, ''), lambda c: chr(list_position(abc, c)::INT))), lambda x, y: x || y) AS eh FROM ck),
cer AS (SELECT id, CASE WHEN r = '' OR h IS NULL THEN NULL WHEN h = '' THEN 1.0 ELSE levenshtein(er, eh) / length(r) END AS cer, length(r)::DOUBLE AS length_clean, length(h)::DOUBLE AS length_ocr FROM ce)"""


@query(f"WITH {_NUMBERED}, {_CER} SELECT pair, page_id, side, round(cer, 9) AS cer, length_clean, length_ocr FROM numbered JOIN cer USING (id)")
def page_character_error_rates(spark, d):
    r, h = F.col("ground_truth"), F.col("answer")
    return answers(spark, d).select("pair", "page_id", "side", F.round(mx.cer(r, h), 9).alias("cer"), *[F.length(tx.strip(c)).cast("double").alias(n) for c, n in ((r, "length_clean"), (h, "length_ocr"))])


_SCORES = f"""{overlaps(_NUMBERED, 'numbered')}, {_WER}, {_CER},
scores AS (SELECT pair, page_id, side, p1 AS unigram_precision, r1 AS unigram_recall, f1 AS unigram_f1, cer, wer, length_clean, length_ocr FROM numbered JOIN rouge USING (id) JOIN wer USING (id) JOIN cer USING (id))"""


@query(f"WITH RECURSIVE {_SCORES} SELECT pair, page_id, side, {', '.join(f'round({m}, 9) AS {m}' for m in METRICS)}, length_clean, length_ocr FROM scores")
def page_scores(spark, d):
    return _scored(spark, d).select("pair", "page_id", "side", *[_r(m) for m in METRICS], *[F.col(n).cast("double").alias(n) for n in ("length_clean", "length_ocr")])


@query(f"""WITH RECURSIVE {_SCORES}, named AS (SELECT string_split(pair, '_vs_')[side] AS sys_name, {', '.join(METRICS)} FROM scores), long AS (UNPIVOT named ON {', '.join(METRICS)} INTO NAME metric VALUE value)
SELECT sys_name, metric, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(stddev_pop(value), 9) AS std FROM long WHERE value IS NOT NULL GROUP BY ALL""")
def score_summary(spark, d):
    scored = durable(_scored(spark, d).select("sys_name", *METRICS))  # read twice, for moments and for ranks
    return sm.metric_summary(scored, "sys_name").select("sys_name", "metric", _r("mean"), _r("median"), _r("std"))


def _overlap_sql(n: int) -> str:
    gram = "tok" if n == 1 else "list_transform(range(1, greatest(len(tok), 1)), lambda i: tok[i] || ' ' || tok[i + 1])"

    def grams(c: str) -> str:
        return f"SELECT id, unnest({gram}) AS g FROM (SELECT id, list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS tok FROM k)"

    return f"""WITH {_ANSWERS}, k AS (SELECT row_number() OVER () AS id, * FROM a WHERE answer IS NOT NULL),
    ca AS (SELECT id, g, count(*) AS n FROM ({grams('ground_truth')}) GROUP BY ALL), cb AS (SELECT id, g, count(*) AS n FROM ({grams('answer')}) GROUP BY ALL),
    hits AS (SELECT ca.id, sum(least(ca.n, cb.n)) AS h FROM ca JOIN cb USING (id, g) GROUP BY ALL), na AS (SELECT id, sum(n) AS n FROM ca GROUP BY ALL), nb AS (SELECT id, sum(n) AS n FROM cb GROUP BY ALL),
    j AS (SELECT k.*, coalesce(h / nb.n, 0)::DOUBLE AS p, coalesce(h / na.n, 0)::DOUBLE AS r FROM k LEFT JOIN hits USING (id) LEFT JOIN na USING (id) LEFT JOIN nb USING (id))
    SELECT pair, page_id, side, round(p, 9) AS p, round(r, 9) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE, 9) AS f FROM j"""


def _overlap(spark, d, n):
    t = answers(spark, d).where("answer is not null")
    o = t.select("pair", "page_id", "side", mx.overlap(tx.overlap_tokens(F.col("ground_truth")), tx.overlap_tokens(F.col("answer")), n).alias("o"))
    return o.select("pair", "page_id", "side", F.round("o.p", 9).alias("p"), F.round("o.r", 9).alias("r"), F.round("o.f", 9).alias("f"))


@query(_overlap_sql(1))
def unigram_overlap(spark, d):
    return _overlap(spark, d, 1)


@query(_overlap_sql(2))
def bigram_overlap(spark, d):
    return _overlap(spark, d, 2)


def _prefers(m: str) -> str:
    return f"(CASE WHEN x.f{m} > y.f{m} THEN 1 WHEN y.f{m} > x.f{m} THEN 2 ELSE 0 END)::INT"


@query(f"""WITH RECURSIVE {overlaps("t AS (SELECT row_number() OVER () AS n, pair, page_id, model1, model2, ground_truth FROM (SELECT DISTINCT pair, page_id, model1, model2, ground_truth FROM annotation_triples WHERE ground_truth IS NOT NULL)), both_ AS (SELECT 2 * n AS id, ground_truth, model1 AS answer FROM t UNION ALL SELECT 2 * n + 1, ground_truth, model2 FROM t)", 'both_')}
SELECT pair, page_id, {_prefers('1')} AS rouge1, {_prefers('2')} AS rouge2, {_prefers('l')} AS "rougeL" FROM t JOIN rouge x ON x.id = 2 * t.n JOIN rouge y ON y.id = 2 * t.n + 1""")
def overlap_preferences(spark, d):
    """Which side's stemmed overlap with the clean page is larger, for unigrams, bigrams and common subsequences."""
    t = triples(spark, d).where("ground_truth is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pair", "page_id")
    s = t.withColumn("x", mx.stemmed_overlap(F.col("ground_truth"), F.col("model1"))).withColumn("y", mx.stemmed_overlap(F.col("ground_truth"), F.col("model2")))
    return s.select("pair", "page_id", *[mx.preference(F.col(f"x.{m}_f"), F.col(f"y.{m}_f")).alias(m) for m in ("rouge1", "rouge2", "rougeL")])


# ---- labels, wins, agreement


@query(f"WITH {_JUDGE} SELECT side_a, side_b, criterion, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 2) AS label_2 FROM judge_long WHERE label IN (0, 1, 2) GROUP BY ALL")
def label_distribution(spark, d):
    return sm.label_distribution(judge_labels(spark, d), ["side_a", "side_b"])


_TALLY = f"""WITH {_JUDGE}, dist AS (SELECT side_a, side_b, criterion, count(*) FILTER (label = 1) AS l1, count(*) FILTER (label = 2) AS l2 FROM judge_long WHERE label IN (0, 1, 2) GROUP BY ALL),
both_ AS (SELECT side_a AS system, criterion, (l1 > l2)::INT AS win FROM dist UNION ALL SELECT side_b, criterion, (l2 > l1)::INT FROM dist),
tally AS (SELECT system, criterion, sum(win)::BIGINT AS wins, count(*) AS contests FROM both_ GROUP BY ALL) """


@query(_TALLY + "SELECT * FROM tally")
def win_tally(spark, d):
    return sm.win_tally(sm.label_distribution(judge_labels(spark, d), ["side_a", "side_b"]), "side_a", "side_b")


@query(_TALLY + "SELECT *, round(wins / nullif(contests, 0), 9) AS rate FROM tally")
def win_rates(spark, d):
    return sm.win_rates(win_tally(spark, d)).withColumn("rate", F.round("rate", 9))


@query(_TALLY + "SELECT system, " + ", ".join(f"max(wins) FILTER (criterion = '{c}') AS {c}" for c in CRITERIA) + " FROM tally GROUP BY ALL")
def win_grid(spark, d):
    return win_tally(spark, d).groupBy("system").pivot("criterion", list(CRITERIA)).agg(F.max("wins"))


def _human_judge(spark, d):
    keys = ["side_a", "side_b", "page_id", "criterion"]
    h = human_labels(spark, d).where(ag.in_range(F.col("label"))).select(*keys, F.col("label").alias("a"))
    j = judge_labels(spark, d).where(ag.in_range(F.col("label"))).select(*keys, F.col("label").alias("b"))
    # labels are counted per item first, so that a busy item is joined by its label counts, not row by row
    return h.groupBy(*keys, "a").agg(F.count("*").alias("na")).join(j.groupBy(*keys, "b").agg(F.count("*").alias("nb")), keys)


_HJ = f"""WITH {_JUDGE}, {_HUMAN},
pairs AS (SELECT criterion, h.label AS a, j.label AS b FROM human_long h JOIN judge_long j USING (side_a, side_b, page_id, criterion) WHERE h.label IN (0, 1, 2) AND j.label IN (0, 1, 2)),
"""


def _kappa(cells: DataFrame, by: str) -> DataFrame:
    return ag.kappa(cells.withColumn("w", F.col("na") * F.col("nb")), [by], weight="w").withColumn("kappa", F.round("kappa", 9))


@query(_HJ + _KAPPA.format(by="criterion"))
def kappa_human_judge(spark, d):
    return _kappa(_human_judge(spark, d), "criterion")


@query(_HJ.replace("SELECT criterion, h.label", "SELECT 'all' AS criterion, h.label") + _KAPPA.format(by="criterion"))
def kappa_human_judge_overall(spark, d):
    both = ag.kappa_with_overall(_human_judge(spark, d).withColumn("w", F.col("na") * F.col("nb")), "criterion", weight="w")
    return both.where("criterion = 'all'").withColumn("kappa", F.round("kappa", 9))


@query(f"""WITH {_JUDGE}, m AS (SELECT sys_name, page_id, max(unigram_precision) AS unigram_precision, max(unigram_recall) AS unigram_recall, max(unigram_f1) AS unigram_f1 FROM metric_rows GROUP BY ALL),
ml AS (UNPIVOT m ON unigram_precision, unigram_recall, unigram_f1 INTO NAME metric VALUE v),
pref AS (SELECT x.sys_name AS side_a, y.sys_name AS side_b, x.page_id, x.metric, CASE WHEN x.v > y.v THEN 1 WHEN y.v > x.v THEN 2 ELSE 0 END AS b FROM ml x JOIN ml y ON x.page_id = y.page_id AND x.metric = y.metric AND x.sys_name < y.sys_name),
pairs AS (SELECT criterion || '/' || metric AS what, j.label AS a, b FROM judge_long j JOIN pref USING (side_a, side_b, page_id) WHERE j.label IN (0, 1, 2)),
""" + _KAPPA.format(by="what"))
def kappa_judge_metrics(spark, d):
    """Every criterion of the judge against every overlap metric's preference."""
    names = ("unigram_precision", "unigram_recall", "unigram_f1")
    m = table(spark, d, "metric_rows").groupBy("sys_name", "page_id").agg(*[F.max(c).alias(c) for c in names]).unpivot(["sys_name", "page_id"], list(names), "metric", "v").where("v is not null")
    j = judge_labels(spark, d).where(ag.in_range(F.col("label"))).groupBy("side_a", "side_b", "page_id", "criterion", F.col("label").alias("a")).agg(F.count("*").alias("na"))
    x, y = (m.select(F.col("sys_name").alias(s), "page_id", "metric", F.col("v").alias(v)) for s, v in (("side_a", "va"), ("side_b", "vb")))
    p = j.join(x, ["side_a", "page_id"]).join(y, ["side_b", "page_id", "metric"]).withColumn("b", mx.preference(F.col("va"), F.col("vb"))).withColumn("nb", F.lit(1))
    return _kappa(p.withColumn("what", F.concat_ws("/", "criterion", "metric")), "what")


@query(f"WITH {_JUDGE} SELECT side_a, side_b, count(*) FILTER (overall_winner IS NULL) AS nulls FROM turned GROUP BY ALL HAVING nulls > 0")
def null_report(spark, d):
    v = ag.judgements(votes(spark, d))
    return sm.null_report(v, ["side_a", "side_b"], F.col("overall_winner"))


_OK4 = " AND ".join(f"{c} IN (0, 1, 2)" for c in CRITERIA[:4])


@query(f"""WITH {_JUDGE}, w AS (SELECT *, (faithfulness = 1)::INT + (fluency = 1)::INT + (completeness = 1)::INT + (no_hallucinations = 1)::INT AS ones, (faithfulness = 2)::INT + (fluency = 2)::INT + (completeness = 2)::INT + (no_hallucinations = 2)::INT AS twos,
    coalesce(nullif(fluency, 0), nullif(faithfulness, 0), nullif(no_hallucinations, 0), nullif(completeness, 0)) AS first_ FROM turned WHERE {_OK4} AND overall_winner IN (0, 1, 2))
SELECT overall_winner AS given, CASE WHEN ones > twos THEN 1 WHEN twos > ones THEN 2 ELSE coalesce(first_, CASE WHEN ('0x' || substr(md5('5:' || page_id), 1, 8))::BIGINT / 4294967296.0 < 0.5 THEN 1 ELSE 2 END) END AS by_rule, count(*) AS n FROM w GROUP BY ALL""")
def winner_rule(spark, d):
    """How often the given overall winner is the one the criteria decide."""
    v = ag.judgements(votes(spark, d))
    v = v.select("page_id", *[ag.swapped(F.col(c), F.col("flipped")).alias(c) for c in CRITERIA]).where(" and ".join(f"{c} in (0, 1, 2)" for c in CRITERIA))
    rule = ag.winner(*[F.col(c) for c in CRITERIA[:4]], coin=tx.hash_unit(F.lit(5), F.col("page_id")) < 0.5)
    return v.groupBy(F.col("overall_winner").alias("given"), rule.alias("by_rule")).agg(F.count("*").alias("n"))


@query(f"""WITH {_JUDGE}, s AS (SELECT *, ('0x' || substr(md5('11:' || page_id || ':' || side_a), 1, 8))::BIGINT / 4294967296.0 >= 0.5 AS swap FROM judge_long WHERE label IN (0, 1, 2))
SELECT side_a, side_b, criterion, count(*) FILTER (swap) AS shown_swapped, sum(CASE WHEN swap AND label > 0 THEN 3 - label ELSE label END)::BIGINT AS shown, sum(label)::BIGINT AS kept FROM s GROUP BY ALL""")
def order_swaps(spark, d):
    """Labels as a judge sees them that is shown the systems in random order, and turned back."""
    s = judge_labels(spark, d).where(ag.in_range(F.col("label"))).withColumn("swap", ag.order_coin(11, F.col("page_id"), F.col("side_a")))
    s = s.withColumn("shown", ag.swapped(F.col("label"), F.col("swap"))).withColumn("back", ag.swapped(F.col("shown"), F.col("swap")))
    return s.groupBy("side_a", "side_b", "criterion").agg(F.count(F.when(F.col("swap"), 1)).alias("shown_swapped"), F.sum("shown").alias("shown"), F.sum("back").alias("kept"))


@query(f"WITH {_JUDGE} SELECT criterion, page_id, side_a, side_b, epoch_us(judged_at) AS judged_us, label::DOUBLE AS label FROM judge_long")
def labels_by_criterion(spark, d):
    return judge_labels(spark, d).select("criterion", "page_id", "side_a", "side_b", F.unix_micros("judged_at").alias("judged_us"), F.col("label").cast("double").alias("label"))


@query(f"WITH {_JUDGE} SELECT page_id, criterion, max_by(label, (side_a, side_b, judged_at)) AS label FROM judge_long WHERE label IS NOT NULL GROUP BY ALL")
def labels_last_wins(spark, d):
    long = judge_labels(spark, d).withColumn("ord", F.struct("side_a", "side_b", "judged_at"))
    return sm.last_wins(long, ["page_id"], "ord")


@query(f"WITH {_JUDGE} SELECT side_a, side_b, page_id, " + ", ".join(f"max({c})::DOUBLE AS {c}" for c in CRITERIA) + " FROM turned GROUP BY ALL")
def label_matrix(spark, d):
    m = sm.label_matrix(judge_labels(spark, d), ["side_a", "side_b", "page_id"])
    return m.select("side_a", "side_b", "page_id", *[F.col(c).cast("double").alias(c) for c in CRITERIA])


@query("""WITH m AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM metric_rows), c AS (SELECT sys_name, length_clean, count(*) AS n, min(page_id) AS first_ FROM m WHERE length_clean IS NOT NULL GROUP BY ALL)
SELECT sys_name, length_clean, n FROM c QUALIFY row_number() OVER (PARTITION BY sys_name ORDER BY n DESC, first_) = 1""")
def commonest_lengths(spark, d):
    """The length that most clean pages of a system have; of equally common ones the first seen."""
    return sm.first_seen_mode(metric_rows(spark, d).where("length_clean is not null"), ["sys_name"], "length_clean", "page_id")


@query(r"""WITH t AS (SELECT DISTINCT pair, page_id, model1 FROM annotation_triples WHERE model1 IS NOT NULL), s AS (SELECT *, string_split(regexp_replace(model1, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g'), 'orrected text:') AS ps FROM t)
SELECT pair, page_id, md5(regexp_replace(ps[-1], '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')) AS answer_md5, len(ps) > 1 AS marked FROM s""")
def answers_after_marker(spark, d):
    """Answers without a lead-in that ends in the marker."""
    t = triples(spark, d).select("pair", "page_id", "model1").distinct().where("model1 is not null")
    return t.select("pair", "page_id", F.md5(tx.after_marker(F.col("model1"), "orrected text:")).alias("answer_md5"), F.contains(tx.strip(F.col("model1")), F.lit("orrected text:")).alias("marked"))


@query(f"""WITH RECURSIVE {_NUMBERED}, {_WER}, {_CER} SELECT DISTINCT pair, page_id, round(cer, 9) AS cer, round(wer, 9) AS wer, length_ocr FROM numbered JOIN wer USING (id) JOIN cer USING (id) WHERE side = 1""")
def streamed_scores(spark, d):
    """Error rates of answers as they arrive, read back from the stream's output; a row delivered twice is scored twice and counts once here."""
    from pageloom.streaming import scores

    out = fresh_folder(spark, "scores")
    stream = scores.answers_stream(spark, f"{d}/annotation_triples.parque[t]", table(spark, d, "annotation_triples").schema).where("ground_truth is not null")
    scored = scores.native_scores(stream, "ground_truth", "model1").select("pair", "page_id", "cer", "wer", "length_ocr", F.xxhash64("model1", "ground_truth").alias("text_id"))
    scores.run_available(scored, f"{out}/rows", f"{out}/state")
    rows = spark.read.parquet(f"{out}/rows").distinct()
    return rows.select("pair", "page_id", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), F.col("length_ocr").cast("double").alias("length_ocr")).distinct()
