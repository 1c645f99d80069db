"""Queries of the training-data problems, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import pair_sides
from pageloom.llm import consensus, cutoff, leaks, ocr_repair, packing, pairs, ranking, skeleton, splitting
from pageloom.llm.common import durable, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    clean = [("ground_truth", table(spark, d, "annotation_triples"), "ground_truth")]
    return ocr_repair.page_faults(table(spark, d, "ocr_pages"), ["page_id"], "text", clean)


def _p1_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = ["page_id"]
    words = [ocr_repair.count_words(ocr_repair.line_words(ocr_repair.page_lines(table(spark, d, t), key, c), key)) for t, c in (("ocr_pages", "text"), ("annotation_triples", "ground_truth"))]
    lex = durable(ocr_repair.lexicon(*words))
    return lex, durable(ocr_repair.noise_words(lex))


def p1_corrections(spark: SparkSession, d: str) -> DataFrame:
    return _p1_tables(spark, d)[1].where("fix is not null")


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned text and every clean text with page layout left in it, put into paragraphs."""
    lex, noise = _p1_tables(spark, d)
    out = None
    for t, c in (("ocr_pages", "text"), ("annotation_triples", "ground_truth")):
        texts = table(spark, d, t).select("page_id", F.xxhash64(c).alias("text_id"), F.col(c).alias("text")).distinct()
        one = ocr_repair.repaired_pages(texts, ["page_id", "text_id"], "text", lex, noise).select(F.lit(c).alias("src_field"), "page_id", "text_id", "repaired")
        out = one if out is None else out.unionByName(one)
    return out


def _ranked(spark: SparkSession, d: str, label: str) -> tuple[DataFrame, DataFrame]:
    edges = durable(ranking.margins(ranking.usable_votes(table(spark, d, "judge_rows"), table(spark, d, "systems"), label)))
    return edges, ranking.strengths(edges)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, ranked = _ranked(spark, d, "overall_winner")
    return ranking.bands(table(spark, d, "systems"), ranked, "sys_name", 4).select("sys_name", "band")


def p2_strengths(spark: SparkSession, d: str) -> DataFrame:
    _, ranked = _ranked(spark, d, "faithfulness")
    return ranking.bands(table(spark, d, "systems"), ranked, "sys_name", 4).withColumn("strength", F.round("strength", 6))


def p2_residuals(spark: SparkSession, d: str) -> DataFrame:
    left = ranking.residuals(*_ranked(spark, d, "overall_winner"))
    return left.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("margin", "fitted", "residual", "share")])


def p2_margins(spark: SparkSession, d: str) -> DataFrame:
    votes = ranking.usable_votes(table(spark, d, "judge_rows"), table(spark, d, "systems"), "overall_winner")
    return ranking.margins(votes).select("a", "b", "n", F.round("margin", 9).alias("margin"), F.round("weight", 9).alias("weight"))


_ITEM = ["pair", "page_id"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return consensus.latest_labels(table(spark, d, "human_rows"), _ITEM, "annotator_id", ["overall_winner", "fluency"], ["labelled_at", "loaded_at"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.faults(consensus.annotator_report(*consensus.fit(_labels(spark, d), _ITEM))).withColumnRenamed("annotator", "annotator_id")


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(consensus.fit(_labels(spark, d), _ITEM)[0], _ITEM)


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotator_report(*consensus.fit(_labels(spark, d), _ITEM))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement beyond chance on each criterion."""
    return consensus.chance_corrected_agreement(_labels(spark, d), _ITEM).withColumn("alpha", F.round("alpha", 9))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_texts(table(spark, d, "text_chunks"), "text", limit=800, overlap=80)
    return pieces.where("cut_kind <> 'whole'").select("page_id", "chunk_no", "cut_kind").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_texts(table(spark, d, "text_chunks").distinct(), "text", limit=800, overlap=80)
    return pieces.select("page_id", "chunk_no", "piece_no", F.col("piece_start").alias("start_pos"), F.col("piece_end").alias("end_pos"), "piece", "cut_kind")


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of every chunk: where its pieces begin and end, whether all keep to the limit, stand at their places, and overlap by 80 characters."""
    chunks = table(spark, d, "text_chunks").distinct()
    pieces = splitting.split_texts(chunks.withColumn("_row", F.xxhash64(*chunks.columns)), "text", limit=800, overlap=80)
    at = F.substring("text", F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")) == F.col("piece")
    per = pieces.groupBy("page_id", "chunk_no", "_row").agg(
        F.min("piece_start").cast("int").alias("first"), F.max("piece_end").cast("int").alias("last"), (F.max(F.length("piece")) <= 800).alias("fit"), F.min(at).alias("stand"),
        F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end"))).alias("ps"),
    )
    joined = F.forall(F.transform("ps", lambda p, i: (i == 0) | (p["piece_start"] == F.get("ps", i - 1)["piece_end"] - 80)), lambda x: x)
    return per.select("page_id", "chunk_no", "first", "last", "fit", "stand", joined.alias("joined"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "annotation_triples"), table(spark, d, "ocr_pages"), ["pair", "page_id"])


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("side", "defect").agg(F.count("*").alias("n"))


def _measured(spark: SparkSession, d: str, reference: bool = True) -> DataFrame:
    """The answers of model1, measured where they are read; what is shuffled holds figures only, the digest keeping different texts apart."""
    triples = table(spark, d, "annotation_triples").withColumn("sys_name", pair_sides(F.lower("pair"))["a"]).withColumn("digest", F.xxhash64("model1", "ground_truth"))
    return cutoff.measure(triples, "model1", "ground_truth" if reference else None)


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d)
    refused = F.coalesce(pairs.is_refusal(F.when(F.coalesce("goes_on", F.lit(1)) > 0, F.col("model1"))), F.lit(False))
    rows = rows.withColumn("no_answer", pairs.is_empty(F.col("model1")) | refused).drop("model1", "model2", "ground_truth", "loaded_at").distinct()
    recorded = table(spark, d, "metric_rows").where("length_ocr is not null").groupBy(F.lower("sys_name").alias("sys_name"), "page_id").agg(F.max("length_ocr").alias("recorded"))
    cuts = cutoff.detect_cuts(rows.join(recorded, ["sys_name", "page_id"], "left"), ["sys_name"], recorded="recorded")
    return cuts.withColumn("cut", F.col("cut") & ~F.coalesce("no_answer", F.lit(True)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("cut").select("pair", "page_id").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(_cuts(spark, d), "sys_name")


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Cut rows by the first evidence that shows them."""
    return _cuts(spark, d).where("cut").groupBy("evidence").agg(F.countDistinct("pair", "page_id").alias("n"))


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """The field limits detection goes by: spikes among the answers that end no sentence."""
    rows = _measured(spark, d, reference=False).select("sys_name", "pair", "page_id", "digest", "unfinished", "chars", "bytes").distinct()
    return cutoff.length_limits(rows, ["sys_name"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack_containers(docs, "doc_id", packing.word_tokens(F.col("text")), capacity=1024)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).where("pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each partition and the fewest possible."""
    return packing.certificates(p7_containers(spark, d))


def p7_sums(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any right packing: texts, pieces, tokens, and no container overfull, below its bound or split without need."""
    c = p7_containers(spark, d)
    full = c.where("container is not null").groupBy("container").agg(F.sum("size").alias("n"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    wrong = full.agg(F.count(F.when((F.col("n") > 1024) | (F.col("bins") < F.col("bound")), 1)).alias("wrong"))
    sums = c.agg(F.countDistinct("id").alias("texts"), F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.count(F.when((F.col("pieces") > 1) & (F.col("piece") < F.col("pieces")) & (F.col("size") < 1024), 1)).alias("short_pieces"))
    return sums.crossJoin(wrong)  # one row each


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = skeleton.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", skeleton.consistent_form(F.col("text")).alias("form"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_classes(table(spark, d, "documents"), "doc_id", "text").where("texts > 1")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_corrections, p1_pages, p2_found, p2_strengths, p2_residuals, p2_margins, p4_found, p4_consensus, p4_annotators, p4_agreement, p3_found, p3_pieces, p3_cover, p5_found, p5_counts, p6_found, p6_rates, p6_evidence, p6_limits, p7_found, p7_containers, p7_bounds, p7_sums, p8_found, p8_items, p9_found, p9_forms, p9_classes)}

_VOTES = r"""names AS (
            SELECT DISTINCT sys_name, unnest([lower(sys_name), lower(hub_path), lower(short_alias), replace(lower(sys_name), '/', '-'), replace(lower(hub_path), '/', '-'), replace(lower(short_alias), '/', '-')]) AS alias FROM systems),
        raw_votes AS (
            SELECT DISTINCT x.sys_name AS s0, y.sys_name AS s1, page_id, judged_at, raw, faithfulness, fluency, completeness, no_hallucinations, overall_winner
            FROM (SELECT *, regexp_split_to_array(regexp_replace(lower(trim(pair)), '\.json$', ''), '_(against|vs)_') AS sides FROM judge_rows)
            JOIN names x ON x.alias = trim(sides[1]) JOIN names y ON y.alias = trim(sides[2]) WHERE x.sys_name <> y.sys_name),
        votes AS (
            SELECT s0, s1, coalesce(CRITERION, try_cast(nullif(regexp_extract(regexp_extract(regexp_replace(raw, '\\+"', '"', 'g'), '(?s)\{.*\}', 0), '"CRITERION"\s*:\s*"?(-?[0-9]{1,3})\b', 1), '') AS INTEGER)) AS v
            FROM raw_votes),
        sums AS (
            SELECT least(s0, s1) AS a, greatest(s0, s1) AS b, count(*) AS n,
                   sum(CASE WHEN v = 0 THEN 0.5 WHEN (v = 1) = (s0 < s1) THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.5 AS wa,
                   sum(CASE WHEN v = 0 THEN 0.5 WHEN (v = 1) = (s0 < s1) THEN 0.0 ELSE 1.0 END)::DOUBLE + 0.5 AS wb
            FROM votes WHERE v BETWEEN 0 AND 2 GROUP BY ALL),
        edges AS (SELECT a, b, n, ln(wa / wb) AS margin, wa * wb / (wa + wb) AS weight FROM sums)"""
# the least-squares strengths by damped relaxation of the same system, all systems a step, to a mean of 0
_SOLVED = """arcs AS (SELECT a AS i, b AS j, weight, margin FROM edges UNION ALL SELECT b, a, weight, -margin FROM edges),
        items AS (SELECT list(DISTINCT i ORDER BY i) AS ids FROM arcs),
        grid AS (SELECT list(row_ ORDER BY i) AS w, list(deg ORDER BY i) AS deg, list(rhs ORDER BY i) AS rhs FROM (
            SELECT i, sum(weight) AS deg, sum(weight * margin) AS rhs, list_transform((SELECT ids FROM items), lambda x: coalesce(list_sum(list_transform(list_filter(list({'j': j, 'w': weight}), lambda y: y.j = x), lambda y: y.w)), 0.0)) AS row_ FROM arcs GROUP BY i)),
        steps AS (SELECT 0 AS k, list_transform(deg, lambda z: 0.0::DOUBLE) AS x, w, deg, rhs FROM grid UNION ALL
            SELECT k + 1, list_transform(range(1, len(x) + 1), lambda i: 0.5 * x[i] + 0.5 * (rhs[i] + list_dot_product(w[i]::DOUBLE[], x::DOUBLE[])) / deg[i]), w, deg, rhs FROM steps WHERE k < 600),
        solved AS (SELECT unnest(ids) AS item, unnest(x) - list_avg(x) AS strength FROM (SELECT x FROM steps WHERE k = 600), items)"""
_RANKED = "SELECT s.sys_name, strength, ntile(4) OVER (ORDER BY strength DESC NULLS LAST, s.sys_name) AS band FROM (SELECT DISTINCT sys_name FROM systems) s LEFT JOIN solved ON item = s.sys_name"


def _alike_sql() -> str:
    """Every document's consistent form: characters replaced one by one. The table holds each character of two bytes, and of the extended Latin ones, that has another form."""
    forms = {c: f for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)]) if (f := skeleton.skeleton(c)) != c and (ord(c) < 0x2100 or c in skeleton._PROTOTYPES)}
    text = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    return f"""t AS (SELECT unnest([{text(forms)}]) AS c, unnest([{text(forms.values())}]) AS f),
        u AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''),
        forms AS (SELECT doc_id, string_agg(coalesce(f, u.c), '' ORDER BY i) AS form FROM u LEFT JOIN t ON t.c = u.c GROUP BY doc_id),
        every AS (SELECT doc_id, text, CASE WHEN text = '' THEN '' ELSE form END AS form FROM documents LEFT JOIN forms USING (doc_id))"""


_LATEST = """last_ AS (SELECT * FROM human_rows WHERE pair IS NOT NULL AND page_id IS NOT NULL AND annotator_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY pair, page_id, annotator_id ORDER BY labelled_at DESC NULLS LAST, loaded_at DESC NULLS LAST, overall_winner DESC NULLS LAST, fluency DESC NULLS LAST) = 1),
        l AS (SELECT pair, page_id, annotator_id, 'overall_winner' AS criterion, overall_winner::INT AS label FROM last_ WHERE overall_winner IN (0, 1, 2) UNION ALL SELECT pair, page_id, annotator_id, 'fluency', fluency::INT FROM last_ WHERE fluency IN (0, 1, 2))"""
_LOG = ", ".join(f"ln((l.label = {t})::INT * c + (1 - c) * g) AS l{t}" for t in range(3))
_SCORED = f"""SELECT *, {", ".join(f"q{t} + sum(l{t}) OVER (PARTITION BY criterion, pair, page_id) AS s{t}" for t in range(3))} FROM (SELECT l.*, c, g, q0, q1, q2, step, {_LOG} FROM l JOIN em USING (criterion, annotator_id, label))"""


def _shares(a: str, less: str = "") -> str:
    """Probabilities p0, p1, p2 from log-probabilities."""
    s = [f"s{t}{less.format(t)}" for t in range(3)]
    top = f"greatest({', '.join(s)})"
    total = " + ".join(f"exp({x} - {top})" for x in s)
    return f"SELECT *, {', '.join(f'exp({x} - {top}) / ({total}) AS p{t}' for t, x in enumerate(s))} FROM ({a})"


# sixty rounds of expectation and maximisation, which is more than they need
_FITTED = f"""em AS (SELECT 0 AS step, criterion, annotator_id, label, 0.7::DOUBLE AS c, (1 / 3.0)::DOUBLE AS g, ln(1 / 3.0) AS q0, ln(1 / 3.0) AS q1, ln(1 / 3.0) AS q2 FROM (SELECT DISTINCT criterion, annotator_id FROM l), (SELECT unnest([0, 1, 2]) AS label)
        UNION ALL
        SELECT step + 1, criterion, annotator_id, label, (sum(kept) OVER own + 0.5) / (sum(n) OVER own + 1), (n - kept + 1 / 3.0) / (sum(n - kept) OVER own + 1), {", ".join(f"ln((sum(m{t}) OVER crit + 1) / (sum(n) OVER crit + 3))" for t in range(3))} FROM (
            SELECT em.step, em.criterion, em.annotator_id, em.label, coalesce(n, 0) AS n, coalesce(m0, 0.0) AS m0, coalesce(m1, 0.0) AS m1, coalesce(m2, 0.0) AS m2, coalesce(CASE em.label WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END, 0.0) * em.c / (em.c + (1 - em.c) * em.g) AS kept
            FROM em LEFT JOIN (SELECT criterion, annotator_id, label, count(*) AS n, sum(p0) AS m0, sum(p1) AS m1, sum(p2) AS m2 FROM ({_shares(_SCORED)}) GROUP BY ALL) k USING (criterion, annotator_id, label) WHERE em.step < 60)
        WINDOW own AS (PARTITION BY criterion, annotator_id), crit AS (PARTITION BY criterion))"""
_FAULTS = f"""fit AS (SELECT * FROM em WHERE step = 60),
        others AS ({_shares(_SCORED.replace("JOIN em", "JOIN fit"), " - l{0}")}),
        crossed AS (SELECT criterion, annotator_id, count(*) AS labels, sum(CASE label WHEN 1 THEN p2 WHEN 2 THEN p1 ELSE 0 END) AS x, sum(CASE label WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE 0 END) AS y FROM others GROUP BY ALL),
        report AS (SELECT criterion, annotator_id, labels, x / nullif(x + y, 0) AS crossed, max(c) AS c, max(g) AS g FROM crossed JOIN fit USING (criterion, annotator_id) GROUP BY ALL)
        SELECT annotator_id, CASE WHEN sum(g * labels) / sum(labels) >= 0.8 THEN 'constant' WHEN sum(crossed * labels) / sum(labels) >= 0.7 THEN 'swapped' ELSE 'random' END AS fault FROM report GROUP BY annotator_id HAVING sum(c * labels) / sum(labels) < 0.4"""


ORACLES: dict[str, str] = {
    "p2_margins": f"WITH {_VOTES.replace('CRITERION', 'overall_winner')} SELECT a, b, n, round(margin, 9) AS margin, round(weight, 9) AS weight FROM edges",
    "p2_found": f"WITH RECURSIVE {_VOTES.replace('CRITERION', 'overall_winner')}, {_SOLVED} SELECT sys_name, band::INT AS band FROM ({_RANKED})",
    "p2_strengths": f"WITH RECURSIVE {_VOTES.replace('CRITERION', 'faithfulness')}, {_SOLVED} SELECT sys_name, round(strength, 6) AS strength, band::INT AS band FROM ({_RANKED})",
    "p2_residuals": f"""WITH RECURSIVE {_VOTES.replace('CRITERION', 'overall_winner')}, {_SOLVED},
        left_ AS (SELECT a, b, n, margin, weight, x.strength - y.strength AS fitted FROM edges JOIN solved x ON x.item = a JOIN solved y ON y.item = b)
        SELECT a, b, n, round(margin, 6) AS margin, round(fitted, 6) AS fitted, round(margin - fitted, 6) AS residual, round(weight * (margin - fitted) ** 2 / sum(weight * (margin - fitted) ** 2) OVER (), 6) AS share FROM left_""",
    "p3_cover": r"""
        WITH d AS (SELECT DISTINCT * FROM text_chunks WHERE text IS NOT NULL),
        b AS (SELECT page_id, chunk_no, text, regexp_replace(text, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS body, length(text) - length(regexp_replace(text, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', '')) AS lead FROM d)
        SELECT page_id, chunk_no, (CASE WHEN body = '' THEN 0 ELSE lead END)::INT AS first, (CASE WHEN body = '' THEN 0 ELSE lead + length(body) END)::INT AS last, true AS fit, true AS stand, true AS joined FROM b""",
    "p7_sums": r"""
        WITH s AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\p{Z}]+')), 0) AS n FROM documents)
        SELECT count(*) AS texts, sum(greatest(ceil(n / 1024), 1))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, 0::BIGINT AS short_pieces, 0::BIGINT AS wrong FROM s""",
    "p9_forms": f"WITH {_alike_sql()} SELECT doc_id, form FROM every",
    "p9_found": f"WITH {_alike_sql()} SELECT x.doc_id AS doc_a, y.doc_id AS doc_b FROM every x JOIN every y ON x.form = y.form AND x.doc_id < y.doc_id AND x.text <> y.text",
    "p9_classes": f"WITH {_alike_sql()} SELECT min(doc_id) AS class_id, count(*) AS members, count(DISTINCT text) AS texts FROM every WHERE text IS NOT NULL GROUP BY form HAVING texts > 1",
    "p4_found": f"WITH RECURSIVE {_LATEST}, {_FITTED}, {_FAULTS}",
    "p4_agreement": r"""
        WITH last_ AS (SELECT * FROM human_rows WHERE pair IS NOT NULL AND page_id IS NOT NULL AND annotator_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY pair, page_id, annotator_id ORDER BY labelled_at DESC NULLS LAST, loaded_at DESC NULLS LAST, overall_winner DESC NULLS LAST, fluency DESC NULLS LAST) = 1),
        l AS (SELECT pair, page_id, 'overall_winner' AS criterion, overall_winner AS label FROM last_ UNION ALL SELECT pair, page_id, 'fluency', fluency FROM last_),
        per AS (SELECT criterion, pair, page_id, count(*) AS m, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2 FROM l WHERE label IN (0, 1, 2) GROUP BY ALL HAVING m > 1),
        g AS (SELECT criterion, count(*) AS items, sum(m)::BIGINT AS labels, sum((n0 * (m - n0) + n1 * (m - n1) + n2 * (m - n2)) / (m - 1)) AS seen, sum(n0) AS s0, sum(n1) AS s1, sum(n2) AS s2 FROM per GROUP BY ALL)
        SELECT criterion, items, labels, round(1 - seen / ((s0 * (labels - s0) + s1 * (labels - s1) + s2 * (labels - s2)) / (labels - 1)), 9) AS alpha FROM g""",
    "p3_found": r"""
        WITH t AS (SELECT page_id, chunk_no, regexp_replace(text, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS b FROM text_chunks WHERE text IS NOT NULL)
        SELECT DISTINCT page_id, chunk_no,
               CASE WHEN list_max(list_transform(regexp_split_to_array(b, '[\s\x{85}\p{Z}]+'), lambda x: length(x))) > 800 THEN 'forced' ELSE 'natural' END AS cut_kind
        FROM t WHERE length(b) > 800""",
    "p6_limits": r"""
        WITH t AS (SELECT DISTINCT trim(regexp_split_to_array(regexp_replace(lower(trim(pair)), '\.json$', ''), '_(?:against|vs)_')[1]) AS sys_name, pair, page_id, ground_truth, model1, regexp_replace(model1, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS body FROM annotation_triples WHERE model1 IS NOT NULL),
        b AS (SELECT *, CASE WHEN contains(body, chr(10)) AND regexp_matches(regexp_extract(body, '\n[^\n]*$', 0), '^\n[^\p{L}\d\n]*(?:p\.\s*)?(?:\d+|[ivxlc]+)[^\p{L}\d\n]*$') THEN regexp_replace(regexp_replace(body, '\n[^\n]*$', ''), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '') ELSE body END AS last_ FROM t WHERE body <> ''),
        u AS (SELECT * FROM b WHERE NOT regexp_matches(right(last_, 12), '(?:[.!?…]|&c\.)[”’»"'')\]]*$')),
        l AS (SELECT sys_name, 'chars' AS unit, length(model1)::INT AS length FROM u UNION ALL SELECT sys_name, 'bytes', strlen(model1)::INT FROM u),
        h AS (SELECT sys_name, unit, length, count(*) AS n FROM l GROUP BY ALL),
        o AS (SELECT *, sum(n) OVER (PARTITION BY sys_name, unit ORDER BY length RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) - n AS other FROM h)
        SELECT sys_name, unit, length, n FROM o WHERE n >= 8 AND n > 5 * greatest(other / 40.0, 1.0)""",
    "p7_found": r"""
        SELECT DISTINCT doc_id FROM documents
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\p{Z}]+')) > 1024""",
}
