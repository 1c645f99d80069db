"""Named queries on texts: chunks, votes, merging, errors, noise, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.durable import durable, fresh_folder
from pageloom.functions import text as tx
from pageloom.operators import align as al
from pageloom.operators import datasets as ds
from pageloom.operators import denoise as dn
from pageloom.operators import errors as er
from pageloom.operators import noise as ns
from pageloom.operators import summary as sm
from pageloom.schema import CRITERIA
from pageloom.plans.alignsql import counted, walked
from pageloom.plans.queries import _ANSWERS, _PAGES, answers, pages, parts, query, table, triples

def page_pairs(spark, d) -> DataFrame:
    """(page_id, ocr, clean): every text of a page with every clean text given for it."""
    g = table(spark, d, "annotation_triples").where("ground_truth is not null").select("page_id", F.col("ground_truth").alias("clean")).distinct()
    p = pages(spark, d).select("page_id", F.col("text").alias("ocr")).distinct()
    return p.hint("merge").join(g, "page_id").repartition(parts(spark), "page_id")


# ---- lengths and selections


@query(f"WITH {_PAGES} SELECT dataset, page_id, length(text)::INT AS length FROM p")
def length_listing(spark, d):
    return sm.length_listing(pages(spark, d), ["dataset", "page_id"], "text")


@query(f"WITH {_PAGES} SELECT lang, count(*) AS pages, min(length(text))::INT AS least, max(length(text))::INT AS most, round(avg(length(text)), 9) AS mean, quantile_cont(length(text), 0.5) AS median FROM p GROUP BY ALL")
def length_stats_by_lang(spark, d):
    n = F.length("text")
    return pages(spark, d).groupBy("lang").agg(F.count("*").alias("pages"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 9).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"))


@query(f"WITH {_PAGES} SELECT dataset, page_id, text FROM p WHERE page_id IN (0, 5, 36, 37, 38, 43, 47)")
def annotated_pages(spark, d):
    return ds.subset(pages(spark, d), "page_id", [0, 5, 36, 37, 38, 43, 47]).select("dataset", "page_id", "text")


@query("SELECT count(*) AS pages FROM (SELECT page_id FROM ocr_pages INTERSECT SELECT page_id FROM annotation_triples INTERSECT SELECT page_id FROM metric_rows)")
def shared_pages(spark, d):
    return ds.shared_keys(*[table(spark, d, t) for t in ("ocr_pages", "annotation_triples", "metric_rows")], key="page_id").agg(F.count("*").alias("pages"))


@query("""WITH k AS (SELECT DISTINCT page_id FROM metric_rows),
o AS (SELECT page_id, min(text) AS text FROM ocr_pages GROUP BY 1), g AS (SELECT page_id, min(ground_truth) AS text FROM annotation_triples GROUP BY 1), m AS (SELECT page_id, min(model1) AS text FROM annotation_triples GROUP BY 1)
SELECT k.page_id, coalesce(o.text, '') AS ocr, coalesce(m.text, '') AS model1, coalesce(g.text, '') AS ground_truth FROM k LEFT JOIN o USING (page_id) LEFT JOIN m USING (page_id) LEFT JOIN g USING (page_id)""")
def triples_with_defaults(spark, d):
    a = table(spark, d, "annotation_triples")
    src = {"ocr": table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("text").alias("t")), "model1": a.groupBy("page_id").agg(F.min("model1").alias("t")), "ground_truth": a.groupBy("page_id").agg(F.min("ground_truth").alias("t"))}
    return ds.with_defaults(table(spark, d, "metric_rows").select("page_id").distinct(), src, "page_id", "t")


@query("""SELECT page_id, CASE WHEN a.page_id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT page_id FROM metric_rows) a FULL JOIN (SELECT DISTINCT page_id FROM annotation_triples) b USING (page_id) WHERE a.page_id IS NULL OR b.page_id IS NULL""")
def merge_check(spark, d):
    return ds.unmatched(table(spark, d, "metric_rows"), table(spark, d, "annotation_triples"), "page_id")


@query("SELECT t.pair, t.page_id, length(p.text)::INT AS length FROM (SELECT DISTINCT pair, page_id, model1, model2, ground_truth FROM annotation_triples) t JOIN (SELECT page_id, max(text) AS text FROM ocr_pages GROUP BY 1) p USING (page_id)")
def strict_pages(spark, d):
    """Every triple with its page; a triple whose page was never delivered fails the query."""
    p = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.max("text").alias("text"))
    return ds.strict_join(triples(spark, d), p, "page_id").select("pair", "page_id", F.length("text").alias("length"))


@query("""WITH o AS (SELECT DISTINCT dataset, page_id, text FROM ocr_pages WHERE text IS NOT NULL), m AS (SELECT 0 AS part_no, page_id, text FROM o WHERE dataset LIKE 'train%' UNION ALL SELECT 1, page_id, text FROM o WHERE dataset LIKE 'test%')
SELECT part_no, page_id, row_number() OVER (ORDER BY part_no, page_id) - 1 AS new_id, md5(upper(text)) AS clean_md5, md5(text) AS noisy_md5 FROM m""")
def paired_merge(spark, d):
    """Datasets given twice, merged strictly: the same new id for both texts of a page. Capitals stand for the second version."""
    p = pages(spark, d).select("dataset", "page_id", "text")
    parts = [p.where(F.col("dataset").startswith(x)) for x in ("train", "test")]
    merged = ds.merge_paired_datasets([x.withColumn("text", F.upper("text")) for x in parts], parts, "page_id")
    return merged.select("part_no", "page_id", "new_id", F.md5("clean").alias("clean_md5"), F.md5("noisy").alias("noisy_md5"))


@query(f"WITH {_PAGES} SELECT dataset, page_id FROM p WHERE ('0x' || substr(md5('42:' || page_id), 1, 8))::BIGINT / 4294967296.0 < 0.02")
def sampled_pages(spark, d):
    return ds.hash_sample(pages(spark, d), F.col("page_id"), 0.02).select("dataset", "page_id")


@query("SELECT lang, dataset FROM (SELECT lang, regexp_replace(dataset, '_ocr$', '') AS dataset FROM (SELECT DISTINCT lang, dataset FROM ocr_pages) WHERE dataset IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY coalesce(try_cast(nullif(regexp_extract(dataset, '([0-9]+)$', 1), '') AS BIGINT), 0) DESC, dataset DESC) = 1")
def latest_dataset(spark, d):
    named = table(spark, d, "ocr_pages").where("dataset is not null").select("lang", F.regexp_replace("dataset", "_ocr$", "").alias("dataset"))
    return ds.latest_by_suffix(named, ["lang"], "dataset")


# ---- merging and splitting


@query("""WITH p AS (SELECT DISTINCT dataset, page_id FROM ocr_pages WHERE text IS NOT NULL), u AS (SELECT 0 AS part_no, page_id, dataset FROM p WHERE dataset LIKE 'train%' UNION ALL SELECT 1, page_id, dataset FROM p WHERE dataset LIKE 'test%')
SELECT part_no, page_id, dataset, row_number() OVER (ORDER BY part_no, page_id) - 1 AS new_id FROM u""")
def merged_pages(spark, d):
    p = pages(spark, d).select("dataset", "page_id").distinct()
    return ds.merge_datasets([p.where(F.col("dataset").startswith("train")), p.where(F.col("dataset").startswith("test"))], "page_id").select("part_no", "page_id", "dataset", "new_id")


@query("""WITH k AS (SELECT DISTINCT page_id FROM ocr_pages WHERE text IS NOT NULL), r AS (SELECT page_id, row_number() OVER (ORDER BY md5('42:' || page_id), page_id) AS i, count(*) OVER () AS n FROM k)
SELECT page_id, CASE WHEN i <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM r""")
def exact_split(spark, d):
    return ds.hash_split(pages(spark, d).select("page_id").distinct(), "page_id", 0.2, 42)


@query("""WITH p AS (SELECT DISTINCT page_id, text FROM ocr_pages WHERE text IS NOT NULL), g AS (SELECT DISTINCT page_id, ground_truth AS clean FROM annotation_triples WHERE ground_truth IS NOT NULL)
SELECT 'Clean the following OCR text:' AS instruction, text AS input, clean AS output FROM p JOIN g USING (page_id)""")
def training_records(spark, d):
    return ds.sft_records(page_pairs(spark, d), "ocr", "clean")


# ---- sentences, prompts, votes

_SENTENCES = """s AS (SELECT DISTINCT page_id, chunk_no, text FROM text_chunks WHERE text IS NOT NULL),
parts AS (SELECT *, string_split(text, '. ') AS ps FROM s),
dotted AS (SELECT page_id, chunk_no, text, generate_subscripts(ps, 1) - 1 AS ord, unnest(list_transform(ps, lambda x, i: CASE WHEN i < len(ps) THEN x || '.' ELSE x END)) AS part FROM parts),
placed AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY page_id, chunk_no, text ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_ FROM dotted)"""


@query(f"WITH {_SENTENCES} SELECT page_id, chunk_no, ord::INT AS ord, part AS text, start_, (start_ + length(part))::INT AS end_ FROM placed")
def sentence_chunks(spark, d):
    c = table(spark, d, "text_chunks").select("page_id", "chunk_no", "text").distinct()
    return dn.sentence_table(c, ["page_id", "chunk_no"], "text").select("page_id", "chunk_no", "ord", "text", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(f"WITH {_SENTENCES}, m AS (SELECT page_id, chunk_no, text, string_agg(part, ' ' ORDER BY start_, ord) AS merged FROM placed GROUP BY ALL) SELECT page_id, chunk_no, merged, merged = text AS same FROM m")
def sentence_roundtrip(spark, d):
    c = table(spark, d, "text_chunks").select("page_id", "chunk_no", "text").distinct().where("text is not null")
    parts = F.transform(tx.sentence_chunks(F.col("text")), lambda x, i: F.struct(i.alias("ord"), x["text"].alias("text"), x["start"].alias("start")))
    return c.withColumn("merged", tx.merge_chunks(parts)).select("page_id", "chunk_no", "merged", (F.col("merged") == F.col("text")).alias("same"))


@query("""WITH s AS (SELECT DISTINCT page_id, chunk_no, text FROM text_chunks WHERE trim(coalesce(text, '')) <> '') SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY chunk_no, text) - 1 AS new_no FROM s""")
def numbered_chunks(spark, d):
    """Chunks numbered per page after the blank ones are left out."""
    from pyspark.sql import Window

    c = table(spark, d, "text_chunks").select("page_id", "chunk_no", "text").distinct().where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return c.select("page_id", "text", (F.row_number().over(Window.partitionBy("page_id").orderBy("chunk_no", "text")) - 1).alias("new_no"))


_SHOTS = (("Tbe cat sat", "The cat sat"), ("on tlie mat", "on the mat"))
_TURNS = [("system", dn.SYSTEM), *[(r, ("Input: " if r == "user" else "") + t) for a, b in _SHOTS for r, t in (("user", a), ("assistant", b))]]


@query(f"WITH {_PAGES}, m AS (SELECT page_id, text, unnest([" + ", ".join(f"{{'ord': {i}, 'role': '{r}', 'content': '{c}'}}" for i, (r, c) in enumerate(_TURNS)) + f", {{'ord': {len(_TURNS)}, 'role': 'user', 'content': 'Input: ' || text}}]) AS x FROM p) SELECT page_id, x.ord::INT AS ord, x.role AS role, x.content AS content FROM m")
def chat_messages(spark, d):
    p = pages(spark, d).select("page_id", F.posexplode(dn.messages(F.col("text"), "complex", _SHOTS)).alias("ord", "m"))
    return p.select("page_id", "ord", "m.role", "m.content")


_HEAD = "Compare two corrections of a scanned page by faithfulness, fluency, completeness and no_hallucinations. Answer with a JSON object of these four and overall_winner; 1 means the first is better, 2 the second, 0 equal."


@query(f"""WITH t AS (SELECT DISTINCT pair, page_id, model1, model2, ground_truth FROM annotation_triples), p AS (SELECT page_id, min(text) AS text FROM ocr_pages GROUP BY 1)
SELECT pair, page_id, md5('{_HEAD}' || chr(10) || chr(10) || 'clean_text:' || chr(10) || coalesce(ground_truth, '') || chr(10) || chr(10) || 'ocr_text:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'denoised_1:' || chr(10) || coalesce(model1, '') || chr(10) || chr(10) || 'denoised_2:' || chr(10) || coalesce(model2, '')) AS prompt_md5 FROM t LEFT JOIN p USING (page_id)""")
def judge_prompts(spark, d):
    p = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("text").alias("text"))
    t = triples(spark, d).join(p, "page_id", "left")
    return t.select("pair", "page_id", F.md5(dn.judge_prompt(F.col("ground_truth"), F.col("text"), F.col("model1"), F.col("model2"))).alias("prompt_md5"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY pair, page_id, model1, model2, ground_truth) AS id, * FROM (SELECT DISTINCT pair, page_id, model1, model2, ground_truth FROM annotation_triples)),
a AS (SELECT pair, page_id, model1, model2, ground_truth, k AS att, list_filter(regexp_split_to_array(x, '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda w: w <> '') AS w, id FROM (SELECT *, unnest([0, 1, 2]) AS k, unnest([model1, model2, ground_truth]) AS x FROM t) WHERE x IS NOT NULL),
sizes AS (SELECT id, len(w) AS n, count(*) AS c, min(att) AS f FROM a GROUP BY ALL), best AS (SELECT id, n FROM sizes QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, f) = 1),
places AS (SELECT a.id, att, generate_subscripts(w, 1) AS p, unnest(w) AS v FROM a JOIN best ON a.id = best.id AND len(w) = best.n),
votes AS (SELECT id, p, v, count(*) AS c, min(att) AS f FROM places GROUP BY ALL), won AS (SELECT id, p, v FROM votes QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY c DESC, f) = 1),
voted AS (SELECT id, string_agg(v, ' ' ORDER BY p) AS voted FROM won GROUP BY 1)
SELECT t.pair, t.page_id, md5(coalesce(voted, '')) AS voted_md5 FROM best JOIN t USING (id) LEFT JOIN voted USING (id)""")
def majority_vote(spark, d):
    """The three texts of a triple as attempts at one answer."""
    t = triples(spark, d).withColumn("voted", dn.majority_of(F.array("model1", "model2", "ground_truth"))).where("voted is not null")
    return t.select("pair", "page_id", F.md5("voted").alias("voted_md5"))


@query(f"""WITH {_ANSWERS}, s AS (SELECT pair, page_id, side, string_split(answer, '. ') AS a, string_split(ground_truth, '. ') AS b FROM a WHERE answer IS NOT NULL)
SELECT pair, page_id, side, (i - 1)::INT AS pos, a[i] AS a, b[i] AS b FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM s)""")
def positional_pairs(spark, d):
    t = answers(spark, d).where("answer is not null")
    z = ds.positional_pairs(F.split("answer", r"\. "), F.split("ground_truth", r"\. "))
    return t.select("pair", "page_id", "side", F.posexplode(z).alias("pos", "z")).select("pair", "page_id", "side", "pos", "z.a", "z.b")


@query("""WITH n AS (SELECT DISTINCT sys_name, hub_path, short_alias FROM systems), m AS (SELECT DISTINCT sys_name, page_id, cer FROM metric_rows WHERE cer IS NOT NULL)
SELECT coalesce(short_alias, m.sys_name) AS name, replace(hub_path, '/', '-') AS file_name, count(*) AS n, round(min(greatest(cer, 1e-5)), 9) AS least FROM m LEFT JOIN n USING (sys_name) GROUP BY ALL""")
def aliased_scores(spark, d):
    m = table(spark, d, "metric_rows").select("sys_name", "page_id", "cer").where("cer is not null").distinct()
    n = F.broadcast(table(spark, d, "systems").select("sys_name", "hub_path", "short_alias").distinct())  # a table of fixed size
    j = m.join(n, "sys_name", "left").select(F.coalesce("short_alias", "sys_name").alias("name"), tx.path_name(F.col("hub_path")).alias("file_name"), sm.log_clamped(F.col("cer")).alias("cer"))
    return j.groupBy("name", "file_name").agg(F.count("*").alias("n"), F.round(F.min("cer"), 9).alias("least"))


_STEM = "regexp_replace(regexp_replace({}, '^.*/', ''), '\\.[^.]*$', '')"


@query(f"""SELECT page_id, pair, {_STEM.format('pair')} || '_classic_scores.json' AS scores_file, {_STEM.format('pair')} || '_rouge_comparison.json' AS preference_file,
{_STEM.format('pair')} || '_denoised_' || replace(a, '/', '-') || '.json' AS denoised_file, {_STEM.format('a')} || '_Against_' || {_STEM.format('b')} || '.json' AS judgement_file
FROM (SELECT DISTINCT page_id, pair, string_split(pair, '_vs_')[1] AS a, string_split(pair, '_vs_')[2] AS b FROM annotation_triples)""")
def file_names(spark, d):
    t = table(spark, d, "annotation_triples").select("page_id", "pair", tx.pair_sides(F.col("pair")).alias("s")).distinct()
    p, a, b = F.col("pair"), F.col("s.a"), F.col("s.b")
    return t.select("page_id", "pair", tx.scores_file(p).alias("scores_file"), tx.preference_file(p).alias("preference_file"), tx.denoised_file(p, a).alias("denoised_file"), tx.judgement_file(a, b).alias("judgement_file"))


@query(f"""WITH t AS (SELECT DISTINCT pair, page_id, model1, model2, ground_truth FROM annotation_triples), p AS (SELECT page_id, min(text) AS text FROM ocr_pages GROUP BY 1)
SELECT pair, page_id, {", ".join(f"CASE WHEN coalesce(length(model1), 0) > coalesce(length(model2), 0) THEN 1 WHEN coalesce(length(model2), 0) > coalesce(length(model1), 0) THEN 2 ELSE 0 END::INT AS {c}" for c in CRITERIA)} FROM t LEFT JOIN p USING (page_id)""")
def judged_triples(spark, d):
    """A judge asked about every triple, the answers shown in random order: one that prefers the longer answer, so that every label is known."""
    p = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("text").alias("text"))
    t = triples(spark, d).join(p, "page_id", "left").withColumn("id", F.xxhash64("model1", "model2", "ground_truth"))
    return dn.judge(t, ["pair", "page_id", "id"], "ground_truth", "text", "model1", "model2", dn.length_judge).drop("id")


@query("SELECT json_valid(raw) AS valid, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM judge_rows) WHERE raw IS NOT NULL AND trim(raw) <> '' GROUP BY ALL")
def json_answers(spark, d):
    r = table(spark, d, "judge_rows").drop("loaded_at").distinct().where("raw is not null and trim(raw) <> ''")
    return r.groupBy(tx.is_json(F.col("raw")).alias("valid")).agg(F.count("*").alias("n"))


# ---- characters, errors, noise


_FLAT = "f AS (SELECT regexp_replace(coalesce(text, ''), '[\\n\\r]', '', 'g') AS t FROM (SELECT DISTINCT dataset, page_id, lang, text FROM ocr_pages WHERE text IS NOT NULL))"


@query(f"""WITH {_FLAT}, c AS (SELECT unnest(string_split(t, '')) AS symbol FROM f), u AS (SELECT symbol, count(*) AS n FROM c WHERE symbol <> '' GROUP BY 1
UNION ALL SELECT ' ', greatest(count(*) - 1, 0) FROM f UNION ALL SELECT 'rn', coalesce(sum(len(string_split(t, 'rn')) - 1), 0) FROM f UNION ALL SELECT 'cl', coalesce(sum(len(string_split(t, 'cl')) - 1), 0) FROM f UNION ALL SELECT 'vv', coalesce(sum(len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 2) = 'vv'))), 0) FROM f)
SELECT symbol, sum(n)::BIGINT AS n FROM u GROUP BY 1""")
def character_counts(spark, d):
    return er.character_counts(pages(spark, d), "text")


@query(f"""WITH {_FLAT}, c AS (SELECT unnest(string_split(t, '')) AS symbol FROM f), u AS (SELECT symbol, count(*) AS n FROM c WHERE symbol <> '' GROUP BY 1) SELECT symbol, n, round(n / sum(n) OVER (), 12) AS share FROM u""")
def character_shares(spark, d):
    flat = pages(spark, d).select(F.explode(F.filter(F.split(F.regexp_replace("text", r"[\n\r]", ""), ""), lambda c: c != "")).alias("symbol"))
    return er.shares(flat.groupBy("symbol").agg(F.count("*").alias("n"))).withColumn("share", F.round("share", 12))


_PAIR_SQL = "pp AS (SELECT row_number() OVER () AS id, page_id, ocr, clean FROM (SELECT DISTINCT page_id, text AS ocr FROM ocr_pages WHERE text IS NOT NULL) JOIN (SELECT DISTINCT page_id, ground_truth AS clean FROM annotation_triples WHERE ground_truth IS NOT NULL) USING (page_id))"


@query(f"WITH {_PAIR_SQL}, i AS (SELECT ocr, clean, unnest(range(1, least(length(ocr), length(clean)) + 1)) AS i FROM pp) SELECT gs AS gt_shape, os AS ocr_shape, (SELECT count(*) FROM i WHERE substr(clean, i, length(gs)) = gs AND substr(ocr, i, length(os)) = os) AS n FROM (VALUES ('m', 'rn'), ('rn', 'm'), ('d', 'cl'), ('cl', 'd'), ('w', 'vv'), ('vv', 'w')) v(gs, os)")
def shape_errors(spark, d):
    p = page_pairs(spark, d).select(F.explode(al.shape_counts(F.col("clean"), F.col("ocr"))).alias("x"))
    return p.groupBy("x.gt_shape", "x.ocr_shape").agg(F.sum("x.n").alias("n"))


@query(f"WITH RECURSIVE {counted(_PAIR_SQL)} SELECT kind, gt_char, ocr_char, n FROM errors")
def word_errors(spark, d):
    return al.word_errors(page_pairs(spark, d), "clean", "ocr")


_SYMBOLS = """flat AS (SELECT regexp_replace(clean, '[\n\r]', '', 'g') AS t FROM pp), letters AS (SELECT unnest(string_split(t, '')) AS symbol FROM flat),
u AS (SELECT symbol, count(*) AS n FROM letters WHERE symbol <> '' GROUP BY 1 UNION ALL SELECT ' ', greatest(count(*) - 1, 0) FROM flat UNION ALL SELECT 'rn', coalesce(sum(len(string_split(t, 'rn')) - 1), 0) FROM flat UNION ALL SELECT 'cl', coalesce(sum(len(string_split(t, 'cl')) - 1), 0) FROM flat UNION ALL SELECT 'vv', coalesce(sum(len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 2) = 'vv'))), 0) FROM flat),
symbols AS (SELECT symbol, sum(n) AS occ FROM u GROUP BY 1)"""


@query(f"WITH RECURSIVE {counted(_PAIR_SQL)}, {_SYMBOLS} SELECT kind, gt_char, ocr_char, n, round_even(n / occ, 3) AS rate FROM errors JOIN symbols ON symbol = gt_char WHERE occ > 0")
def word_error_rates(spark, d):
    """Errors of a symbol by its occurrences in the clean pages."""
    pp = page_pairs(spark, d)
    return er.letter_shares(al.word_errors(pp, "clean", "ocr"), er.character_counts(pp, "clean"))


@query(f"WITH RECURSIVE {walked(_PAIR_SQL)} SELECT k.kind, count(met.kind) AS n FROM (SELECT unnest(['space_added', 'space_removed']) AS kind) k LEFT JOIN met USING (kind) GROUP BY ALL")
def space_error_totals(spark, d):
    return er.space_totals(al.word_errors(page_pairs(spark, d), "clean", "ocr"))


@query(f"WITH RECURSIVE {walked(_PAIR_SQL)} SELECT page_id, kind, ex AS gt_words, ey AS ocr_words FROM met WHERE kind <> 'pair'")
def space_error_examples(spark, d):
    return al.space_examples(page_pairs(spark, d), ["page_id"], "clean", "ocr")


# one chunk of every text a step; places count from 0
_CHUNKS = r"""t AS (SELECT row_number() OVER () AS id, page_id, clean, length(clean) AS n FROM (SELECT DISTINCT page_id, ground_truth AS clean FROM annotation_triples WHERE ground_truth IS NOT NULL) WHERE page_id IN (SELECT page_id FROM ocr_pages WHERE text IS NOT NULL)),
c AS (SELECT id, -1 AS chunk_no, -1 AS start_, -1 AS end_ FROM t UNION ALL
    SELECT id, chunk_no + 1, from_, CASE WHEN far < n AND dot > 0 THEN far + dot - 1 WHEN far < n THEN stop + length(regexp_extract(substr(clean, stop + 1, least(stop + 21, n) - stop), '^[^ .]*')) ELSE far END FROM (
        SELECT *, strpos(substr(clean, far + 1, stop - far), '.') AS dot FROM (
            SELECT c.id, c.chunk_no, c.end_ + 1 AS from_, c.end_ + 201 AS far, least(c.end_ + 201 + 67, t.n) AS stop, t.clean, t.n FROM c JOIN t USING (id) WHERE c.end_ + 1 < t.n))),
chunks AS (SELECT id, page_id, chunk_no, regexp_replace(substr(clean, start_ + 1, end_ - start_ + 1), '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS chunk FROM c JOIN t USING (id) WHERE chunk_no >= 0)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT page_id, chunk_no::INT AS chunk_no, chunk FROM chunks")
def clean_chunks(spark, d):
    return al.clean_chunks(page_pairs(spark, d).select("page_id", "clean").distinct(), ["page_id"], "clean")


@query()
def aligned_chunks(spark, d):
    return al.aligned_chunks(page_pairs(spark, d), ["page_id"], "clean", "ocr")


@query()
def aligned_chunk_count(spark, d):
    return al.aligned_count(aligned_chunks(spark, d))


@query()
def chunk_error_counts(spark, d):
    return al.document_errors(page_pairs(spark, d), "clean", "ocr")


@query()
def common_error_distribution(spark, d):
    return er.error_distribution(durable(chunk_error_counts(spark, d)))


@query(f"""WITH RECURSIVE {counted(_PAIR_SQL)}, {_SYMBOLS}, rates AS (SELECT kind, gt_char, ocr_char, n, round_even(n / occ, 3) AS rate FROM errors JOIN symbols ON symbol = gt_char WHERE occ > 0),
c AS (SELECT rate, sum(w) OVER o AS w, sum(w * rate) OVER o AS x, sum(w * rate * rate) OVER o AS xx FROM (SELECT rate, count(*) AS w FROM rates GROUP BY 1) WINDOW o AS (ORDER BY rate ROWS UNBOUNDED PRECEDING)), t AS (SELECT max_by(w, rate) AS tw, max_by(x, rate) AS tx, max_by(xx, rate) AS txx, max(rate) AS top FROM c),
cut AS (SELECT arg_min(rate, xx - x * x / w + (txx - xx) - (tx - x) ** 2 / (tw - w)) AS below FROM c, t WHERE rate < top)
SELECT kind, gt_char, ocr_char, n, rate, 1 AS cluster FROM rates, cut WHERE below IS NULL OR rate > below""")
def common_word_errors(spark, d):
    """The larger of two clusters of word error rates."""
    return er.common_errors(durable(word_error_rates(spark, d)), "rate", 2, 1)


@query()
def synthetic_pages(spark, d):
    """A noisy corpus from the clean pages, with the errors of characters found in aligned chunks and the shapes found in words."""
    found = er.merged(chunk_error_counts(spark, d), word_errors(spark, d).where("kind = 'visual'"))
    model = ns.model_of(er.shares(found, ["kind"]))
    clean = page_pairs(spark, d).select(F.xxhash64("page_id", "clean").alias("text_id"), "clean").distinct()
    return ns.noisy_corpus(clean, "text_id", "clean", model)


_SUB = {"e": ("c", 0.03), "h": ("b", 0.02), "n": ("u", 0.02), "l": ("1", 0.01)}
_SUB_SQL = " ".join(f"WHEN '{k}' THEN CASE WHEN h < {p} THEN '{t}' ELSE c END" for k, (t, p) in _SUB.items())


@query(f"""WITH s AS (SELECT DISTINCT page_id, chunk_no, text FROM text_chunks WHERE text IS NOT NULL), k AS (SELECT row_number() OVER () AS id, * FROM s),
c AS (SELECT id, page_id, chunk_no, generate_subscripts(string_split(text, ''), 1) - 1 AS i, unnest(string_split(text, '')) AS c FROM k),
x AS (SELECT *, CASE WHEN c IN ('e', 'h', 'n', 'l') THEN ('0x' || substr(md5('7:' || (page_id || '/' || chunk_no) || ':' || i), 1, 8))::BIGINT / 4294967296.0 END AS h FROM c)
SELECT page_id, chunk_no, string_agg(CASE c {_SUB_SQL} ELSE c END, '' ORDER BY i) AS noisy FROM x GROUP BY id, page_id, chunk_no""")
def substituted_chunks(spark, d):
    c = table(spark, d, "text_chunks").select("page_id", "chunk_no", "text").distinct().where("length(text) > 0")
    return c.select("page_id", "chunk_no", ns.substitute(F.col("text"), F.concat_ws("/", "page_id", "chunk_no"), _SUB).alias("noisy"))


_WORDS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


@query(f"""WITH {_SENTENCES}, w AS (SELECT page_id, chunk_no, text, ord, start_, array_to_string(list_transform(string_split(part, ' '), lambda x: CASE WHEN x IN ('tbe', 'tle', 'lhe', 'thc') THEN 'the' ELSE x END), ' ') AS said FROM placed),
v AS (SELECT page_id, chunk_no, text, ord, start_, array_to_string(list_filter(regexp_split_to_array(said, '{_WORDS}'), lambda x: x <> ''), ' ') AS voted FROM w)
SELECT page_id, chunk_no, string_agg(voted, ' ' ORDER BY start_, ord) AS denoised FROM v GROUP BY page_id, chunk_no, text""")
def denoised_chunks(spark, d):
    """Chunks through a dictionary backend, three attempts, voted and merged."""
    c = table(spark, d, "text_chunks").select("page_id", "chunk_no", "text", F.xxhash64("text").alias("id")).distinct().where("text is not null")
    table_ = {"tbe": "the", "tle": "the", "lhe": "the", "thc": "the"}
    return dn.denoise(c, ["page_id", "chunk_no", "id"], "text", dn.dictionary_backend(table_), attempts=3, mode="simple", shots=_SHOTS).drop("id")


@query("SELECT lang, count(*) AS pages, max(page_id) AS last_page FROM (SELECT DISTINCT page_id, lang, text FROM ocr_pages WHERE text IS NOT NULL) GROUP BY ALL")
def streamed_pages(spark, d):
    """Page deliveries read as a stream, repeats taken out in its state; the result is read back from the stream's output."""
    from pageloom.streaming import scores

    out = fresh_folder(spark, "stream")
    src = table(spark, d, "ocr_pages")
    stream = scores.answers_stream(spark, f"{d}/ocr_pages.parque[t]", src.schema).where("text is not null")
    unique = scores.without_repeats(stream.withColumn("digest", F.xxhash64("lang", "text")), ["page_id", "digest"])
    scores.run_available(unique.select("page_id", "lang"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("lang").agg(F.count("*").alias("pages"), F.max("page_id").alias("last_page"))


@query("""WITH c AS (SELECT page_id, chunk_no, max(length(text)) AS n FROM text_chunks GROUP BY ALL)
SELECT page_id, chunk_no, n::INT AS length, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c WHERE n IS NOT NULL""")
def chunk_offsets(spark, d):
    """Where each chunk of a page would begin if they followed each other."""
    c = table(spark, d, "text_chunks").groupBy("page_id", "chunk_no").agg(F.max(F.length("text")).alias("length")).where("length is not null")
    return sm.running_offset(c, ["page_id"], "chunk_no", F.col("length")).select("page_id", "chunk_no", "length", "offset")


@query(f"WITH RECURSIVE {counted(_PAIR_SQL)} SELECT kind, gt_char, ocr_char, n, row_number() OVER (ORDER BY n DESC, kind, gt_char, ocr_char)::INT AS rank FROM errors QUALIFY rank <= 25")
def frequent_errors(spark, d):
    """The 25 most frequent errors."""
    return er.most_frequent(word_errors(spark, d), 25)


@query("""SELECT CASE sys_name WHEN 'x' THEN 'y' ELSE sys_name END AS name, count(*) AS n FROM (SELECT DISTINCT sys_name, page_id FROM metric_rows) GROUP BY ALL""")
def renamed_systems(spark, d):
    """Names that have no alias stay as they are; every name is a known one."""
    m = table(spark, d, "metric_rows").select("sys_name", "page_id").distinct()
    known = {r["sys_name"]: r["sys_name"] for r in table(spark, d, "systems").select("sys_name").distinct().collect()}  # a table of fixed size
    return m.groupBy(tx.known_model(tx.alias(F.col("sys_name"), {"x": "y"}), known).alias("name")).agg(F.count("*").alias("n"))
