"""Repair, pairs, cut-off and leaks on small cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import cutoff, leaks, ocr_repair, pairs

# ---- suffix automaton


def plain_coverage(page, answer, least=3):
    covered = set()
    for i in range(len(answer)):
        for j in range(i + least, len(answer) + 1):
            if any(page[k : k + j - i] == answer[i:j] for k in range(len(page))):
                covered |= set(range(i, j))
    return len(covered) / len(answer) if answer else 0.0


words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_coverage_against_all_substrings(page, answer):
    assert pairs.SuffixAutomaton(page).coverage(answer) == pytest.approx(plain_coverage(page, answer))


def test_delimiters_and_votes():
    assert pairs.open_delimiters("“a (b) c") == 1 and pairs.open_delimiters("a) (b)") == 0
    assert pairs.language_vote("la vedova e il ponte di pietra nel giardino")[0] == "it"
    assert pairs.language_vote("the widow and the bridge of stone in the garden")[0] == "en"
    assert pairs.language_vote("x y")[0] is None and pairs.language_vote(None)[0] is None


CLEAN = "The old widow carried a lamp to the garden of the abbey. She dropped the key near the gate, and the clerk found it in the morning."
PAGE = "THE OLD KEY\nThe old widow carried a lamp to tbe gar-\nden of the abbey. She droppcd the key near\nthe gate, and thc clerk found it in the mornlng.\n12"


def pair_table(spark, answers):
    rows = [("a_vs_b", i, m, CLEAN, CLEAN) for i, m in enumerate(answers)]
    return spark.createDataFrame(rows, "pair string, page_id long, model1 string, model2 string, ground_truth string")


def test_defects(spark):
    answers = {
        CLEAN: None, None: "empty", " ​\n": "empty", "N/A": "empty", "[]": "empty", "…": "empty",
        "I'm sorry, but I can't restore this page.": "refusal", "Please provide the text you would like me to denoise.": "refusal", "Mi dispiace, ma non posso correggere questo testo.": "refusal",
        "La vedova portava una lampada nel giardino e il ponte di pietra nella biblioteca, quando la badessa trovò la chiave.": "language",
        PAGE: "copy", "Output: " + " ".join(PAGE.replace("gar-\nden", "garden").split()): "copy",
        CLEAN[:60]: "truncated", CLEAN[: CLEAN.index(" She")]: "truncated", "Corrected text:\n" + CLEAN: None, CLEAN + " Note: all words were checked.": None,
        CLEAN.replace(" She dropped the key near the gate,", ""): None,
    }
    pages = spark.createDataFrame([(i, "EN", PAGE) for i in range(len(answers))] * 2, "page_id long, lang string, text string")
    got = {(r["page_id"], r["side"]): r["defect"] for r in pairs.defects(pair_table(spark, list(answers)), pages, ["pair", "page_id"]).collect()}
    assert {k: got.get((i, 1)) for i, k in enumerate(answers)} == answers
    assert not any(s == 2 for _, s in got)


def test_defects_without_page_or_reference(spark):
    rows = [("p", 1, "text that ends.", None, None), ("p", None, None, "x", "y"), ("p", 3, "long " * 30_000, "z", None)]
    t = spark.createDataFrame(rows, "pair string, page_id long, model1 string, model2 string, ground_truth string")
    pages = spark.createDataFrame([(3, None, None)], "page_id long, lang string, text string")
    got = {(r["page_id"], r["side"]): r["defect"] for r in pairs.defects(t, pages, ["pair", "page_id"]).collect()}
    assert got[(1, 2)] == "empty" and (1, 1) not in got and got[(None, 1)] == "empty"
    assert pairs.defects(t.limit(0), pages.limit(0), ["pair", "page_id"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(words)
def test_phrases_against_search(text):
    patterns = ("a b", "b (c) d", "a/b a", "d")
    plain = [x.split() for x in ("a b", "b c d", "b d", "a a", "b a", "d")]
    found = {k for k in range(len(text)) for x in plain if text[k : k + len(x)] == x}
    got = set(pairs.PhraseAutomaton(patterns).matches(text))
    # of patterns that end on the same word the longest counts
    assert got <= found and {k for k in found if text[k] != "d" or k == 0 or k in got} <= got | {k for k in found if any(j < k for j in got)}


@pytest.mark.parametrize("text, out", [
    ("I'm sorry, but I can't read this.", True), ("Well, I am very sorry but this page is empty", True), ("I won’t be able to complete it.", True), ("“I am sorry, but I cannot go,” said the clerk.", False),
    ("The clerk said that he must. I am sorry, but I cannot go.", False), ("", False), (None, False), ("Es tut mir leid.", True), ("Non posso aiutarti.", True),
])
def test_refusals(text, out):
    assert pairs.refuses(text) is out


def test_defects_when_no_reference_is_known(spark):
    """Copies are told by the other response, or by words with marks among their letters; cuts by their end and by what the page holds after it."""
    odd = PAGE.replace("widow", "w1dow").replace("clerk", "cl;erk")
    cases = [
        (PAGE, CLEAN, "copy", None), (CLEAN, PAGE, None, "copy"), (CLEAN, CLEAN, None, None), ("I cannot assist with this text.", CLEAN, "refusal", None),
        (CLEAN[:60], CLEAN, "truncated", None), ("She said: (the old", None, "truncated", "empty"), (CLEAN, "Mi dispiace, ma non posso.", None, "refusal"), (odd, None, "copy", "empty"),
    ]
    t = spark.createDataFrame([("p", i, a, b, None) for i, (a, b, _, _) in enumerate(cases)], "pair string, page_id long, model1 string, model2 string, ground_truth string")
    pages = spark.createDataFrame([(i, "en", odd if i == 7 else PAGE) for i in range(len(cases))], "page_id long, lang string, text string")
    got = {(r["page_id"], r["side"]): r["defect"] for r in pairs.defects(t, pages, ["pair", "page_id"]).collect()}
    assert {(i, s): got.get((i, s)) for i in range(len(cases)) for s in (1, 2)} == {(i, s): c[1 + s] for i, c in enumerate(cases) for s in (1, 2)}


def test_copies_keep_every_error_and_right_answers_do_not(spark):
    half = CLEAN.replace("the garden", "tbe garden")
    page = spark.createDataFrame([(i, "en", PAGE) for i in range(4)], "page_id long, lang string, text string")
    long_ = " ".join([CLEAN.replace("key", f"key {k}") for k in range(400)])
    page = page.unionByName(spark.createDataFrame([(9, "en", long_.replace("widow", "vvidow"))], page.schema))
    rows = [("p", 0, half, PAGE, CLEAN), ("p", 1, PAGE.replace("\n", "\r\n"), CLEAN.upper(), CLEAN), ("p", 9, long_, long_.replace("widow", "vvidow"), long_)]
    got = {(r["page_id"], r["side"]): r["defect"] for r in pairs.defects(spark.createDataFrame(rows, "pair string, page_id long, model1 string, model2 string, ground_truth string"), page, ["page_id"]).collect()}
    assert got == {(0, 2): "copy", (1, 1): "copy", (9, 2): "copy"}


# ---- cut off


def test_spikes_and_cuts(spark):
    random.seed(9)
    rows = []
    for i in range(300):
        whole = "word " * random.randrange(20, 60) + "end."
        rows.append((i, "s", whole[:100] if i % 5 == 0 else whole, None, None))
    rows += [(900, "t", "Short and finished.", 19, "Short and finished."), (901, "t", "It stops in the mid", 60, None), (902, "t", None, 5, "x"), (903, "t", "  ", 9, "x"), (904, "t", "Nothing", None, None)]
    d = spark.createDataFrame(rows, "id int, src string, text string, rec int, ref string").withColumn("chars", F.lit("clash"))
    m = cutoff.measure(d, "text", "ref")
    got = cutoff.detect_cuts(m, ["src"], "rec")
    cut = {r["id"] for r in got.where("cut").collect()}
    assert cut == {r[0] for r in rows[:300] if len(r[2]) == 100} | {901}
    assert {r["id"]: r["evidence"] for r in got.where("cut").collect()}[901] == "recorded" and got.where("evidence = 'limit'").count() == len(cut) - 1
    assert [tuple(r) for r in cutoff.length_limits(m.withColumn("col", F.lit("text")), ["src", "col"]).orderBy("unit").collect()] == [("s", "text", u, 100, len(cut) - 1) for u in ("bytes", "chars")]
    rate = {r["src"]: (r["texts"], r["cut_texts"]) for r in cutoff.cut_rates(got, "src").collect()}
    assert rate["t"] == (5, 1)
    assert cutoff.detect_cuts(cutoff.measure(d.limit(0), "text"), ["src"]).count() == 0


@pytest.mark.parametrize("text, left", [(CLEAN, 0), (CLEAN[:-20], None), (CLEAN[:50], None), ("entirely other words that never stand there at all", -1), (CLEAN + " And more.", 0)])
def test_letters_left(spark, text, left):
    only = lambda t: re.sub(r"[\W\d_]", "", t.lower())
    d = spark.createDataFrame([(text, CLEAN)], "t string, r string")
    got = d.select(cutoff.letters_left(cutoff.body(F.col("t")), cutoff.body(F.col("r")))).first()[0]
    assert got == (None if left == -1 else 0 if left == 0 else len(only(CLEAN)) - len(only(text)))


PAGE_9 = "In the grey morning the widow walked slowly across the old bridge to the garden above the mill."


def test_letters_left_near_the_end(spark):
    left = {
        PAGE_9[:-1]: 0, "Oh. " + PAGE_9.replace("mill", "rnill"): 0, PAGE_9.replace("mill", "mitt"): 0, PAGE_9.replace("the mill", "thc rnill"): 0, PAGE_9.replace("mill", "weir"): 0,
        PAGE_9.replace("mill.", "river. And so they went home again."): 0, PAGE_9[:-6]: 4, PAGE_9[:-3]: 2, PAGE_9[:-10]: 7, PAGE_9[:-14]: 11, PAGE_9[:-15]: 12, PAGE_9.replace("above", "abave")[:-3]: 2, PAGE_9.replace("walked", "walkcd")[:-6]: 4,
    }
    d = spark.createDataFrame([(t, PAGE_9) for t in left], "t string, r string").coalesce(1)
    got = d.select("t", cutoff.letters_left(cutoff.body(F.col("t")), cutoff.body(F.col("r"))).alias("left")).collect()
    assert {r["t"]: r["left"] for r in got} == left
    # the place is found however far back the last letters that stand in both are
    far = "".join(f"{PAGE_9[:-1]} number {'x' * k} stands here. " for k in range(1, 30))
    lost = far[:1500] + " zq" * 200
    d = spark.createDataFrame([(lost, far)], "t string, r string")
    assert d.select(cutoff.letters_left(F.col("t"), F.col("r"))).first()[0] is not None


def test_short_cuts_are_found(spark):
    texts = {k: PAGE_9[:-1][:-k].rstrip() for k in range(1, 14)} | {20: PAGE_9, 21: PAGE_9.replace("mill", "rnill")}
    d = spark.createDataFrame([(k, "s", t, PAGE_9, 99) for k, t in texts.items()], "id int, src string, text string, ref string, rec int").coalesce(1)
    m = cutoff.measure(d, "text", "ref").cache()
    for recorded in (None, "rec"):
        assert {r["id"] for r in cutoff.detect_cuts(m, ["src"], recorded).where("cut").collect()} == {*range(1, 14)}
    p = d.select(F.col("id").alias("page_id"), F.col("ref").alias("model1"), F.col("text").alias("model2"), F.col("ref").alias("ground_truth"))
    pages = spark.createDataFrame([(1, "en", "Other words stand here.")], "page_id int, lang string, text string")
    assert {tuple(r) for r in pairs.defects(p, pages, ["page_id"]).collect()} == {(k, 2, "truncated") for k in range(1, 14)}


# ---- leaks

VOCABULARY = [a + b for a in ("lam", "bro", "ket", "vin", "sol", "dar", "mip", "tus") for b in ("per", "lin", "gat", "mos", "ruk", "fen")]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_leaks_against_plain_word_search(spark):
    rng = random.Random(10)
    items = {i: passage(rng, 60) for i in range(6)}
    docs, truth = {}, set()
    for n in range(120):
        body = passage(rng, 80)
        kind = n % 6
        item = rng.randrange(6)
        if kind in (1, 2, 3):
            a = rng.randrange(0, 30)
            part = list(items[item][a : a + 30])
            if kind == 2:
                for j in (7, 15, 23):
                    part[j] = part[j][:-1] + "x"
            if kind == 3:
                part.insert(10, "then")
                part.insert(21, "sic")
            body[40:40] = part
            truth.add((n, item))
        elif kind == 4:
            body[40:40] = items[item][:18]
        text = " ".join(body)
        docs[n] = text.upper().replace(" ", "\n", 3) if n % 2 else text.replace("a", "а", 3)
    d = spark.createDataFrame([(k, v) for k, v in docs.items()] + [(900, None), (901, "")], "doc_id long, text string").withColumn("item", F.lit("clash"))
    it = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(99, "too short"), (98, None)], "item_id long, text string")
    found = leaks.find_leaks(d, "doc_id", "text", it, "item_id", "text")
    assert {(r["doc"], r["item"]) for r in found.collect()} == truth
    in_blocks = leaks.find_leaks(d, "doc_id", "text", it, "item_id", "text", block_letters=600)
    assert {tuple(r) for r in in_blocks.collect()} == {tuple(r) for r in found.collect()}
    assert {r["item"] for r in leaks.leaked_items(found).collect()} == {i for _, i in truth}
    assert leaks.find_leaks(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert leaks.find_leaks(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def item_tables(spark, texts, min_words=25, notice_words=14):
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "i long, t string")
    return leaks.Items([tuple(r) for r in leaks.with_notices(d, notice_words).collect()], 16, min_words)


def test_shared_notices_do_not_count(spark):
    rng = random.Random(11)
    notice, own = passage(rng, 20), [passage(rng, 40) for _ in range(2)]
    items = item_tables(spark, [o + notice for o in own])
    rest = passage(rng, 30)
    assert leaks.find_in_batch(items, [" ".join(rest + own[0][-10:] + notice)]) == []
    assert leaks.find_in_batch(items, [" ".join(own[0][-26:] + notice + rest)]) == [(0, 0, 26)]
    assert leaks.find_in_batch(items, [" ".join(own[0][-13:] + notice + own[0][:13])]) == []
    # a notice between two parts of a passage joins them, and does not count itself
    parted = item_tables(spark, [own[0][:15] + notice + own[0][15:], own[1] + notice])
    assert leaks.find_in_batch(parted, [" ".join(own[0][:15] + notice + own[0][15:])]) == [(0, 0, 40)]


def test_notices_are_the_same_however_many_blocks(spark):
    rng = random.Random(21)
    notice = passage(rng, 16)
    items = spark.createDataFrame([(k, " ".join(passage(rng, 30) + notice)) for k in range(6)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), "text")
    found = [sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "text", block_letters=n).collect())) for n in (10**6, 300)]
    assert found[0] == found[1] == [(k, k, 30) for k in range(6)]


def test_an_item_many_times_in_one_document(spark):
    """Misread words in every copy: the longest run is found however many copies stand in between."""
    rng = random.Random(22)
    item = passage(rng, 40)
    copies = []
    for k in range(60):
        words = item[:12] + ["zzz" + "qx"[k % 2] * 9] * 6 + item[18:30]
        copies += words + passage(rng, 25)
    whole = list(item)
    for j in (8, 17, 26):
        whole[j] = whole[j][:-1] + "x"
    items = item_tables(spark, [item])
    assert leaks.find_in_batch(items, [" ".join(copies)]) == []
    assert leaks.find_in_batch(items, [" ".join(copies[:900] + whole + copies[900:])])[0][:2] == (0, 0)


def test_letters_of_any_script(spark):
    assert leaks.letters("Éa, б-в 1") == "eaбb1".encode() and leaks.letters("A-b") == b"ab"
    rng = random.Random(23)
    item = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(40)]
    assert leaks.find_in_batch(item_tables(spark, [item]), ["x " + " ".join(item[5:35]).upper()]) == [(0, 0, 30)]


@pytest.mark.parametrize("seed", range(6))
def test_occurrences_against_plain_search(spark, seed):
    import numpy as np

    rng = random.Random(seed)
    items = item_tables(spark, [passage(rng, 40) for _ in range(3)], 5)
    text = b"\0".join(leaks.letters(" ".join(passage(rng, 500))) + items.text[k % 3][: rng.randrange(400)] for k in range(1 + 20 * seed))
    at, n = items.occurrences(np.frombuffer(text, dtype=np.uint8))
    want = {(m.start(), p) for p in items.where for m in re.finditer(b"(?=" + re.escape(p) + b")", text)}
    assert {(int(a), bytes(items.patterns[k])) for a, k in zip(at, n)} == want


# ---- repair


def test_edge_lines(spark):
    texts = {
        1: "THE OLD KEY.\n\nCHAPTER II. The Gate.\nThe widow carried the lamp\nover the bridge.\n( 12 )",
        2: "THE OLD KEY,\n\nA Tale.",
        3: "xiv\nCHAP. 1V.\nbody text stands here and\ngoes on",
        4: "first body line, and\n- 31 -\nTHE 0LD KEY\nsecond body line",
        5: "12   THE OLD KEY\r\nbody line of the page\r\nand one more",
        6: "", 7: None, 8: "mi\nla vedova", 9: "1880\nwas a year of",
    }
    d = spark.createDataFrame(list(texts.items()), "page_id int, text string")
    got = {}
    for r in ocr_repair.page_lines(d, ["page_id"], "text").where("kind <> 'body'").collect():
        got.setdefault(r["page_id"], {})[r["line_no"]] = r["kind"]
    assert got == {1: {1: "header", 6: "pagenum"}, 3: {1: "pagenum", 2: "header"}, 4: {2: "pagenum", 3: "header"}, 5: {1: "header"}}


def scanned(spark):
    clean = "the grey-haired widow carried the lamp to the garden and the widow found the lamp in the morning near the grey-haired clerk"
    noisy = {1: "the grey-haired wid-\now carried thc lamp to the gar¬\nden and the grey-\nhaired clerk found", 2: "thelamp in the mor ning near the vvidow\nand the garden", 3: None, 4: "the garderi of\nthe clerk"}
    pages = spark.createDataFrame(list(noisy.items()), "page_id int, text string").withColumn("n", F.lit("clash"))
    trusted = spark.createDataFrame([(1, clean + " of")] * 4, "page_id int, g string")
    return pages, trusted


def test_page_faults(spark):
    pages, trusted = scanned(spark)
    got = {(r["page_id"], r["line_no"], r["kind"]) for r in ocr_repair.page_faults(pages, ["page_id"], "text", [("g", trusted, "g")]).where("src_field = 'text'").collect()}
    assert got == {(1, 1, "hyphen"), (1, 2, "misread"), (1, 2, "hyphen"), (2, 1, "misread"), (4, 1, "misread")}
    none = ocr_repair.page_faults(pages.limit(0), ["page_id"], "text", [("g", trusted.limit(0), "g")])
    assert none.count() == 0


def test_repaired_pages(spark):
    pages, trusted = scanned(spark)
    count = lambda df, c: ocr_repair.count_words(ocr_repair.line_words(ocr_repair.page_lines(df, ["page_id"], c), ["page_id"]))
    lex = ocr_repair.lexicon(count(pages, "text"), count(trusted, "g"))
    noise = ocr_repair.noise_words(lex)
    got = {r["page_id"]: r["repaired"] for r in ocr_repair.repair(pages.select("page_id", "text"), ["page_id"], "text", lex, noise).collect()}
    assert got[1] == "the grey-haired widow carried the lamp to the garden and the grey-haired clerk found"
    assert got[2].startswith("the lamp in the") and got[2].endswith("near the widow and the garden")
    assert got[4] == "the garden of the clerk" and 3 not in got


def test_parted_words_and_empty_pages(spark):
    texts = {1: "the mirr or near,\nthe cr ooked (mir ror) a bout\nmir. Ror stands", 2: "Ta rnithithal, near the lamp", 3: None, 4: "  ", 5: "the mir ror mir ror", 6: "near or the"}
    sound = ("the", "or", "mirror", "crooked", "tarnithithal", "near", "lamp", "a", "about", "stands")
    lex = spark.createDataFrame([(w, 50, True) for w in sound] + [(w, 1, False) for w in ("mirr", "ta", "rnithithal", "cr", "ooked", "mir", "ror", "bout")], "word string, n long, known boolean")
    pages = spark.createDataFrame(list(texts.items()), "page_id int, text string")
    noise = spark.createDataFrame([("ta", "a"), ("mirr", "mirror"), ("cr", "or")], "word string, fix string")
    got = {r["page_id"]: r["repaired"] for r in ocr_repair.repaired_pages(pages, ["page_id"], "text", lex, noise).collect()}
    assert got == {1: "the mirror near, the crooked (mirror) about mir. Ror stands", 2: "Tarnithithal, near the lamp", 3: "", 4: "", 5: "the mirror mirror", 6: "near or the"}


def test_corrections_against_plain_distance(spark):
    rng = random.Random(13)
    good = [("".join(rng.choice("abcdefgh") for _ in range(8)), 1000) for _ in range(30)]
    bad = []
    for w, _ in good:
        k = rng.randrange(8)
        bad += [(w[:k] + "x" + w[k + 1 :], 1), (w[:k] + w[k + 1 :], 1), (w[:k] + "y" + w[k:], 1)]
    lex = spark.createDataFrame([(w, n, True) for w, n in good] + [(w, n, False) for w, n in sorted(set(bad))], "word string, n long, known boolean")
    got = {r["word"]: r["fix"] for r in ocr_repair.corrections(lex).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                d, row[j] = row[j], min(d + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for w, _ in bad:
        assert distance(w, got[w]) == min(distance(w, g) for g, _ in good) == 1


def test_lexicon_without_trusted_text(spark):
    counts = spark.createDataFrame([("the", 900_000), ("tbe", 3), ("lamp", 50)], "word string, n long")
    got = {r["word"]: r["known"] for r in ocr_repair.lexicon(counts).collect()}
    assert got == {"the": True, "tbe": False, "lamp": True}


def test_words_of_any_length(spark):
    """Variants and run-together words beyond forty letters; a token far longer than any sound word costs nothing and has no fix."""
    long_ = "abcdefghij" * 6
    lex = spark.createDataFrame([(long_, 50, True), ("lamp" * 12, 40, True), (long_[:30] + "x" + long_[31:], 1, False), (long_[:-1], 1, False), (long_ + "lamp" * 12, 1, False), ("q" * 3000, 1, False)], "word string, n int, known boolean")
    fixes = {r["word"]: r["fix"] for r in ocr_repair.corrections(lex).collect()}
    assert fixes == {long_[:30] + "x" + long_[31:]: long_, long_[:-1]: long_}
    assert {r["word"]: r["fix"] for r in ocr_repair.splits(lex).collect()} == {long_ + "lamp" * 12: long_ + " " + "lamp" * 12}


def test_repair_keeps_capitals_and_the_hyphen_rule(spark):
    pages = spark.createDataFrame([(1, "THE OLD KEY\nHe saw TBE lamp and Tbe gar-\nden, the well-\nknown gate.\n12")], "page_id int, text string")
    words = [("the", 90), ("he", 50), ("saw", 50), ("lamp", 50), ("and", 50), ("garden", 50), ("well-known", 50), ("gate", 50), ("gar-den", 4)]
    lex = spark.createDataFrame([(w, n, True) for w, n in words] + [("tbe", 1, False)], "word string, n int, known boolean")
    noise = spark.createDataFrame([("tbe", "the")], "word string, fix string")
    got = ocr_repair.repair(pages, ["page_id"], "text", lex, noise).first()["repaired"]
    assert got == "He saw THE lamp and The garden, the well-known gate."
