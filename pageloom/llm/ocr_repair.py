"""Problem 1: noise in text from scanned pages.

Lines at the page edges that hold the running title or the page number are
taken off; words broken at a line end are joined where the words of the corpus
say so; misread words are found and corrected by anagram hashes: words that
clean text does not have, and that differ by a known amount of hash from a
frequent word, are its confusable variants. Corrections are ranked by distance,
then by frequency. Words run together are split, and parts of a word put
together, where the parts, or the whole, are frequent words.

A null or empty text has no lines to report and an empty repair. Lines are
counted from 1 between line feeds, empty ones included; a carriage return at a
line end belongs to no word. Equal rows count once. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import durable, settled

#: Marks that break a word at a line end.
BREAKS = "-¬‐=­"
# Groups of letters read for one another, beside single letters.
CONFUSABLE_GROUPS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("lr", "h"), ("ii", "u"), ("ll", "u"), ("vv", "w"), ("in", "m"), ("ni", "m"), ("tl", "d"), ("fi", "h"), ("iu", "m"), ("rr", "n"), ("lc", "k"))
#: White space within lines, and the marks around words.
_BLANK = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BEFORE, _AFTER = "“”„\"'‘’([«¿", "”“\"'‘’)]».,;:!?"
_EDGE = r"(?<![^\s])[“”„\"'‘’(\[«¿]+|[”“\"'‘’)\]».,;:!?]+(?![^\s])"
ROMAN = r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: Variants at distance two are looked for of words of this length or more: of shorter ones they are other words.
LEAST_TWO = 6


def _running_title(line: Column) -> Column:
    """Whether a line is set as a running title: capitals, but for a few misread ones, or the abbreviated chapter with its number.

    A chapter heading spells the word out.
    """
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    plain = F.regexp_replace(line, r"[^\p{L}0-9]+", "")
    heading = F.levenshtein(F.substring(plain, 1, 7), F.lit("CHAPTER"), 2) >= 0
    number = F.length(plain).between(5, 11) & (F.levenshtein(F.substring(plain, 1, 4), F.lit("CHAP"), 1) >= 0) & F.substring(plain, 5, 7).rlike("^[IVXLC1l0-9]+$")
    return ~line.rlike(r"[\p{Ll}]{3}") & ~heading & (number | ((letters >= 4) & (upper >= 0.7 * letters)))


def _page_number(line: Column, edge: Column) -> Column:
    """Whether a line holds nothing but a page number, arabic or small roman, with its marks; digits may be misread as letters.

    At the page's edge a single roman letter or a small word of roman letters
    counts as well. A number all of whose digits are misread is not told from
    the rest of a broken word.
    """
    core = F.regexp_replace(F.regexp_replace(line, r"^[^\p{L}\p{N}]*(?:p\.\s*)?", ""), r"[^\p{L}\p{N}|!]+", "")
    bare = F.regexp_replace(line, r"\s+", "").rlike(r"^[\p{L}\p{N}]+$")
    number = core.rlike(r"^[0-9lIoOiStszZB&A|!]{1,4}$") & core.rlike("[0-9]") & (~bare | (F.length(core) < 4))
    letters = F.translate(core, "1I|!jíì", "iiiiiii")
    roman = core.rlike("^[a-z1|!jíìI]+$") & core.rlike("[a-z]") & letters.rlike(rf"^(?=.){ROMAN}$") & (edge | ~bare | ((F.length(core) > 1) & ~core.isin("li", "mi", "vi", "ci", "di", "mix")))
    return (F.length(F.trim(line)) <= 14) & (number | roman)


def page_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line_no, line, kind, broken, tail, continues): the lines of each text.

    kind: header, pagenum or body; running titles and page numbers may stand
    within a text that goes over a page break. broken: the line ends in a part
    of a word; tail: its rest, the first word of the next body line. continues:
    the line's first word is such a rest. A title page, that is capitals and at
    most one short line more, without a page number, has no header.
    """
    d = df.where(F.col(text).isNotNull()).select(*key, F.split(F.col(text), "\n").alias("_l"))
    d = settled(d, _l=F.transform("_l", lambda x: F.rtrim(x, F.lit(_BLANK))))
    d = settled(d, _nb=F.filter(F.transform("_l", lambda x, i: F.when(F.length(F.trim(x)) > 0, i)), lambda i: i.isNotNull()))
    ends = F.array(F.get("_nb", F.lit(0)), F.get("_nb", F.size("_nb") - 1))
    d = settled(d, _ends=ends)
    found = F.transform("_l", lambda x, i: F.when(F.length(F.trim(x)) == 0, "blank").when(_page_number(x, F.array_contains("_ends", i)) & (F.size("_nb") > 1), "pagenum").when(_running_title(x), "header").otherwise("body"))
    d = settled(d, _k=found)
    plain = F.filter(F.transform("_l", lambda x, i: F.when(F.get(F.col("_k"), i) == "body", F.length(F.trim(x)))), lambda n: n.isNotNull())
    title = ~F.array_contains("_k", "pagenum") & ((F.size(plain) == 0) | ((F.size(plain) == 1) & (F.get(plain, F.lit(0)) <= 16)))
    d = settled(d, _k=F.when(title, F.transform("_k", lambda k: F.when(k == "header", "body").otherwise(k))).otherwise(F.col("_k")))
    broken = lambda x: F.right(x, F.lit(2)).rlike(rf"^\p{{L}}[{BREAKS}]$")
    body = F.filter(F.transform("_k", lambda k, i: F.when(k == "body", i)), lambda i: i.isNotNull())
    d = settled(d, _b=body)
    after = F.transform("_b", lambda i, n: F.when(broken(F.get("_l", i)), F.struct(i.alias("i"), F.get(F.col("_b"), n + 1).alias("j"))))
    d = settled(d, _a=F.filter(after, lambda x: x.isNotNull()))
    d = settled(d, _a=F.map_from_entries("_a"), _j=F.transform("_a", lambda x: x["j"]))

    def row(x: Column, i: Column) -> Column:
        j = F.try_element_at("_a", i)
        kind = F.get("_k", i)
        return F.struct(
            (i + 1).alias("line_no"), x.alias("line"), F.when(kind == "blank", "body").otherwise(kind).alias("kind"), F.map_contains_key("_a", i).alias("broken"),
            F.when(j.isNotNull(), F.regexp_extract(F.get("_l", j), r"^\s*(\S+)", 1)).alias("tail"), F.coalesce(F.array_contains("_j", i), F.lit(False)).alias("continues"),
        )

    return d.select(*key, F.inline(F.transform("_l", row)))


def _bare(word: Column) -> Column:
    return F.ltrim(F.rtrim(word, F.lit(_AFTER)), F.lit(_BEFORE))


def words_of(line: Column) -> Column:
    """Lower-case words of a line without the marks around them; dashes part words."""
    # mixed cases of roman letters, and the capital numeral before a small word, are no numerals: a mark keeps them apart
    odd = F.regexp_replace(line, r"\b(i)(?=I\b)|\b(l)(?=[IVXLC]+\b)|(?<![A-Z.] )\b(I)(?=I \p{Ll})", "$1$2$3¦")
    seen = F.when(line.rlike("II|iI|l[IVXLC]"), odd).otherwise(line)
    plain = F.replace(F.replace(F.lower(seen), F.lit("—"), F.lit(" ")), F.lit("–"), F.lit(" "))
    plain = F.when(plain.rlike(rf"[{_BLANK.replace(' ', '')}]|--"), F.regexp_replace(plain, rf"[{_BLANK}]|--+", " ")).otherwise(plain)
    return F.filter(F.transform(F.split(plain, " "), _bare), lambda w: w != "")


def line_words(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, line_no, kind, words, last_part, first_part): the words of body lines; of a word broken at the line end the parts stand apart. Edge lines have no words; blank body lines are left out."""
    inner = F.when(F.col("continues"), F.regexp_replace("line", r"^\s*\S+", "")).otherwise(F.col("line"))
    inner = F.when(F.col("broken"), F.regexp_replace(inner, r"\S+$", "")).otherwise(inner)
    part = F.regexp_extract(F.lower(F.regexp_replace("line", "[—–]+", " ")), rf"(\S+)[{BREAKS}]$", 1)
    body = F.col("kind") == "body"
    d = lines.where(~body | (F.length("line") > 0)).withColumn("_in", inner)
    return d.select(
        *key, "line_no", "kind", F.when(body, words_of(F.col("_in"))).otherwise(F.array().cast("array<string>")).alias("words"), F.when(body & F.col("broken"), _bare(part)).alias("last_part"),
        F.when(body & F.col("tail").isNotNull(), _bare(F.get(F.split(F.lower("tail"), "[—–]"), F.lit(0)))).alias("first_part"),
    )


def _ordinary(w: Column) -> Column:
    """Numbers and roman numerals need no dictionary."""
    return w.rlike(rf"^(?:[0-9]{{2,4}}|(?=..|[ivx]){ROMAN}|&c)$")


def lexicon(scanned: DataFrame, trusted: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(word, n, known): word counts of the scanned text, and whether a word is sound.

    scanned, trusted: (word, n). With trusted text, a sound word is one that
    stands there at least `least` times and at least a fifth as often as in the
    scanned text; without, one of the most frequent words of the scanned text.
    """
    if trusted is None:
        total = scanned.agg(F.sum("n").alias("total"))
        return scanned.crossJoin(F.broadcast(total)).select("word", "n", (F.col("n") >= F.greatest(F.lit(least), F.col("total") * 5e-6)).alias("known"))
    s, t = scanned.agg(F.sum("n").alias("ts")), trusted.agg(F.sum("n").alias("tt"))
    both = scanned.join(trusted.withColumnRenamed("n", "m"), "word", "full").fillna(0, ["n", "m"]).crossJoin(F.broadcast(s)).crossJoin(F.broadcast(t))
    return both.select("word", F.greatest("n", "m").alias("n"), ((F.col("m") >= least) & (F.col("m") * F.col("ts") >= 0.2 * F.col("n") * F.col("tt"))).alias("known"))


def _hash_of(chars: Column) -> Column:
    """Anagram hash: the sum of the fifth powers of the code points, exact in a long, overflow included."""
    power = lambda c: F.ascii(c).cast("long") * F.ascii(c) * F.ascii(c) * F.ascii(c) * F.ascii(c)
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: a + power(c))


def _without(words: DataFrame, n: int) -> DataFrame:
    """(word, n, hash): hashes of each word less none or one of its letters (n = 1), or less two (n = 2)."""
    chars = F.split(F.col("word"), "")
    size = F.length("word")
    h = _hash_of(F.col("_c"))
    d = words.withColumn("_c", F.filter(chars, lambda c: c != "")).withColumn("_i", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), size - 1))))
    d = settled(d, _h=h - F.when(F.col("_i") >= 0, _hash_of(F.array(F.get("_c", F.greatest("_i", F.lit(0)))))).otherwise(0))
    if n == 2:
        d = d.where("_i >= 0").withColumn("_j", F.explode(F.when(F.col("_i") < size - 1, F.sequence(F.col("_i") + 1, size - 1)).otherwise(F.array().cast("array<int>"))))
        d = d.withColumn("_h", F.col("_h") - _hash_of(F.array(F.get("_c", F.col("_j")))))
    return d.select("word", "n", F.col("_h").alias("hash")).distinct()


def _of_lengths(words: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """The words whose length is within n of some other word's; the lengths are told by a broadcast of the different ones, of which there are few."""
    near = others.select(F.explode(F.sequence(F.length("word") - n, F.length("word") + n)).alias("_len")).distinct()
    return words.withColumn("_len", F.length("word")).join(near, "_len", "left_semi").drop("_len")


def corrections(lex: DataFrame, ratio: float = 3.0) -> DataFrame:
    """(word, fix): ranked corrections of the words that are not sound.

    Joined are equal anagram hashes of the words less one letter each (a letter
    changed, lost or added), or with a confusable group replaced; for longer
    words without such a partner, less two letters. The edit distance confirms,
    a sound word of `ratio` times the variant's frequency is wanted.
    """
    good = lex.where("known").select("word", "n")
    bad = lex.where(~F.col("known") & ~_ordinary(F.col("word"))).select("word", "n")
    plain = F.regexp_replace("word", r"[^\p{L}\p{N}' -]+", "")
    marks = bad.withColumn("fix", plain).where("fix <> word and fix <> ''").join(good.select(F.col("word").alias("fix"), F.col("n").alias("fn")), "fix").select("word", "fix", "fn", F.lit(0).alias("d"))
    groups = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for x, y in CONFUSABLE_GROUPS for a, b in ((x, y), (y, x))])
    swapped = bad.withColumn("_g", F.explode(groups)).where("contains(word, _g.a)").select("word", "n", F.explode(F.array(*[F.regexp_replace("word", F.concat(F.lit(r), F.col("_g.a")), F.concat(F.lit("$1"), F.col("_g.b"))) for r in ("^(.*?)", "^(.*)")])).alias("fix"))
    by_group = swapped.join(good.select(F.col("word").alias("fix"), F.col("n").alias("fn")), "fix").where(F.col("fn") >= ratio * F.col("n")).select("word", "fix", "fn", F.lit(1).alias("d")).distinct()

    def near(words: DataFrame, n: int) -> DataFrame:
        # both lose up to one letter, or two each: only words of nearly, or just, the same length can meet, and no others are taken apart
        words, others = _of_lengths(words, good, n % 2), _of_lengths(good, words, n % 2)
        pairs = _without(words, n).join(_without(others, n).select(F.col("word").alias("fix"), F.col("n").alias("fn"), "hash"), "hash").select("word", "n", "fix", "fn").distinct()
        return pairs.withColumn("d", F.levenshtein("word", "fix", n)).where((F.col("d") > 0) & (F.col("fn") >= ratio * F.col("n"))).select("word", "fix", "fn", "d")

    first = durable(marks.unionByName(by_group).unionByName(near(bad, 1)).groupBy("word", "fix").agg(F.max("fn").alias("fn"), F.min("d").alias("d")))
    rest = bad.join(first.select("word").distinct(), "word", "left_anti").where(F.length("word") >= LEAST_TWO)
    ranked = first.unionByName(near(rest, 2))
    best = ranked.groupBy("word").agg(F.min(F.struct("d", (-F.col("fn")).alias("f"), "fix")).alias("b"))
    return best.select("word", F.col("b.fix").alias("fix"))


def splits(lex: DataFrame) -> DataFrame:
    """(word, fix): unsound words that are two sound ones run together; the frequentest parting counts."""
    good = lex.where("known").select("word", "n")
    # a word longer than any two sound ones is not two of them
    longest = F.broadcast(good.agg(F.max(F.length("word")).alias("_most")))
    bad = lex.where(~F.col("known") & (F.length("word") >= 3)).select("word").crossJoin(longest).where(F.length("word") <= 2 * F.col("_most")).drop("_most")
    cut = bad.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("word") - 1))).select("word", F.expr("left(word, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    two = cut.join(good.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(good.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    best = two.groupBy("word").agg(F.max(F.struct(F.least("na", "nb").alias("n"), F.concat_ws(" ", "a", "b").alias("fix"))).alias("b"))
    return best.select("word", F.col("b.fix").alias("fix"))


def count_words(line_words_: DataFrame) -> DataFrame:
    """(word, n) over the words within lines and the words joined over line ends."""
    joined = F.when(F.col("last_part").isNotNull() & F.col("first_part").isNotNull(), F.array(F.concat("last_part", "first_part"))).otherwise(F.array().cast("array<string>"))
    return line_words_.select(F.explode(F.concat("words", joined)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def noise_words(lex: DataFrame) -> DataFrame:
    """(word, fix): every unsound word with what it should be; fix null where only its kind tells that it is wrong (digits or marks among letters, a lone letter)."""
    fixes = splits(lex).withColumn("r", F.lit(1)).unionByName(corrections(lex).withColumn("r", F.lit(0)))
    odd = lex.where(~F.col("known") & ~_ordinary(F.col("word")) & (F.col("word").rlike(r"[^\p{L}'-]") | (F.length("word") == 1))).select("word", F.lit(None).cast("string").alias("fix"), F.lit(2).alias("r"))
    return fixes.unionByName(odd).groupBy("word").agg(F.min_by("fix", "r").alias("fix"))


def line_faults(words: DataFrame, key: list[str], lex: DataFrame, noise: DataFrame, common_words: int = 20_000) -> DataFrame:
    """(key, line_no, kind): hyphen and misread lines.

    Sound words of the lexicon are set aside first by a broadcast of the most
    frequent ones, at most `common_words` of them; the rest, and the broken
    words, are joined with the tables by shuffle, rare as they are.
    """
    top = F.broadcast(lex.where("known").orderBy(F.col("n").desc(), "word").limit(common_words).select("word"))
    spread = words.select(*key, "line_no", F.posexplode("words").alias("pos", "word"), F.col("words").alias("_w"))
    rare = spread.withColumn("prev", F.when(F.col("pos") > 0, F.get("_w", F.greatest(F.col("pos") - 1, F.lit(0))))).withColumn("next", F.get("_w", F.col("pos") + 1)).drop("_w", "pos").join(top, "word", "left_anti")
    rare = rare.where(~_ordinary(F.col("word")))
    wrong = rare.join(noise.select("word", F.lit(True).alias("bad")), "word", "left").join(lex.select("word", "known"), "word", "left")
    wrong = durable(wrong.where(~F.coalesce("known", F.lit(False))).select(*key, "line_no", "word", "prev", "next", "bad"))
    sure = wrong.where("bad").select(*key, "line_no")
    open_ = wrong.where("bad is null")
    whole = open_.select(*key, "line_no", F.explode(F.array(F.concat("prev", "word"), F.concat("word", "next"))).alias("word")).where("word is not null").join(lex.where("known").select("word"), "word").select(*key, "line_no")
    misread = sure.unionByName(whole).withColumn("kind", F.lit("misread"))
    return misread.unionByName(broken_words(words, key, lex, noise)).distinct()


def broken_words(words: DataFrame, key: list[str], lex: DataFrame, noise: DataFrame) -> DataFrame:
    """(key, line_no, kind) of the words broken at line ends: hyphen where the mark must go, misread for the line with the wrong part."""
    broken = words.where("last_part is not null").select(*key, "line_no", "last_part", F.coalesce("first_part", F.lit("")).alias("first_part"))
    broken = broken.withColumn("word", F.concat("last_part", "first_part")).withColumn("hyphened", F.concat_ws("-", "last_part", "first_part"))
    known = lex.where("known").select("word", "n")
    b = broken.join(known.select(F.col("word"), F.col("n").alias("nj")), "word", "left").join(known.select(F.col("word").alias("hyphened"), F.col("n").alias("nh")), "hyphened", "left").join(noise, "word", "left")
    b = settled(b, compound=F.col("nh").isNotNull() & (F.col("nh") > F.coalesce("nj", F.lit(0))))
    hyphen = b.where(~F.col("compound")).select(*key, "line_no", F.lit("hyphen").alias("kind"))
    faulty = b.where(F.col("nj").isNull() & ~F.col("compound") & F.col("fix").isNotNull() & ~F.contains("fix", F.lit(" ")))
    first = F.substring("fix", F.lit(1), F.length("last_part")) == F.col("last_part")
    misjoined = faulty.select(*key, F.when(first, F.col("line_no") + 1).otherwise(F.col("line_no")).alias("line_no"))
    return misjoined.withColumn("kind", F.lit("misread")).unionByName(hyphen)


def edge_faults(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, line_no, kind) of headers and page numbers."""
    return lines.where("kind <> 'body'").select(*key, "line_no", "kind")


def page_faults(pages: DataFrame, key: list[str], text: str, trusted: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(src_field, key, line_no, kind): the noisy lines of scanned pages, and the page layout left in trusted texts.

    trusted: (name, table, column) of clean texts with the same key, whose words
    decide which words are sound. Every text is read and taken apart once; the
    words by line are kept for the steps that follow.
    """
    words = durable(line_words(page_lines(pages, key, text), key))
    clean_words = [(name, durable(line_words(page_lines(df, key, column), key))) for name, df, column in trusted]
    counts = None
    for _, w in clean_words:
        counts = count_words(w) if counts is None else counts.unionByName(count_words(w))
    if counts is not None:
        counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    lex = durable(lexicon(count_words(words), counts))
    noise = durable(noise_words(lex))
    out = edge_faults(words, key).unionByName(line_faults(words, key, lex, noise)).withColumn("src_field", F.lit(text))
    for name, ws in clean_words:
        layout = edge_faults(ws, key).unionByName(broken_words(ws, key, lex, noise).where("kind = 'hyphen'"))
        out = out.unionByName(layout.withColumn("src_field", F.lit(name)))
    return out.select("src_field", *key, "line_no", "kind").distinct()


def _joined_parts(tokens: DataFrame, key: list[str], lex: DataFrame, common_words: int = 20_000) -> DataFrame:
    """tokens with the two parts of a word that a blank has parted in one token.

    tokens: (key, line_no, part, pos, token, glued, word, hyphened). Neighbours of
    a line with no mark between them are parts where together they are a sound word
    and one of them is none; of three such neighbours the first two count. The most
    frequent sound words, at most `common_words` of them, are told by a broadcast,
    so that only neighbours with a rarer word are looked up by shuffle.
    """
    top = F.broadcast(lex.where("known").orderBy(F.col("n").desc(), "word").limit(common_words).select("word", F.lit(True).alias("common")))
    line = Window.partitionBy(*key, "line_no").orderBy("pos")
    d = tokens.join(top, "word", "left").withColumn("common", F.coalesce("common", _ordinary(F.col("word"))))
    d = d.select("*", *[F.lead(c).over(line).alias(f"_{c}") for c in ("glued", "word", "common")])
    d = d.where(F.col("glued").rlike(r"\p{L}$") & F.col("_glued").rlike(r"^\p{L}") & ~(F.col("common") & F.col("_common")))
    sound = lex.where("known").select("word")
    pairs = d.select(*key, "line_no", "pos", F.col("word").alias("_a"), F.col("_word").alias("_b"), F.concat("word", "_word").alias("word")).join(sound, "word").drop("word")
    for c in ("_a", "_b"):
        pairs = pairs.join(sound.select(F.col("word").alias(c), F.lit(True).alias(f"{c}_sound")), c, "left").withColumn(f"{c}_sound", F.coalesce(f"{c}_sound", _ordinary(F.col(c))))
    pairs = pairs.where(~(F.col("_a_sound") & F.col("_b_sound"))).select(*key, "line_no", "pos")
    # neighbouring pairs share a token: of a row of them every other one counts
    pairs = pairs.withColumn("_row", F.col("pos") - F.row_number().over(line))
    pairs = pairs.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "line_no", "_row").orderBy("pos"))).where("_k % 2 = 1")
    ends = pairs.select(*key, "line_no", F.explode(F.array(F.struct("pos", F.lit(1).alias("side")), F.struct((F.col("pos") + 1).alias("pos"), F.lit(2).alias("side")))).alias("_x")).select(*key, "line_no", "_x.pos", "_x.side")
    d = tokens.join(ends, [*key, "line_no", "pos"], "left")
    for c in ("glued", "word"):
        d = d.withColumn(f"_{c}", F.lead(c).over(line))
    d = d.withColumn("_first", F.col("side").isNotNull()).where("side is null or side = 1")
    whole = {c: F.when(F.col("_first"), F.concat(c, f"_{c}")).otherwise(F.col(c)) for c in ("glued", "word")}
    d = d.withColumns(whole | {"token": F.when(F.col("_first"), F.concat("glued", "_glued")).otherwise(F.col("token")), "hyphened": F.when(~F.col("_first"), F.col("hyphened"))})
    return d.select(*tokens.columns)


def repair(pages: DataFrame, key: list[str], text: str, lex: DataFrame, noise: DataFrame) -> DataFrame:
    """(key, repaired): continuous paragraphs of each text, without edge lines, words joined and misread words put right.

    Paragraphs are parted by an empty line, as blank and indented lines part
    them in the text. The parts of a word with a blank in it are put together
    before words are corrected. A word keeps the marks around it, its capitals or the
    one at its beginning; a hyphen at a line end stays where page_faults() keeps it. Texts without words have no row here, see repaired_pages(). A page is one row before and after; only its own words come
    together again.
    """
    lines = page_lines(pages, key, text).where("kind = 'body'")
    order = Window.partitionBy(*key).orderBy("line_no")
    part = F.sum(F.when((F.trim("line") == "") | F.col("line").rlike(r"^\s{2,}\S"), 1).otherwise(0)).over(order)
    tokens = lines.withColumn("part", part).where(F.trim("line") != "")
    own = F.when(F.col("continues"), F.regexp_replace("line", r"^\s*\S+", "")).otherwise(F.col("line"))
    stem = F.regexp_replace(own, rf"[{BREAKS}]$", "")
    whole = F.when(F.col("broken") & F.col("tail").isNotNull(), F.concat(stem, F.lit("\u0001"), F.col("tail"))).otherwise(own)
    token = F.filter(F.split(F.trim(F.regexp_replace(whole, "([—–]+)", "$1\u0002")), r"[\s\u0002]+"), lambda x: x != "")
    t = tokens.select(*key, "line_no", "part", F.posexplode(token).alias("pos", "token"))
    t = t.withColumn("glued", F.regexp_replace("token", "\u0001", "")).withColumn("word", F.regexp_replace(F.lower(F.regexp_replace("glued", "[—–]", "")), _EDGE, ""))
    t = t.withColumn("hyphened", F.when(F.contains("token", F.lit("\u0001")), F.regexp_replace(F.lower(F.regexp_replace("token", "\u0001", "-")), _EDGE, "")))
    t = _joined_parts(durable(t), key, lex)
    known = lex.where("known")
    t = t.join(noise, "word", "left").join(known.select(F.col("word").alias("hyphened"), F.col("n").alias("nh")), "hyphened", "left").join(known.select("word", F.col("n").alias("nj")), "word", "left")
    compound = F.col("nh").isNotNull() & (F.col("nh") > F.coalesce("nj", F.lit(0)))
    bare = F.regexp_replace(F.regexp_replace("glued", "[—–]", ""), _EDGE, "")
    fixed = F.when(bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}") & (F.length(bare) > 1), F.upper("fix")).when(bare.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("fix", 1, 1)), F.substring("fix", F.lit(2), F.length("fix")))).otherwise(F.col("fix"))
    text_ = F.when(compound, F.regexp_replace("token", "\u0001", "-")).when(F.col("fix").isNotNull() & (bare != ""), F.replace("glued", bare, fixed)).otherwise(F.col("glued"))
    words = t.select(*key, "part", "line_no", "pos", text_.alias("w")).groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "pos", "w"))).alias("ws"))
    para = words.select(*key, "part", F.regexp_replace(F.array_join(F.transform("ws", lambda x: x["w"]), " "), "([—–]) ", "$1").alias("p"))
    return para.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]), "\n\n").alias("repaired"))


def repaired_pages(pages: DataFrame, key: list[str], text: str, lex: DataFrame, noise: DataFrame) -> DataFrame:
    """repair() with every key of the pages: an empty repair where a text is null, blank or nothing but edge lines."""
    done = repair(pages, key, text, lex, noise)
    done = done.select(*[F.col(k).alias(f"_{k}") for k in key], "repaired")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return pages.select(*key).distinct().join(done, same, "left").select(*key, F.coalesce("repaired", F.lit("")).alias("repaired"))
