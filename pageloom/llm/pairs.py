"""Problem 5: defective answers of prompt and response pairs.

A suffix automaton of the prompt, here the page's words with those broken at line
ends joined, is walked by the reference and by every response. The stretches
of the page's body that the reference's walk leaves out are its recognition errors. A response has at most one defect, the first that
holds of:
empty      null, or nothing but white space, invisible characters, punctuation or a stand-in for no value
refusal    an automaton of refusals and requests for input matches where it begins, and its walk covers little of the page or of the reference
language   little is covered, and its stopwords vote for another language than the page's and the reference's
copy       its walk covers nearly all of it, and the page's errors with it, as the walk of a right response could not
truncated  it ends no sentence, or in an omission mark, or leaves a delimiter open, and the reference does not
           stop there as well; or the reference goes on where it stops

Without reference the other response stands in for it in the search for errors,
or, if that is none, words with marks or digits among their letters count as
errors; truncated is then a response that shows it by its end and after whose
last place the page goes on. A pair without its page has no page text to copy.
Repeated rows count once. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from pageloom.llm import cutoff
from pageloom.llm.common import settled, stripped

# Stand-ins for no value, letters and digits only.
NO_VALUE = ("null", "none", "na", "nan", "nil", "undefined", "empty", "void", "missing", "blank", "nodata", "notext", "nocontent", "nooutput", "noanswer", "noresponse", "notavailable", "notapplicable")
# Beginnings of refusals and of requests for input. Words of one place are parted by strokes, words that may be absent stand in brackets.
REFUSALS = (
    "i'm/im (very/so/truly/really/terribly) sorry but i/we/this/it/that/i'm/the", "i/we am/are (very/so/truly/really/terribly) sorry but i/we/this/it/that/i'm/the", "we're (very/so/truly) sorry but i/we/this/it/that/the",
    "sorry (but) i/we/it/it's/this/that/i'm", "i (must/sincerely/do) apologize/apologise", "my apologies (but) i/we", "i have to apologize/apologise", "unfortunately/regrettably i/we/this/it/the/i'm", "as a/an (large) ai/language",
    "i must decline/refuse", "i have to decline/refuse",
    "i can't/cannot/won't/couldn't (be) (able) (to) assist/help/correct/clean/restore/process/rewrite/complete/denoise/transcribe/provide/comply/do/fulfil/fulfill/continue/edit/repair/read",
    "i can/will/could not (be) (able) (to) assist/help/correct/clean/restore/process/rewrite/complete/denoise/transcribe/provide/comply/do/fulfil/fulfill/continue/edit/repair/read",
    "i'm unable/not (able/allowed/permitted/comfortable)", "i am unable", "i am not able/allowed/permitted/comfortable/in", "i don't feel/see/have", "i do not feel/see/have",
    "no correction/answer/output/text can be", "please provide/paste/share/upload/send/supply/attach", "could/can/would you (please) paste/provide/share/upload/send/supply/attach",
    "the/this/your request/input/content/prompt was/is/has/falls/violates/can't/cannot", "it is not possible", "it's not possible", "there is no text/input/content",
    "mi dispiace/spiace", "purtroppo non/mi", "non sono in grado", "non posso aiutarti/aiutarla/aiutarvi/aiutare/correggere/elaborare/completare/fornire/soddisfare/assistere/assisterti/assisterla", "non mi è possibile", "non è possibile correggere/elaborare/completare",
    "la richiesta non", "per favore fornisci/fornire/fornisca/incolla/incollare/invia/inviare", "si prega di fornire/incollare/inviare",
    "es tut mir", "tut mir leid", "leider kann", "je suis désolé/désolée", "désolé", "malheureusement je", "je ne peux pas aider/corriger/traiter",
)
# Common words that tell the languages apart.
STOPWORDS = {
    "en": "the of and to was by with his her my their our in that who had for but beneath beyond above across within is from at it he she they i we",
    "it": "il la di che un una del della dello lo gli nel nella per con sul sulla e ma perché perche quando finché finche mentre dopo prima alla al sotto fra",
    "de": "der die das und den dem des ein eine einen im am auf unter in mit von zu als war nicht neben hinter weil während wahrend wo sodass bis denn",
    "fr": "le la les de du des un une et dans sur sous près pres au aux que qui quand pendant car mais avec pour lorsque derrière derriere vers",
}
#: Texts with no more letters and digits than the longest stand-in.
_FEW = rf"^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{1,{max(map(len, NO_VALUE))}}}[^\p{{L}}\p{{N}}]*$"
_STOP = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
_BREAK = re.compile(r"(?<=[^\W\d_])[-¬‐=­]\s*(?=[^\W_])")
_NUMBER_LINE = re.compile(r"\W*[ivxlc]+\W*")
_LINE_END = re.compile(r"\r\n?")
_WORDS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_ODD = re.compile(r"[^\W\d_][^\w\s'’\-–—.,]+[^\W\d_]|[^\W\d_]\d|\d[^\W\d_]{3}")
_SPEECH = re.compile("[“„«]")
_OPEN, _CLOSE = {"“": "”", "(": ")", "[": "]", "«": "»"}, {"”": "“", ")": "(", "]": "[", "»": "«"}
#: Ends that mark something left out.
OMISSION = r"(?:\.\.\.|…)[”’»\"')\]]*$"


class SuffixAutomaton:
    """Of a sequence of words; state 0 is the empty word sequence, `end` the last place of a state's first occurrence."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        link, length, end, last = [-1], [0], [-1], 0
        for at, w in enumerate(words):
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            end.append(at)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][w]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(end[q])
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.link, self.length, self.end = link, length, end

    def runs(self, words: list[str], least: int = 3) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, last place in the sequence) of the longest runs of at least `least` words that stand in the sequence."""
        nxt, link, length, end = self.next, self.link, self.length, self.end
        state = run = 0
        for k, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                if run >= least:
                    yield k - run, k, end[state]
                while state and w not in nxt[state]:
                    state = link[state]
                run = length[state]
                to = nxt[state].get(w)
                if to is None:
                    continue
            state, run = to, run + 1
        if run >= least:
            yield len(words) - run, len(words), end[state]

    def coverage(self, words: list[str], least: int = 3) -> float:
        """Share of the words that lie in such runs."""
        covered = seen = 0
        for a, z, _ in self.runs(words, least):
            covered += z - max(a, seen)
            seen = z
        return covered / len(words) if words else 0.0


class PhraseAutomaton:
    """Of several word sequences at once, with failure links; patterns in the form of REFUSALS."""

    def __init__(self, patterns: tuple[str, ...]):
        self.next: list[dict[str, int]] = [{}]
        self.found: list[int] = [0]
        for p in patterns:
            places = [["", *x[1:-1].split("/")] if x[0] == "(" else x.split("/") for x in p.split()]
            for words in product(*places):
                self._add([w for w in words if w])
        self.fail = [0] * len(self.next)
        queue = list(self.next[0].values())
        for s in queue:  # grows while it is read: breadth first
            for w, t in self.next[s].items():
                f = self.fail[s]
                while f and w not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(w, 0)
                self.found[t] = self.found[t] or self.found[self.fail[t]]
                queue.append(t)

    def _add(self, words: list[str]) -> None:
        s = 0
        for w in words:
            if w not in self.next[s]:
                self.next[s][w] = len(self.next)
                self.next.append({})
                self.found.append(0)
            s = self.next[s][w]
        self.found[s] = len(words)

    def matches(self, words: list[str]) -> Iterator[int]:
        """First word of every match."""
        s = 0
        for k, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.fail[s]
            s = self.next[s].get(w, 0)
            if self.found[s]:
                yield k + 1 - self.found[s]


_REFUSED = PhraseAutomaton(REFUSALS)


def refuses(text: str | None, lead: int = 3) -> bool:
    """Whether a refusal or a request for input begins among the first words, `lead` at most before it, and not as a story's direct speech."""
    plain = (text or "").lower().replace("’", "'").replace("ʼ", "'")
    tokens = list(_TOKENS.finditer(plain))
    return any(k <= lead and not _SPEECH.search(plain, 0, tokens[k].start()) for k in _REFUSED.matches([t[0] for t in tokens]))


@F.pandas_udf(BooleanType())
def is_refusal(text: pd.Series) -> pd.Series:
    """refuses() of a column; null for null."""
    return text.map(refuses, na_action="ignore")


def joined_words(text: str | None) -> list[str]:
    """Words of a text, without the hyphens in them: whether one that stands at a line end belongs to the word is not known."""
    return _BREAK.sub("", text or "").split()


def language_vote(text: str | None) -> tuple[str | None, dict[str, int]]:
    """The language whose stopwords are most, if they are at least three and half as many again as any other's."""
    words = _WORDS.findall((text or "").lower())
    votes = {k: sum(map(s.__contains__, words)) for k, s in _STOP.items()}
    first, second = sorted(votes, key=votes.get, reverse=True)[:2]
    return (first if votes[first] >= 3 and votes[first] >= 1.5 * votes[second] else None), votes


def open_delimiters(text: str) -> int:
    """Depth of the delimiter stack at the end of the text; a closing mark without its opening one is passed over."""
    stack: list[str] = []
    for c in text:
        if c in _OPEN:
            stack.append(c)
        elif stack and _CLOSE.get(c) == stack[-1]:
            stack.pop()
    return len(stack)


class Prompt:
    """A page whose suffix automaton the responses to it walk."""

    def __init__(self, page: str | None):
        self.words: list[str] = []
        self.line: list[int] = []
        self.body: list[bool] = []
        for n, words in enumerate(_BREAK.sub("", _LINE_END.sub("\n", page or "")).split("\n")):
            for w in words.split():
                self.words.append(w)
                self.line.append(n)
            self.body.append(not _NUMBER_LINE.fullmatch(words) and any(w[k : k + 3].islower() and w[k : k + 3].isalpha() for w in words.split() for k in range(len(w) - 2)))
        if not any(self.body):
            self.body = [True] * len(self.body)
        self.automaton = SuffixAutomaton(self.words)

    def walk(self, words: list[str]) -> tuple[float, bytearray, int]:
        """(share of the words covered, by letters; places of the page covered; last place of the walk) of a response."""
        places, covered, seen, last = bytearray(len(self.words)), 0, 0, -1
        for a, z, end in self.automaton.runs(words):
            covered += sum(map(len, words[max(a, seen) : z]))
            seen, last = z, end
            places[end + 1 - (z - a) : end + 1] = b"\1" * (z - a)
        return covered / max(1, sum(map(len, words))), places, last

    def errors(self, right: bytearray) -> list[range]:
        """Stretches of body lines that a right response's walk leaves out.

        Body lines have small letters; of a page without such lines all are.
        """
        out: list[range] = []
        for k, c in enumerate(right):
            if not c and self.body[self.line[k]]:
                if out and out[-1].stop == k:
                    out[-1] = range(out[-1].start, k + 1)
                else:
                    out.append(range(k, k + 1))
        return out

    def odd(self) -> list[range]:
        """Places of words with marks or digits among their letters."""
        return [range(k, k + 1) for k, w in enumerate(self.words) if _ODD.search(w)]

    def after(self, last: int) -> int:
        """Words with small letters after a place."""
        return sum(any(c.islower() for c in w) for w in self.words[last + 1 :])


def _kept(places: bytearray, errors: list[range], kept: float) -> bool:
    """Whether a walk holds the errors whole, a share of them where they are many."""
    n = sum(all(places[e.start : e.stop]) for e in errors)
    return n > 0 and len(errors) - n <= int((1 - kept) * len(errors))


def pair_defects(prompt: Prompt, lang: str | None, reference: str | None, responses: tuple[str | None, ...], kept: float = 0.9, coverage: float = 0.8, little: float = 0.5) -> list[tuple[str | None, bool, int | None]]:
    """(refusal, language, copy or None; whether a delimiter stays open; words of the page after the response's last place) of each response.

    Responses that are null, as empty ones are here, have none. The last figure is
    null where there is a reference or nothing of the page is held.
    """
    words = [joined_words(r) for r in responses]
    walks = [prompt.walk(w) for w in words]
    known = joined_words(reference)
    right = prompt.walk(known) if known else (0.0, b"", -1)
    reference_lang = None
    out = []
    for k, r in enumerate(responses):
        if r is None:
            out.append((None, False, None))
            continue
        share, places, last = walks[k]
        kind = None
        if share < little:
            if refuses(r) and SuffixAutomaton(known).coverage(words[k]) < little:
                kind = "refusal"
            else:
                spoken, votes = language_vote(r)
                if spoken and lang and spoken != lang and votes[spoken] >= 2 * votes.get(lang, 0):
                    reference_lang = reference_lang or language_vote(reference)[0]
                    kind = "language" if spoken != reference_lang else None
        if kind is None and share >= coverage and words[k] != known:
            if right[0] >= little:
                errors = prompt.errors(right[1])
            else:
                other = next((w[1] for j, w in enumerate(walks) if j != k and responses[j] is not None and w[0] >= little), None)
                errors = prompt.errors(other) if other is not None else prompt.odd()
            kind = "copy" if errors and _kept(places, errors, kept) else None
        out.append((kind, open_delimiters(r) > 0, prompt.after(last) if not known and last >= 0 else None))
    return out


_JUDGED = StructType([StructField(f"{c}{s}", t) for s in "12" for c, t in (("d", StringType()), ("o", StringType()), ("after", IntegerType()))])


def _judge():
    @F.pandas_udf(_JUDGED)
    def judge(page: pd.Series, lang: pd.Series, reference: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        out, last, prompt = [], None, Prompt(None)
        for p, lg, r, a, b in zip(page, lang, reference, one, two):
            if a is None and b is None:
                out.append((None,) * 6)
                continue
            if p != last:  # rows come by page, so its automaton serves them all
                last, prompt = p, Prompt(p)
            out.append(tuple(x for kind, opened, after in pair_defects(prompt, lg, r, (a, b)) for x in (kind, "open" if opened else None, after)))
        return pd.DataFrame(out, columns=_JUDGED.names)

    return judge


def is_empty(text: Column) -> Column:
    """Null, without a letter or digit, or a stand-in for no value."""
    short = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "").isin(*NO_VALUE)
    return F.coalesce(~text.rlike(r"[\p{L}\p{N}]") | (text.rlike(_FEW) & short), F.lit(True))


def defects(pairs: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, side, defect).

    pairs: page_id, model1, model2, ground_truth and the key columns; pages:
    page_id, lang, text, of which a page delivered twice counts once.
    """
    p = pages.where("page_id is not null").groupBy("page_id").agg(F.min_by(F.struct("lang", "text"), F.struct(F.col("text").isNull(), "text")).alias("_p"))
    p = p.select("page_id", F.lower("_p.lang").alias("_lang"), F.col("_p.text").alias("_page"))
    d = pairs.select(*dict.fromkeys([*key, "page_id"]), F.col("model1").alias("_m1"), F.col("model2").alias("_m2"), F.col("ground_truth").alias("_g"))
    # no partitioning is forced here, so that adaptive execution may split a page that very many pairs share
    d = d.join(p, "page_id", "left")
    ref = cutoff.body(stripped(F.col("_g")))
    d = settled(d, _e1=is_empty(F.col("_m1")), _e2=is_empty(F.col("_m2")), _ref=F.when(F.length(ref) > 0, ref), _a1=cutoff.body(stripped(F.col("_m1"))), _a2=cutoff.body(stripped(F.col("_m2"))))
    made = {"_done": cutoff.finished(F.col("_ref"))}
    for s in "12":
        a = F.col(f"_a{s}")
        made[f"_t{s}"] = F.when(~F.col(f"_e{s}"), cutoff.letters_left(a, F.col("_ref")))
        made[f"_u{s}"] = ~cutoff.finished(a)
        made[f"_o{s}"] = a.rlike(OMISSION)
    d = settled(d, **made)
    d = d.withColumn("_j", _judge()("_page", "_lang", "_g", *[F.when(~F.col(f"_e{s}"), F.col(f"_m{s}")) for s in "12"]))
    rows = []
    for s in "12":
        found, left, opened = F.col(f"_j.d{s}"), F.col(f"_t{s}"), F.coalesce(F.col(f"_j.o{s}") == "open", F.lit(False))
        shown = F.col(f"_u{s}") | F.col(f"_o{s}") | opened
        alone = F.col("_ref").isNull() & F.when(F.col(f"_j.after{s}").isNull(), F.col(f"_u{s}") & opened).otherwise(F.col(f"_j.after{s}") >= 3)
        unplaced = F.col("_ref").isNotNull() & left.isNull() & F.col(f"_u{s}") & F.col("_done") & opened
        by_end = shown & (F.coalesce((left >= 1) & F.col("_done") & F.col(f"_u{s}"), F.lit(False)) | unplaced | alone)
        cut = by_end | F.coalesce(left >= 3, F.lit(False))
        kind = F.when(F.col(f"_e{s}"), "empty").when(found.isNotNull(), found).when(cut, "truncated")
        rows.append(F.struct(F.lit(int(s)).alias("side"), kind.alias("defect")))
    return d.select(*key, F.explode(F.array(*rows)).alias("x")).select(*key, "x.side", "x.defect").where("defect is not null").distinct()
