"""Denoising as a data flow: chunks, prompts, a pluggable backend, votes, merging.

A backend is a callable from a list of message lists to a list of texts; a
factory builds one per Python worker. No model is part of this package.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import is_json, merge_chunks, sentence_chunks, words
from pageloom.operators.agreement import order_coin, swapped
from pageloom.schema import CRITERIA, JUDGEMENT, LABELS

Backend = Callable[[list[list[dict]]], list[str]]

SYSTEM = "You correct text from an optical character recognition system. Restore the words that were printed, keep grammar, order and meaning, and answer with the corrected text only."
MODES = ("none", "simple", "complex")


def messages(text: Column, mode: str = "none", shots: tuple[tuple[str, str], ...] = (), instruction: str = SYSTEM) -> Column:
    """array<struct<role, content>>: instruction, example pairs unless the mode is none, and the text; the complex mode labels inputs."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    label = "Input: " if mode == "complex" else ""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    out = [msg("system", F.lit(instruction))]
    for a, b in shots if mode != "none" else ():
        out += [msg("user", F.lit(label + a)), msg("assistant", F.lit(b))]
    return F.array(*out, msg("user", F.concat(F.lit(label), text)))


def judge_prompt(clean: Column, ocr: Column, one: Column, two: Column) -> Column:
    """The question which of two corrections of a page is better, by criterion."""
    head = "Compare two corrections of a scanned page by faithfulness, fluency, completeness and no_hallucinations. Answer with a JSON object of these four and overall_winner; 1 means the first is better, 2 the second, 0 equal."
    part = lambda name, c: F.concat(F.lit(f"\n\n{name}:\n"), F.coalesce(c, F.lit("")))
    return F.concat(F.lit(head), part("clean_text", clean), part("ocr_text", ocr), part("denoised_1", one), part("denoised_2", two))


def with_retry(call: Callable[[], object], transient: Callable[[Exception], bool], retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's answer; transient failures are tried again after 1, 2, 4, ... seconds, others are raised at once."""
    for n in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if not transient(e):
                raise
            sleep(2**n)
    raise RuntimeError(f"no answer after {retries + 1} attempts")


def sentence_table(df: DataFrame, key: list[str], text: str, split: bool = True) -> DataFrame:
    """(key, ord, text, start, end)."""
    whole = F.array(F.struct(F.col(text).alias("text"), F.lit(0).alias("start"), F.length(text).alias("end")))
    chunks = sentence_chunks(F.col(text)) if split else whole
    return df.where(F.col(text).isNotNull()).select(*key, F.posexplode(chunks).alias("ord", "c")).select(*key, "ord", "c.*")


def run_backend(chunks: DataFrame, key: list[str], factory: Callable[[], Backend], attempts: int = 1, mode: str = "none", shots: tuple = (), transient: Callable[[Exception], bool] | None = None, retries: int = 5) -> DataFrame:
    """(key, ord, start, end, attempt, answer): every chunk through the backend, batch by batch, one backend per worker."""
    return ask(chunks.select(*key, "ord", "start", "end", messages(F.col("text"), mode, shots).alias("m")), "m", factory, attempts, transient, retries)


def ask(rows: DataFrame, prompt: str, factory: Callable[[], Backend], attempts: int = 1, transient: Callable[[Exception], bool] | None = None, retries: int = 5) -> DataFrame:
    """rows without the prompt, with attempt and answer: each prompt, a list of messages, through the backend.

    A batch whose call fails for a transient reason is asked again, see with_retry();
    other failures fail the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for b in batches:
            prompts = [[{"role": x["role"], "content": x["content"]} for x in m] for m in b[prompt]]
            rest = b.drop(columns=prompt)
            for n in range(attempts):
                answer = with_retry(lambda: backend(prompts), transient or (lambda e: False), retries)  # noqa: B023
                yield rest.assign(attempt=n, answer=answer)[[*rest.columns, "attempt", "answer"]]

    types = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in rows.columns if c != prompt) + ", attempt int, answer string")


def judge(rows: DataFrame, key: list[str], clean: str, ocr: str, one: str, two: str, factory: Callable[[], Backend], seed: int = 42, **retry) -> DataFrame:
    """(key, five labels): a judge's labels of two answers, 1 where the first is better.

    A hash of the key decides which answer is shown first, and the labels are
    turned back. An answer that is no JSON object, or labels out of range, give nulls.
    """
    swap = order_coin(seed, *[F.col(k) for k in key])
    first, second = F.when(swap, F.col(two)).otherwise(F.col(one)), F.when(swap, F.col(one)).otherwise(F.col(two))
    asked = rows.select(*key, swap.alias("_swap"), F.array(F.struct(F.lit("user").alias("role"), judge_prompt(F.col(clean), F.col(ocr), first, second).alias("content"))).alias("_m"))
    said = ask(asked, "_m", factory, **retry).withColumn("_o", F.from_json(F.when(is_json(F.col("answer")), F.col("answer")), JUDGEMENT))
    label = lambda c: F.when(F.col(f"_o.{c}").isin(*LABELS), F.col(f"_o.{c}").cast("int"))
    return said.select(*key, *[swapped(label(c), F.col("_swap")).alias(c) for c in CRITERIA])


def majority_of(attempts: Column) -> Column:
    """The vote over an array of attempts at one text: of those of the commonest word count, the commonest word at each place; the first seen counts on ties. Null attempts do not vote; null if none does."""

    def commonest(values: Column) -> Column:
        return F.array_max(F.transform(values, lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v"))))["v"]

    def vote(s: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda p: commonest(F.transform(s["k"], lambda w: F.get(w, p)))), " ")

    ws = F.transform(F.filter(attempts, lambda x: x.isNotNull()), words)
    sized = F.transform(F.array(ws), lambda ws: F.struct(ws.alias("ws"), commonest(F.transform(ws, lambda w: F.size(w))).alias("n")))
    kept = F.transform(sized, lambda s: F.struct(F.filter(s["ws"], lambda w: F.size(w) == s["n"]).alias("k"), s["n"].alias("n")))
    return F.get(F.transform(kept, lambda s: F.when(s["n"] > 0, vote(s)).when(s["n"] == 0, "")), F.lit(0))


def majority_text(attempts: DataFrame, key: list[str], attempt: str, text: str) -> DataFrame:
    """(key, voted): majority_of() the attempts of each key, in their order; keys without an attempt are left out."""
    a = attempts.where(F.col(text).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(attempt).alias("a"), F.col(text).alias("t")))).alias("_t"))
    return a.select(*key, majority_of(F.transform("_t", lambda x: x["t"])).alias("voted"))


def denoise(pages: DataFrame, key: list[str], text: str, factory: Callable[[], Backend], attempts: int = 1, split: bool = True, mode: str = "none", shots: tuple = (), **retry) -> DataFrame:
    """(key, denoised): chunks, backend, vote over the attempts, chunks put together again."""
    answers = run_backend(sentence_table(pages, key, text, split), key, factory, attempts, mode, shots, **retry)
    if attempts > 1:
        voted = majority_text(answers, [*key, "ord", "start", "end"], "attempt", "answer").withColumnRenamed("voted", "answer")
    else:
        voted = answers
    parts = voted.groupBy(*key).agg(F.collect_list(F.struct("ord", F.col("answer").alias("text"), "start", "end")).alias("_c"))
    return parts.select(*key, merge_chunks(F.col("_c")).alias("denoised"))


def dictionary_backend(table: dict[str, str]) -> Callable[[], Backend]:
    """A backend that replaces whole words of the last message; for tests and as a baseline."""

    def factory() -> Backend:
        return lambda prompts: [" ".join(table.get(w, w) for w in p[-1]["content"].split(" ")) for p in prompts]

    return factory


def length_judge() -> Backend:
    """A judge that prefers the longer answer on every criterion; for tests."""

    def answer(prompt: str) -> str:
        one, two = prompt.split("\n\ndenoised_1:\n", 1)[1].split("\n\ndenoised_2:\n", 1)
        return json.dumps({c: 1 if len(one) > len(two) else 2 if len(two) > len(one) else 0 for c in CRITERIA})

    return lambda prompts: [answer(p[-1]["content"]) for p in prompts]
