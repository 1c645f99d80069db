"""Command line: python -m pageloom COMMAND ..., under spark-submit or on its own.

Reads and writes JSON page datasets. A backend or judge is named as module:factory.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import metrics as mx
from pageloom.operators import datasets as ds
from pageloom.operators import denoise as dn
from pageloom.session import session
from pageloom.sources import pages as src


def _factory(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _one(spark, path: str, column: str) -> DataFrame:
    return src.read_pages(spark, path).select("page_id", F.col("text").alias(column))


def denoise(spark, a) -> None:
    pages = _one(spark, a.pages, "text")
    shots = tuple(map(tuple, json.load(open(a.shots)))) if a.shots else ()
    out = dn.denoise(pages, ["page_id"], "text", _factory(a.backend), a.attempts, not a.whole, a.mode, shots)
    src.write_pages(out.withColumnRenamed("denoised", "text"), a.out)


def merge_datasets(spark, a) -> None:
    clean, noisy = ([_one(spark, p, "text") for p in paths] for paths in (a.clean, a.noisy))
    merged = ds.merge_paired_datasets(clean, noisy, "page_id")
    for name in ("clean", "noisy"):
        src.write_pages(merged.select(F.col("new_id").alias("page_id"), F.col(name).alias("text")), f"{a.out}/{name}")


def evaluate_metrics(spark, a) -> None:
    both = ds.strict_join(_one(spark, a.answers, "answer"), _one(spark, a.clean, "clean"), "page_id")
    mx.evaluate(both, "clean", "answer", a.metric).drop("answer", "clean").write.mode("overwrite").json(a.out)


def evaluate_judge(spark, a) -> None:
    rows = _one(spark, a.clean, "clean")
    for path, name in ((a.ocr, "ocr"), (a.first, "one"), (a.second, "two")):
        rows = ds.strict_join(rows, _one(spark, path, name), "page_id")
    dn.judge(rows, ["page_id"], "clean", "ocr", "one", "two", _factory(a.judge), a.seed).write.mode("overwrite").json(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pageloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("denoise")
    c.add_argument("pages"), c.add_argument("out"), c.add_argument("--backend", required=True), c.add_argument("--attempts", type=int, default=1)
    c.add_argument("--mode", default="none", choices=dn.MODES), c.add_argument("--shots"), c.add_argument("--whole", action="store_true")
    c = sub.add_parser("merge_datasets")
    c.add_argument("out"), c.add_argument("--clean", nargs="+", required=True), c.add_argument("--noisy", nargs="+", required=True)
    c = sub.add_parser("evaluate_metrics")
    c.add_argument("clean"), c.add_argument("answers"), c.add_argument("out"), c.add_argument("--metric", default="ALL")
    c = sub.add_parser("evaluate_judge")
    c.add_argument("clean"), c.add_argument("ocr"), c.add_argument("first"), c.add_argument("second"), c.add_argument("out")
    c.add_argument("--judge", required=True), c.add_argument("--seed", type=int, default=42)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    globals()[a.command](session("pageloom"), a)


if __name__ == "__main__":
    main()
