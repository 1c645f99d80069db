"""Readers and writers of page datasets, judgements and training records."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import file_stem
from pageloom.schema import CRITERIA, JUDGEMENT


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, ord): the entries of JSON objects, one object per file, values as text; files that are no object are passed over.

    One object is one row until it is opened, so a file is read by one task.
    """
    files = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    return files.where("m is not null").select("file", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("file", F.col("e.key").alias("key"), F.col("e.value").alias("value"), "ord")


def object_report(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(file, status, entries) of the files a scan should find: ok, empty (an object without entries), broken (no object) or missing."""
    wanted = spark.createDataFrame([(n,) for n in names], "file string")
    files = spark.read.text(folder, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("file"), F.size(F.from_json("value", "map<string,string>")).alias("n"), F.from_json("value", "map<string,string>").isNull().alias("bad"))
    status = F.when(F.col("bad").isNull(), "missing").when(F.col("bad"), "broken").when(F.col("n") == 0, "empty").otherwise("ok")
    return wanted.join(files, "file", "left").select("file", status.alias("status"), F.when(status == "ok", F.col("n")).otherwise(0).alias("entries"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_id, text, ord) of page datasets; of a key given twice the last value counts."""
    rows = read_objects(spark, path).select("file", F.col("key").cast("bigint").alias("page_id"), F.col("value").alias("text"), "ord")
    return rows.groupBy("file", "page_id").agg(F.max_by("text", "ord").alias("text"), F.max("ord").alias("ord"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(pair, page_id, five labels): values may be objects, objects as text, or null; what does not parse is null."""
    rows = read_objects(spark, path)
    return rows.select(F.col("file").alias("pair"), F.col("key").cast("bigint").alias("page_id"), F.from_json(F.trim("value"), JUDGEMENT).alias("j")).select("pair", "page_id", *[F.col(f"j.{c}").alias(c) for c in CRITERIA])


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole plain-text files."""
    return spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def read_paired_corpus(spark: SparkSession, path: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, ocr, clean) of a paired corpus in Parquet, or of a seeded Bernoulli sample of it."""
    d = spark.read.parquet(path).select(F.col("text").alias("ocr"), F.col("corrected_text").alias("clean"))
    d = d.sample(False, fraction, seed) if fraction is not None else d
    return d.withColumn("doc_id", F.xxhash64("ocr", "clean"))


def json_objects(pages: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """(group, json): one JSON object per group, keys in order; a dataset that goes into one file goes through one task."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda e: F.struct(e[key].cast("string").alias("k"), e[value].alias("v")))
    return pages.groupBy(*group).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def write_pages(pages: DataFrame, path: str, key: str = "page_id", value: str = "text") -> None:
    """One JSON object per dataset as text files, parted by dataset where there is that column."""
    group = ["dataset"] if "dataset" in pages.columns else []
    out = json_objects(pages, group, key, value)
    (out.write.partitionBy("dataset") if group else out.write).mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Training records as JSON lines."""
    records.write.mode("overwrite").json(path)


def write_by_criterion(long: DataFrame, path: str) -> None:
    """Labels parted into one folder per criterion, nulls included."""
    long.write.mode("overwrite").partitionBy("criterion").option("ignoreNullFields", "false").json(path)


def register(path: str, name: str, entry: dict) -> dict:
    """Insert or replace one entry of a small JSON registry on the driver; the file is replaced as a whole."""
    known = {}
    if os.path.exists(path):
        with open(path) as f:
            known = json.load(f)
    known[name] = entry
    with open(path + ".new", "w") as f:
        json.dump(known, f, indent=2, sort_keys=True)
    os.replace(path + ".new", path)
    return known
