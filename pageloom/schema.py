"""Explicit schemas of the data model; nothing is inferred, as page numbers are JSON keys."""

from __future__ import annotations

from pyspark.sql import types as T

CRITERIA = ("faithfulness", "fluency", "completeness", "no_hallucinations", "overall_winner")
LABELS = (0, 1, 2)
METRICS = ("unigram_precision", "unigram_recall", "unigram_f1", "cer", "wer")

PAGE = T.StructType([T.StructField("page_id", T.LongType(), False), T.StructField("text", T.StringType())])
CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ERROR_COUNT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType()), T.StructField("n", T.LongType())])
SCORES = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS] + [T.StructField("length_clean", T.IntegerType()), T.StructField("length_ocr", T.IntegerType())])
JUDGEMENT = T.StructType([T.StructField(c, T.ByteType()) for c in CRITERIA])
PREFERENCE = T.StructType([T.StructField(m, T.ByteType()) for m in ("rouge1", "rouge2", "rougeL")])
TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("model1", "model2", "ground_truth")])
SFT = T.StructType([T.StructField(c, T.StringType()) for c in ("instruction", "input", "output")])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
