"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.durable import durable  # noqa: F401  (for the modules beside this one)

#: White space as Unicode defines it, for Java character classes.
WS = r"\s\x1c-\x1f\x85\xa0  -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same characters one by one, for trimming.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """Text without white space at both ends, of any Unicode kind."""
    return F.btrim(text, F.lit(_SPACES))


def spread(df: DataFrame, *keys: str, rows_per_part: int = 0) -> DataFrame:
    """Even the rows out over the session's shuffle partitions, so that Python work does not hang on the input files' sizes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once per row.

    They come out of a generator, through which the optimizer neither pushes
    filters nor copies expressions.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
