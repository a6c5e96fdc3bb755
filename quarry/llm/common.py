"""Helpers shared by the training-data operators: distributed prefix sums and bitmaps; lookup is that of quarry.operators.skew, materialize quarry.shared.settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.skew import HEAVY, lookup  # noqa: F401
from quarry.shared import settle as materialize  # noqa: F401

#: The six ASCII white-space characters that separate words, as a regular-expression class body.
WS = r"\x20\x09-\x0D"
WORD = f"[^{WS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def hash60(c: Column) -> Column:
    """60 bits of MD5 of the value's text as a non-negative long; null counts as the empty string. Any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def id_as_text(id_col: str) -> Column:
    """The id for a trip through pandas, where a null would turn whole numbers into floats."""
    return F.col(id_col).cast("string").alias("_id")


def id_back(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """df with _id as docs has it under id_col, in first place."""
    return df.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in df.columns if c != "_id"])


def running_sum(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sum of value within group, ordered by (bucket, *order), with no group in one task.

    bucket is an evenly filled, order-preserving column. Sums per (group, bucket) are
    prefix-summed first; rows then add a running sum within their own (group, bucket).
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(base, [group, bucket]).withColumn(out, F.col("_base") + F.col("_within")).drop("_base", "_within")


#: Bits of a bitmap filter, as powers of 2; the largest is 32 MB whatever the input.
LEAST_BITS, MOST_BITS = 18, 28
_PAGE = 32768


def bitmap_bits(n: int) -> int:
    """The power of 2 of at least n bits, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, max(1, n).bit_length()))


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Pages of a bitmap over the keys modulo 2^bits; a table of at most 2^bits / 8 bytes, fit to broadcast."""
    k = keys.select(F.pmod(key, F.lit(1 << bits)).alias("_k"))
    return k.groupBy(F.expr(f"_k div {_PAGE}").alias("_page")).agg(F.expr(f"bitmap_construct_agg(cast(pmod(_k, {_PAGE}) as int))").alias("_bitmap"))


def in_bitmap(df: DataFrame, key: Column, pages: DataFrame, bits: int, name: str) -> DataFrame:
    """df with the boolean name: false only for keys that aren't in the bitmap; some others are true too."""
    df = df.withColumn("_k", F.pmod(key, F.lit(1 << bits))).withColumn("_page", F.expr(f"_k div {_PAGE}"))
    byte = F.expr(f"cast(conv(hex(substring(_bitmap, cast(pmod(_k, {_PAGE}) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.coalesce(F.call_function("bit_get", byte, F.expr("cast(pmod(_k, 8) as int)")), F.lit(0).cast("byte"))
    return df.join(F.broadcast(pages), "_page", "left").withColumn(name, bit == 1).drop("_k", "_page", "_bitmap")
