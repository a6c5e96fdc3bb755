"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WS, bitmap, bitmap_bits, in_bitmap, lookup, materialize, text_or_empty

PREFIX_CHARS = 128


def normalised(c: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(c, f"[{WS}]+", "")


def _survivors(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows whose keys another row shares. Counts are made before the shuffle and hot keys dealt out."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("_shared")).where("_shared > 1").withColumn("_more", F.lit(True))
    return lookup(rows, shared, keys, "_shared", total).where("_more").select(*rows.columns)


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """_id, _chars, _len, _prefix of each row in one pass over the texts, and _sha of the whole normalised text where full.

    _len counts the normalised text's bytes; _prefix hashes its first PREFIX_CHARS characters.
    """
    norm = docs.select(F.col(id_col).alias("_id"), F.length(text_or_empty(text)).cast("long").alias("_chars"), normalised(text_or_empty(text)).alias("_norm"))
    own = [F.octet_length("_norm").cast("long").alias("_len"), F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix")]
    return norm.select("_id", "_chars", *own, *([F.sha2("_norm", 256).alias("_sha")] if full else []))


def refine(rows: DataFrame, total: int) -> DataFrame:
    """The rows whose (_len, _prefix) another row shares: groups by length first, then by prefix hash within the lengths that repeat."""
    by_length = materialize(_survivors(rows, ["_len"], total), "lengths")
    return materialize(_survivors(by_length, ["_len", "_prefix"], total), "prefixes")


def _best(*more: str) -> list[Column]:
    """The row of a group that stays comes first: most code points, then smallest id, null last."""
    return [(-F.col("_chars")).alias("_neg"), F.col("_id").isNull().alias("_null"), *(F.col(c) for c in ("_id", *more))]


def decide(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The result names every text's full hash, so the texts are read once for all three keys; the rounds then refine narrow
    rows by length, by prefix hash and by full hash. Of equal texts the one with the most code points stays, then the smallest id. A null
    text counts as empty; a null id ranks last. Rows that repeat id, length and content are
    interchangeable: exactly one of them is marked kept. An empty table gives an empty result.
    """
    rows = materialize(signatures(docs, id_col, text, full=True).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    total = rows.count()
    groups = refine(rows, total).groupBy("_sha").agg(F.min(F.struct(*_best("_row"))).alias("_best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select("_sha", F.col("_best._id").alias("_keep"), F.col("_best._row").alias("_first"), "group_size"), "groups")
    out = lookup(rows.select("_sha", "_id", "_row"), groups, ["_sha"], "group_size", total)
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_row") == F.col("_first"))).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns unchanged; see decide() for ties and nulls.

    Full hashes are taken only of rows that share their length and prefix hash with another. Two bitmaps of bounded size
    then part the rows where they lie: rows outside the first, of ids that drop out, stay; of the others those outside the
    second, of staying ids that the first holds by chance, go. Only the few rows in both, and rows that repeat an id or have none, are joined.
    """
    rows = materialize(signatures(docs, id_col, text), "signatures")
    total, ids = rows.count(), F.xxhash64("_id")
    odd = materialize(rows.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1 or _id is null").select("_id"), "odd")  # null, or more than once
    found = refine(rows, total).select("_id").unionByName(odd)
    bits = bitmap_bits(8 * found.count())
    body = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text")).withColumn("_own", ids)
    to_read = materialize(bitmap(found, ids, bits), "read")
    read = in_bitmap(body.select("_id", "_text", "_own"), F.col("_own"), to_read, bits, "_may").where("_may")
    content = [F.length(text_or_empty("_text")).cast("long").alias("_chars"), F.sha2(normalised(text_or_empty("_text")), 256).alias("_sha")]
    hashed = materialize(read.select("_id", *content), "hashes")
    groups = hashed.groupBy("_sha").agg(F.min(F.struct(*_best())).alias("_best"), F.count("*").alias("_size"))
    groups = materialize(groups.select("_sha", F.col("_best._id").alias("_keep"), (-F.col("_best._neg")).alias("_most"), "_size"), "groups")
    gone = lookup(hashed, groups.where("_size > 1"), ["_sha"], "_size", total).where("_size is not null and not (_id <=> _keep)").select("_id")
    gone = materialize(gone.unionByName(odd).distinct(), "gone")
    n_gone = gone.count()
    if not n_gone:
        return docs
    bits = bitmap_bits(16 * n_gone)
    out = materialize(bitmap(gone, ids, bits), "out")
    chance = in_bitmap(rows.select("_id"), ids, out, bits, "_may").where("_may").join(gone, "_id", "left_anti").where("_id is not null")
    chance = materialize(chance.select("_id"), "chance")
    again, other = F.xxhash64(F.lit("again"), F.col("_id")), bitmap_bits(16 * (chance.count() + odd.count()))
    back = materialize(bitmap(chance.unionByName(odd), again, other), "back")
    parted = in_bitmap(in_bitmap(body, F.col("_own"), out, bits, "_out"), again, back, other, "_back")
    stays, unsure = parted.where("not _out"), parted.where("_out and _back")
    result = stays.select("_row.*").unionByName(unsure.join(chance, "_id", "left_semi").select("_row.*"))
    if odd.isEmpty():
        return result
    doubtful = unsure.join(odd.withColumnRenamed("_id", "_odd"), F.col("_id").eqNullSafe(F.col("_odd")), "left_semi").select("_row", "_id", *content)
    best = groups.select(F.col("_sha").alias("_s"), "_keep", "_most")
    kept = doubtful.join(best, (F.col("_sha") == F.col("_s")) & F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_most")), "left_semi")
    return result.unionByName(kept.dropDuplicates(["_id", "_sha"]).select("_row.*"))
