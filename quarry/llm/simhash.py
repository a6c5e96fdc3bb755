"""SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import HEAVY, bitmap, bitmap_bits, id_as_text, id_back, in_bitmap, lookup, materialize, text_or_empty
from quarry.operators.skew import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A bucket with more distinct fingerprints than this is linked by stars instead of pairs. By chance 36-bit keys meet so often
#: only beyond 1e10 distinct fingerprints; such buckets hold families of near copies.
DENSE = 64
#: Fingerprints of a task that makes keys, about 120 each: a count before the shuffle holds a million keys, however few files hold the fingerprints.
TASK_FPS = 8192
#: Generator polynomial of the binary Golay code (23, 12): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Bits of the fingerprint in each segment; the code's words have 23 bits, missing ones are 0.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_WINDOW = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of message << 11 by the generator, and the error pattern of weight up to 3 that has each syndrome."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
        return v

    one = [1 << i for i in range(23)]
    errors = [0, *one, *[a | b for i, a in enumerate(one) for b in one[:i]], *[a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]]
    pattern = np.zeros(2048, np.int64)
    pattern[remainder(np.array(errors))] = errors
    return remainder(np.arange(4096) << 11), pattern


_REMAINDER, _ERROR = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the only codeword within 3 bits of each 23-bit word."""
    syndrome = _REMAINDER[words >> 11] ^ (words & 2047)
    return (words ^ _ERROR[syndrome]) >> 11


@cache
def _steps(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the codeword indices (as differences to the word's own) that 1 flip, and only 2 flips, of the lower bits reach; -1 pads.

    The code is linear, so the difference depends on the syndrome and the flipped bits alone.
    """
    one = 1 << np.arange(bits)
    two = np.array([a | b for i, a in enumerate(one) for b in one[:i]])

    def moved(flips: np.ndarray, s: int) -> np.ndarray:
        syndrome = _REMAINDER[flips >> 11] ^ (flips & 2047)
        return np.unique((flips ^ _ERROR[s ^ syndrome] ^ _ERROR[s]) >> 11)

    first = [np.setdiff1d(moved(one, s), [0]) for s in range(2048)]
    second = [np.setdiff1d(moved(two, s), [0, *near]) for s, near in enumerate(first)]
    out = tuple(np.full((2048, max(map(len, found))), -1, np.int64) for found in (first, second))
    for table, found in zip(out, (first, second), strict=True):
        for s, own in enumerate(found):
            table[s, : len(own)] = own
    return out


#: Most keys of a fingerprint.
MOST_KEYS = 2081
_SHIFT = (24, 12, 0)


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, flips): keys of each fingerprint such that any two within 3 bits share one whose flips add up to at most 3.

    A key is the codeword indices of all three segments, 36 bits, of the fingerprint or of a vector 1 or 2 flips
    away from it; flips is the least number that reaches the key. By the pigeonhole principle 3 errors, however they
    fall on the segments, are at most 1 on one side and at most 2 on the other: there both fingerprints are the same vector. The
    code gathers neighbouring vectors, so 2,081 vectors have about 140 keys.
    """
    n = len(fingerprints)
    segment = [(fingerprints >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
    center = np.zeros(n, np.int64)
    step1, step2 = [], []
    for word, (_, bits), shift in zip(segment, SEGMENTS, _SHIFT, strict=True):
        center |= codeword_index(word) << shift
        syndrome = _REMAINDER[word >> 11] ^ (word & 2047)
        for steps, of in zip((step1, step2), _steps(bits), strict=True):
            found = of[syndrome]
            steps.append(np.where(found < 0, -1, found << shift))
    far = [*step2]
    for i in range(3):
        for j in range(i):
            both = step1[i][:, :, None] ^ step1[j][:, None, :]
            far.append(np.where((step1[i] < 0)[:, :, None] | (step1[j] < 0)[:, None, :], -1, both).reshape(n, -1))
    rows, keys, flips = [np.arange(n)], [center], [np.zeros(n, np.int8)]
    for k, steps in ((1, np.hstack(step1)), (2, np.hstack(far))):
        row, col = np.nonzero(steps >= 0)
        rows.append(row)
        keys.append(center[row] ^ steps[row, col])
        flips.append(np.full(len(row), k, np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(flips)


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a whole text; a text without words has 0. Works through long texts in windows."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n < SHINGLE:
        return digest(b" ".join(words), SEED)
    count = np.zeros(64, np.int64)
    for at in range(0, n - SHINGLE + 1, _WINDOW):
        part = words[at : at + _WINDOW + SHINGLE - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        spans = zip(starts[: len(part) - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little")
        count += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    up = 2 * count > n - SHINGLE + 1
    return int(np.packbits(up, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) for every row of docs."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["_id", "fp"])

    narrow = docs.select(id_as_text(id_col), text_or_empty(text).alias("text"))
    return id_back(narrow.mapInArrow(run, "_id string, fp long"), docs, id_col)


def _keyed(fps: DataFrame, total: int) -> DataFrame:
    """(key, flips, fp) for every key of every distinct fingerprint, of which there are total; TASK_FPS of them a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in range(0, len(own), 1 << 10):
                part = own[at : at + (1 << 10)]
                row, key, flips = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(flips), pa.array(part[row])], ["key", "flips", "fp"])

    dealt = fps.select("fp").repartition(max(1, -(-total // TASK_FPS)))
    return dealt.mapInArrow(run, "key long, flips byte, fp long")


def _ball(fps: DataFrame, radius: int) -> DataFrame:
    """(z, fp) for every vector z within radius (1 or 2) bits of each fingerprint."""
    one = F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")
    masks = F.concat(F.array(F.lit(0).cast("long")), one)
    if radius == 2:
        two = F.expr("flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))")
        masks = F.concat(masks, two)
    return fps.select(F.explode(masks).alias("_m"), "fp").select(F.expr("fp ^ _m").alias("z"), "fp")


def _dense_links(keys: DataFrame, dense: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, parts): links that connect the fingerprints of dense buckets as all their pairs would, in rows linear in the fingerprints.

    parts (fp, part) names for each fingerprint of a dense bucket what is linked by 2 bits or fewer.

    Fingerprints within 1 bit of a vector z are within 2 of each other: each takes a link to the
    least of them. Then a pair at distance 3 in different parts has a z within 1 of one end and 2
    of the other; only fingerprints outside their bucket's main part need look for it.
    """
    member = keys.join(F.broadcast(heavy), "key", "left_semi").unionByName(
        keys.join(F.broadcast(heavy), "key", "left_anti").join(dense.join(F.broadcast(heavy), "key", "left_anti"), "key", "left_semi")
    )
    member = materialize(member, "dense")
    fps = materialize(member.select("fp").distinct(), "densefp")
    near = materialize(_ball(fps, 1), "ball1")
    least = near.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("_n"))
    links = materialize(near.join(least.where("_n > 1").hint("merge"), "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct(), "links2")
    part = components(links)
    own = materialize(fps.join(part, fps["fp"] == part["node"], "left").select("fp", F.coalesce("component", "fp").alias("part")), "parts")
    times = member.groupBy("fp").agg(F.count("*").alias("_times"))
    placed = materialize(member.join(own.join(times, "fp"), "fp").select("key", "fp", "part"), "placed")
    main = placed.groupBy("key", "part").agg(F.count("*").alias("_c")).groupBy("key").agg(F.max_by("part", F.struct("_c", "part")).alias("_main"), F.sum("_c").alias("_n"))
    odd = lookup(placed, materialize(main, "main"), ["key"], "_n").where("part <> _main").select("fp").distinct()
    # a bitmap of all z drops most of a ball before the shuffle; merge, as the planner takes the exploded rows for few
    bits = bitmap_bits(16 * 65 * fps.count())
    far = in_bitmap(_ball(materialize(odd, "odd"), 2), F.xxhash64("z"), materialize(bitmap(least, F.xxhash64("z"), bits), "bits"), bits, "_may").where("_may")
    far = far.join(least.select("z", "b").hint("merge"), "z").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return links.unionByName(far.distinct()), own


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, fp.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest id reachable, its
    own included. Null, empty and wordless texts have fingerprint 0, which links like any other.
    Equal fingerprints are one node, so copies cost nothing. A null id is ignored when the
    smallest id is sought. An empty table gives an empty result; other columns are left out.
    """
    rows = materialize(fingerprints(docs, id_col, text), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count("*").alias("_rows")), "groups")
    total = groups.count()
    # made twice rather than stored: a file's row group of keys would be one task's to count
    keys = _keyed(groups, total)
    # shared by two fingerprints, of which one comes to the key with at most 1 flip
    count = keys.groupBy("key").agg(F.count("*").alias("_n"), F.min("flips").alias("_least"))
    count = materialize(count.where("_n > 1 and _least < 2").select("key", "_n"), "shared")
    n_shared = count.count()
    # a bitmap of the shared keys drops the others, nearly all, before any join shuffles them
    bits = bitmap_bits(8 * n_shared)
    pages = materialize(bitmap(count, F.xxhash64("key"), bits), "pages")
    hits = materialize(in_bitmap(keys, F.xxhash64("key"), pages, bits, "_may").where("_may").drop("_may"), "hits")
    dense = count.where(F.col("_n") > DENSE)
    # buckets with at least 1/HEAVY of all fingerprints: a fingerprint has at most MOST_KEYS keys, so there are at most MOST_KEYS x HEAVY
    heavy = materialize(dense.where(F.col("_n") >= max(DENSE + 1, -(-total // HEAVY))).select("key"), "heavykeys")
    few = hits.join(F.broadcast(heavy), "key", "left_anti").join(count.where(F.col("_n") <= DENSE), "key", "left_semi")
    few = materialize(few, "few")
    links = None
    few = few.withColumn("part", F.col("fp"))
    if dense.limit(1).count():
        links, parts = _dense_links(hits.select("key", "fp"), dense.select("key"), heavy)
        # what is linked already needs no pairs
        few = few.drop("part").join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    a, b = (few.where(w).select("key", F.col("fp").alias(x), F.col("part").alias(f"_{x}")) for w, x in (("flips < 2", "a"), ("true", "b")))
    close = a.join(b, "key").where(f"_a <> _b and bit_count(a ^ b) <= {DISTANCE}")
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = close if links is None else links.unionByName(close)
    part = components(links)
    known = groups.join(part, groups["fp"] == part["node"], "left").select("fp", "_least", "_rows", F.coalesce("component", "fp").alias("_part"))
    known = materialize(known, "known")
    least = known.groupBy("_part").agg(F.min("_least").alias("component_id"), F.count("*").alias("_fps"))
    named = lookup(known.select("_part", "fp", "_rows"), least, ["_part"], "_fps", total).select("fp", "component_id", "_rows")
    out = lookup(rows, materialize(named, "final"), ["fp"], "_rows")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest; a row with a null id stays. Of rows that repeat an id within a component one stays."""
    named = docs.where(F.col(id_col).isNotNull())
    found = materialize(near_duplicates(named, id_col, text).where(f"{id_col} = component_id").select(F.col(id_col).alias("_keep"), F.col("fp").alias("_fp")), "kept")
    alone = docs.where(F.col(id_col).isNull())
    if found.groupBy("_keep").count().where("count > 1").isEmpty() and named.groupBy(id_col).count().where("count > 1").isEmpty():
        return named.join(found, named[id_col] == found["_keep"], "left_semi").unionByName(alone)

    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    rows = named.select(F.struct("*").alias("_row"), F.col(id_col).alias("_keep"), own(text_or_empty(text)).alias("_fp"))
    rows = rows.join(found.distinct(), ["_keep", "_fp"], "left_semi")
    first = Window.partitionBy("_keep").orderBy("_fp")
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("_row.*").unionByName(alone)
