"""Scoring documents by a gated recurrent language model beside a smoothed unigram base."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import gru
from quarry.llm.common import hash60, id_as_text, id_back, materialize, text_or_empty

FOLDS, SMOOTH = 10, 0.1
#: The end of a text; no word holds a space.
END = b" end"
#: Most frequent tokens whose counts every worker holds (about 30 MB); counts of all others are joined.
HEAD, HEAD_STEPS = 200_000, 8
#: Units for words outside the model's vocabulary, by the word's beginning and closing mark.
BUCKETS = 128
#: Documents (about, and twice as many at most) of the driver's training that only initialises the round, first in hash order of their ids.
SEED_DOCS = 1500
#: Tokens of a shard of the distributed round, in which all training documents take part, and the round's rate.
SHARD_TOKENS, ROUND_RATE = 1_000_000, 0.01
#: Tokens that a task holds before it trains on them, before it scores them (three times as many of long documents), and words it counts at once.
TRAIN_TOKENS, MOST_TOKENS, LONG_TOKENS, MOST_WORDS = 2_000_000, 500_000, 2048, 500_000
#: Tokens that are looked up at once; a longer document is looked up whole.
CODED_TOKENS = 100_000
#: Weights are added up as whole multiples of 2^-32, so that their mean doesn't depend on the order of the sum.
_FIXED = float(1 << 32)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def bucket(word: bytes) -> int:
    return zlib.crc32(word[:2] + (word[-1:] if word[-1:] in b".,!?;:|" else b"")) % BUCKETS


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, c: counts of all tokens of all rows; tasks add up before the shuffle."""

    def table(own: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["token", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                own.update(tokens(t.as_py()))
                if len(own) > MOST_WORDS:
                    yield table(own)
                    own.clear()
        yield table(own)

    found = docs.select(text_or_empty(text).alias("text")).mapInArrow(run, "token binary, c long")
    return found.groupBy("token").agg(F.sum("c").alias("c"))


class Lexicon(NamedTuple):
    """Head tokens with their unit and logs, units' order, and totals."""

    index: dict[bytes, int]
    unit: np.ndarray
    base: np.ndarray  # log10 of the base probability of each head token
    rest: np.ndarray  # log10 of its share of its bucket; 0 for vocabulary
    bucket_unit: np.ndarray
    bucket_log: np.ndarray  # log10 of each bucket's smoothed mass
    end: int
    counts: np.ndarray
    n: int
    v: int
    base_log: float


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals over all counts; the HEAD most frequent tokens and the buckets' masses come to the driver, nothing else."""
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = n or 0, v or 0
    # the least count that at most HEAD tokens reach, from a histogram of under 600 steps: no sort, and no task sends more
    step = F.floor(F.log2("c") * HEAD_STEPS).cast("int")
    histogram = dict(map(tuple, counts.groupBy(step.alias("s")).count().collect()))
    least, room = 1 << 30, HEAD
    for s in sorted(histogram, reverse=True):
        room -= histogram[s]
        if room < 0:
            break
        least = s
    head = counts.where(step >= least).toArrow()
    words, c = [bytes(w) for w in head.column("token").to_pylist()], head.column("c").to_numpy().astype(np.int64)
    by_count = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in by_count], c[by_count]
    room = gru.UNITS - BUCKETS - 1
    vocabulary = [w for w in words[: room + 1] if w != END][:room]
    known = frozenset(vocabulary) | {END}

    def masses(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for w, k in zip(batch["token"], batch["c"], strict=True):
                if bytes(w) not in known:
                    b = bucket(bytes(w))
                    mass[b] += k
                    kinds[b] += 1
        yield pd.DataFrame({"b": np.arange(BUCKETS), "c": mass, "v": kinds})

    tail = counts.mapInPandas(masses, "b int, c long, v long").groupBy("b").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).toPandas()
    mass, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    mass[tail["b"]], kinds[tail["b"]] = tail["c"], tail["v"]
    of = dict(zip(words, c.tolist(), strict=True))
    # units by falling count, so that classes hold words of like frequency
    size = np.concatenate([[of.get(END, 0)], mass, [of[w] for w in vocabulary], np.zeros(room - len(vocabulary))])
    place = np.empty(gru.UNITS, np.int64)
    order = np.argsort(-size, kind="stable")
    place[order] = np.arange(gru.UNITS)
    own = {w: int(place[1 + BUCKETS + i]) for i, w in enumerate(vocabulary)} | {END: int(place[0])}
    bucket_unit, bucket_log = place[1 : BUCKETS + 1], np.log10(mass + SMOOTH * (kinds + 1))
    base_log = math.log10(n + SMOOTH * (v + 1))
    where = np.array([-1 if w in own else bucket(w) for w in words], np.int64)
    unit = np.array([own[w] if b < 0 else bucket_unit[b] for w, b in zip(words, where, strict=True)], np.int32)
    logs = np.log10(c + SMOOTH) if len(c) else np.zeros(0)
    rest = np.where(where < 0, 0.0, logs - bucket_log[where]) if len(c) else np.zeros(0)
    return Lexicon(dict(zip(words, range(len(words)), strict=True)), unit, logs - base_log, rest, bucket_unit, bucket_log, int(place[0]), size[order], n, v, base_log)


def _units(lex: Lexicon, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[Counter]]:
    """(units of all documents' tokens, ends of the documents, [head tokens, their base, their rest] by document, counts of the words outside the head)."""
    ends = np.cumsum([len(words) for words in docs])
    starts = ends - [len(words) for words in docs]
    index = np.fromiter(map(lex.index.get, chain.from_iterable(docs), repeat(-1)), np.int64, ends[-1])
    if not len(lex.unit):
        unit, sums = np.zeros(len(index), np.int32), [np.zeros(len(docs), np.int64), np.zeros(len(docs)), np.zeros(len(docs))]
    else:
        unit, head = lex.unit[index], index >= 0
        sums = [np.add.reduceat(x, starts) for x in (head.astype(np.int64), np.where(head, lex.base[index], 0.0), np.where(head, lex.rest[index], 0.0))]
    far: list[Counter] = [Counter() for _ in docs]
    place = np.nonzero(index < 0)[0]
    owner = np.searchsorted(ends, place, "right")
    for i, d, k in zip(place.tolist(), owner.tolist(), (place - starts[owner]).tolist(), strict=True):
        word = docs[d][k]
        unit[i] = lex.end if word == END else lex.bucket_unit[bucket(word)]
        far[d][word] += 1
    return unit, ends, sums, far


def encode(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as units, tokenised once: _row, _id, held_out, n_tokens, known and base (of head tokens), rest, units (2 bytes each), far.

    rest is the log10 of the words' shares in their buckets; far lists words outside the head with their number and bucket mass.
    """
    mass = [float(x) for x in lex.bucket_log]

    def table(keys: pa.Array, flags: pa.Array, held: list[list[bytes]]) -> pa.RecordBatch:
        unit, ends, (known, base, rest), counted = _units(lex, held)
        far = [w for x in counted for w in x]
        entry = [pa.array(far, pa.binary()), pa.array([k for x in counted for k in x.values()], pa.int64()), pa.array([0.0 if w == END else mass[bucket(w)] for w in far], pa.float64())]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in counted])]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(entry, ["token", "k", "mass"]))
        cells = pa.array([x.tobytes() for x in np.split(unit.astype("<u2"), ends[:-1])], pa.binary())
        sizes = pa.array([len(x) for x in held], pa.int64())
        return pa.RecordBatch.from_arrays([keys, flags, sizes, pa.array(known), pa.array(base), pa.array(rest), cells, lists], ["_id", "held_out", "n_tokens", "known", "base", "rest", "units", "far"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, flags, texts = batch.columns
            at, held, n = 0, [], 0
            for k, t in enumerate(texts, 1):
                held.append(tokens(t.as_py()))
                n += len(held[-1])
                if n >= CODED_TOKENS or k == len(texts):
                    yield table(keys[at:k], flags[at:k], held)
                    at, held, n = k, [], 0

    narrow = docs.select(id_as_text(id_col), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text).alias("text"))
    schema = "_id string, held_out boolean, n_tokens long, known long, base double, rest double, units binary, far array<struct<token:binary,k:long,mass:double>>"
    return narrow.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def _as_units(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, "<u2").astype(np.int32)


def fit(coded: DataFrame, lex: Lexicon) -> gru.Params:
    """Weights that start from a training on whole texts of a bounded sample, then one round of training over all documents (_id, units).

    The round deals the documents by a hash of their ids to shards of about SHARD_TOKENS tokens, so their number
    grows with the corpus. Each shard trains on all of its documents, in hash order, from the common start; the weights'
    mean over the shards is added up on the executors. Neither depends on how rows lie in partitions.
    """
    h, x = hash60(F.col("_id")), F.xxhash64("units")
    n_docs = int(lex.counts[lex.end])
    rows = coded.select(h.alias("_h"), x.alias("_x"), "units")
    # a bound on the hash, so that no task sorts more than about its part of the sample
    near = rows.where(F.col("_h") < int(2**60 * min(1.0, SEED_DOCS / max(1, n_docs)))) if n_docs > SEED_DOCS else rows
    seeds = near.orderBy("_h", "_x").limit(2 * SEED_DOCS).toPandas()
    first, _ = gru.train(gru.start(lex.counts), [_as_units(u) for u in seeds["units"]], lex.end)
    start = gru.flat(first)
    shards = max(1, round(lex.n / SHARD_TOKENS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total, n_shards, shard = np.zeros(len(start), np.int64), 0, None
        params, held, n = gru.unflat(start), [], 0

        def learn() -> gru.Params:
            return gru.train(params, held, lex.end, ROUND_RATE)[0]

        def add() -> np.ndarray:
            return np.round(gru.flat(params).astype(np.float64) * _FIXED).astype(np.int64)

        for batch in batches:
            for own, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != shard:
                    if shard is not None:
                        params = learn()
                        total, n_shards = total + add(), n_shards + 1
                    params, held, n, shard = gru.unflat(start), [], 0, own
                held.append(_as_units(cell.as_py()))
                n += len(held[-1])
                if n > TRAIN_TOKENS:
                    params, held, n = learn(), [], 0
        if shard is not None:
            params = learn()
            total, n_shards = total + add(), n_shards + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start), dtype=np.int32)), pa.array(total), pa.array(np.full(len(start), n_shards))], ["i", "w", "n"])

    dealt = rows.withColumn("_shard", F.pmod("_h", F.lit(shards)).cast("int")).repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_h", "_x")
    tuned = dealt.select("_shard", "units").mapInArrow(run, "i int, w long, n long")
    # decimals, as the sum over the shards of a large corpus may exceed a long
    mean = tuned.groupBy("i").agg((F.sum(F.col("w").cast("decimal(20,0)")).cast("double") / F.sum("n")).alias("w")).toPandas()
    out = start.astype(np.float64)
    out[mean["i"]] = mean["w"] / _FIXED
    return gru.unflat(out)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod 10 isn't 0. A word outside the model's vocabulary
    is scored as its bucket's unit times its smoothed share of the bucket, so that all words have
    probabilities. Null and empty texts are the end alone. Without rows to learn from N and V are 0
    and both scores follow from smoothing and untrained weights. Repeated rows are scored alike and
    counted as often as they occur; a null id hashes as the empty string.
    """
    learn = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("text")).where(~held_out(F.col("_id")))
    counts = materialize(count_tokens(learn), "counts")
    lex = lexicon(counts)
    coded = materialize(encode(docs, lex, id_col, text), "units")
    weights = tuple(fit(coded.where(~F.col("held_out")), lex))
    kept = ["_row", "_id", "held_out", "n_tokens", "known", "base", "rest", "units"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = gru.Params(*weights)

        def done(held: list) -> pa.RecordBatch:
            ll = gru.log_likelihoods(params, [x[-1] for x in held], lex.end) / math.log(10)
            columns = [pa.array([x[k] for x in held], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x[6] + float(s) for x, s in zip(held, ll, strict=True)], pa.float64())], [*kept[:6], "model"])

        # long documents wait for each other: beside short ones they would walk on in few streams
        held: dict[bool, list] = {False: [], True: []}
        n = {False: 0, True: 0}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), batch.column(7), strict=True):
                row = (*row[:7], _as_units(row[7].as_py()))
                long = len(row[7]) > LONG_TOKENS
                held[long].append(row)
                n[long] += len(row[7])
                if n[long] > MOST_TOKENS * (3 if long else 1):
                    yield done(held[long])
                    held[long], n[long] = [], 0
        yield from (done(rows) for rows in held.values() if rows)

    scored = coded.select(*kept).mapInArrow(run, "_row long, _id string, held_out boolean, n_tokens long, known long, base double, model double")
    far = coded.select("_row", F.explode("far").alias("f")).select("_row", "f.token", "f.k", "f.mass")
    joined = far.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    log = F.log10(F.col("c") + SMOOTH)
    sums = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"),
        F.sum(F.col("k") * (log - F.lit(lex.base_log))).alias("_base"),
        F.sum(F.when(F.col("token") == F.lit(END), 0.0).otherwise(F.col("k") * (log - F.col("mass")))).alias("_model"),
    )
    zero = F.lit(0.0)
    out = scored.join(sums, "_row", "left").select(
        "_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", zero)).alias("base_score"), (F.col("model") + F.coalesce("_model", zero)).alias("score"),
    )
    return id_back(out, docs, id_col)
