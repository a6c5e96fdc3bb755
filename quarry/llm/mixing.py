"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, hash60, materialize, running_sum, text_or_empty

#: Weights by rank of the source, repeating; the mix's size as a part of the corpus; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Slots of the schedule. A block has the mix's words / SLOTS, rounded up, so that a source misses its target by the same small part at every size.
SLOTS = 1 << 17
GOLDEN = 0.6180339887498949
#: Cells of [0, 1) by which schedule points meet the sources' intervals.
CELLS = 4096
ROWS_PER_BUCKET = 20_000
#: Tables of at most this many sources or slots (a few MB) are broadcast.
MOST_BROADCAST = 1 << 18
_SPACES = " \t\n\x0b\x0c\r"


def _along(df: DataFrame, order: list, sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """df with running sums (name: column) and the rank along order, the row itself included; no window holds the whole table.

    Rows are range-partitioned by order; sums within a part start from the sums of the parts before it.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    sums = dict(sums) | ({rank: "_one"} if rank else {})
    placed = placed.withColumn("_one", F.lit(1).cast("long"))
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_w_{k}": F.sum(c).over(own) for k, c in sums.items()}).join(F.broadcast(parts), "_part")
    return out.select(*df.columns, *[(F.col(f"_b_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size -> source_rank, target: share by weight, no target above passes x size, excess reshared by weight.

    Sources rank by code point, null last. In order of cap / weight the sources that reach their
    cap come first, so one pass finds the level at which resharing ends. One row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = _along(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {}, "source_rank")
    s = s.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(passes))
    s = _along(s, [(F.col("_cap") / F.col("_w")).asc(), F.col("source_rank").asc()], {"_ca": "_cap", "_wa": "_w"})
    s = materialize(s, "levels")
    total, w_sum = s.agg(F.sum("source_size") * float(share), F.sum("_w")).first()
    rest, open_ = F.lit(total or 0.0) - (F.col("_ca") - F.col("_cap")), F.lit(w_sum or 0.0) - (F.col("_wa") - F.col("_w"))
    s = s.withColumn("_full", rest / open_ >= F.col("_cap") / F.col("_w"))
    used, w_open = s.agg(F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)), F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w")))).first()
    share_of = F.col("_w") * F.lit((total or 0.0) - (used or 0.0)) / F.nullif(F.lit(w_open or 0.0), F.lit(0.0))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(share_of)
    return s.select("source", "source_rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def schedule(sources: DataFrame, n: int) -> DataFrame:
    """The n slots of the mix in order: slot, source_rank, r (the slot's rank in its source).

    Point k x golden ratio mod 1 falls into one source's interval of cumulative whole targets; a source's slots
    are ranked by k. So any run of slots holds the sources in their proportions, up to a few slots.
    """
    spark = sources.sparkSession
    line = _along(sources.select("source_rank", F.round("target").cast("long").alias("_words")), [F.col("source_rank").asc()], {"_hi": "_words"})
    line = materialize(line.withColumn("_lo", F.col("_hi") - F.col("_words")).where("_words > 0"), "intervals")
    total = line.agg(F.sum("_words")).first()[0] or 0
    cell = lambda words: F.least(F.floor(words / F.lit(float(max(1, total))) * CELLS), F.lit(CELLS - 1))
    line = line.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    k = spark.range(n if total else 0).withColumn("_u", F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN)))
    k = k.withColumn("_at", F.col("_u") * F.lit(float(total))).withColumn("_cell", cell(F.col("_at"))).withColumn("_one", F.lit(1).cast("long"))
    hit = k.join(line.select("_cell", "_lo", "_hi", "source_rank"), "_cell").where("_at >= _lo and _at < _hi")
    hit = hit.select(F.col("id").alias("slot"), "source_rank", "_one", F.expr(f"id div {ROWS_PER_BUCKET}").alias("_bucket"))
    return running_sum(hit, "source_rank", "_bucket", ["slot"], "_one", "r").select("slot", "source_rank", "r")


def mix(docs: DataFrame, id_col: str = "doc_id", seed: str = "", block_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix; docs needs id, source and text.

    documents: one row per row of docs with id, source, size, source_size, target, taken, first_slot, n_pieces. pieces:
    one row per slot and pass of a document that the slot's block overlaps: slot, id, source, in_pass, piece_start,
    piece_words (of the document). Each source's documents are laid on a line in hash order, the line is repeated
    PASSES times and cut into equal-word blocks; slot r of a source takes block r, which ends where the line does. What
    a source gives is what its slots take, so it comes within a few blocks of its target and never beyond PASSES
    times its size. Texts that are null or without words have size 0 and nothing taken (first_slot null); a
    table without words has all targets 0. Rows that repeat an id are kept apart by their place.
    """
    line, empty, pieces = _laid(docs, id_col, seed, block_words)
    got = pieces.groupBy("source_rank", "_start").agg(F.sum("piece_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))
    zero = F.lit(0).cast("long")
    cols = [F.col("_id").alias(id_col), "source", "size", "source_size", "target"]
    empty = empty.select(*cols, zero.alias("taken"), F.lit(None).cast("long").alias("first_slot"), zero.alias("n_pieces"))
    placed = line.join(got, ["source_rank", "_start"], "left").select(*cols, F.coalesce("taken", zero).alias("taken"), "first_slot", F.coalesce("n_pieces", zero).alias("n_pieces"))
    return placed.unionByName(empty), pieces.select("slot", F.col("_id").alias(id_col), "source", "in_pass", "piece_start", "piece_words")


def _laid(docs: DataFrame, id_col: str, seed: str = "", block_words: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with words, each at its place _start on its source's line; documents without; pieces of the first as slots take them)."""
    order = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    narrow = materialize(docs.select(F.col(id_col).alias("_id"), "source", size.alias("size"), hash60(order).alias("_h")), "sizes")
    sources = materialize(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    words_all, n_sources = sources.agg(F.sum(F.round("target").cast("long")), F.count("*")).first()
    block = block_words or max(1, -(-int(words_all or 0) // SLOTS))
    n_slots, n = -(-int(words_all or 0) // block), narrow.count()
    known = F.broadcast(sources) if n_sources <= MOST_BROADCAST else sources
    rows = narrow.join(known, narrow["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    bits = min(30, max(8, (n // ROWS_PER_BUCKET).bit_length() + 2))
    words = rows.where("size > 0").withColumn("_bucket", F.expr(f"shiftright(_h, {60 - bits})"))
    line = materialize(running_sum(words, "source_rank", "_bucket", ["_h", "_id"], "size", "_start").drop("_bucket"), "line")
    passes = line.withColumn("in_pass", F.explode(F.array(*[F.lit(p).cast("long") for p in range(PASSES)])))
    passes = passes.withColumn("_lo", F.col("in_pass") * F.col("source_size") + F.col("_start"))
    passes = passes.withColumn("_hi", F.col("_lo") + F.col("size"))
    pieces = passes.withColumn("r", F.explode(F.expr(f"sequence(_lo div {block}, (_hi - 1) div {block})")))
    first = F.greatest(F.col("_lo"), F.col("r") * block)
    pieces = pieces.withColumns({"piece_start": first - F.col("_lo"), "piece_words": F.least(F.col("_hi"), (F.col("r") + 1) * block) - first})
    slots = materialize(schedule(sources, n_slots), "slots")
    pieces = pieces.join(F.broadcast(slots) if n_slots <= MOST_BROADCAST else slots, ["source_rank", "r"])
    return line, rows.where("size = 0"), pieces


def first_words(text: Column, k: Column) -> Column:
    """text up to the end of its k-th word, for texts with more than k words: the k-th space behind a word is found without an array of words."""
    plain = F.translate(text, _SPACES, " " * len(_SPACES))
    marked = F.regexp_replace(plain, "(?<=[^ ]) ", "\n")  # as long as the text; a mark behind each word
    return F.left(text, F.length(F.call_function("substring_index", marked, F.lit("\n"), k.cast("int"))))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix as rows with the columns of docs, in slot order within each partition.

    A document appears once for every pass in which slots take all of it, and once cut to the words taken for
    a pass in which they take its beginning alone; only a source's last block cuts a document. All other columns stay as they
    are. Each partition holds a part of every run of slots, so it is a mix in the schedule's order by itself.
    """
    line, _, pieces = _laid(docs.withColumn("text", F.col(text)), id_col)
    key = ["_id", F.col("source").alias("_source"), F.col("size").alias("_size")]
    turns = pieces.select(*key, "in_pass", "slot", "piece_words").groupBy("_id", "_source", "_size", "in_pass").agg(F.min("slot").alias("_slot"), F.sum("piece_words").alias("_words"))
    taken = turns.groupBy("_id", "_source", "_size").agg(F.collect_list(F.struct("_slot", "_words")).alias("_turns"))  # one a pass
    taken = materialize(taken, "turns")
    odd = materialize(line.select(*key).groupBy("_id", "_source", "_size").count().where("count > 1").drop("count"), "repeats")
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.col("source").alias("_s"), size.alias("_n"), F.lit(0).cast("long").alias("_k"))
    match = F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    if not odd.isEmpty():  # rows that repeat an id, source and size share their words out in the order of their texts' hashes
        same = Window.partitionBy("_i", "_s", "_n").orderBy(F.xxhash64(f"_row.{text}"))
        again = rows.join(odd, match, "left_semi").withColumn("_k", F.row_number().over(same).cast("long") - 1)
        rows = rows.join(odd, match, "left_anti").unionByName(again)
    both = rows.join(taken, match).withColumn("_t", F.explode("_turns"))
    left = F.least(F.col("_size"), F.col("_t._words") - F.col("_k") * F.col("_size"))
    both = both.withColumn("_left", left).where("_left > 0").withColumn("_slot", F.col("_t._slot"))
    whole = F.col(f"_row.{text}")
    new = F.when(F.col("_left") == F.col("_size"), whole).otherwise(first_words(whole, F.col("_left")))
    out = both.select("_slot", *[new.alias(text) if c == text else F.col(f"_row.{c}").alias(c) for c in docs.columns])
    return out.sortWithinPartitions("_slot").select(*docs.columns)
