"""Sources and sinks: snapshots, deltas between snapshots, named checkpoints, collections on disk, local conversions."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = "put", "delete"


def scan_prefix(rows: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def count_prefix(rows: DataFrame, prefix: str, key: str = "key") -> int:
    return scan_prefix(rows, prefix, key).count()


def save_snapshot(df: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Parquet brings dictionary, run-length and delta encodings; compression is the codec on top."""
    df.write.mode(mode).option("compression", compression).parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_snapshots(spark: SparkSession, paths: list[str], path: str) -> None:
    """Many snapshots into one, row by row, without a shuffle."""
    spark.read.option("mergeSchema", "true").parquet(*paths).write.parquet(path)


def diff(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A delta from old to new: key, op (put or delete), was (added, changed, removed) and new's values."""
    values = [c for c in new.columns if c != key]
    a, b = old.select(F.col(key).alias("_k"), F.struct(*values).alias("_old")), new.select(key, F.struct(*values).alias("_new"))
    both = b.join(a, b[key] == a["_k"], "full").where("_new is null or _old is null or not (_new <=> _old)")
    was = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("changed")
    op = F.when(F.col("_new").isNull(), DELETE).otherwise(PUT)
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), op.alias("op"), was.alias("was"), *[F.col("_new")[c].alias(c) for c in values])


def apply_delta(base: DataFrame, delta: DataFrame, key: str = "key") -> DataFrame:
    """base with the delta's puts in and its deletes out."""
    puts = delta.where(F.col("op") == PUT).select(*base.columns)
    return base.join(delta.select(key), key, "left_anti").unionByName(puts)


def merge_deltas(deltas: list[DataFrame], key: str = "key") -> DataFrame:
    """One delta for a chain of them in order; the last write of a key counts."""
    tagged = [d.withColumn("_seq", F.lit(i)) for i, d in enumerate(deltas)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return every.groupBy(key).agg(F.max_by(F.struct(*every.columns), "_seq").alias("_r")).select("_r.*").drop("_seq")


def fields_changed(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(key, field, before, after) for every value that differs."""
    names = [c for c in new.columns if c != key]
    both = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in names]).join(new, F.col("_k") == F.col(key), "full")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").cast("string").alias("before"), F.col(c).cast("string").alias("after")) for c in names])
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), F.inline(each)).where("not (before <=> after)")


LOG = "seq long, op string, key string, value string"


def append_log(records: DataFrame, path: str) -> None:
    """Add records (seq, op 'put' or 'delete', key, value) to a log folder; a batch is one atomic write."""
    records.select("seq", "op", "key", "value").write.mode("append").parquet(path)


def replay_log(log: DataFrame, base: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """(key, value) after a log in order of seq, on top of a snapshot: each key's last record counts."""
    if upto is not None:
        log = log.where(F.col("seq") <= upto)
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("_r"))
    out = last.where("_r.op = 'put'").select("key", F.col("_r.value").alias("value"))
    return out if base is None else base.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(out)


class Checkpoints:
    """Named versions of tables as Parquet folders under a shared root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, tables: dict[str, DataFrame], name: str | None = None) -> str:
        at = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
        name = name or f"checkpoint-{at}"
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{name}/{table}")
        row = [(name, at, sorted(tables))]
        self.spark.createDataFrame(row, "name string, created_at string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.root}/index")
        return name

    def list(self, limit: int | None = None) -> DataFrame:
        """Newest first."""
        df = self.spark.read.parquet(f"{self.root}/index").orderBy(F.col("created_at").desc())
        return df if limit is None else df.limit(limit)

    def restore(self, name: str) -> dict[str, DataFrame]:
        row = self.list().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return {t: self.spark.read.parquet(f"{self.root}/versions/{name}/{t}") for t in row["tables"]}


def save_collections(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """A folder with one part per collection, as parquet or json."""
    getattr(rows.write.partitionBy("collection"), form)(path)


def load_collections(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return getattr(reader, form)(path)


def from_pandas(spark: SparkSession, frame, renamed: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(frame.rename(columns=renamed or {}))


def from_vectors(spark: SparkSession, vectors: dict, normalize: bool = False) -> DataFrame:
    """{key: values} as (key, embedding); normalize scales to unit length, zero vectors stay."""
    import numpy as np

    rows = []
    for k, v in vectors.items():
        v = np.asarray(v, float)
        n = float(np.linalg.norm(v))
        rows.append((k, (v / n if normalize and n else v).tolist()))
    return spark.createDataFrame(rows, "key string, embedding array<float>")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (id, content, size)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content", F.col("length").alias("size"))
