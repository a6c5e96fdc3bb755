"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, lm_scoring, matroska, mixing, secrets, sharding, simhash, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = docs.select("doc_id", n_bytes.alias("n_bytes"))
    return sharding.shard(docs, F.col("doc_id"), F.col("n_bytes"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark)).drop("url")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_matroska, op3_lm_scoring, op4_exact_dedup, op5_secret_scans, op6_url_filters, op7_bpe, op8_mixing, op9_simhash, op10_toxicity)}

_HASH = "('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint"
_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE = {
    "op1_sharding": f"""
with d as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, {_HASH} as h from documents),
levels as (select unnest(range(0, 61)) as depth),
node as (
  select depth, h >> (60 - depth) as p, sum(n_bytes)::bigint as b, count(*) as r,
    sum(n_bytes) <= {sharding.MAX_BYTES} or min(h) = max(h) as fits
  from d, levels group by all),
leaf as (
  select c.* from node c where c.fits and (c.depth = 0 or exists (
    select 1 from node q where q.depth = c.depth - 1 and q.p = c.p >> 1 and not q.fits)))
select doc_id, n_bytes,
  case when depth = 0 then '' else lpad(bin(p), depth::int, '0') end as shard,
  depth::int as depth, r as shard_rows, b as shard_bytes
from d join leaf on h >> (60 - depth) = p""",
    "op4_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id rows between unbounded preceding and unbounded following)""",
    "op6_url_filters": r"""
with u as (
  select page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path from (select page_id, coalesce(url, '') as url from pages)),
r(rule_host, rule_path, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(v, length(rule_host || rule_path)) as v
  from (select distinct host, path from u) join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by all)
select page_id, u.host, u.path, rule, coalesce(v, 'allow') as verdict from u left join m on u.host = m.host and u.path = m.path""",
    "op8_mixing": f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::bigint as size, {_HASH} as h from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from d group by source),
s1 as (select *, [5.0::double, 2.0::double, 1.0::double][((k - 1) % 3) + 1] as w, source_size * 2.0::double as cap from s0),
s2 as (select *, sum(source_size) over () * 1.5::double as total, sum(w) over () as wsum,
  coalesce(sum(cap) over o, 0.0) as cb, coalesce(sum(w) over o, 0.0) as wb
  from s1 window o as (order by cap / w, k rows between unbounded preceding and 1 preceding)),
s3 as (select *, (total - cb) / (wsum - wb) >= cap / w as is_full from s2),
s4 as (select *, total - sum(case when is_full then cap else 0 end) over () as rest, sum(case when is_full then 0 else w end) over () as unmet from s3),
s as (select source, source_size, k, coalesce(case when is_full then cap else w * rest / nullif(unmet, 0) end, 0) as target from s4),
total as (select sum(round(target)::bigint)::bigint as words, greatest(1, (sum(round(target)::bigint)::bigint + {mixing.SLOTS - 1}) // {mixing.SLOTS}) as block from s),
span as (select *, sum(round(target)::bigint) over (order by k) - round(target)::bigint as lo, sum(round(target)::bigint) over (order by k) as hi from s),
point as (select i as slot, (i * {mixing.GOLDEN}::double - floor(i * {mixing.GOLDEN}::double)) * words::double as x from total, range((words + block - 1) // block) t(i)),
slots as (select slot, k, row_number() over (partition by k order by slot) - 1 as r from point join span on lo <= x and x < hi),
line as (
  select d.*, s.k, s.source_size, s.target, block, coalesce(c, 0) * block as lim,
    coalesce(sum(size) over (partition by s.k order by h, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as lo
  from d join s on d.source is not distinct from s.source cross join total left join (select k, count(*) as c from slots group by k) n on n.k = s.k)
select doc_id, size, source_size, target,
  greatest(least(lo + size, lim) - lo, 0) + greatest(least(source_size + lo + size, lim) - source_size - lo, 0) as taken,
  slot as first_slot,
  case when size > 0 and lo < lim then (least(lo + size, lim) - 1) // block - lo // block + 1 else 0 end
    + case when size > 0 and source_size + lo < lim then (least(source_size + lo + size, lim) - 1) // block - (source_size + lo) // block + 1 else 0 end as n_pieces
from line left join slots on slots.k = line.k and r = lo // block and size > 0""",
}
