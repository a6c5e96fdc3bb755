"""Operators whose results a plain version repeats exactly."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, matroska, mixing, queries, sharding, url_filter
from tests.conftest import rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def pandas(df):
    return df.toPandas().astype(object).where(lambda x: x.notna(), None)


# sharding


@pytest.mark.parametrize("limit", [200, 3000, 1 << 20])
def test_shards_fit_and_split_only_when_needed(docs, edge_docs, limit):
    for df in (docs, edge_docs):
        out = sharding.shard(df, F.col("doc_id"), F.octet_length("text"), limit)
        assert out.count() == df.count()
        p = out.select("doc_id", F.col("shard").alias("s"), "depth", "shard_rows", "shard_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), sharding.hash60(F.col("doc_id")).alias("h")).toPandas()
        sums = p.groupby("s").n.agg(["sum", "count", "max"])
        for s, rows_, total in p[["s", "shard_rows", "shard_bytes"]].drop_duplicates().itertuples(index=False):
            assert (sums.loc[s, "count"], sums.loc[s, "sum"]) == (rows_, total)
            assert total <= limit or rows_ == 1
        for s, depth, h in p[["s", "depth", "h"]].itertuples(index=False):
            assert f"{h:060b}"[:depth] == s.split("+")[0]
        for s in {s for s in p.s if s and "+" not in s}:  # the parent had to split
            parent = s[:-1]
            under = p[[f"{h:060b}".startswith(parent) for h in p.h]]
            assert under.n.sum() > limit and under.h.nunique() > 1


def test_one_key_with_many_rows_gets_overflow_pages(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"), F.lit(10).alias("n"))
    out = sharding.shard(df, F.col("k"), F.col("n"), 1000)
    sums = out.groupBy("shard").agg(F.sum("n").alias("b"), F.first("shard_bytes").alias("s")).collect()
    assert all(r["b"] <= 1000 and r["b"] == r["s"] for r in sums)
    assert out.count() == 3000


def test_sharding_of_nothing(empty_docs):
    assert sharding.shard(empty_docs, F.col("doc_id"), F.octet_length("text")).count() == 0


# exact dedup


def plain_dedup(data):
    groups = {}
    for i, (doc, t) in enumerate(data):
        t = t or ""
        groups.setdefault(SPACE.sub("", t), []).append((-len(t), doc is None, doc if doc is not None else 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, sha))
    return sorted(out, key=repr)


def test_exact_dedup_matches_plain_version(docs, edge_docs, empty_docs):
    for df in (docs, edge_docs):
        data = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert rows(exact_dedup.decide(df)) == plain_dedup(data)
        kept = exact_dedup.exact_dedup(df)
        assert kept.columns == df.columns
        assert kept.count() == len({SPACE.sub("", t or "") for _, t in data})
    assert exact_dedup.decide(empty_docs).count() == 0


def test_refining_leaves_the_rows_that_share_length_and_prefix(spark):
    texts = ["a b", "ab", "a  b ", "ba", "abc", "x" * 200 + "1", "x" * 200 + "2", "", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    left = exact_dedup.refine(exact_dedup.signatures(df), len(texts)).collect()
    assert {r["_id"] for r in left} == {0, 1, 2, 5, 6, 7, 8, 9}


@pytest.mark.parametrize("bits", [None, 4])
def test_exact_dedup_keeps_the_right_rows(spark, edge_docs, bits, monkeypatch):
    if bits:  # bitmaps so small that nearly every row is in both
        monkeypatch.setattr(exact_dedup, "bitmap_bits", lambda n: bits)
    many = spark.range(400).selectExpr("id as doc_id", "concat('text ', id % 90, if(id % 3 = 0, ' ', '')) as text", "id as extra")
    for df in (many, edge_docs, edge_docs.unionByName(edge_docs), many.limit(0), many.where("doc_id < 90")):
        data = df.select("doc_id", "text").collect()
        best = {}
        for r in data:
            t, d = r["text"] or "", r["doc_id"]
            k = SPACE.sub("", t)
            best[k] = min(best.get(k, (1, True, 0, "")), (-len(t), d is None, d or 0, t))
        want = Counter((None if n else d, SPACE.sub("", t), -c) for c, n, d, t in best.values())
        got = Counter((r["doc_id"], SPACE.sub("", r["text"] or ""), len(r["text"] or "")) for r in exact_dedup.exact_dedup(df).collect())
        assert got == want


# media


@pytest.mark.parametrize("lacing", [None, matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
@pytest.mark.parametrize("size", [0, 1, 64, 511, 512, 4095, 4097, 131_073, 400_000])
def test_matroska_round_trip(size, lacing):
    payload = matroska.payload_of(np.random.default_rng(size).bytes(size))
    data = matroska.mux(payload, lacing)
    found = matroska.parse(data)
    assert found.error is None and matroska.read_back(data, found) == payload
    assert [p.timestamp_ns for p in found.packets] == [64_000_000 * k for k in range(len(found.packets))]
    assert len(found.cues) == len(found.clusters)
    assert all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in found.cues)


def test_unknown_sizes_and_block_groups():
    frame = b"abc" * 20
    block = matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, b"\x81\x00\x05\x00" + frame))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska._uint(matroska.TIMESTAMP, 10) + block
    data = matroska._HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + matroska._TRACKS + cluster + cluster
    found = matroska.parse(data)
    assert found.error is None and len(found.clusters) == 2
    assert [(p.timestamp_ns, data[p.offset : p.offset + p.size]) for p in found.packets] == [(15_000_000, frame)] * 2


def test_a_file_of_another_writer():
    """Written here by hand: two tracks, header stripping, void elements, a reference, lacing in three kinds, cues for both tracks."""
    def element(ident, body):
        ident = bytes.fromhex(ident)
        return ident + b"\x10" + len(body).to_bytes(3, "big") + body

    stripped = element("6D80", element("6240", element("5034", element("4254", b"\x03") + element("4255", b"HEAD"))))
    tracks = element("1654AE6B", element("AE", element("D7", b"\x01") + element("86", b"V_TEST") + stripped) + element("AE", element("D7", b"\x02") + element("86", b"A_TEST")))
    void = element("EC", b"\xa3\xa3\xa3")
    one = element("1F43B675", element("E7", b"\x00") + void + element("A3", b"\x81\x00\x00\x80" + b"abc") + element("A0", element("A1", b"\x82\x00\x02\x02\x01\x02" + b"xyZ" + b"more") + element("FB", b"\xff")))
    ebml_laced = b"\x82\x00\x00\x06\x02" + b"\x83" + b"\xbe" + b"111" + b"22" + b"33333"  # sizes 3, 3 - 1, rest
    two = element("1F43B675", element("E7", b"\x64") + element("A0", element("A1", b"\x81\xff\xff\x80" + b"def")) + element("A3", ebml_laced))
    info = element("1549A966", element("2AD7B1", (500_000).to_bytes(3, "big")))
    at = len(info) + len(tracks)
    position = lambda track, to: element("B7", element("F7", bytes([track])) + element("F1", to.to_bytes(4, "big")))
    cues = element("1C53BB6B", element("BB", element("B3", b"\x00") + position(1, at) + position(2, at)) + element("BB", element("B3", b"\x64") + position(2, at + len(one))))
    head = element("1A45DFA3", element("4282", b"matroska"))
    data = head + element("18538067", info + tracks + one + two + cues)
    found = matroska.parse(data)
    assert found.error is None and found.tracks == {1: "V_TEST", 2: "A_TEST"} and found.encodings == {1: (3, b"HEAD")}
    assert matroska.read_back(data, found, 1) == b"HEADabcHEADdef" and matroska.read_back(data, found, 2) == b"xyZmore1112233333"
    assert [(p.track, p.timestamp_ns, p.size, p.keyframe, p.cued) for p in found.packets] == [
        (1, 0, 3, True, True), (2, 1_000_000, 2, False, True), (2, 1_000_000, 5, False, True),
        (1, 99 * 500_000, 3, True, False), (2, 50_000_000, 3, False, True), (2, 50_000_000, 2, False, True), (2, 50_000_000, 5, False, True)]
    assert {c for _, _, c in found.cues} == set(found.clusters) and len(found.cues) == 3
    assert all(p.cluster_offset == found.clusters[p.cluster] and p.cluster_time_ns == (0, 50_000_000)[p.cluster] for p in found.packets)


def test_damaged_files_keep_what_was_read(spark):
    data = matroska.mux(bytes(20_000))
    whole, cut = matroska.parse(data), matroska.parse(data[:15_000])
    assert cut.error and 0 < len(cut.packets) < len(whole.packets)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[:100]))], "doc_id long, media binary")
    found = matroska.packets(df).toPandas()
    assert found[found.doc_id == 1].error.isna().all() and found[found.doc_id != 1].error.notna().sum() == 2


def test_media_digests(edge_docs, empty_docs):
    p = matroska.digests(edge_docs).toPandas()
    texts = Counter((r["text"] or "").encode() for r in edge_docs.select("text").collect())
    want = Counter()
    for t, n in texts.items():
        pay = t + bytes(-len(t) % 64 if t else 64)
        want[len(t), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])] += n
    assert Counter(p[["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]].itertuples(index=False, name=None)) == want
    assert p.groupby("payload_sha256").feature.nunique().max() == 1
    assert p.doc_id.isna().sum() == 1 and p.doc_id.max() == 108
    assert matroska.digests(empty_docs).count() == 0
    media = matroska.store(edge_docs)
    assert matroska.packets(media).where("error is not null").count() == 0


# URL filters


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


RULES = [*url_filter.RULES, ("b.net", "", "allow"), ("net", "/a/b/", "allow"), ("net", "/a/", "block"), ("x.b.net", "/a/", "block"), ("com", "/a", "block"), ("com", "/a/b/c", "allow"), ("com", "/aé", "allow")]
URLS = [None, "", "no scheme", "http://", "HTTP://NET/", "http://net", "http://a.net/en/", "http://example.net/en/x", "https://m.example.net/en", "http://xnet/", "http://b.net/a/b/c", "http://x.b.net/a/b/c?q#f", "http://x.b.net:80/a/",
        "http://c.com/a/b/c/d", "http://c.com/a/b/d", "http://c.com/aé/x", "http://c.com/ab", "http://ÄB.org/fr/", "x://y://org/fr/", "http://org/fr/", "http://org/fr", "http://example.com/de/?x", "http://e.com#/de/", "a://b\n.net/x\ny"]


def test_url_filters_match_plain_version(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 3 + [f"http://h{k % 7}.net/a/{k}" for k in range(500)])], "page_id long, url string").withColumn("_row", F.lit(1)).withColumn("host", F.lit("x"))
    for rules in (url_filter.RULES, RULES):
        out = url_filter.judge(df, url_filter.rules_frame(spark, rules)).select("page_id", "host", "path", "rule", "verdict", "url").collect()
        assert len(out) == df.count()
        for r in out:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"], rules)


def test_url_filters_of_nothing(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in url_filter.judge(df, none).collect()] == ["allow"]
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark)).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_matches_the_library(edge_docs, docs, tokenizer, empty_docs):
    for df in (edge_docs, docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            e = tokenizer.encode(r["text"] or "", add_special_tokens=False)
            back = tokenizer.decode(e.ids, skip_special_tokens=False)
            want[r["doc_id"], len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.digests(df, queries.tokenizer_path()).collect())) == want
    assert bpe.digests(empty_docs, queries.tokenizer_path()).count() == 0


def test_bpe_columns_round_trip(edge_docs):
    coded = bpe.decode(bpe.encode(edge_docs, queries.tokenizer_path()), queries.tokenizer_path())
    assert coded.where("coalesce(text, '') <> decoded").count() == 0


def test_bpe_of_random_strings(tokenizer):
    import random

    coder, r = bpe.loaded(queries.tokenizer_path()), random.Random(8)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "1", "'s", "'ll", "!!", "AB", "<|endoftext|>", "漢", "😀", "\t", "aaaa", "\x1c", "\x85", "\xa0", "==", "\u2028"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert coder.encode_text(t) == ",".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids))
    assert coder.encode_text("ab" * 20_000) == ",".join(map(str, tokenizer.encode("ab" * 20_000, add_special_tokens=False).ids))


# mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        t = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_} | {s: 2.0 * sizes[s] for s in full}
        over = {s for s in open_ if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def plain_mix(data):
    """Words taken of each (id, source, text), ids distinct, slot by slot."""
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in data}
    sizes = Counter()
    for i, source, _ in data:
        sizes[source] += words[i]
    want = plain_targets(dict(sizes))
    names = sorted([x for x in sizes if x is not None]) + ([None] if None in sizes else [])
    whole = {x: round(want[x]) for x in names}
    total = sum(whole.values())
    block = max(1, -(-total // mixing.SLOTS))
    slots, taken = Counter(), Counter()
    for k in range(-(-total // block)):
        at, low = (k * mixing.GOLDEN - math.floor(k * mixing.GOLDEN)) * total, 0
        for x in names:
            if low <= at < low + whole[x]:
                slots[x] += 1
            low += whole[x]
    for x in names:
        line = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i, source, _ in data if source == x)
        left = min(slots[x] * block, 2 * sizes[x])
        for _ in range(2):
            for _, i in line:
                own = min(words[i], left)
                taken[i] += own
                left -= own
    return {i: taken[i] for i, _, _ in data}


def plain_mixed(data):
    """(id, text) of the rows of the mix."""
    out = []
    taken = plain_mix(data)
    for i, _, t in data:
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        if ends:
            out += [(i, t)] * (taken[i] // len(ends))
            if taken[i] % len(ends):
                out.append((i, t[: ends[taken[i] % len(ends) - 1]]))
    return out


def test_mix_matches_a_plain_version(docs):
    data = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()]
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs)[0].collect()} == plain_mix(data)
    assert Counter((r["doc_id"], r["text"]) for r in mixing.mixed_rows(docs).collect()) == Counter(plain_mixed(data))


def test_mix_reaches_targets(docs, edge_docs, empty_docs):
    for df in (docs, edge_docs):
        p = mixing.mix(df)[0].toPandas().astype({"source": object})
        p["source"] = p.source.where(p.source.notna(), None)
        word = Counter()
        for r in df.select("source", "text").collect():
            word[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        want = plain_targets(dict(word))
        assert len(p) == df.count() and (p.taken <= 2 * p["size"]).all()
        for s, part in p.groupby("source", dropna=False):
            s = None if s != s else s
            assert part.source_size.iloc[0] == word[s] and part.target.iloc[0] == pytest.approx(want[s])
            block = -(-round(sum(want.values())) // mixing.SLOTS)
            assert abs(part.taken.sum() - want[s]) <= 4 * block
            assert part.taken.sum() <= 2 * word[s]
    assert mixing.mix(empty_docs)[0].count() == 0


def test_mixed_rows_hold_the_taken_words(docs, edge_docs):
    for df in (docs, edge_docs):
        out = mixing.mixed_rows(df)
        assert out.columns == df.columns
        data, made = df.select("doc_id", "source", "text", "n_chars").collect(), out.select("doc_id", "source", "text", "n_chars").collect()
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
        taken = Counter()
        for r in mixing.mix(df)[0].collect():
            taken[r["doc_id"]] += r["taken"]
        got = Counter()
        for r in made:
            got[r["doc_id"]] += len(words(r["text"]))
        assert got == +taken
        whole = {(r["doc_id"], r["source"], r["n_chars"]): r["text"] or "" for r in data}
        for r in made:  # whole texts or their beginnings; other columns as they were
            assert whole[r["doc_id"], r["source"], r["n_chars"]].startswith(r["text"])


def test_mixed_rows_come_in_slot_order(docs):
    out = mixing.mixed_rows(docs)
    first = {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs)[0].collect()}
    parts = out.select(F.spark_partition_id().alias("p"), "doc_id").collect()
    for p in {r["p"] for r in parts}:
        once = list(dict.fromkeys(r["doc_id"] for r in parts if r["p"] == p))
        assert [first[d] for d in once] == sorted(first[d] for d in once)


def test_first_words_keep_the_text_as_it_is(spark):
    df = spark.createDataFrame([(" a  bé\n\tc d ", 2), ("x y", 1), ("\ta\x0bb\x0cc", 2)], "t string, k long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("k"))).collect()] == [" a  bé", "x", "\ta\x0bb"]


def test_the_schedule_decides_the_mix(docs, monkeypatch):
    good = rows(mixing.mix(docs)[0])
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)  # all points in the first source
    p = mixing.mix(docs)[0].toPandas()
    assert (p.taken[p.source != p.source.min()] == 0).all() and rows(mixing.mix(docs)[0]) != good


def test_schedule_spreads_sources(docs):
    documents, pieces = mixing.mix(docs)
    p = pieces.toPandas()
    taken = documents.groupBy("doc_id").agg(F.sum("taken").alias("t")).toPandas().set_index("doc_id").t
    assert p.groupby("doc_id").piece_words.sum().eq(taken[taken > 0]).all()
    half = p[p.slot < p.slot.max() / 2].groupby("source").piece_words.sum()
    whole = p.groupby("source").piece_words.sum()
    assert ((half / whole).dropna() - 0.5).abs().max() < 0.02
