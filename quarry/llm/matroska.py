"""Matroska media columns: write texts' payloads as PCM tracks, parse EBML into packet tables, read payloads back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, id_back, text_or_empty

# Element identifiers of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
ENCODINGS, ENCODING, COMPRESSION, COMPRESSION_KIND, COMPRESSION_SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
ZLIB, STRIPPED = 0, 3
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
#: Elements at the level of a cluster: one of these ends a cluster or segment of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

PAD, SAMPLE_RATE = 64, 8000
#: 512 samples (64 ms) a frame, 8 frames a block, 32 blocks a cluster: block times fit their 16 bits.
FRAME, FRAMES, BLOCKS = 512, 8, 32


def payload_of(data: bytes) -> bytes:
    """data followed by bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD if data else PAD)


def _size(n: int, width: int = 0) -> bytes:
    """A length as a variable-length integer, the shortest that isn't the reserved all-ones value."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: int) -> bytes:
    if lacing == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += _size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


_HEAD = _element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ_VERSION, 2)]))
_AUDIO = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _AUDIO))


def mux(payload: bytes, lacing: int | None = None) -> bytes:
    """A Matroska file with one 8-bit PCM track. lacing None: fixed for frames of one size, EBML lacing otherwise."""
    duration = len(payload) * 1000 / SAMPLE_RATE
    parts = [_element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", duration)) + _element(MUXER, b"quarry") + _element(WRITER, b"quarry")), _TRACKS]
    at, cues = sum(map(len, parts)), []
    block, step = FRAME * FRAMES, FRAME * FRAMES * BLOCKS
    for start in range(0, len(payload), step):
        time = start * 1000 // SAMPLE_RATE
        body = [_uint(TIMESTAMP, time)]
        for b in range(start, min(start + step, len(payload)), block):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + block, len(payload)), FRAME)]
            kind = lacing if lacing is not None else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            kind = NO_LACING if len(frames) == 1 else kind
            if kind == FIXED and len(frames[-1]) != FRAME:
                kind = EBML_LACING
            if kind == NO_LACING:
                for n, f in enumerate(frames):
                    body.append(_element(SIMPLE_BLOCK, struct.pack(">BhB", 0x81, b * 1000 // SAMPLE_RATE - time + n * FRAME * 1000 // SAMPLE_RATE, 0x80) + f))
                continue
            body.append(_element(SIMPLE_BLOCK, struct.pack(">BhB", 0x81, b * 1000 // SAMPLE_RATE - time, 0x80 | kind << 1) + _lace(frames, kind)))
        parts.append(_element(CLUSTER, b"".join(body)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    """One frame: its bytes lie at offset; cluster is the number and cluster_offset the first byte of its cluster element, to which cues point."""

    track: int
    codec: str
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    cluster_offset: int
    cluster_time_ns: int
    block: int
    lace: int
    keyframe: bool
    cued: bool  # a cue of this track points to the cluster


class Parsed(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, str]
    cues: list[tuple[int, int, int]]  # time in timestamp units, track, first byte of the cluster element
    clusters: list[int]  # first bytes of the cluster elements
    timestamp_scale: int
    error: str | None
    encodings: dict[int, tuple[int, bytes]]  # by track, where its frames are compressed: ZLIB, or STRIPPED and the bytes left out


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are ones) of a variable-length integer."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad variable-length integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    low = value & (1 << 7 * width) - 1
    return (value if marker else low), at + width, low == (1 << 7 * width) - 1


def _children(data: bytes, at: int, end: int, unknown: bool = False) -> Iterator[tuple[int, int, int, bool]]:
    """(id, first byte of the body, end, unknown size) of the elements in a range; an unknown range ends before a TOP element."""
    for _, ident, body, stop, open_ in _placed(data, at, end, unknown):
        yield ident, body, stop, open_


def _placed(data: bytes, at: int, end: int, unknown: bool = False) -> Iterator[tuple[int, int, int, int, bool]]:
    """The elements as _children has them, each behind the first byte of the element itself."""
    while at < end:
        ident, body, _ = _vint(data, at, True)
        if unknown and ident in TOP:
            return
        size, body, open_ = _vint(data, body, False)
        stop = end if open_ else body + size
        if stop > end and ident not in (SEGMENT, CLUSTER):
            raise ValueError(f"element at {at} runs past its parent")
        yield at, ident, body, min(stop, end), open_
        if stop > end:
            raise ValueError(f"element at {at} is cut off")
        if open_:
            stop = body
            for _, _, stop, _ in _children(data, body, end, unknown=True):
                pass
        at = stop


def _block(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, [(offset, size) of each frame]) of a block."""
    track, at, _ = _vint(data, at, False)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, time, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING and n > 1:
        size, at, _ = _vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at, _ = _vint(data, at, False)
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    elif lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return track, time, flags, list(zip(starts, sizes, strict=True))


def parse(data: bytes) -> Parsed:
    """Packets of every track in file order, tracks' codecs and frame encodings, cues and cluster offsets.

    A frame of a SimpleBlock is a keyframe by its flag, one of a BlockGroup when no other block is referred to. Frames of a laced block are spaced by their number of samples where the track is 8-bit PCM at a known rate, else
    they share the block's time. A damaged file gives what was read up to there, and error.
    """
    packets: list[Packet] = []
    tracks: dict[int, str] = {}
    rates: dict[int, float] = {}
    encodings: dict[int, tuple[int, bytes]] = {}
    cues, clusters, scale, error = [], [], 1_000_000, None
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        if not data or _vint(data, 0, True)[0] != EBML:
            raise ValueError("no EBML header")
        for ident, body, end, open_ in _children(data, 0, len(data)):
            if ident != SEGMENT:
                continue
            first = body
            for place, ident, body, end, open_ in _placed(data, body, end):
                if ident == INFO:
                    scale = next((number(a, b) for i, a, b, _ in _children(data, body, end) if i == TIMESTAMP_SCALE), scale)
                elif ident == TRACKS:
                    for i, a, b, _ in _children(data, body, end):
                        if i == TRACK_ENTRY:
                            own = {j: (c, d) for j, c, d, _ in _children(data, a, b)}
                            track = number(*own[TRACK_NUMBER])
                            tracks[track] = data[slice(*own[CODEC])].decode("ascii", "replace") if CODEC in own else ""
                            if AUDIO in own:
                                rate = next((data[c:d] for j, c, d, _ in _children(data, *own[AUDIO]) if j == RATE), b"")
                                if len(rate) in (4, 8):
                                    rates[track] = struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0]
                            if ENCODINGS in own:
                                encodings[track] = _encoding(data, *own[ENCODINGS])
                elif ident == CUES:
                    for i, a, b, _ in _children(data, body, end):
                        if i == CUE_POINT:
                            own = list(_children(data, a, b))
                            time = next(number(c, d) for j, c, d, _ in own if j == CUE_TIME)
                            for position in [(c, d) for j, c, d, _ in own if j == CUE_POSITIONS]:
                                to = {j: number(c, d) for j, c, d, _ in _children(data, *position)}
                                cues.append((time, to[CUE_TRACK], first + to[CUE_CLUSTER]))
                elif ident == CLUSTER:
                    clusters.append(place)
                    base, n = 0, 0
                    for i, a, b, _ in _children(data, body, end, unknown=open_):
                        if i == TIMESTAMP:
                            base = number(a, b)
                        own = [(SIMPLE_BLOCK, a, b, False)] if i == SIMPLE_BLOCK else list(_children(data, a, b)) if i == BLOCK_GROUP else []
                        alone = all(j != REFERENCE_BLOCK for j, *_ in own)
                        for c, d in [(c, d) for j, c, d, _ in own if j in (SIMPLE_BLOCK, BLOCK)]:
                            track, time, flags, frames = _block(data, c, d)
                            when = (base + time) * scale
                            spaced = 1e9 / rates[track] if tracks.get(track, "").startswith("A_PCM") and rates.get(track) else 0
                            done = 0
                            for k, (at, size) in enumerate(frames):
                                key = bool(flags & 0x80) if i == SIMPLE_BLOCK else alone
                                packets.append(Packet(track, tracks.get(track, ""), when + round(done * spaced), at, size, len(clusters) - 1, place, base * scale, n, k, key, False))
                                done += size
                            n += 1
    except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
        error = str(e) or type(e).__name__
    pointed = {(track, at) for _, track, at in cues}
    packets = [p._replace(cued=True) if (p.track, p.cluster_offset) in pointed else p for p in packets]
    return Parsed(packets, tracks, cues, clusters, scale, error, encodings)


def _encoding(data: bytes, at: int, end: int) -> tuple[int, bytes]:
    """How a track's frames are compressed; only one layer of zlib or of header stripping can be read."""
    layers = [list(_children(data, a, b)) for i, a, b, _ in _children(data, at, end) if i == ENCODING]
    if len(layers) != 1 or any(i == ENCRYPTION for i, *_ in layers[0]):
        raise ValueError("frames in several encodings or encrypted")
    own = {j: data[c:d] for i, a, b, _ in layers[0] if i == COMPRESSION for j, c, d, _ in _children(data, a, b)}
    kind = int.from_bytes(own.get(COMPRESSION_KIND, b"\0"), "big")
    if kind not in (ZLIB, STRIPPED):
        raise ValueError(f"frames in unknown compression {kind}")
    return kind, own.get(COMPRESSION_SETTINGS, b"")


def read_back(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The track's frames in file order as its codec wrote them, joined: headers that were left out are put back, zlib is undone."""
    frames = [data[p.offset : p.offset + p.size] for p in parsed.packets if p.track == track]
    if track in parsed.encodings:
        kind, settings = parsed.encodings[track]
        frames = [zlib.decompress(f) if kind == ZLIB else settings + f for f in frames]
    return b"".join(frames)


def feature(payload: bytes, parsed: Parsed) -> str:
    """Packet counts and duration, then mean, deviation and zero crossings of the samples around 128."""
    x = np.frombuffer(payload, np.uint8)
    mean, up = 0.0, 0
    square = 0.0
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20)].astype(np.float64)
        mean, square = mean + part.sum(), square + (part * part).sum()
        high = x[at : at + (1 << 20) + 1] >= 128
        up += int(np.count_nonzero(high[1:] != high[:-1]))
    mean, square = mean / len(x), square / len(x)
    last = parsed.packets[-1]
    end = last.timestamp_ns // 1_000_000 + last.size * 1000 // SAMPLE_RATE
    return f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};duration_ms={end};mean={mean:.4f};std={max(0.0, square - mean * mean) ** 0.5:.4f};crossings={up}"


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, media: each row's text as a Matroska file. Null counts as empty; an empty text is 64 zero samples."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "media": [mux(payload_of(t.encode("utf-8", "surrogatepass"))) for t in batch["text"]]})

    narrow = docs.select(id_as_text(id_col), text_or_empty(text).alias("text"))
    return id_back(narrow.mapInPandas(run, "_id string, media binary"), docs, id_col)


PACKETS = "track int, codec string, timestamp_ns long, offset long, size long, cluster int, cluster_offset long, cluster_time_ns long, block int, lace int, keyframe boolean, cued boolean"


def packets(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """Packet table of a binary column: one row per frame with track, codec, time, byte range, cluster and cue, in file order within a file.

    A damaged file gives its packets up to the damage, then one row with error set and the rest
    null; so does a null or empty value. Other columns are left out.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", *Packet._fields, "error"]
        for batch in batches:
            rows = []
            for key, data in zip(batch["_id"], batch["media"], strict=True):
                found = parse(bytes(data) if data is not None else b"")
                rows += [(key, *p, None) for p in found.packets]
                if found.error:
                    rows.append((key, *[None] * len(Packet._fields), found.error))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=names, dtype=object)

    narrow = media.select(id_as_text(id_col), F.col(column).alias("media"))
    return id_back(narrow.mapInPandas(run, f"_id string, {PACKETS}, error string"), media, id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all from the parsed file.

    Null counts as empty; equal texts give equal values; an empty table gives an empty result.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for t in batch["text"]:
                data = t.encode("utf-8", "surrogatepass")
                media = mux(payload_of(data))
                parsed = parse(media)
                if parsed.error:
                    raise ValueError(parsed.error)
                back = read_back(media, parsed)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, parsed)))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "_id", batch["_id"].to_numpy())
            yield out

    narrow = docs.select(id_as_text(id_col), text_or_empty(text).alias("text"))
    schema = "_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return id_back(narrow.mapInPandas(run, schema), docs, id_col)
