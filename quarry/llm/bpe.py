"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_as_text, id_back, text_or_empty

#: Fixed value: the pre-tokenisation pattern of the byte-level tokenizer file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the per-process memo tables; a full table starts anew. Only speed depends on them.
MOST_WORDS, MOST_PAIRS, LONGEST_KEPT = 300_000, 1_000_000, 64


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBPE:
    """A tokenizer file's vocabulary, its Aho-Corasick automaton, pair table and offset table."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *added.values()])
        self.tokens: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = t.encode() if t in added else b"".join(back[c] for c in t)
        for t, i in added.items():
            self.tokens[i] = t.encode()
        self.ids = {t: i for i, t in enumerate(self.tokens) if t and i not in added.values()}
        self.rank, self.parts = {}, {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[b"".join(back[c] for c in x)] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = self.ids[self.tokens[a] + self.tokens[b]]
            self.rank[a, b] = (r, whole)
            self.parts.setdefault(whole, (r, a, b))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.split = regex.compile(PATTERN)
        self.added = {t: i for t, i in added.items() if t}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        # every token that a merge yields, and single bytes; a token's next shorter prefix ends the walk back
        known = {*self.parts, *self.single}
        self.machine = ahocorasick.Automaton()
        for i in known:
            self.machine.add_word(self.tokens[i].decode("latin-1"), i)
        self.machine.make_automaton()
        self.known, self.shorter = known, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[str, int]] = {}

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for a single byte."""
        if token not in self.shorter:
            t = self.tokens[token]
            found = (self.ids.get(t[:n], -1) for n in range(len(t) - 1, 0, -1))
            self.shorter[token] = next((i for i in found if i in self.known), -1)
        return self.shorter[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side: no merge across the seam comes before the merges that made them."""
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[key] = out = self._seam(left, right)
        return out

    def _seam(self, left: int, right: int) -> bool:
        never = 1 << 60
        limit = never
        a, b = left, right
        while True:
            met = self.rank.get((a, b))
            if met and met[0] < limit:
                return False
            ra, rb = self.parts.get(a, (-1,))[0], self.parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges: its parts still stood apart before it
            if ra > rb:
                limit, a = ra, self.parts[a][2]
                if self._early(a, b, limit):
                    return False
            else:
                limit, b = rb + 1, self.parts[b][1]
                if self._early(a, b, limit):
                    return False

    def _early(self, a: int, b: int, limit: int) -> bool:
        met = self.rank.get((a, b))
        return bool(met) and met[0] < limit

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Exact BPE of one pre-token: take the longest match, step back to shorter ones where two neighbours don't fit."""
        n = len(piece)
        if n == 1:
            return [self.single[piece[0]]]
        longest: list[int] = [-1] * n
        size = [0] * n
        for end, token in self.machine.iter(piece.decode("latin-1")):
            length = len(self.tokens[token])
            if length > size[end - length + 1]:
                longest[end - length + 1], size[end - length + 1] = token, length
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + len(self.tokens[token])
            if not dead[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
                continue
            token = self._shorter(token)
            if token < 0:
                dead[pos] = 1
                token = out.pop()
                pos -= len(self.tokens[token])
                # the popped token was tried: go on with the next shorter one
                while (token := self._shorter(token)) < 0:
                    dead[pos] = 1
                    token = out.pop()
                    pos -= len(self.tokens[token])
        return out

    def _word(self, word: str) -> str:
        ids = ",".join(map(str, self.encode_bytes(word.encode("utf-8", "surrogatepass"))))
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas, as the tokenizers library gives them without special tokens added."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            self._plain(text[at : m.start()], out)
            out.append(str(self.added[m.group()]))
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return ",".join(out)

    def _plain(self, text: str, out: list[str]) -> None:
        """Pieces of a bounded number of words, so that a very long text needs little more than itself."""
        get, word = self.words.get, self._word
        words: list[str] = []
        for m in self.split.finditer(text) if len(text) > 1 << 22 else ():
            words.append(m.group())
            if len(words) == 1 << 16:
                out.append(",".join([get(w) or word(w) for w in words]))
                words = []
        if len(text) <= 1 << 22:
            words = self.split.findall(text)
        if words:
            out.append(",".join([get(w) or word(w) for w in words]))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: token i is blob[offsets[i]:offsets[i + 1]]."""
        parts = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k : k + (1 << 18)]
            start, length = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(length)
            index = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
            parts.append(self.blob[index].tobytes())
        return b"".join(parts)


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, dtype=np.int64, sep=",") if ids else np.empty(0, np.int64)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the array<int> column out of token ids; null text counts as empty and gives no ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in texts:
            yield pd.Series([_numbers(bpe.encode_text(t)).astype(np.int32) for t in batch])

    return docs.withColumn(out, ids(text_or_empty(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the string column out; a null list decodes to the empty text, broken UTF-8 to replacement characters."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(path)
        for batch in batches:
            yield pd.Series([bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") if x is not None else "" for x in batch])

    return encoded.withColumn(out, texts(F.col(ids)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row: whole texts are encoded, and their ids decoded again.

    Null texts count as empty: 0 tokens. Rows aren't compared with each other, so repeated rows
    give repeated results; an empty table gives an empty result; other columns are left out.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in batches:
            rows = []
            for t in batch["text"]:
                ids = bpe.encode_text(t)
                numbers = _numbers(ids)
                back = bpe.decode(numbers) if len(numbers) else b""
                back = back.decode("utf-8", "replace").encode()
                rows.append((len(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "_id", batch["_id"].to_numpy())
            yield out

    narrow = docs.select(id_as_text(id_col), text_or_empty(text).alias("text"))
    return id_back(narrow.mapInPandas(run, "_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"), docs, id_col)
