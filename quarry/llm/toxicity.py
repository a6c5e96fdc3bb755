"""Toxicity by compression distance: two zstandard dictionaries, window by window, and calibrated thresholds."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash60, id_as_text, id_back, text_or_empty

FOLDS = 5
#: Bounds of the sample that the classifier is fitted on: distinct labelled texts of each class, in hash order of their ids, and bytes of
#: all of them. Texts are taken whole; one that would go beyond the bytes left is passed over.
MOST_ROWS, MOST_BYTES = {1: 2500, 0: 5000}, {1: 64 << 20, 0: 64 << 20}
#: Bytes of a window, of the ordinary dictionary, of the toxic one and its part a piece, and of the lead that every window is compressed behind.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, PIECE_BYTES, LEAD = 32, 1536, 1024, 48, 64
#: Windows, evenly spaced over the sample's ordinary texts, that the ordinary dictionary is trained on.
ORDINARY_WINDOWS = 20_000
#: A piece is toxic when its surplus over ordinary text reaches LEAST_SURPLUS (G squared, one degree of freedom: one in 1e9 by chance) both in
#: texts and in distinct contexts, at LEAST_RATIO times ordinary text's share; a longer piece stands for a shorter one that has little more.
LEAST_SURPLUS, LEAST_RATIO, AS_GOOD = 38.0, 4.0, 0.7
LEVEL, LEAST_MATCH = 6, 4
#: Segment and match length of zstandard's trainer, suited to words; its samples have at least 8 bytes.
SEGMENT, MATCH, LEAST_SAMPLE = 12, 8, 8
_LONGEST = 12
#: Fixed value: the start offsets 1, 4, 8 that stand before the content of every trained dictionary.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


class Model(NamedTuple):
    """What a score needs; a few kilobytes. Without both classes it is prior alone."""

    toxic: bytes
    ordinary: bytes
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float


def trained_content(size: int, samples: list[bytes]) -> bytes:
    """Content of the dictionary of at most size bytes that zstandard trains on samples, without its entropy tables; of too few samples: themselves."""
    import zstandard as z

    try:
        made = z.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:].ljust(LEAST_SAMPLE)
    return made[made.index(_OFFSETS) + len(_OFFSETS) :]


def windows(text: str) -> Iterator[bytes]:
    """The lower-cased text in pieces of about WINDOW bytes, cut behind a space where there is one; the empty text is one empty piece."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at, n = 0, len(data)
    if not n:
        yield b""
    while at < n:
        end = at + WINDOW
        if end < n:
            space = data.rfind(b" ", at + WINDOW // 2, end)
            end = space + 1 if space > 0 else end
        yield data[at:end]
        at = end


class Scorer:
    def __init__(self, model: Model) -> None:
        import zstandard as z

        self.model = model
        params = z.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW + LEAD, dict_size=len(model.toxic) + len(model.ordinary), min_match=LEAST_MATCH, write_content_size=False, write_dict_id=False, write_checksum=False)
        made = []
        # both contents come from zstandard's trainer; behind the toxic one stands the ordinary one, so that ordinary text costs the same with both
        for content in (model.ordinary, model.toxic + model.ordinary):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(z.ZstdCompressor(compression_params=params, dict_data=d).compress)
        self.ordinary, self.toxic = made
        # behind a lead that both know, a window is never stored raw and each match shows in its length
        self.lead = model.ordinary[-LEAD:]

    def features(self, text: str) -> np.ndarray:
        lead, a, b = self.lead, self.ordinary, self.toxic
        gain = np.array([len(a(lead + w)) - len(b(lead + w)) for w in windows(text)], float)
        up = np.maximum(gain, 0)
        top = np.sort(gain)[::-1]
        many = [math.log1p((gain >= k).sum()) for k in (2, 4, 6)]
        return np.array([top[0], math.log1p(up.sum()), up.mean(), (gain >= 3).mean(), *many, top[:3].mean(), math.log1p(len(gain))])

    def raw(self, text: str) -> float:
        return float(_terms(self.features(text)[None, :], self.model.center, self.model.spread)[0] @ self.model.weights)

    def score(self, text: str) -> float:
        if not len(self.model.weights):
            return self.model.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(text)))))


def _terms(x: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    u = np.clip((x - center) / spread, -6, 6)
    return np.column_stack([np.ones(len(u)), u, *[u[:, i] * u[:, j] for i in range(u.shape[1]) for j in range(i + 1)]])


def _surplus(a: float, b: float, n_a: float, n_b: float) -> float:
    """Likelihood ratio (G squared) of a in n_a against b in n_b; 0 unless a is the larger share."""
    e = (a + b) * n_a / (n_a + n_b)
    if a <= e:
        return 0.0
    return 2 * (a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0.0))


def _pieces(word: bytes) -> list[bytes]:
    """Beginnings of 3 to 11 bytes of a word behind a space, and a short word between spaces."""
    w = b" " + word
    return [w[:n] for n in range(4, min(len(w), _LONGEST) + 1)] + ([w + b" "] if len(w) < _LONGEST else [])


def _contexts(texts: Iterable[bytes]) -> Counter:
    """Distinct (word before, word, word after) by word: what copies and near copies of a text repeat counts once."""
    seen: set[int] = set()
    out: Counter = Counter()
    for t in texts:
        words = t.split()
        for key in zip([b"", *words], words, [*words[1:], b""]):
            h = hash(key)
            if h not in seen:
                seen.add(h)
                out[key[1]] += 1
    return out


def toxic_samples(texts: list[str], labels: list[int]) -> list[bytes]:
    """What zstandard trains the toxic dictionary on: for each distinct context of a word with a toxic piece, the longest such piece."""
    by = {y: list(dict.fromkeys(t.encode("utf-8", "surrogatepass").lower() for t, own in zip(texts, labels, strict=True) if own == y)) for y in (0, 1)}
    words = {y: _contexts(by[y]) for y in by}
    total = {y: sum(words[y].values()) for y in by}
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for w, c in words[1].items():
        for p in _pieces(w):
            found[1][p] += c
    for w, c in words[0].items():
        for p in _pieces(w):
            if p in found[1]:
                found[0][p] += c
    value = {}
    for p, c in found[1].items():
        if c * total[0] >= LEAST_RATIO * found[0][p] * total[1]:
            v = _surplus(c, found[0][p], total[1], total[0])
            if v >= LEAST_SURPLUS:
                value[p] = v
    # texts that hold each of the few pieces left
    own = {w: ps for w in words[1].keys() | words[0].keys() if (ps := [p for p in _pieces(w) if p in value])}
    n_texts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y in by:
        for t in by[y]:
            n_texts[y].update({p for w in set(t.split()) & own.keys() for p in own[w]})
    value = {p: min(v, _surplus(n_texts[1][p], n_texts[0][p], len(by[1]), len(by[0]))) for p, v in value.items()}
    value = {p: v for p, v in value.items() if v >= LEAST_SURPLUS}
    out = []
    for w in sorted(own.keys() & words[1].keys()):
        held = [p for p in own[w] if p in value]
        if held:
            best = max(value[p] for p in held)
            out += [max((p for p in held if value[p] >= AS_GOOD * best), key=len).ljust(LEAST_SAMPLE)] * words[1][w]
    # the trainer picks its segments part by part of the samples: deal the pieces out evenly
    return [p for _, p in sorted((zlib.crc32(b"%d %s" % (i, p)), p) for i, p in enumerate(out))]


def _newton(terms: np.ndarray, y: np.ndarray, each: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    w = np.zeros(terms.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(terms @ w, -30, 30)))
        hessian = (terms * (each * p * (1 - p))[:, None]).T @ terms + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, terms.T @ (each * (y - p)) - ridge * w)
    return w


def _fit(texts: list[str], y: np.ndarray, prior: float, rounds: int, ridge: float) -> Model:
    """Both dictionaries and the logistic curve on window gains, its threshold not yet moved."""
    none = np.empty(0)
    samples = toxic_samples(texts, y.astype(int).tolist()) if 0 < y.sum() < len(y) else []
    if not samples:
        return Model(b"", b"", none, none, none, prior)
    ordinary_windows = [w for t, label in zip(texts, y, strict=True) if not label for w in windows(t) if len(w) >= LEAST_SAMPLE]
    step = max(1, len(ordinary_windows) // ORDINARY_WINDOWS)
    ordinary = trained_content(ORDINARY_BYTES, ordinary_windows[::step]) if ordinary_windows else b" " * LEAST_SAMPLE
    model = Model(trained_content(TOXIC_BYTES + PIECE_BYTES * len(set(samples)), samples), ordinary, none, none, none, prior)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t in texts])
    center, spread = x.mean(0), x.std(0) + 1e-6
    each = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return model._replace(center=center, spread=spread, weights=_newton(_terms(x, center, spread), y, each, rounds, ridge))


def fit(texts: list[str], labels: list[int], share: float | None = None, rounds: int = 30, ridge: float = 1.0) -> Model:
    """Train a dictionary on each class's text, then fit a logistic curve on window gains and calibrate its threshold by folds.

    share is label 1's share of all labelled rows where the sample has another; rows are weighted by it. For the threshold, each half of
    the rows is scored by a model, dictionaries included, of the other half; the curve is moved so that 0.5 has the best F1 of these scores.
    """
    y = np.array(labels, float)
    prior = float(y.mean()) if share is None and len(y) else share or 0.0
    model = _fit(texts, y, prior, rounds, ridge)
    if not len(model.weights):
        return model
    raw, known = np.zeros(len(y)), np.zeros(len(y), bool)
    half = np.zeros(len(y), bool)
    for label in (0, 1):  # every second row of each class
        half[np.nonzero(y == label)[0][::2]] = True
    for part in (half, ~half):
        other = _fit([t for t, k in zip(texts, part, strict=True) if k], y[part], prior, rounds, ridge)
        if len(other.weights):
            scorer = Scorer(other)
            raw[~part] = [scorer.raw(t) for t, k in zip(texts, part, strict=True) if not k]
            known |= ~part
    if not known.any():  # too little text in halves: the rows' own scores
        scorer = Scorer(model)
        raw, known = np.array([scorer.raw(t) for t in texts]), np.ones(len(y), bool)
    raw, y = raw[known], y[known]
    each = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    order = np.argsort(-raw, kind="stable")
    caught, wrong = np.cumsum((each * y)[order]), np.cumsum((each * (1 - y))[order])
    at = int(np.argmax(2 * caught / (caught + wrong + (each * y).sum())))
    cut = (raw[order][at] + raw[order][min(at + 1, len(raw) - 1)]) / 2
    model.weights[0] -= cut
    return model


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """Fit on whole labelled texts outside the held-out fold: at most MOST_ROWS distinct ones and MOST_BYTES of each class, in hash order of their ids."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label")).withColumn("_h", hash60(F.col("_id")))
    sizes = dict(map(tuple, known.groupBy("_label").count().collect()))
    # a bound on the hash leaves little more than the rows that are taken, so the sorts are small
    near = {y: int(2**60 * min(1.0, (1.5 * n + 200) / max(1, sizes.get(y, 0)))) for y, n in MOST_ROWS.items()}
    own = [known.where((F.col("_label") == y) & (F.col("_h") <= near[y])).orderBy("_h", "_id").limit(2 * n) for y, n in MOST_ROWS.items()]
    ids = F.broadcast(own[0].unionByName(own[1]))  # at most 15,000 rows
    body = text_or_empty(text)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_x"), F.octet_length(body).cast("long").alias("_bytes"), body.alias("_text")).join(ids, "_id")
    # narrow rows first: of texts that equal each other, and of rows that repeat an id with its text, one
    narrow = rows.groupBy("_label", "_x").agg(F.min("_h").alias("_h"), F.min("_id").alias("_id"), F.max("_bytes").alias("_bytes"))
    taken = []
    for y, n in MOST_ROWS.items():
        room, found = MOST_BYTES[y], 0
        for r in narrow.where(F.col("_label") == y).orderBy("_h", "_x").limit(2 * n).collect():
            if found < n and r["_bytes"] <= room:
                taken.append((r["_x"], y))
                room, found = room - r["_bytes"], found + 1
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(taken, "_x long, _label int"))  # at most 7,500 rows
    found = rows.join(picked, ["_x", "_label"]).groupBy("_x", "_label").agg(F.first("_text").alias("_text")).toPandas().sort_values(["_x", "_label"])
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return fit(found["_text"].tolist(), found["_label"].tolist(), share)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row's whole text.

    A null text counts as empty and gets the score of a text without windows that gain. A null
    id hashes as the empty string. Without labelled rows of both classes every score is the
    share of label 1 (0 without labels). Equal texts have equal scores; an empty table gives an
    empty result; other columns are left out.
    """
    plain = tuple(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*plain)) if len(plain[4]) else None
        for batch in batches:
            s = np.array([scorer.score(t) if scorer else plain[5] for t in batch["text"]], float)
            yield pd.DataFrame({"_id": batch["_id"], "held_out": batch["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    narrow = docs.select(id_as_text(id_col), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text).alias("text"))
    return id_back(narrow.mapInPandas(run, "_id string, held_out boolean, score double, predicted int"), docs, id_col)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns unchanged."""
    plain = tuple(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*plain)) if len(plain[4]) else None
        for batch in batches:
            yield pd.Series([scorer.score(t) if scorer else plain[5] for t in batch], dtype=float)

    return docs.where(score(text_or_empty(text)) < 0.5)
