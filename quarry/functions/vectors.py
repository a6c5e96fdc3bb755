"""Vector metrics and transforms as column expressions over array<float|double> columns, computed in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics of plain search: a higher score is better for each.
SEARCH_METRICS = ("cosine", "dot_product", "euclidean")
METRICS = (*SEARCH_METRICS, "angular", "geodesic", "jaccard", "overlap", "weighted_jaccard", "manhattan", "composite")


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)))


def angular_distance(a: Column, b: Column) -> Column:
    return F.acos(cosine(a, b))


def positions(a: Column) -> Column:
    """0-based positions of the values that aren't 0."""
    return F.filter(F.transform(_d(a), lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def jaccard(a: Column, b: Column) -> Column:
    """Of the positions; two empty vectors are alike (1)."""
    pa, pb = positions(a), positions(b)
    union = F.size(F.array_union(pa, pb))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(pa, pb)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Common positions over the smaller set; 0 when either is empty."""
    pa, pb = positions(a), positions(b)
    least = F.least(F.size(pa), F.size(pb))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(pa, pb)) / least)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller magnitudes over sum of larger ones; two zero vectors are alike (1)."""
    low = total(F.zip_with(_d(a), _d(b), lambda x, y: F.least(F.abs(x), F.abs(y))))
    high = total(F.zip_with(_d(a), _d(b), lambda x, y: F.greatest(F.abs(x), F.abs(y))))
    return F.when(high == 0, 1.0).otherwise(low / high)


def composite(a: Column, b: Column, w_cosine: float = 0.5, w_structure: float = 0.3, w_magnitude: float = 0.2) -> Column:
    parts = w_cosine * (cosine(a, b) + 1) / 2 + w_structure * jaccard(a, b) + w_magnitude / (1 + euclidean_distance(a, b))
    return parts / (w_cosine + w_structure + w_magnitude)


def score(metric: str, a: Column, b: Column) -> Column:
    """Similarity, higher is better. Distances d become 1 / (1 + d), angles 1 - angle / pi."""
    return {
        "cosine": lambda: cosine(a, b), "dot_product": lambda: dot(a, b), "euclidean": lambda: 1 / (1 + euclidean_distance(a, b)),
        "angular": lambda: 1 - angular_distance(a, b) / F.pi(), "geodesic": lambda: 1 - angular_distance(a, b) / F.pi(),
        "manhattan": lambda: 1 / (1 + manhattan_distance(a, b)), "jaccard": lambda: jaccard(a, b), "overlap": lambda: overlap(a, b),
        "weighted_jaccard": lambda: weighted_jaccard(a, b), "composite": lambda: composite(a, b),
    }[metric]()


def unit_interval(metric: str, raw: Column) -> Column:
    """Cosine mapped to [0, 1]; the other scores are there already."""
    return (raw + 1) / 2 if metric == "cosine" else raw


# Sparse vectors are struct<dim int, pos array<int>, val array<double>>; two of them are merged in Arrow batches.


def to_sparse(a: Column, threshold: float = 0.0) -> Column:
    kept = F.filter(F.transform(_d(a), lambda x, i: F.struct(i.alias("pos"), x.alias("val"))), lambda e: F.abs(e["val"]) > threshold)
    return F.struct(F.size(a).alias("dim"), F.transform(kept, lambda e: e["pos"]).alias("pos"), F.transform(kept, lambda e: e["val"]).alias("val"))


def _entries(s: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    """(pos, val) with f of the values."""
    return F.zip_with(s["pos"], s["val"], lambda p, v: F.struct(p.alias("pos"), f(v).alias("val")))


def _of_entries(kept: Column, dim: Column) -> Column:
    """Positions ascending, zeros dropped."""
    ordered = F.array_sort(F.filter(kept, lambda e: e["val"] != 0))
    return F.struct(dim.alias("dim"), F.transform(ordered, lambda e: e["pos"]).alias("pos"), F.transform(ordered, lambda e: e["val"]).alias("val"))


def _flat(s: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dim, -1 for null; rows without values; and of each value its row, position and value, null as 0) of a batch of sparse vectors."""
    pos, val = s.field("pos"), s.field("val")
    absent = np.asarray(pc.or_(pc.or_(pos.is_null(), val.is_null()), s.is_null()))
    n = np.where(absent, 0, np.asarray(pc.fill_null(pc.list_value_length(pos), 0)))
    if (n != np.where(absent, 0, np.asarray(pc.fill_null(pc.list_value_length(val), 0)))).any():
        raise ValueError("a sparse vector has as many values as positions")
    nothing = pa.array(absent)
    pos, val = (pc.list_flatten(pc.if_else(nothing, pa.scalar(None, x.type), x)) for x in (pos, val))
    dim = np.where(np.asarray(s.is_null()), -1, np.asarray(pc.fill_null(s.field("dim"), -1)))
    return dim, absent, np.repeat(np.arange(len(n)), n), np.asarray(pos).astype("int64"), np.asarray(pc.fill_null(val.cast("double"), 0.0))


def _lists(rows: np.ndarray, values: np.ndarray, n: int, absent: np.ndarray, kind: str) -> pa.Array:
    """A list of each of n rows from values in order of their rows, null where absent."""
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype("int32"), mask=np.r_[absent, False])
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))


def to_dense(s: Column) -> Column:
    @F.arrow_udf("array<double>")
    def dense(s: pa.Array) -> pa.Array:
        dim, absent, rows, pos, val = _flat(s)
        absent = absent & (dim != 0) | (dim < 0)
        n = np.where(absent, 0, dim)
        keep = (pos >= 0) & (pos < n[rows])
        out = np.zeros(n.sum())
        out[(np.cumsum(n) - n)[rows[keep]] + pos[keep]] = val[keep]
        return _lists(np.repeat(np.arange(len(n)), n), out, len(n), absent, "double")

    return dense(s)


def _matched(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows without values; and of each position of either vector in order its row, position and both values, 0 where there is none)."""
    (_, gone, ra, pa_, va), (_, away, rb, pb, vb) = _flat(a), _flat(b)
    absent = gone | away
    width = 1 + max(pa_.max(initial=0), pb.max(initial=0))
    keys, at = np.unique(np.r_[ra * width + pa_, rb * width + pb], return_inverse=True)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    for of, values in ((at[: len(ra)], va), (at[len(ra) :], vb)):
        if len(of) and np.bincount(of).max() > 1:
            raise ValueError("a sparse vector has a position twice")
    x[at[: len(ra)]], y[at[len(ra) :]] = va, vb
    rows = keys // width
    kept = ~absent[rows]
    return absent, rows[kept], (keys % width)[kept], x[kept], y[kept]


def sparse_dot(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def dots(a: pa.Array, b: pa.Array) -> pa.Array:
        absent, rows, _, x, y = _matched(a, b)
        return pa.array(np.bincount(rows, x * y, len(absent)), mask=absent)

    return dots(a, b)


def _merged(a: Column, b: Column, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """f of the values at each position of either vector, 0 where there is none; positions ascending, zeros dropped."""

    @F.arrow_udf("struct<dim:int,pos:array<int>,val:array<double>>")
    def merge(a: pa.Array, b: pa.Array) -> pa.Array:
        absent, rows, pos, x, y = _matched(a, b)
        v = f(x, y)
        kept = v != 0
        lists = [_lists(rows[kept], part[kept], len(absent), absent, kind) for part, kind in ((pos, "int32"), (v, "double"))]
        return pa.StructArray.from_arrays([a.field("dim"), *lists], ["dim", "pos", "val"])

    return merge(a, b)


def sparse_add(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: x + y)


def sparse_subtract(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: x - y)


def sparse_scale(a: Column, k: float) -> Column:
    return _of_entries(_entries(a, lambda v: v * k), a["dim"])


def sparse_weighted(a: Column, b: Column, wa: float, wb: float) -> Column:
    """Weighted mean of two vectors; the first one when the weights add up to 0."""
    return a if wa + wb == 0 else _merged(a, b, lambda x, y: (x * wa + y * wb) / (wa + wb))


def sparse_prune(a: Column, threshold: float) -> Column:
    return _of_entries(F.filter(_entries(a), lambda e: F.abs(e["val"]) >= threshold), a["dim"])


def sparse_delta(before: Column, after: Column, threshold: float = 0.0) -> Column:
    """The changes between two dense vectors as a sparse one."""
    return to_sparse(F.zip_with(_d(after), _d(before), lambda x, y: x - y), threshold)


def sparsity(a: Column) -> Column:
    """Part of the values that are 0; 0 for an empty vector."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(_d(a), lambda x: x == 0)) / F.size(a))


def normalized(a: Column) -> Column:
    """Unit length; NULL for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n))


def project_out(a: Column, direction: Column) -> Column:
    """a without its component along direction; a itself for a zero direction."""
    n2 = dot(direction, direction)
    k = dot(a, direction) / F.nullif(n2, F.lit(0.0))
    return F.when(n2 == 0, _d(a)).otherwise(F.zip_with(_d(a), _d(direction), lambda x, y: x - k * y))


def quantize_u8(a: Column) -> Column:
    """struct<min, scale, codes>: codes 0 to 255 with scale (max - min) / 255."""
    low, high = F.array_min(_d(a)), F.array_max(_d(a))
    scale = (high - low) / 255
    codes = F.transform(_d(a), lambda x: F.when(scale == 0, 0).otherwise(F.round((x - low) / scale)).cast("int"))
    return F.struct(low.alias("min"), scale.alias("scale"), codes.alias("codes"))


def dequantize_u8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["min"] + c * q["scale"])


def binary_code(a: Column) -> Column:
    """Signs of up to 64 values as the bits of a long."""
    return F.aggregate(F.transform(_d(a), lambda x, i: F.when((x > 0) & (i < 64), F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def hamming_similarity(a: Column, b: Column, bits: int) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / bits


def parse(text: Column) -> Column:
    """'[1, 2.5]' or '1,2.5' as array<double>; NULL where it can't be read."""
    t = F.trim(text)
    return F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), "array<double>")
