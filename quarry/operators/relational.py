"""Relational operators over DataFrames: filter, project, six joins, grouping, distinct, paging, copy-on-write changes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.operators.conditions import TRUE, Condition, compile_condition

MOST_CROSS_ROWS = 1_000_000
#: Aggregate call -> output name pattern.
NAMES = {"count_all": "count_all", "count": "count_{}", "sum": "sum_{}", "avg": "avg_{}", "min": "min_{}", "max": "max_{}"}


class ResultTooLargeError(ValueError):
    pass


def select(df: DataFrame, where: Condition | Column = TRUE, columns: list[str] | None = None, order_by_id: str | None = None, limit: int | None = None, mode: str = "engine") -> DataFrame:
    """Filter and project; columns that df lacks are left out. limit is a cap: more rows raise ResultTooLargeError."""
    out = df.where(where if isinstance(where, Column) else compile_condition(where, mode))
    if columns is not None:
        out = out.select(*[c for c in columns if c in df.columns])
    if order_by_id:
        out = out.orderBy(order_by_id)
    if limit is not None and out.limit(limit + 1).count() > limit:
        raise ResultTooLargeError(f"more than {limit} rows")
    return out


def rows_by_id(df: DataFrame, ids: list, id_col: str) -> DataFrame:
    """Rows with the given ids, a list from the caller."""
    return df.where(F.col(id_col).isin(*ids)) if ids else df.limit(0)


def cursor(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> Iterator[Row]:
    """Rows one at a time; a partition at a time is fetched."""
    df = df.orderBy(*order).offset(offset)
    return (df if limit is None else df.limit(limit)).toLocalIterator(prefetchPartitions=True)


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 100) -> tuple[DataFrame, bool]:
    """(rows of the page, whether there are more) in a total order; limit 0 gives an empty page."""
    found = df.orderBy(*order).offset(offset).limit(limit + 1)
    more = found.count() > limit
    return found.orderBy(*order).limit(limit), more


def after_key(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """Keyset page: the rows behind last; cheaper than an offset at any depth."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(limit)


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k rows with the highest score; ties by tie ascending."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).limit(k)


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]] | None = None, how: str = "inner", most_cross_rows: int = MOST_CROSS_ROWS) -> DataFrame:
    """inner left right full cross natural. Equality treats NULL as a value; both sides keep their columns.

    natural joins on all common names and is cross without any. Cross products beyond most_cross_rows are refused.
    """
    if how == "natural":
        common = [c for c in left.columns if c in right.columns]
        if common:
            pairs = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in common])
            return left.join(right, pairs, "inner").drop(*[right[c] for c in common])
        how = "cross"
    if how == "cross":
        n = left.count() * right.count()
        if n > most_cross_rows:
            raise ResultTooLargeError(f"the cross product has {n} rows; the limit is {most_cross_rows}")
        return left.crossJoin(right)
    if not on:
        raise ValueError("an equi-join needs column pairs")
    return left.join(right, reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in on]), how)


def aggregate_column(call: str, column: str | None = None, empty_sum: float | None = 0.0) -> Column:
    """count_all, count, sum, avg, min or max. Sums are doubles; the relational SUM of nothing is 0.0, the graph one NULL."""
    if call == "count_all":
        return F.count(F.lit(1)).alias("count_all")
    c = F.col(column)
    made = {
        "count": lambda: F.count(c), "avg": lambda: F.avg(c.cast("double")), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "sum": lambda: F.sum(c.cast("double")) if empty_sum is None else F.coalesce(F.sum(c.cast("double")), F.lit(empty_sum)),
    }[call]()
    return made.alias(NAMES[call].format(column))


def group_by(df: DataFrame, keys: list[str], calls: list[tuple[str, str | None]], where: Condition | Column = TRUE, having: Condition | Column | None = None, ordered: bool = True) -> DataFrame:
    """WHERE, GROUP BY, aggregates, HAVING, sorted by the keys. Without keys and rows there is no group."""
    rows = select(df, where)
    columns = [aggregate_column(*c) for c in calls]
    if keys:
        out = rows.groupBy(*keys).agg(*columns)
    else:
        out = rows.agg(F.count(F.lit(1)).alias("_n"), *columns).where("_n > 0").drop("_n")
    if having is not None:
        out = out.where(having if isinstance(having, Column) else compile_condition(having, "engine"))
    return out.orderBy(*keys) if keys and ordered else out


def aggregate(df: DataFrame, calls: list[tuple[str, str | None]], where: Condition | Column = TRUE, empty_sum: float | None = 0.0) -> DataFrame:
    """One row of aggregates, also over no rows."""
    return select(df, where).agg(*[aggregate_column(c, x, empty_sum) for c, x in calls])


def distinct_first(df: DataFrame, columns: list[str] | None, order: list[str]) -> DataFrame:
    """Distinct on columns keeps the whole first row in order; without columns, whole rows."""
    if not columns:
        return df.dropDuplicates()
    kept = df.groupBy(*columns).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def update(df: DataFrame, where: Condition | Column, changes: dict[str, Column]) -> DataFrame:
    """Copy on write: changed columns where the condition holds."""
    hit = F.coalesce(where if isinstance(where, Column) else compile_condition(where), F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete(df: DataFrame, where: Condition | Column) -> DataFrame:
    hit = F.coalesce(where if isinstance(where, Column) else compile_condition(where), F.lit(False))
    return df.where(~hit)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def first_result(*parts: DataFrame) -> DataFrame:
    """The first part that has rows, else the last."""
    return next((p for p in parts if not p.isEmpty()), parts[-1])


# Constraints as queries: each returns the rows that violate it.


def violates_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def violates_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; keys with a NULL part pass."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(whole).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violates_primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    nulls = violates_not_null(df, columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return violates_unique(df, columns).unionByName(nulls)


def violates_foreign_key(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Child rows without a parent; rows with a NULL part pass."""
    whole = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a, _ in on])
    return child.where(whole).join(parent, reduce(lambda a, b: a & b, [child[a] == parent[b] for a, b in on]), "left_anti")


def delete_referenced(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]], where: Condition | Column, action: str = "restrict") -> tuple[DataFrame, DataFrame]:
    """(parent, child) after deleting from parent under restrict, no_action, cascade, set_null or set_default (NULL)."""
    gone = select(parent, where).select(*[F.col(b).alias(f"_{b}") for _, b in on])
    hit = reduce(lambda a, b: a & b, [child[a] == gone[f"_{b}"] for a, b in on])
    if action in ("restrict", "no_action"):
        if not child.join(gone, hit, "left_semi").isEmpty():
            raise ValueError("rows are still referenced")
        return delete(parent, where), child
    if action == "cascade":
        return delete(parent, where), child.join(gone, hit, "left_anti")
    marked = child.join(gone.withColumn("_gone", F.lit(True)).dropDuplicates(), hit, "left")
    kept = [F.when(F.col("_gone"), None).otherwise(child[c]).alias(c) if c in [a for a, _ in on] else child[c] for c in child.columns]
    return delete(parent, where), marked.select(*kept)
