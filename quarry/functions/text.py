"""Full-text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words that an index may leave out.
STOP_WORDS = "a an the and or but in on at to for of is it".split()


def tokens(text: Column, least_bytes: int = 1, stop_words: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits of at least least_bytes UTF-8 bytes, without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.octet_length(w) >= least_bytes))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words])) if stop_words else words


def has_all(words: Column, wanted: list[str]) -> Column:
    return F.forall(F.array(*[F.lit(w.lower()) for w in wanted]), lambda w: F.array_contains(words, w)) if wanted else F.lit(False)


def has_prefix(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: w.startswith(prefix.lower()))


def has_near(words: Column, query: str, distance: int = 1) -> Column:
    """Any token within the edit distance of the whole query."""
    return F.exists(words, lambda w: F.levenshtein(w, F.lit(query.lower())) <= distance)


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: UTF-8 bytes / 4, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def cost(input_tokens: Column, output_tokens: Column, input_per_1k: float, output_per_1k: float) -> Column:
    return input_tokens / 1000 * input_per_1k + output_tokens / 1000 * output_per_1k


def token_count(c: Column, tokenizer: str) -> Column:
    """Tokens of a text by a tokenizers file; NULL counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer)
        made.no_padding()
        made.no_truncation()
        for batch in batches:
            yield pd.Series([len(made.encode(t, add_special_tokens=False).ids) for t in batch], dtype="int64")

    return count(F.coalesce(c, F.lit("")))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def display(c: Column, kind: str) -> Column:
    """A value as text: 'null' for NULL, '<n bytes>' for binary."""
    if kind == "binary":
        return F.coalesce(F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>")), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def token_index(df: DataFrame, id_col: str, column: str, least_bytes: int = 1, stop_words: list[str] | None = None) -> DataFrame:
    """(token, id): an inverted index of a text property; write it bucketed by token where it is used often."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(column), least_bytes, stop_words))).alias("token"), id_col)
