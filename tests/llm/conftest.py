import random

import pytest

WORDS = "the of and to in is that it for on was be with as by this er en de la und der die que le".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    r = random.Random(4)
    base = [sentence(r, r.randint(3, 80)) for _ in range(30)]
    data = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    data += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", None, 4), (None, base[3], "en", "src1", 5)]
    data += [(103, base[0] + " ", "en", "src0", 9), (104, base[0].replace(" ", "  "), "de", "src2", 9), (105, "A", "en", "src3", 1), (105, "A", "en", "src3", 1)]
    data += [(106, sentence(r, 30_000), "en", "src1", 9), (107, "naïve 漢字 😀 <|endoftext|> x", "fr", "é", 9), (108, "x" * 100_000, "en", "src1", 100_000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {"_row": "1", "_h": "2", "_id": "'z'", "_n": "3", "fp": "'f'", "kept": "true", "group_size": "0", "shard": "'s'", "score": "0.5D", "taken": "7", "host": "'h'", "ids": "9"}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.expr(v) for k, v in clash.items()}).cache()


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
