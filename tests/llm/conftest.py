import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # Names that the operators use themselves, and a clash in another case.
                       T.StructField("quality", T.StringType()), T.StructField("_sid", T.LongType()),
                       T.StructField("Key", T.StringType()), T.StructField("held_out", T.StringType()),
                       T.StructField("size", T.LongType())])
WORDS = ("the of and to in is that was with from lantern river stone cloud paper garden mountain silver winter "
         "market harbour candle forest window bridge").split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    words = [rnd.choice(WORDS) + rnd.choice(["", "", "s", "er", "ing"]) for _ in range(n)]
    return "".join(w + (".\n" if rnd.random() < 0.05 else ". " if rnd.random() < 0.08 else " ") for w in words).strip()


def edges() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, a long text, unusual characters, an unknown key."""
    rows = [(1, None), (2, ""), (3, " \n\t \x0b"), (4, "one two three"), (5, "one two three"), (5, "one two three"),
            (None, "one two THREE"), (6, prose(6, 6000)), (7, "ÄÖ ß 日本語 😀 é́ 　x\x85y \xa0z"),
            (8, "..."), (9, "\n\n\na  b \n c\r\n'tis don't <|endoftext|>"), (10, prose(10, 60)),
            (11, prose(10, 60) + " end"), (12, prose(12, 300)), (13, "word " * 400), (14, "x" * 5000),
            (15, "same line here.\n" * 30), (None, None), (16, prose(16, 2500))]
    return [(k, t, "en" if k is None or k % 3 else None, "s", None, "q", 1, "k", "h", 2) for k, t in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edges(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def table_dir(spark, tmp_path):
    """A folder of the given tables, as a query reads them."""
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
