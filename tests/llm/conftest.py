import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, doc string, node int, row int, bit int, spans string, _copy int, _key int"


@pytest.fixture
def table(spark):
    """Documents with nulls and many columns whose names operators use inside."""

    def make(rows):
        full = [(d, t, None if i % 5 == 0 else "en", None, None if t is None else len(t), "k", "d", i, i, i, "s", i, i) for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, long and repeated texts, ties, and passages that texts share."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(12000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "aaaa" * 80), (6, "aaaa" * 80), (7, long), (8, passage), (9, passage), (9, passage)]
    for i in range(10, 60):
        own = " ".join(word() for _ in range(rnd.randint(0, 60)))
        rows.append((i, f"{own} {passage if i % 3 else passage[40:]} {own[::-1]}"))
    rows += [(60, "12 34 !!"), (61, long + " end"), (62, "The quick brown fox"), (63, "the QUICK brown fox"), (64, "é" * 300), (65, "ü" + "é" * 200)]
    return rows


@pytest.fixture(scope="session")
def sample_rows(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
