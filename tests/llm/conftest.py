import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(spark):
    """Texts of the smallest scale and planted cases: (doc_id, text)."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()][:120]
    rnd = random.Random(1)
    mixed = [(1000 + k, "ab" * rnd.randint(0, 200) + "x" * rnd.randint(0, 130) + docs[rnd.randrange(120)][1][rnd.randint(0, 50) : rnd.randint(60, 400)]) for k in range(30)]
    odd = [(2000, None), (2001, ""), (2002, " \t\n"), (None, docs[0][1]), (5, docs[7][1]), (1001, "é" * 300), (2003, "word " * 30000), (2004, docs[3][1]), (2004, docs[3][1])]
    return docs + mixed + odd


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    frame = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), k, "v") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row int, value string")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)
