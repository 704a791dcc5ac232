import math

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.llm import quality

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def both(spark, docs, labels):
    own = sorted(map(tuple, quality.judge(docs, labels).select(*COLUMNS).collect()), key=str)
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    db.register("labels", labels.toPandas())
    return own, sorted(db.execute(quality.oracle_sql()).fetchall(), key=str)


def test_against_sql_at_a_size_that_selects_cutoffs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    own, sql = both(spark, docs, labels)
    assert own == sql and sum(not r[6] and not r[7] for r in own) > 50
    bad = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in own if bad.get(r[0]) == 1 and not r[6]]
    assert sum(not r[7] for r in good) <= 0.03 * len(good)


def test_the_registered_query_rejects_by_certified_rules(spark):
    """At the size of the correctness run, English has cutoffs."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    own, sql = both(spark, docs, labels)
    assert own == sql and sum(not r[6] and not r[7] for r in own) > 5


def allowed(points, n, alpha, level):
    """The strictest point, one after the other, for counts of first rejections."""
    tail = lambda k: sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
    k, at = 0, -1
    for point in range(quality.POINTS):
        k += points.get(point, 0)
        if k > n * alpha or tail(k) > level:
            break
        at = point
    return at


def test_guarantee_by_simulation(spark):
    """Of many holdouts, at most ``delta`` lead to more false rejections than ``alpha``."""
    alpha, delta, n, tries = 0.05, 0.1, 200, 400
    rng = np.random.default_rng(5)
    chance = np.full(quality.POINTS + 1, 0.0)  # of a good document, to be first rejected at a point
    chance[10:60] = 0.004
    chance[-1] = 1 - chance.sum()
    draws = rng.choice(quality.POINTS + 1, (tries, n), p=chance)
    rows = [(t, int(p), int(c)) for t in range(tries) for p, c in zip(*np.unique(draws[t], return_counts=True))]
    frame = spark.createDataFrame(rows, "_stratum int, point int, n long")
    # each holdout is a run of its own here, so the level is that of one stratum
    got = {r["_stratum"]: r["at"] for r in quality.reached(frame, alpha, delta * tries).collect()}
    want = {t: at for t in range(tries) if (at := allowed({p: c for s, p, c in rows if s == t}, n, alpha, delta)) >= 0}
    assert got == want
    broken = sum(chance[: at + 1].sum() > alpha for at in got.values())
    assert broken <= delta * tries and len(got) == tries and np.median(list(got.values())) > 12


def test_odd_rows_against_sql(spark, docs, rows):
    one_each = docs.where("doc_id is not null and doc_id not in (5, 1001, 2004)")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:50]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    own, sql = both(spark, one_each, labels)
    assert own == sql
    assert quality.judge(docs, labels).count() == len(rows)


def test_no_labels_and_no_rows(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).where("kept = base_failed").count() == 0
    assert quality.judge(none, labels).count() == 0


def test_repeat_words_with_shared_bits(spark):
    """Hashes that agree in all bits but those of the position."""
    frame = spark.createDataFrame([([5 << 20, (5 << 20) + 1, 5 << 20, 9 << 20],), ([1, 2, 3],), ([],), ([7] * 10,)], "h array<long>")
    assert [r.n for r in frame.select(quality.repeat_words(F.col("h")).alias("n")).collect()] == [5, 0, 0, 12]


def test_binomial_tail(spark):
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (2000, 7, 0.004)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-9)


def test_columns_come_along(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert set(docs.columns) <= set(quality.judge(docs, labels, keep_columns=True).columns)
    assert pd.Series(quality.judge(docs, labels).columns).is_unique
