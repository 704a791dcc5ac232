import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def lines(rows):
    rnd = random.Random(2)
    made = [(8000 + k, "\n".join(rnd.choice("abcd") * rnd.randint(1, 2) + rnd.choice(["", " ", "\t"]) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "\n", " \n\n"])) for k in range(60)]
    ids = [i for i, _ in rows]
    return [r for r in rows if ids.count(r[0]) == 1] + made


def longest(lines, k):
    """The longest match of a later run with the first place of its window."""
    runs = {i: [x.strip(SPACE) for x in (t or "").split("\n") if x.strip(SPACE)] for i, t in lines}
    first, out = {}, {}
    for i in sorted(runs, key=lambda i: (i is None, i or 0)):
        out[i] = 0
        for p in range(len(runs[i]) - k + 1):
            j, q = first.setdefault(tuple(runs[i][p : p + k]), (i, p))
            if (j, q) != (i, p):
                n = 0
                while p + n < len(runs[i]) and q + n < len(runs[j]) and runs[i][p + n] == runs[j][q + n]:
                    n += 1
                out[i] = max(out[i], n)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_against_sql_and_python(spark, lines, k):
    frame = spark.createDataFrame([(i, t, 1) for i, t in lines], "doc_id long, text string, lines int").repartition(3)
    out = linededup.deduplicate(frame, min_lines=k)
    own = out.select("doc_id", "n_lines", "n_removed_lines", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()
    db = duckdb.connect()
    db.register("documents", frame.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(map(tuple, own), key=str) == sorted(db.execute(linededup.oracle_sql(k)).fetchall(), key=str)
    assert {r.doc_id: r.longest_run for r in own} == longest(lines, k)
    assert out.columns == ["doc_id", "text", "lines", *linededup.ADDED]


def test_passages_against_sql(spark, lines):
    passage = " ".join(f"w{k}" for k in range(60))
    more = [(9001, f"a\n{passage}\nb"), (9002, f"c\n {passage}\nd"), (9003, passage), (9004, " ".join(passage.split()[:50])), (9005, " ".join(passage.split()[:50]))]
    frame = spark.createDataFrame([*lines, *more], "doc_id long, text string").repartition(3)
    out = linededup.deduplicate(frame)
    own = out.select("doc_id", "n_lines", "n_removed_lines", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()
    db = duckdb.connect()
    db.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(map(tuple, own), key=str) == sorted(db.execute(linededup.oracle_sql()).fetchall(), key=str)
    assert {r.doc_id: r.n_removed_lines for r in own if r.doc_id in range(9001, 9006)} == {9001: 0, 9002: 1, 9003: 1, 9004: 0, 9005: 0}


def test_suffixes_are_sorted(spark, lines):
    """Ranks of one depth are in the order of the lines' names, equal for equal runs."""
    frame = spark.createDataFrame(lines, "id long, text string").withColumn("row", F.monotonically_increasing_id())
    symbols = linededup.line_symbols(frame).persist()
    levels = linededup.suffix_ranks(symbols)
    names = {(r.row, r.at): (r.x, r.y) for r in symbols.collect()}
    for h, ranks in levels:
        spelt = sorted((r.rank, [names[r.row, r.at + k] for k in range(h)]) for r in ranks.collect())
        assert len(levels) > 2 and [s for _, s in spelt] == sorted(s for _, s in spelt)
        assert len({r for r, _ in spelt}) == len({str(s) for _, s in spelt})
    array = linededup.suffix_array(levels).collect()
    assert len({(r.row, r.at) for r in array}) == len(array) == levels[0][1].count()


def test_one_line_over_and_over(spark):
    frame = spark.createDataFrame([(1, "x\n" * 3000)], "doc_id long, text string")
    r = linededup.deduplicate(frame).first()
    assert (r.n_lines, r.n_removed_lines, r.n_runs, r.longest_run) == (3000, 2999, 1, 2999) and r.text == "x\n"


def test_repeated_rows_and_empty_table(docs, none, rows):
    out = linededup.deduplicate(docs)
    assert out.count() == len(rows) and out.columns == [*docs.columns, *linededup.ADDED]
    assert linededup.deduplicate(none).count() == 0
    assert out.where("text is null").count() == sum(t is None for _, t in rows)
