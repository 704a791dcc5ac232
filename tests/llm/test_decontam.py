import random
import re

import duckdb
import pytest

from ledgerlens.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, items, length=10):
    phrases = {}
    for i, t in items:
        words = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(words) - length + 1) if words else 0):
            phrases.setdefault(tuple(words[k : k + length]), set()).add(i)
    out = []
    for i, t in rows:
        words, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in phrases:
                    found |= phrases[tuple(words[k : k + size])]
                    hit |= set(range(k, k + size))
        spans = [(a, next(b for b in range(a, len(words) + 1) if b not in hit) - a) for a in sorted(hit) if a - 1 not in hit]
        out.append((i, len(words), len(hit), sorted(found - {None}), spans))
    return sorted(out, key=str)


def got(frame, items, **more):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontam.decontaminate(frame, items, **more).collect()], key=str)


@pytest.fixture(scope="module")
def items(spark, rows):
    some = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    return [*some, (900, "Of THE"), (901, ""), (902, None), (None, "the of"), (903, rows[3][1][40:200]), (904, rows[3][1][40:200]), (905, "x")]


@pytest.fixture(scope="module")
def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_every_window(docs, rows, items, frame, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 3000)
    want = brute(rows, items)
    assert sum(w[2] for w in want) > 50
    assert got(docs, frame) == want


def test_blocks_of_items_give_the_same(docs, rows, items, frame, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    ids = [i for i, _ in rows]
    once = {i for i in ids if i is not None and ids.count(i) == 1}
    assert got(docs.where(docs.doc_id.isin(list(once))), frame) == brute([r for r in rows if r[0] in once], items)


def test_blocks_keep_repeated_and_null_ids(docs, rows, items, frame, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 3000)
    assert got(docs, frame) == brute(rows, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c y d"), (3, "d c b a"), (4, "a q q q q q b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    out = {r.doc_id: (r["items"], r.near_items) for r in decontam.decontaminate(docs, items, length=4, slop=2).collect()}
    assert out == {1: ([7], [7]), 2: ([], [7]), 3: ([], []), 4: ([], [])}


def test_proximity_against_every_place(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 200)
    rnd = random.Random(4)
    some = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    docs = [(k, some(rnd.randint(0, 40))) for k in range(60)] + [(None, some(30)), (3, some(30))]
    items = [(100 + k, some(rnd.choice([1, 3, 4, 5, 9]))) for k in range(25)] + [(None, some(4)), (100, some(4))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    for slop, length in ((1, 4), (2, 5)):
        want = []
        for i, text in docs:
            words, near = text.split(), set()
            for item, t in items:
                own = t.split()
                for p in range(max(1, len(own) - length + 1)):
                    phrase = own[p : p + length]
                    if any(all(w in words[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, w in enumerate(phrase)) for s in range(-slop, len(words))):
                        near.add(item)
            want.append((i, sorted(near - {None})))
        out = decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), length=length, slop=slop).collect()
        assert sorted(((r.doc_id, r.near_items) for r in out), key=str) == sorted(want, key=str)
        assert all(set(r["items"]) <= set(r.near_items) for r in out) and any(set(r["items"]) < set(r.near_items) for r in out)


def test_query_columns_against_sql(spark, docs, frame, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    frame.write.parquet(f"{tmp_path}/benchmark.parquet")
    own = queries.op6_decontaminate(spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, own.collect()), key=str) == sorted(db.execute(decontam.oracle_sql()).fetchall(), key=str)
    assert own.where("n_near > n_items").count() > 0


def test_empty_tables(docs, none, frame):
    assert got(none, frame) == []
    assert all(r[2] == 0 for r in got(docs, frame.limit(0)))
