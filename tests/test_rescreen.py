"""The record table of a stream: what a batch reads, and batches that run again."""

import shutil

from pyspark.sql import functions as F

from ledgerlens.queries.derived import records
from ledgerlens.streaming.rescreen import State, store

SF = "/root/testdata/sf0.001"


def refs(frame):
    return sorted(r.source_ref for r in frame.select("source_ref").collect())


def test_rows_read_follow_the_chains(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = records(spark, SF).withColumn("place", F.pmod(F.xxhash64("source_ref"), F.lit(10))).persist()
    every, seen = {}, []
    for r in rows.select("object_id", "source_ref").collect():
        every.setdefault(r.object_id, []).append(r.source_ref)
    objects = sorted(every)
    first = store(rows.where("place < 7").drop("place"), 0, table, bucket_rows=20)
    assert first.buckets >= 64 and first.rows_read == first.rows_in_all
    held = {r.source_ref for r in rows.where("place < 7").collect()}
    for k in range(1, 11):
        some = objects[k : k + 2]
        batch = rows.where(F.col("object_id").isin(some) & (F.col("place") == 7 + k % 3)).drop("place")
        got = store(batch, k, table, bucket_rows=20, most_parts=3)
        new = {r.source_ref for r in batch.collect()}
        touched = {r.object_id for r in batch.collect()}
        held |= new
        chains = refs(got.chains)
        assert chains == sorted(s for o in touched for s in every[o] if s in held)
        if k == 5:  # runs again from the list before it
            assert refs(store(batch, k, table, bucket_rows=20, most_parts=3).chains) == chains
        seen.append((len(touched), got.rows_read, got.rows_in_all))
    assert all(read <= 200 * max(1, n) and read < total / 4 for n, read, total in seen), seen
    state = State.before(table, 99)
    assert refs(state.read(spark, table, state.parts, rows.drop("place").schema)) == sorted(held) and sum(state.rows.values()) == len(held)
    assert max(map(len, state.parts.values())) <= 4
    shutil.rmtree(table)


def test_empty_batches(spark, tmp_path):
    rows = records(spark, SF)
    got = store(rows.limit(0), 0, str(tmp_path / "t"))
    assert got.chains.collect() == [] and got.rows_in_all == 0
    assert store(rows.limit(3), 1, str(tmp_path / "t")).chains.count() == 3
