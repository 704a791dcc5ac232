"""Records that arrive over time: each batch screens the chains it touches.

Events lie decades back, so there is no event-time watermark: old dates are
never late.  The record table is the state.  It is laid out by buckets of
objects, and a batch reads the buckets that its objects are in and no others:

* a bucket holds some ``BUCKET_ROWS`` records; when the table has grown, buckets
  are split by four, so what a batch reads follows the objects that it touches,
  however long the table is;
* a batch adds a part to each bucket that it touches, and a bucket of more than
  ``MOST_PARTS`` parts is written again as one, so buckets stay few files;
* a small list (``state-<batch>.json``) says which parts are current.  It is
  written last, so a batch that runs again starts from the list before it, and
  what that list names is only deleted two batches later.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.parts import located, put
from ..plans.screening import screen
from ..sources.lists import Config
from ..sources.records import typed
from ..staging import delete

FIRST_BUCKETS = 16
BUCKET_ROWS = 100_000
MOST_PARTS = 8


@dataclass
class State:
    """Buckets, the rows and the parts of each, and parts that are no more."""

    buckets: int = FIRST_BUCKETS
    rows: dict[int, int] = field(default_factory=dict)
    parts: dict[int, list[str]] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)

    @classmethod
    def before(cls, table: str, batch_id: int) -> State:
        """The state that the newest batch before this one left."""
        system, root = located(table)
        try:
            names = [f.base_name for f in system.get_file_info(_selector(root)) if f.base_name.startswith("state-")]
        except FileNotFoundError:
            names = []
        older = [k for n in names if (k := int(n[6:].partition(".")[0])) < batch_id]
        if not older:
            return cls()
        with system.open_input_stream(f"{root}/state-{max(older)}.json") as f:
            found = json.loads(f.read())
        keyed = lambda d: {int(k): v for k, v in d.items()}
        return cls(found["buckets"], keyed(found["rows"]), keyed(found["parts"]), found["gone"])

    def write(self, table: str, batch_id: int) -> None:
        put(f"{table}/state-{batch_id}.json", json.dumps({"buckets": self.buckets, "rows": self.rows, "parts": self.parts, "gone": self.gone}))

    def read(self, spark: SparkSession, table: str, buckets, schema) -> DataFrame:
        """The rows of some buckets, of their files alone."""
        paths = [f"{table}/{p}" for b in sorted(buckets) for p in self.parts.get(b, ())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


def _dealt(rows: DataFrame, buckets: int, path: str) -> dict[int, int]:
    """Rows written by bucket under ``path``; how many each has."""
    bucket = F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    counted = rows.sparkSession.read.parquet(path).groupBy("bucket").count() if any_file(path) else None
    return {r.bucket: r["count"] for r in counted.collect()} if counted is not None else {}


def any_file(path: str) -> bool:
    system, root = located(path)
    return any(f.base_name.startswith("bucket=") for f in system.get_file_info(_selector(root)))


@dataclass
class Stored:
    """A batch in the table: the whole chains that it touches, and what was read."""

    chains: DataFrame
    rows_read: int
    rows_in_all: int
    buckets: int


def store(rows: DataFrame, batch_id: int, table: str, bucket_rows: int = BUCKET_ROWS, most_parts: int = MOST_PARTS) -> Stored:
    """Adds typed rows to the table; running a batch again changes nothing."""
    spark, schema = rows.sparkSession, rows.schema
    state = State.before(table, batch_id)
    for path in state.gone:
        delete(spark, f"{table}/{path}")
    gone: list[str] = []
    added = _dealt(rows, state.buckets, f"{table}/batch={batch_id}")
    for b, n in added.items():
        state.parts.setdefault(b, []).append(f"batch={batch_id}/bucket={b}")
        state.rows[b] = state.rows.get(b, 0) + n
    read, total = sum(state.rows[b] for b in added), sum(state.rows.values())
    touched = spark.read.schema(schema).parquet(f"{table}/batch={batch_id}").select("object_id").distinct() if added else rows.select("object_id").limit(0)
    chains = state.read(spark, table, added, schema).join(touched, "object_id", "left_semi")

    def again(buckets, number: int, name: str) -> None:
        """Some buckets' rows, written as one part each."""
        path = f"{name}={batch_id}"
        counts = _dealt(state.read(spark, table, buckets, schema), number, f"{table}/{path}")
        gone.extend(p for b in buckets for p in state.parts.pop(b))
        for b in list(buckets):
            state.rows.pop(b)
        state.parts |= {b: [f"{path}/bucket={b}"] for b in counts}
        state.rows |= counts

    if total > bucket_rows * state.buckets:
        while total > bucket_rows * state.buckets:
            state.buckets *= 4
        again(list(state.parts), state.buckets, "split")
    elif many := [b for b in added if len(state.parts[b]) > most_parts]:
        again(many, state.buckets, "merged")
    state.gone = gone
    state.write(table, batch_id)
    return Stored(chains, read, total, state.buckets)


def rescreen_batch(batch: DataFrame, batch_id: int, table: str, out: str, cfg: Config) -> Stored:
    """Idempotent by batch: a batch that runs again replaces its own output."""
    rows = typed(batch)
    # a bad row is set aside with its problems; it doesn't stop the stream
    rows.where("size(problems) > 0").select("source_ref", "problems").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
    stored = store(rows.where("size(problems) = 0").drop("problems"), batch_id, table)
    result = screen(stored.chains, cfg)
    result.flags.drop("chain_seq").write.mode("overwrite").parquet(f"{out}/flags/batch={batch_id}")
    result.objects.select("object_id", "screening_statement", "resolved_status", "coverage_note").write.mode("overwrite").parquet(f"{out}/objects/batch={batch_id}")
    return stored


def rescreen_stream(raw: DataFrame, table: str, out: str, checkpoint: str, cfg: Config, available_now: bool = False) -> StreamingQuery:
    """``raw``: a stream of input columns with ``source_ref`` and ``source_order``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rescreen_batch(batch, batch_id, table, out, cfg)

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
