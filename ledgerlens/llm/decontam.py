"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: each segment holds a bounded number of
training words and, for every term, the ascending list of the positions where
it stands.  A segment is one row of the stored table, so that building and
searching need no shuffle and a lost executor costs only its own segments.

The test phrases are a stated query set.  They go to all segments in blocks of
bounded size.  In a segment a phrase starts from its rarest term: that list,
shifted by the term's offset in the phrase, gives the candidate starts, and the
shifted lists of the other terms, rarest first, are intersected with it.  With
``slop`` over 0 each term may stand that many words from its place, which gives
the proximity matches; exact ones are among them.

Defined results: a null or empty text has no words, is in the index with
``n_words`` 0 and matches nothing; a test item without words has no phrase; an
item of fewer words than a phrase is one phrase; words in the phrases of an item
without id are hit, but that item can't be listed or counted; repeated rows are
kept and matched each; empty tables give empty results.  Other columns are left out, so
their names can't clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_scratch, text_bytes, written

#: A segment is closed at this many words; one longer text is a segment alone.
SEGMENT_WORDS = 1 << 18
#: Most UTF-8 bytes of test texts that go to the workers at once; a worker
#: holds some 50 times that as arrays of phrases.
BLOCK_BYTES = 4 << 20
#: Free places between documents, over any phrase length plus slop.
GAP = 64

#: Letters, digits and whatever isn't ASCII, on UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text after A-Z are lower-cased, and no other letters."""
    return WORD.findall(text.encode().lower()) if text else []


INDEX_SCHEMA = "segment string, doc_ids array<bigint>, starts array<int>, n_words array<int>, terms array<string>, ends array<int>, positions binary"


def _segment(name: str, ids: list, texts: list[list[bytes]]) -> dict:
    """One segment's row: documents, terms and their concatenated postings."""
    terms: dict[bytes, int] = {}
    new, local, starts, place = terms.setdefault, [], [], 0
    places = []
    for words in texts:
        local += [new(w, len(terms)) for w in words]
        starts.append(place)
        places.append(np.arange(place, place + len(words), dtype=np.int32))
        place += len(words) + GAP
    codes = np.array(local, dtype=np.int32)
    order = np.argsort(codes, kind="stable")
    positions = (np.concatenate(places) if places else np.zeros(0, np.int32))[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(terms))) if len(codes) else np.zeros(0, int)
    return {"segment": name, "doc_ids": ids, "starts": starts, "n_words": [len(w) for w in texts], "terms": [t.decode() for t in terms], "ends": ends.tolist(), "positions": positions.astype("<i4").tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of all texts, a row for each segment."""
    bounded_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("positions", pa.binary())])
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text, name in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()):
                words = words_of(text)
                if ids and size + len(words) > SEGMENT_WORDS:
                    yield pa.RecordBatch.from_pylist([_segment(first, ids, texts)], schema)
                    ids, texts, size = [], [], 0
                if not ids:
                    first = str(name)
                ids.append(i)
                texts.append(words)
                size += len(words)
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(first, ids, texts)], schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("name"))
    return rows.mapInArrow(build, INDEX_SCHEMA)


def blocks_of_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The test items as a written table of blocks (``block``, ``ids``, ``texts``)
    of at most ``BLOCK_BYTES`` (one longer item: a block), packed by tasks."""
    bounded_batches(items.sparkSession)
    rows = items.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])
        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                n = len(text.encode())
                if ids and size + n > BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([{"block": f"{part}-{k}", "ids": ids, "texts": texts}], schema)
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += n
        if ids:
            yield pa.RecordBatch.from_pylist([{"block": f"{part}-{k}", "ids": ids, "texts": texts}], schema)

    parts = -(-text_bytes(rows, "t") // BLOCK_BYTES)
    dealt = rows.repartition(parts) if parts > 1 else rows.coalesce(1)
    return written(dealt.mapInArrow(pack, "block string, ids array<bigint>, texts array<string>"), "item_blocks")


class Phrases:
    """A block's distinct phrases as arrays of term numbers, and their items.

    ``groups``: for each size the phrases (one a row) and their items, as
    ``owners`` from ``ends[k - 1]`` to ``ends[k]``; an item is its place in
    ``ids``.
    """

    def __init__(self, block: list[tuple[int | None, str]], length: int):
        terms: dict[bytes, int] = {}
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.ids = [i for i, _ in block]
        for item, (_, text) in enumerate(block):
            codes = np.array([terms.setdefault(w, len(terms)) for w in words_of(text)], dtype=np.int32)
            if len(codes):
                size = min(length, len(codes))
                by_size.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(codes, size), item))
        self.terms = [t.decode() for t in terms]
        self.groups = []
        for _, windows in sorted(by_size.items()):
            every = np.concatenate([w for w, _ in windows])
            distinct, which = np.unique(every, axis=0, return_inverse=True)
            owner = np.repeat([item for _, item in windows], [len(w) for w, _ in windows])
            pairs = np.unique(np.stack([which.reshape(-1), owner]), axis=1)
            self.groups.append((distinct, np.cumsum(np.bincount(pairs[0], minlength=len(distinct))), pairs[1]))


#: The phrases that this process built last, and of which block.
_built: dict[str, Phrases] = {}


def phrases_of(name: str, block: list[tuple[int | None, str]], length: int) -> Phrases:
    """Built once for each process; of one block at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Phrases(block, length)
    return _built[name]


class Postings:
    """A segment's row as arrays; keys of (term, position) ascend."""

    def __init__(self, row: dict):
        self.terms = {t: k for k, t in enumerate(row["terms"])}
        self.ends = np.array(row["ends"], dtype=np.int64)
        self.begins = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        self.positions = np.frombuffer(row["positions"], dtype="<i4").astype(np.int64)
        self.shift = (int(self.positions.max()) if len(self.positions) else 0) + 4 * GAP
        # the lists follow each other by term and ascend inside
        self.keys = np.repeat(np.arange(len(self.ends)), self.ends - self.begins) * self.shift + self.positions + GAP
        self.starts = np.array(row["starts"], dtype=np.int64)

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Which terms stand within ``slop`` words of their places."""
        key = term * self.shift + place + GAP
        j = np.minimum(np.searchsorted(self.keys, key - slop), len(self.keys) - 1)
        return (self.keys[j] >= key - slop) & (self.keys[j] <= key + slop)

    def all_near(self, local: np.ndarray, which: np.ndarray, start: np.ndarray, slop: int) -> np.ndarray:
        """Of candidates, those with every term within ``slop`` of its place."""
        ok = np.arange(len(which))
        for k in range(local.shape[1]):
            ok = ok[self.near(local[which[ok], k], start[ok] + k, slop)]
        return ok


def _search(post: Postings, group: np.ndarray, code: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """(exact, near): phrases and places of matches of one group of phrases.

    Each is (phrase, document's place, first word).  Candidates come from the
    rarest term, and the other lists are asked from the rarest on.  With
    ``slop`` a phrase's own place may lie that far from where its rarest term
    puts it, so lists are first asked twice as far.
    """
    none = np.zeros(0, dtype=np.int64)
    local = code[group]
    alive = np.flatnonzero((local >= 0).all(axis=1))
    if not len(alive):
        return none, none, none, none, none
    local = local[alive]
    order = np.argsort((post.ends - post.begins)[local], axis=1, kind="stable")
    rarest = local[np.arange(len(local)), order[:, 0]]
    n = post.ends[rarest] - post.begins[rarest]
    which = np.repeat(np.arange(len(alive)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(post.begins[rarest], n)
    anchor = post.positions[at]
    start = anchor - order[which, 0]
    for k in range(1, group.shape[1]):
        offset = order[which, k]
        ok = post.near(local[which, offset], start + offset, 2 * slop)
        which, start, anchor = which[ok], start[ok], anchor[ok]
    exact = post.all_near(local, which, start, 0) if slop else np.arange(len(which))
    doc = np.searchsorted(post.starts, anchor, side="right") - 1
    first = (alive[which[exact]], doc[exact], start[exact] - post.starts[doc[exact]])
    if not slop:
        return *first, first[0], first[1]
    moved = np.arange(len(which) * (2 * slop + 1)) // (2 * slop + 1)
    shifted = start[moved] + np.arange(len(moved)) % (2 * slop + 1) - slop
    moved = np.unique(moved[post.all_near(local, which[moved], shifted, slop)])
    return *first, alive[which[moved]], doc[moved]


def _items(phrase: np.ndarray, doc: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Distinct (document, item), two rows, of phrases found in documents."""
    n = ends[phrase] - np.r_[0, ends][phrase]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[phrase] - n, n)
    return np.unique(np.stack([np.repeat(doc, n), owners[at]]), axis=1)


def _matches(row: dict, phrases: Phrases, slop: int) -> list[dict]:
    """Matches of a block in one segment, a row for each of its documents."""
    post = Postings(row)
    code = np.array([post.terms.get(t, -1) for t in phrases.terms], dtype=np.int64)
    exact, near, runs = set(), set(), {}
    for group, ends, owners in phrases.groups if len(post.keys) else ():
        phrase, doc, start, near_phrase, near_doc = _search(post, group, code, slop)
        exact |= set(map(tuple, _items(phrase, doc, ends, owners).T.tolist()))
        near |= set(map(tuple, _items(near_phrase, near_doc, ends, owners).T.tolist()))
        for d, s in set(zip(doc.tolist(), start.tolist())):
            runs.setdefault(d, []).append((s, s + group.shape[1]))
    of_doc: dict[int, tuple[set, set]] = {}
    for side, found in enumerate((exact, near)):
        for d, k in found:
            of_doc.setdefault(d, (set(), set()))[side].add(phrases.ids[k])
    out = []
    for d, (doc, n) in enumerate(zip(row["doc_ids"], row["n_words"])):
        spans: list[list[int]] = []
        for a, b in sorted(runs.get(d, ())):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        items, near_items = (sorted(found - {None}) for found in of_doc.get(d, (set(), set())))
        out.append({"segment": row["segment"], "place": d, "doc_id": doc, "n_words": n, "n_hit": sum(b - a for a, b in spans), "items": items, "near_items": near_items, "spans": [{"start": a, "length": b - a} for a, b in spans]})
    return out


MATCH_SCHEMA = "segment string, place int, doc_id bigint, n_words int, n_hit int, items array<bigint>, near_items array<bigint>, spans array<struct<start:int,length:int>>"


def search(index: DataFrame, block: list[tuple[int | None, str]], length: int = 10, slop: int = 0) -> DataFrame:
    """Matches of one block of items in all segments: a row for each document,
    named by its segment and its place there.

    ``items`` have an exact phrase there, ``n_hit`` words lie in one and
    ``spans`` are the maximal runs of such words.  ``near_items`` have a
    proximity match there: some place from which every word of a phrase stands
    at most ``slop`` words from where it would be in an exact one.
    """
    if length + 2 * slop > GAP:
        raise ValueError(f"length + 2 * slop is over {GAP}")
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int32()), ("n_hit", pa.int32()), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])
        phrases = phrases_of(name, block, length)
        for batch in batches:
            for k in range(batch.num_rows):  # one segment at a time
                yield pa.RecordBatch.from_pylist(_matches(batch.slice(k, 1).to_pylist()[0], phrases, slop), schema)

    return index.mapInArrow(run, MATCH_SCHEMA)


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 0, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Exact phrase and proximity matches of all items: a row for each document.

    Blocks of items are sought one after the other.  The driver holds the block
    that is sought, as it goes with the task, and no other; what a block finds is
    written before the next begins, of later blocks only documents with matches.
    The matches of several blocks meet by segment and place in it, so repeated
    and null ids stay apart.
    """
    spark = docs.sparkSession
    index = written(build_index(docs, doc_id, text_col), "postings")
    blocks = blocks_of_items(items, item_id, item_text)
    names = [r.block for r in blocks.select("block").orderBy("block").collect()]
    held = lambda name: list(zip(*blocks.where(F.col("block") == name).select("ids", "texts").first()))
    if len(names) <= 1:
        return search(index, held(names[0]) if names else [], length, slop).drop("segment", "place")
    folder = new_scratch(spark, "matches")
    for k, name in enumerate(names):
        found = search(index, held(name), length, slop)
        found = found if k == 0 else found.where("n_hit > 0 or size(items) > 0 or size(near_items) > 0")
        found.write.option("compression", "zstd").parquet(f"{folder}/{k:06}")
    whole = spark.read.schema(MATCH_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    word_numbers = F.flatten(F.collect_list(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    hit = F.array_sort(F.array_distinct(word_numbers))
    first = F.filter(hit, lambda w, k: (k == 0) | (F.get(hit, k - 1) != w - 1))
    last = F.filter(hit, lambda w, k: (k == F.size(hit) - 1) | (F.get(hit, k + 1) != w + 1))
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return whole.groupBy("segment", "place", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.size(hit).cast("int").alias("n_hit"),
        joined("items").alias("items"),
        joined("near_items").alias("near_items"),
        F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("spans"),
    ).drop("segment", "place")


def oracle_sql(length: int = 10, slop: int = 2) -> str:
    """Digest rows of the query in DuckDB SQL: a join on all windows, and for
    proximity all places around each window's rarest word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(upper, lower)
    listed = "string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {words} AS w FROM benchmark),
p AS (SELECT DISTINCT item, item_id, least(len(w), {length}) AS n, w[i:i + least(len(w), {length}) - 1] AS v
    FROM (SELECT item, item_id, w, unnest(range(1, greatest(1, len(w) - {length - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, g.n, item_id FROM g JOIN p ON array_to_string(p.v, ' ') = g.g AND p.n = g.n),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, {listed} AS items FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r),
o AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
f AS (SELECT x, count(*) AS often FROM o GROUP BY x),
v AS (SELECT row_number() OVER () AS q, n, v FROM (SELECT DISTINCT n, v FROM p)),
a AS (SELECT q, n, v, x, k, often FROM (SELECT q, n, v, unnest(v) AS x, unnest(range(1, n + 1)) AS k FROM v) JOIN f USING (x)
    QUALIFY count(*) OVER (PARTITION BY q) = n AND row_number() OVER (PARTITION BY q ORDER BY often, k) = 1),
c AS (SELECT DISTINCT r, q, n, v, pos - k + unnest(range(-{slop}, {slop + 1})) AS s FROM a JOIN o USING (x)),
e AS (SELECT DISTINCT r, n, v FROM (SELECT r, q, n, v, s, k, w[greatest(1, s + k - {slop}):greatest(0, s + k + {slop})] AS around FROM (SELECT c.*, unnest(range(1, n + 1)) AS k FROM c) JOIN d USING (r))
    GROUP BY r, q, s, n, v HAVING bool_and(list_contains(around, v[k]))),
l AS (SELECT r, count(*) AS n_near, {listed} AS near FROM (SELECT DISTINCT e.r, item_id FROM e JOIN p ON p.n = e.n AND p.v = e.v WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r LEFT JOIN l ON l.r = d.r
"""
