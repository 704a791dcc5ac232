"""Repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte is removed if a string of ``length`` bytes over it also starts in a
document with a smaller id.  Sorting every suffix of a corpus would move many
times its bytes, so suffixes are kept in their buckets and refined only where a
bucket can still decide something:

1. *Initial buckets.*  Every start of a window of ``length`` bytes goes to the
   bucket of the least (by hash) of the window's q-grams, q = length / 2.
   Equal windows have equal q-grams, so they are in one bucket.  A bucket that
   only one document reaches is dropped: its windows are new.
2. *First refinement.*  Neighbouring starts in one bucket form a block.  Blocks
   are sorted by the bucket identifiers of later offsets, the q-grams at the
   block's first start, q bytes on, and q bytes before its last window's end,
   which spell out the block.  Equal blocks beyond the smallest document are
   repeats as a whole.
3. *Recursive refinement.*  Where a bucket still holds different blocks, and
   only there, the smallest document of each block hands in its single starts,
   as the block's bytes.  Their buckets start from the first seven bytes and are
   sorted by the bucket pointers seven bytes on, the refined ones by those
   fourteen bytes on, and so on until they span the window; a start that is
   alone in its bucket drops out.  The smallest document of each window decides.

Documents are hashed into chunks.  A chunk hands in each bucket or block once,
so that a string in a third of all documents costs one entry for each chunk,
and gets its answers back; nothing is gathered by string beyond that.  Entries
travel as packed arrays by ranges of their bucket, a bounded number to a task.
Identifiers are 64-bit hashes, compared in pairs (128 bits) wherever a block
removes something; the recursive refinement compares the bytes themselves.

A bucket that very many chunks have (a phrase of q bytes in many contexts) is
taken to be mixed without asking: its blocks are dealt by bucket and block, and
its starts one by one, by a hash of their windows, so that no task gathers it.

Defined results: a null text counts as empty; texts shorter than ``length``
lose nothing; rows of one id don't count against each other; a row without id
is kept as it is and counts against none; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_shuffles, given_back, text_bytes, written

#: UTF-8 bytes of text that a chunk holds on average.
CHUNK_BYTES = 8 << 20
#: UTF-8 bytes whose windows meet in one range of buckets, on average.
RANGE_BYTES = 8 << 20
#: Bytes that are hashed at once.
STRIP_BYTES = 1 << 20
#: A bucket that more chunks have is split: its blocks meet by themselves, and
#: its single starts by their windows.
HOT_CHUNKS = 1024
#: Bytes of the initial buckets of the recursive refinement.
FIRST_BYTES = 7
#: Entries that a task gathers before it hands them on.
HELD_ENTRIES = 1 << 22

_U = np.uint64
_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    # callers let the products wrap around
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def gram_ids(data: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of all q-grams; wider hashes from the two halves."""
    with np.errstate(over="ignore"):
        power, width, part = _STEP, 1, _BYTE[data]
        out, have, out_power = None, 0, _U(1)
        n = len(data) - q + 1
        while True:
            if q & width:  # append this width to what is there
                out = part[:n].copy() if out is None else out * power + part[have : have + n]
                have += width
            if 2 * width > q:
                break
            part = part[:-width] * power + part[width:]
            power = power * power
            width *= 2
        return _mix(out)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = width - n
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def refined(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers of the strings of ``length`` bytes at all places, and
    whether a string stands at another place too.

    A pointer is the place of its bucket's first member in the order of all
    places.  The initial buckets are the first bytes themselves.  Each round
    sorts the members of a bucket by the pointers at a later offset, which the
    last round has refined; a bucket's parts get pointers of their own, and
    places that are alone in theirs drop out.  Places whose strings run over
    the end compare as if zeros followed.
    """
    n, width = len(data), min(FIRST_BYTES, length)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    gram = np.zeros(n, np.uint64)
    for k in range(width):
        gram <<= _U(8)
        gram |= padded[k : k + n]
    pointer = np.full(n + length, -1, np.int32)  # beyond the end: -1

    def settle(places: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Give places, sorted by their keys, the pointers of their parts; the ones that aren't alone."""
        index = np.arange(len(places), dtype=np.int32)
        opens = lambda *columns: np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(places) else np.zeros(0, bool)
        new = opens(*keys)
        first = np.maximum.accumulate(np.where(new, index, np.int32(0))) if len(places) else index
        if len(keys) > 1 and len(places):
            first += keys[0] - np.maximum.accumulate(np.where(opens(keys[0]), index, np.int32(0)))
        pointer[places] = first
        alone = new & np.r_[new[1:], True] if len(places) else new
        return places[~alone]

    order = np.argsort(gram).astype(np.int32)
    left = settle(order, gram[order])
    del gram, order
    while width < length and len(left):
        step = min(width, length - width)
        here, later = pointer[left], pointer[left + step]
        order = np.argsort(here.astype(np.int64) * (n + 1) + later + 1)  # both in one number
        left = settle(left[order], here[order], later[order])
        width += step
    shared = np.zeros(n, dtype=bool)
    shared[left] = True
    return pointer[:n], shared


class Strip:
    """Blocks of the windows of some whole documents.

    ``first`` and ``last``: a block's starts in the strip's bytes; ``doc``: its
    document's place; ``bucket`` and ``block``: its identifiers.
    """

    def __init__(self, texts: list[bytes], length: int):
        q = length // 2
        self.q, self.length = q, length
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.data = data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if len(data) < length:
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.bucket = self.block = self.grams = np.zeros(0, np.uint64)
            return
        self.grams = gram_ids(data, q)
        least = sliding_min(self.grams, length - q + 1)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        whole = owner[: len(least)] == owner[length - 1 :]
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])
        new[1:] |= ~whole[:-1]
        opens = np.flatnonzero(new & whole)
        # a block ends before the next one or where its document's windows end
        ends = np.minimum(np.r_[opens[1:], len(least)], (self.begin + self.sizes)[owner[opens]] - length + 1) - 1
        span = length - q + 1
        runs = (ends - opens) // span + 1  # periodic text: its long runs are cut
        at = np.repeat(opens, runs) + span * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        self.first = at
        self.last = np.minimum(at + span - 1, np.repeat(ends, runs))
        self.doc = owner[at]
        self.bucket = least[at]
        with np.errstate(over="ignore"):
            g = self.grams
            self.block = _mix(_mix(g[self.first] * _U(3) + g[self.first + q]) * _U(5) + g[self.last + length - q] + (self.last - self.first).astype(np.uint64) * _STEP)


def strips(ids: list, texts: list, length: int) -> Iterator[tuple[list, Strip]]:
    """Strips of about ``STRIP_BYTES``, with their documents' rows."""
    rows, held, size = [], [], 0
    for k, (i, t) in enumerate(zip(ids, texts)):
        if i is None or not t or len(t) < length:
            continue
        rows.append(k)
        held.append(t)
        size += len(t)
        if size >= STRIP_BYTES:
            yield rows, Strip(held, length)
            rows, held, size = [], [], 0
    if held:
        yield rows, Strip(held, length)


def _packed(ranges: np.ndarray, fields: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The structured ``fields`` by range."""
    order = np.argsort(ranges, kind="stable")
    ranges, fields = ranges[order], fields[order]
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else []
    for a, b in zip(cuts, [*cuts[1:], len(ranges)]):
        yield int(ranges[a]), fields[a:b].tobytes()


def _mix_again(bucket: np.ndarray) -> np.ndarray:
    """Least hashes crowd at the low end; this spreads them evenly."""
    with np.errstate(over="ignore"):
        return _mix(bucket * _STEP)


def _share(spread: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges."""
    with np.errstate(over="ignore"):
        return ((spread >> _U(40)) * _U(n)) >> _U(24)


def _range(bucket: np.ndarray, n: int) -> np.ndarray:
    return _share(_mix_again(bucket), n)


def _unpacked(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table["payload"].to_pylist()), dtype=dtype) if table.num_rows else np.zeros(0, dtype)


PACKED = "target int, payload binary"
WITH_BYTES = "target int, payload binary, body binary"


def _packed_table(pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"target": pa.array([t for t, _ in pairs], pa.int32()), "payload": pa.array([p for _, p in pairs], pa.binary())})


def _with_bytes(rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table({"target": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary()), "body": pa.array([r[2] for r in rows], pa.binary())})


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them), one run after the other."""
    n = n.astype(np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


#: Beyond its range 40 bits of a bucket, and 24 of its chunk, in one number;
#: buckets that agree by chance stay in and are told apart by the next step.
SHORT, CHUNK_BITS = _U(24), 24
#: Marks a bucket that is split, in what chunks are told.
HOT = _U(1 << 40)
BLOCK = np.dtype([("bucket", "<u8"), ("block", "<u8"), ("doc", "<i8"), ("chunk", "<u4")])
ANSWER = np.dtype([("bucket", "<u8"), ("block", "<u8"), ("doc", "<i8"), ("mixed", "u1")])
#: A block that hands in its ``n`` starts; its bytes travel beside it.
HEAD = np.dtype([("bucket", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i4"), ("n", "<i4"), ("chunk", "<u4")])
#: ``mark`` tells rows of one id and different texts apart.
COVER = np.dtype([("mark", "<i8"), ("at", "<i4"), ("size", "<i4")])


def _first_of(fields: np.ndarray, *names: str) -> np.ndarray:
    """Marks the first of each run of equal values."""
    new = np.ones(len(fields), dtype=bool)
    if len(fields):
        new[1:] = False
        for name in names:
            new[1:] |= fields[name][1:] != fields[name][:-1]
    return new


def _joined(c: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covers that follow each other in one text as one; and their chunks."""
    joins = np.zeros(len(c), dtype=bool)
    joins[1:] = (c["mark"][1:] == c["mark"][:-1]) & (chunk[1:] == chunk[:-1]) & (c["at"][1:] <= c["at"][:-1] + c["size"][:-1]) & (c["at"][1:] > c["at"][:-1])
    head = np.flatnonzero(~joins)
    if not len(head):
        return c, chunk
    out = c[head]
    out["size"] = np.maximum.reduceat(c["at"] + c["size"], head) - c["at"][head]
    return out, chunk[head]


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(documents with their chunk, covered bytes packed by chunk, chunks)."""
    if length < 4 or length % 2:
        raise ValueError("length has to be even, 4 at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    total = text_bytes(docs, f"`{text_col}`")
    n_chunks = min(max(6, total // CHUNK_BYTES), (1 << CHUNK_BITS) - 1)
    n_ranges = max(6, total // RANGE_BYTES)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("text"))
    # by id and text, so that neither rows without id nor texts of one id crowd a chunk
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod("mark", F.lit(n_chunks)).cast("int"))

    def buckets_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            every = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
            third = np.zeros(len(every), dtype=bool)  # two entries of a chunk tell that it is repeated
            third[2:] = every[2:] == every[:-2]
            every = every[~third]
            yield from _packed_table(list(_packed(_share(every, n_ranges), every))).to_batches()

        for batch in batches:
            texts, chunks = batch["text"].to_pylist(), batch["chunk"].to_numpy()
            for own, strip in strips(batch["doc_id"].to_pylist(), texts, length):
                order = np.lexsort((strip.doc, strip.bucket))
                bucket, doc = strip.bucket[order], strip.doc[order]
                new = np.ones(len(order), dtype=bool)  # once for each document
                new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
                bucket = bucket[new]
                chunk = chunks[np.array(own)[doc[new]]].astype(np.uint64)
                seen.append(((_mix_again(bucket) >> SHORT) << SHORT) | chunk)
                held += len(bucket)
            if held >= HELD_ENTRIES:
                yield from handed()
                seen, held = [], 0
        yield from handed()
        given_back(None)

    def repeated_buckets(table: pa.Table) -> pa.Table:
        seen = np.sort(_unpacked(table, np.dtype("<u8")))
        bucket = seen >> SHORT
        new = np.ones(len(seen), dtype=bool)
        new[1:] = bucket[1:] != bucket[:-1]
        alone = new & np.r_[new[1:], True]
        seen = np.unique(seen[~alone])
        chunk, bucket = (seen & _U((1 << CHUNK_BITS) - 1)).astype(np.int64), seen >> SHORT
        _, which, n = np.unique(bucket, return_inverse=True, return_counts=True)
        return given_back(_packed_table(list(_packed(chunk, np.where(n[which] > HOT_CHUNKS, bucket | HOT, bucket) if len(bucket) else bucket))))

    seen = rows.mapInArrow(buckets_seen, PACKED)
    repeated = written(seen.groupBy("target").applyInArrow(repeated_buckets, PACKED), "buckets")
    del seen
    free_shuffles(spark)

    def blocks(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        told = _unpacked(answers, np.dtype("<u8"))
        told = told[np.argsort(told & ~HOT)]
        known, split = told & ~HOT, told & HOT > 0
        if not len(known) or not docs_.num_rows:
            return _packed_table([])
        ids, chunk = docs_["doc_id"].to_pylist(), docs_["chunk"][0].as_py()
        found, hot = [], []
        for own, strip in strips(ids, docs_["text"].to_pylist(), length):
            short = _mix_again(strip.bucket) >> SHORT
            j = np.minimum(np.searchsorted(known, short), len(known) - 1)
            hit = np.flatnonzero(known[j] == short)
            hot.append(split[j[hit]])
            b = np.zeros(len(hit), BLOCK)
            b["bucket"], b["block"] = strip.bucket[hit], strip.block[hit]
            b["doc"] = np.array([ids[k] for k in own], dtype=np.int64)[strip.doc[hit]]
            b["chunk"] = chunk
            found.append(b)
        b = np.concatenate(found) if found else np.zeros(0, BLOCK)
        order = np.lexsort((b["doc"], b["block"], b["bucket"]))
        b, hot = b[order], (np.concatenate(hot) if hot else np.zeros(0, bool))[order]
        # Once for each chunk, by its smallest document; a second document must be told apart.
        new = _first_of(b, "bucket", "block")
        second = np.zeros(len(b), dtype=bool)
        second[1:] = new[:-1] & ~new[1:]
        b, hot = b[new | second], hot[new | second]
        with np.errstate(over="ignore"):
            apart = _range(b["bucket"] + _mix(b["block"]), n_ranges) + _U(n_ranges)
        return given_back(_packed_table(list(_packed(np.where(hot, apart, _range(b["bucket"], n_ranges)), b))))

    def least_blocks(table: pa.Table) -> pa.Table:
        b = _unpacked(table, BLOCK)
        b = b[np.lexsort((b["doc"], b["block"], b["bucket"]))]
        new_bucket, new = _first_of(b, "bucket"), _first_of(b, "bucket", "block")
        if not len(b):
            return _packed_table([])
        of_bucket, of_block = np.cumsum(new_bucket) - 1, np.cumsum(new) - 1
        kinds = np.bincount(of_bucket[new], minlength=of_bucket[-1] + 1)
        size = np.bincount(of_block)
        # ranges beyond the first ones have split buckets, of which a task sees a part
        mixed = np.full(len(b), 2) if table["target"][0].as_py() >= n_ranges else (kinds[of_bucket] > 1).astype(np.int64)
        least = b["doc"][new][of_block]
        # an answer is due where something is covered or single starts are asked for
        due = (mixed > 0) | (size[of_block] > 1)
        a = np.zeros(int(due.sum()), ANSWER)
        a["bucket"], a["block"], a["doc"], a["mixed"] = b["bucket"][due], b["block"][due], least[due], mixed[due]
        chunk = b["chunk"][due].astype(np.int64)
        order = np.lexsort((a["block"], a["bucket"], chunk))
        a, chunk = a[order], chunk[order]
        once = _first_of(a, "bucket", "block")
        once[1:] |= chunk[1:] != chunk[:-1]
        return given_back(_packed_table(list(_packed(chunk[once], a[once]))))

    by_chunk = lambda frame: rows.groupBy("chunk").cogroup(frame.groupBy("target"))
    handed = by_chunk(repeated).applyInArrow(blocks, PACKED)
    answers = written(handed.groupBy("target").applyInArrow(least_blocks, PACKED), "blocks")
    del handed
    free_shuffles(spark)

    def covers_and_starts(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        """Covered blocks (target: -1 - chunk) and single starts (target: range)."""
        a = _unpacked(replies, ANSWER)
        if not len(a) or not docs_.num_rows:
            return _with_bytes([])
        key = lambda bucket, block: _mix(bucket + _mix(block + _STEP))
        with np.errstate(over="ignore"):
            a_key = key(a["bucket"], a["block"])
        order = np.argsort(a_key)
        a, a_key = a[order], a_key[order]
        ids, chunk = docs_["doc_id"].to_pylist(), docs_["chunk"][0].as_py()
        marks = docs_["mark"].to_numpy()
        covers, heads, keys, bodies = [], [], [], []
        for own, strip in strips(ids, docs_["text"].to_pylist(), length):
            with np.errstate(over="ignore"):
                k = key(strip.bucket, strip.block)
            j = np.minimum(np.searchsorted(a_key, k), len(a) - 1)
            hit = np.flatnonzero((a_key[j] == k) & (a["bucket"][j] == strip.bucket) & (a["block"][j] == strip.block))
            j = j[hit]
            doc = np.array([ids[r] for r in own], dtype=np.int64)[strip.doc[hit]]
            mark = marks[np.array(own)[strip.doc[hit]]]
            first, last = strip.first[hit], strip.last[hit]
            at = first - strip.begin[strip.doc[hit]]
            done = a["doc"][j] < doc
            c = np.zeros(int(done.sum()), COVER)
            c["mark"], c["at"], c["size"] = mark[done], at[done], (last - first)[done] + length
            covers.append(_joined(c, c["mark"])[0])
            for split in (False, True):
                ask = np.flatnonzero(~done & (a["mixed"][j] == 1 + split))
                n = ((last - first)[ask] + 1).astype(np.int64)
                begin, moved = first[ask], at[ask]
                if split:  # every start by itself
                    moved, begin, ask = _runs(moved, n), _runs(begin, n), np.repeat(ask, n)
                    n = np.ones(len(ask), np.int64)
                h = np.zeros(len(ask), HEAD)
                h["bucket"], h["doc"], h["mark"], h["at"] = strip.bucket[hit[ask]], doc[ask], mark[ask], moved
                h["n"], h["chunk"] = n, chunk
                heads.append(h)
                with np.errstate(over="ignore"):
                    keys.append(_mix(strip.grams[begin] * _U(3) + strip.grams[begin + length - strip.q]) if split else h["bucket"])
                bodies.append(strip.data[_runs(begin, n + length - 1)])
        c = np.concatenate(covers) if covers else np.zeros(0, COVER)
        out = [(-1 - chunk, c.tobytes(), b"")] if len(c) else []
        h = np.concatenate(heads) if heads else np.zeros(0, HEAD)
        if len(h):
            body, size = np.concatenate(bodies), h["n"].astype(np.int64) + length - 1
            offset, ranges = np.cumsum(size) - size, _range(np.concatenate(keys), n_ranges).astype(np.int64)
            order = np.argsort(ranges, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(ranges[order]) > 0, True])
            for x, y in zip(cuts[:-1], cuts[1:]):
                own = order[x:y]
                out.append((int(ranges[own[0]]), h[own].tobytes(), body[_runs(offset[own], size[own])].tobytes()))
        return given_back(_with_bytes(out))

    def least_starts(table: pa.Table) -> pa.Table:
        h = _unpacked(table, HEAD)
        if not len(h):
            return _packed_table([])
        body = np.frombuffer(b"".join(table["body"].to_pylist()), dtype=np.uint8)
        n = h["n"].astype(np.int64)
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        pointer, shared = refined(body, length)
        which, p = np.repeat(np.arange(len(h)), n), _runs(begin, n)
        again = shared[p]
        which, p = which[again], p[again]
        doc = h["doc"][which]
        order = np.lexsort((doc, pointer[p]))
        which, p, doc = which[order], p[order], doc[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = pointer[p[1:]] != pointer[p[:-1]]
        late = doc[new][np.cumsum(new) - 1] < doc if len(p) else new
        which, p = which[late], p[late]
        c = np.zeros(len(p), COVER)
        c["mark"], c["at"], c["size"] = h["mark"][which], h["at"][which] + p - begin[which], length
        chunk = h["chunk"][which].astype(np.int64)
        order = np.lexsort((c["at"], c["mark"], chunk))
        c, first = _joined(c[order], chunk[order])
        return given_back(_packed_table(list(_packed(first, c))))

    mixed = written(by_chunk(answers).applyInArrow(covers_and_starts, WITH_BYTES), "starts")
    free_shuffles(spark)
    late = mixed.where("target >= 0").groupBy("target").applyInArrow(least_starts, PACKED)
    covers = mixed.where("target < 0").select((-1 - F.col("target")).cast("int").alias("target"), "payload").unionAll(late)
    return rows, covers, length


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans``
    (maximal removed runs of bytes) and ``kept`` (the remaining bytes).

    What remains is bytes, as a cut may fall inside a character.
    """
    rows, covers, length = repeated_spans(docs, length, id_col, text_col)

    def cut(docs_: pa.Table, packed: pa.Table) -> pa.Table:
        c = _unpacked(packed, COVER)
        c = c[np.argsort(c["mark"], kind="stable")]
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")}
        for i, mark, text in zip(docs_["doc_id"].to_pylist(), docs_["mark"].to_pylist(), docs_["text"].to_pylist()):
            spans: list[tuple[int, int]] = []
            if i is not None:
                a, b = np.searchsorted(c["mark"], mark, "left"), np.searchsorted(c["mark"], mark, "right")
                if b > a:
                    gone = np.zeros(len(text) + 1, dtype=np.int32)
                    np.add.at(gone, c["at"][a:b], 1)
                    np.add.at(gone, c["at"][a:b] + c["size"][a:b], -1)
                    edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(gone) > 0, 0]))
                    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
            kept, end = [], 0
            for x, y in spans:
                kept.append(text[end:x])
                end = y
            kept.append(text[end:])
            for k, v in zip(out, (i, len(text), sum(y - x for x, y in spans), len(spans), [{"start": x, "end": y} for x, y in spans], b"".join(kept))):
                out[k].append(v)
        return given_back(pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": pa.array(out["kept"], pa.binary())}))

    return rows.groupBy("chunk").cogroup(covers.groupBy("target")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:int,end:int>>, kept binary")


def oracle_sql(length: int = 50) -> str:
    """Digest rows of the query in DuckDB SQL: every substring, in hexadecimal."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, {2 * length}) AS g FROM (SELECT r, doc_id, x, unnest(range(0, strlen(x) // 2 - {length - 1})) AS p FROM d WHERE strlen(x) >= {2 * length} AND doc_id IS NOT NULL)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT r, p FROM s JOIN f USING (g) WHERE first < doc_id),
o AS (SELECT r, p, p > lag(p) OVER (PARTITION BY r ORDER BY p) + {length} OR lag(p) OVER (PARTITION BY r ORDER BY p) IS NULL AS opens FROM c),
k AS (SELECT r, p, sum(opens::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM o),
n AS (SELECT r, min(p) AS a, max(p) + {length} AS b FROM k GROUP BY r, k),
e AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM n),
q AS (SELECT e.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN q.r IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN q ON q.r = d.r
"""
