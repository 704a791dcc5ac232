"""SimHash near-duplicates by the generalised pigeonhole principle.

If two fingerprints differ in at most ``t`` bits and the bits are dealt over
``m`` partitions with thresholds whose sum is ``t - m + 1``, then some
partition differs in at most its own threshold (a threshold of -1 leaves the
partition out).  Bits that agree more than chance would have it are dealt to
the same partition, so that the others stay selective.  A dynamic programme
allocates the thresholds, and the number of partitions is chosen with them, by
the candidates that a bounded sample of fingerprints lets expect.

Only distinct fingerprints take part, each standing for all its documents, so
copies cost nothing.  Every fingerprint is filed under its own value in each
partition and looks itself up under all values within the threshold; what meets
is verified on all 64 bits.  A file of values larger than ``BLOCK`` is cut into
blocks that meet pairwise, so no task holds more than two blocks; smaller files
meet in bundles, many to a call.  Each meeting returns a spanning forest of its
links rather than every pair.

Components come from alternating large-star and small-star steps over links
between fingerprints; each step is written to the shared folder.

The pipeline's groups at a Jaccard similarity (``similar_groups``) come from an
exact prefix-filter join instead, with the same components.

Defined results: a null text counts as empty; no words gives fingerprint 0,
linked like any other; fewer words than a shingle give one shingle of all
words; ties at half the shingles give bit 0; repeated rows are kept; a null id
keeps its row and is never a component's name unless all ids there are null;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import ROWS_KEY, bounded_batches, hashed_sample, setting, small, written

BITS = 64
#: Fingerprints sampled for bit correlations and candidate estimates.
SAMPLE = 4096
#: Most fingerprints on either side of a meeting in one task.
BLOCK = 4096
#: Values in a bundle of small files, and the size of a handful.
BUNDLE_ROWS, FEW = 1 << 15, 24
#: Rows of plain numbers that an Arrow batch may have.
NUMBER_ROWS = "10000"
#: What filing one value costs, in verified candidates.
PROBE_COST = 8.0

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of a text with A-Z lower-cased, repeats included."""
    words = WORD.findall(text.encode().lower())
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[k:] for k in range(size)))]


def fingerprint_of(text: str | None, size: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    parts = shingles(text, size) if text else []
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """The 64-bit fingerprint of each text as a signed long."""

    @pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text)


def correlated_order(bits: np.ndarray) -> list[int]:
    """Bit numbers such that bits that agree often stand side by side."""
    if len(bits) < 2:
        return list(range(BITS))
    x = bits.astype(np.float64) - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    alike = np.abs((x / norm).T @ (x / norm))
    order, left = [0], set(range(1, BITS))
    while left:
        nearest = max(left, key=lambda b: (alike[order[-1], b], -b))
        order.append(nearest)
        left.remove(nearest)
    return order


def within(width: int, threshold: int) -> list[int]:
    """Masks of at most ``threshold`` bits among ``width``."""
    return [sum(1 << b for b in c) for r in range(threshold + 1) for c in combinations(range(width), r)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, -1 and up, of the given sum and the least total cost.

    ``costs[i][t + 1]`` is what threshold ``t`` costs in partition ``i``.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:  # state: the sum of threshold + 1 so far
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step, extra in enumerate(row):
                total = used + step
                if total <= budget and (total not in nxt or cost + extra < nxt[total][0]):
                    nxt[total] = (cost + extra, [*chosen, step - 1])
        best = nxt
    return best[budget]


def plan(sample: np.ndarray, total: int, threshold: int) -> list[tuple[list[int], int]]:
    """Partitions of the bits and their thresholds, for ``total`` fingerprints."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(sample) else np.zeros((0, BITS), np.uint8)
    order = correlated_order(bits)
    other = np.random.default_rng(64).permutation(len(bits))
    choices = []
    for m in range(1, threshold + 2):
        parts = [sorted(order[BITS * k // m : BITS * (k + 1) // m]) for k in range(m)]
        costs = []
        for part in parts:
            row = [0.0]
            apart = np.concatenate([(bits[:, part] != np.roll(bits[other], s, axis=0)[:, part]).sum(axis=1) for s in range(1, 9)]) if len(bits) > 8 else np.zeros(0)
            for t in range(threshold + 1):
                if len(within(min(len(part), 64), min(t, 2))) > 3000 or t > 2:
                    row.append(float("inf"))
                    continue
                variants = len(within(len(part), t))
                chance = max(float((apart <= t).mean()) if len(apart) else 0.0, variants / 2.0 ** len(part))
                row.append(PROBE_COST * (variants + 1) + chance * total)
            costs.append(row)
        cost, chosen = allocate(costs, threshold + 1)
        choices.append((cost, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def gather(values: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of ``part`` of each value, packed."""
    out = np.zeros(len(values), dtype=np.uint64)
    for k, b in enumerate(part):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _forest(a: np.ndarray, b: np.ndarray, same: bool, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between (or inside) two sets of values."""
    every = a if same else np.concatenate([a, b])
    parent = np.arange(len(every))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    base = 0 if same else len(a)
    for i in range(len(a)):
        rest = b[i + 1 :] if same else b
        near = np.flatnonzero(np.bitwise_count(rest ^ a[i]) <= threshold) + (i + 1 if same else 0)
        if len(near):
            mine = root(i)
            for j in near[parent[near + base] != mine].tolist():
                other = root(j + base)
                if other != mine:
                    parent[other] = mine
                    out.append((int(every[i]), int(every[j + base])))
            parent[near + base] = np.where(parent[near + base] == near + base, parent[near + base], mine)
    return out


def _few(fps: list[int], own: list[bool], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a handful of values."""
    group, out = list(range(len(fps))), []
    for y in range(1, len(fps)):
        for x in range(y):
            if group[x] != group[y] and (own[x] or own[y]) and (fps[x] ^ fps[y]).bit_count() <= threshold:
                out.append((fps[x], fps[y]))
                gone, kept = group[y], group[x]
                group = [kept if g == gone else g for g in group]
    return out


def links(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """Links that connect whatever lies within ``threshold`` bits.

    ``prints`` has distinct, non-null longs in ``fp``.  The result (``a``,
    ``b``: fingerprints) has at least a spanning forest of every component.
    """
    spark = prints.sparkSession
    total = prints.count()
    sample = np.array([r.fp for r in hashed_sample(prints.select("fp"), SAMPLE, total).collect()], dtype=np.int64).view(np.uint64)
    chosen = plan(sample, total, threshold)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch[0].to_numpy().view(np.uint64)
            for k, (part, t) in enumerate(chosen):
                own = gather(fps, part)
                for mask in within(len(part), t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array((own ^ np.uint64(mask)).view(np.int64)), pa.array(np.full(len(fps), mask == 0)), pa.array(fps.view(np.int64))], ["part", "value", "own", "fp"])

    values = prints.select("fp").mapInArrow(filed, "part int, value bigint, own boolean, fp bigint")
    # Values under which only one fingerprint is filed, or none under its own, meet nothing.
    sizes = values.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0")
    met = values.join(sizes, ["part", "value"])
    # A large file of values: every fingerprint goes to one row and one column of blocks.
    # The others, which are nearly all, meet in bundles, so that a call handles many.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
    bundles = max(16, total * len(chosen) // BUNDLE_ROWS)
    large = blocks > 1
    bundle = F.when(large, F.struct(F.col("part").cast("bigint").alias("x"), F.col("value").alias("y"))).otherwise(F.struct(F.lit(-1).cast("bigint").alias("x"), F.pmod(F.xxhash64("part", "value"), F.lit(bundles)).alias("y")))
    dealt = met.select("part", "value", "own", "fp", block.alias("block"), bundle.alias("bundle"), F.explode(places).alias("at")).select("bundle.x", "bundle.y", "at.i", "at.j", "part", "value", "block", "own", "fp")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        fps, own, block = table["fp"].to_numpy().view(np.uint64), table["own"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
        part, value = table["part"].to_numpy(), table["value"].to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        order = np.lexsort((fps, value, part))
        fps, own, block, part, value = fps[order], own[order], block[order], part[order], value[order]
        cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1]), True])
        pairs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            f, o, k = fps[a:b], own[a:b], block[a:b]
            if b - a <= FEW:
                pairs += _few(f.tolist(), o.tolist(), threshold)
            elif o.all():
                pairs += _forest(f[k == i], f[k == j], i == j, threshold)
            else:
                pairs += _forest(f[o & (k == i)], f[k == j], False, threshold)
                if i != j:
                    pairs += _forest(f[o & (k == j)], f[k == i], False, threshold)
        ends = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
        ends = ends[ends[:, 0] != ends[:, 1]]
        return pa.table({"a": ends.min(axis=1, initial=2**64 - 1).view(np.int64) if len(ends) else pa.array([], pa.int64()), "b": ends.max(axis=1, initial=0).view(np.int64) if len(ends) else pa.array([], pa.int64())})

    return dealt.groupBy("x", "y", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node`` and the smallest node of its component, ``root``.

    ``edges`` has comparable ``a`` and ``b``.  Large-star and small-star steps
    alternate until nothing changes; every node hangs on its root then.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a and m <> b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        step = written(small, "edges")
        same = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        was = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        current = step
        if same == was:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Documents of one fingerprint are dealt over this many keys wherever they meet.
SALTS = 64


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint(F.col(f"`{text_col}`"), size).alias("fp"))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "prints")
    salted = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    groups = written(salted.groupBy("fp").agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts")), "groups")
    with setting(docs.sparkSession, ROWS_KEY, NUMBER_ROWS):
        roots = components(links(groups.select("fp"), threshold))
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", "salts", F.coalesce("root", "fp").alias("root"))
    # a component has few fingerprints or many; partial minima go first
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = written(named.join(lowest, "root").select("fp", F.explode("salts").alias("salt"), "component_id"), "components")
    return rows.join(of_print, ["fp", "salt"]).select("doc_id", "fp", "component_id")


#: The part of all hash values whose shingles are counted, in 64ths.
SLICE = 26
#: Postings that a chunk holds before it is handed on, and about what a bucket gets.
POSTINGS = 1 << 20
#: Texts of a large cluster that all its others meet first, about.
LEADERS = 16
#: Bytes of text on either side of a meeting, and in a bundle of small clusters.
MEET_BYTES = 8 << 20


def hashed_set(text: str, size: int) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(p, 42) for p in set(shingles(text, size))], dtype=np.uint64))


def prefix_size(n: int, similarity: float) -> int:
    """Sets that alike share one of so many first elements, in any one order."""
    return n - max(1, math.ceil(similarity * n - 1e-9)) + 1


def _alike(sets: list[np.ndarray], sides: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of some sets; with sides, only across them."""
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    by_value = owner[order]
    values, begins, counts = np.unique(every[order], return_index=True, return_counts=True)
    parent, out = list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        at = np.searchsorted(values, own)
        at = at[counts[at] > 1]
        n = counts[at]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[at], n)
        shared = np.bincount(by_value[places], minlength=len(sets))
        shared[k:] = 0
        if sides is not None:
            shared[sides == sides[k]] = 0
        for j in np.flatnonzero((shared > 0) & (shared >= similarity * (sizes + sizes[k] - shared) - 1e-9)).tolist():
            a, b = root(k), root(j)
            if a != b:
                parent[a] = b
                out.append((k, j))
    return out


def led_by_few(members: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(``node`` and ``core`` of the texts that need no meeting among themselves,
    links ``a``, ``b`` that join them).

    In a cluster of more than ``MEET_BYTES`` every text first meets about
    ``LEADERS`` of its texts, chosen by hash.  The largest group that these links
    join is the cluster's core if it holds over half of the bytes.  So a family of
    near copies costs a pass over its texts, not a meeting of all pairs of blocks.
    """
    spark = members.sparkSession
    node, none = "node bigint, core boolean", "a bigint, b bigint"
    sizes = members.groupBy("root").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    large = written(sizes.where(F.col("bytes") > MEET_BYTES), "large")
    if large.isEmpty():
        return spark.createDataFrame([], node), spark.createDataFrame([], none)
    parts = F.ceil(F.col("bytes") / MEET_BYTES).cast("int")
    own = written(members.join(small(large), "root").select("root", "node", "text", "bytes", "n", parts.alias("parts")), "large_members")
    leaders = own.where(F.pmod(F.xxhash64("node", F.lit(11)), F.col("n")) < LEADERS).select("root", "node", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"))
    dealt = own.select("root", "node", "text", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("leads")).unionAll(leaders)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        nodes, leads = table["node"].to_numpy(), table["leads"].to_numpy(zero_copy_only=False)
        sets = [hashed_set(t.as_py(), size) for t in table["text"]]
        pairs = [(nodes[x], nodes[y]) for x, y in _alike(sets, leads, similarity)]
        ends = np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    links_ = written(dealt.groupBy("root", "part").applyInArrow(meet, none), "led")
    joined = components(links_).withColumnRenamed("root", "group")
    joined = written(joined.unionAll(joined.select(F.col("group").alias("node"), "group")).distinct(), "joined")
    each = written(own.select("root", "node", "bytes", F.octet_length("text").alias("own")).join(small(joined), "node"), "grouped")
    heavy = each.groupBy("root", "group", "bytes").agg(F.sum("own").alias("held")).where(2 * F.col("held") > F.col("bytes")).select("root", "group")
    return written(each.join(small(written(heavy, "heavy")), ["root", "group"]).select("node", F.lit(True).alias("core")), "core"), links_


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``component_id`` where links are Jaccard similarities.

    Two texts are linked if their sets of word shingles (A-Z lower-cased, as
    64-bit hashes) have at least that similarity.  No link is lost: in any one
    order of all shingles, texts that alike share one of the first
    ``prefix_size`` of their own.  The order is: hashes below a cut, rare
    before frequent; then the others.  So only the shingles below the cut have
    to be counted, and of the others a text hands in what its prefix still
    lacks.  The postings of a shingle that stands in very many texts are dealt by
    their texts, and only their number goes to the shingle's bucket, so that no
    group grows with it.  Texts that share a shingle of their prefixes form clusters; all
    pairs of a cluster meet that aren't linked through its leaders already
    (``led_by_few``), block by block, and each meeting returns a spanning forest
    of the links.  Texts that are equal count as one; texts
    without words are equal to each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(text.rlike(r"[^\x20\x09-\x0d]"), text).otherwise("").alias("text"))
    node = F.xxhash64("text")
    each = rows.select("doc_id", node.alias("node"), F.octet_length("text").alias("bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    each = written(each, "sketches")
    buckets = max(16, (each.agg(F.sum("bytes")).first()[0] or 0) * SLICE // 64 // 6 // POSTINGS)
    cut = np.uint64(SLICE << 58)
    # a shingle that often in the postings of one task would fill a bucket by itself
    most = max(2, POSTINGS // buckets)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            values = np.concatenate([v for _, _, v in held])
            sizes = [len(v) for _, _, v in held]
            nodes = np.repeat(np.array([o for o, _, _ in held], dtype="<i8"), sizes)
            rooms = np.repeat(np.array([r for _, r, _ in held], dtype="<i4"), sizes)
            bucket = (values % np.uint64(buckets)).astype(np.int32)
            _, first, which, often = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
            if (hot := often > most).any():
                # texts of a frequent shingle are dealt by themselves; its own bucket gets their
                # number in the place of the room, which is at most 0 otherwise
                bucket = np.where(hot[which], buckets + nodes % buckets, bucket).astype(np.int32)
                told = values[first[hot]]
                values, nodes, rooms = np.r_[values, told], np.r_[nodes, np.zeros(len(told), "<i8")], np.r_[rooms, often[hot].astype("<i4")]
                bucket = np.r_[bucket, (told % np.uint64(buckets)).astype(np.int32)]
            order = np.argsort(bucket, kind="stable")
            values, nodes, rooms, bucket = values[order].astype("<u8"), nodes[order].astype("<i8"), rooms[order].astype("<i4"), bucket[order]
            begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[begins[1:], len(bucket)]
            packed = lambda c: pa.array([c[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), packed(values), packed(nodes), packed(rooms)], ["bucket", "shingles", "nodes", "rooms"])

        held, seen, n = [], set(), 0
        for batch in batches:
            for owner, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                if owner in seen:
                    continue
                seen.add(owner)
                own = hashed_set(text, size)
                if not len(own):
                    continue
                below, prefix = int(np.searchsorted(own, cut)), prefix_size(len(own), similarity)
                handed = max(below, prefix)
                held.append((owner, prefix - handed, own[:handed]))
                n += handed
                if n >= POSTINGS:
                    yield dealt(held)
                    held, seen, n = [], set(), 0
        if held:
            yield dealt(held)

    def counted(table: pa.Table) -> pa.Table:
        """Postings with their shingle's count; that is null for those that are
        dealt by themselves, and of these shingles a row without node has it."""
        column = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)
        values, nodes, rooms = column("shingles", "<u8"), column("nodes", "<i8"), column("rooms", "<i4")
        told = rooms > 0
        order = np.lexsort((nodes, values))
        values, nodes, rooms, told = values[order], nodes[order], rooms[order], told[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1]) | told[1:] | told[:-1]]
        values, nodes, rooms, told = values[new], nodes[new], rooms[new], told[new]
        begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        sizes = np.diff(np.r_[begins, len(values)])
        often = np.repeat(np.add.reduceat(np.where(told, rooms, 1).astype(np.int64), begins), sizes)
        apart = table["bucket"][0].as_py() >= buckets
        kept = (often > 1) | apart
        # one row tells the count, however many parts it was summed from
        place = np.arange(len(values)) - np.repeat(begins, sizes)
        head = np.repeat(np.logical_or.reduceat(told, begins), sizes) & (place == 0)
        # beyond the cut the order doesn't ask for counts
        often = np.where(values >= cut, 2**31 - 1, np.minimum(often, 2**31 - 2)).astype(np.int32)
        rows = kept & ~told
        out = pa.table({"shingle": values[rows].view(np.int64), "node": nodes[rows], "often": pa.array(often[rows], mask=np.full(int(rows.sum()), apart)), "room": rooms[rows]})
        n = int(head.sum())
        heads = pa.table({"shingle": values[head].view(np.int64), "node": pa.nulls(n, pa.int64()), "often": often[head], "room": pa.nulls(n, pa.int32())})
        return pa.concat_tables([out, heads]) if n else out

    postings = rows.where("text <> ''").select(node.alias("node"), "text").mapInArrow(posted, "bucket int, shingles binary, nodes binary, rooms binary")
    shared = written(postings.groupBy("bucket").applyInArrow(counted, "shingle bigint, node bigint, often int, room int"), "shared")
    counts = shared.where("node is null").select("shingle", F.col("often").alias("told"))
    if not counts.isEmpty():
        counts = small(written(counts, "frequent"))
        apart = shared.where("node is not null and often is null").join(counts, "shingle").select("shingle", "node", F.col("told").alias("often"), "room")
        shared = shared.where("node is not null and often is not null").unionByName(apart)
    # a text's other shingles stand in no other text and come first
    of_node = Window.partitionBy("node")
    ranked = shared.withColumns({"place": F.row_number().over(of_node.orderBy("often", "shingle")), "n": F.count("*").over(of_node)})
    prefixes = written(ranked.where("place <= room + n").select("shingle", "node"), "prefixes")
    ends = prefixes.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("shingle", "first")
    clusters = components(prefixes.join(ends, "shingle").select(F.col("node").alias("a"), F.col("first").alias("b")))
    clusters = written(clusters.unionAll(clusters.select(F.col("root").alias("node"), "root")).distinct(), "clusters")
    # few texts are in any cluster; while their list is short the others needn't move
    members = written(rows.select(node.alias("node"), "text").join(small(clusters), "node").groupBy("node", "root").agg(F.min("text").alias("text")), "members")
    core, led = led_by_few(members, size, similarity)
    members = members.join(small(core), "node", "left").withColumn("core", F.col("core").isNotNull())
    # core texts of a cluster are linked already: they only meet the rest of it
    rest = F.sum(F.when(~F.col("core"), F.octet_length("text")).otherwise(0))
    sizes = written(members.groupBy("root").agg(rest.alias("rest"), (F.sum(F.octet_length("text")) - rest).alias("bytes")), "sizes")
    total = sizes.agg(F.sum(F.col("rest") + F.col("bytes"))).first()[0] or 0
    blocks = lambda n: F.ceil(F.col(n) / MEET_BYTES).cast("int")
    r, c = blocks("rest"), blocks("bytes")
    block = F.when(F.col("core"), r + F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(c, F.lit(1)))).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(r, F.lit(1)))).cast("int")
    others = F.when(F.col("core"), r).otherwise(r + c)
    places = F.when(others > 0, F.transform(F.sequence(F.lit(0), F.greatest(others - 1, F.lit(0))), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"))))
    bundle = F.when(r + c > 1, F.struct(F.lit(1).alias("x"), F.col("root").alias("y"))).otherwise(F.struct(F.lit(0).alias("x"), F.pmod(F.xxhash64("root"), F.lit(max(16, total // MEET_BYTES))).alias("y")))
    dealt_members = members.join(small(sizes), "root").select("root", "node", "text", block.alias("block"), bundle.alias("bundle"), F.explode(places).alias("at")).select("bundle.x", "bundle.y", "at.i", "at.j", "root", "block", "node", "text")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        across = key[2].as_py() != key[3].as_py()
        roots, nodes, side = table["root"].to_numpy(), table["node"].to_numpy(), table["block"].to_numpy()
        texts, order = table["text"], np.argsort(roots, kind="stable")
        cuts = np.flatnonzero(np.r_[True, roots[order][1:] != roots[order][:-1], True])
        pairs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            here = order[a:b]
            sets = [hashed_set(texts[k].as_py(), size) for k in here.tolist()]
            pairs += [(nodes[here[x]], nodes[here[y]]) for x, y in _alike(sets, side[here] if across else None, similarity)]
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    roots = components(dealt_members.groupBy("x", "y", "i", "j").applyInArrow(meet, "a bigint, b bigint").unionAll(led))
    # equal texts: the smallest id stands for all
    salted = each.groupBy("node", "salt").agg(F.min("doc_id").alias("least"))
    equal = salted.groupBy("node").agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts"))
    named = written(equal.join(roots, "node", "left").select("node", "least", "salts", F.coalesce("root", "node").alias("root")), "groups")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = written(named.join(lowest, "root").select("node", F.explode("salts").alias("salt"), "component_id"), "components")
    return each.join(of_node, ["node", "salt"]).select("doc_id", "component_id")
