import random
import re
from itertools import product

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash


def print_of(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[root(a)] = root(b)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_against_all_pairs(docs, rows, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    small = [(i, t if len(t or "") < 100_000 else t[:1000]) for i, t in rows]
    prints = [print_of(t) for _, t in small]
    root = groups(len(small), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(small, root):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    want = sorted(((i, p, least[r]) for (i, _), p, r in zip(small, prints, root)), key=str)
    frame = docs.sparkSession.createDataFrame(small, "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    assert out == want


def test_planned_thresholds_miss_no_pair():
    rng = np.random.default_rng(0)
    for total, threshold in product((100, 10**9), (0, 1, 2, 3, 4)):
        sample = rng.integers(0, 2**63, 300, dtype=np.uint64)
        chosen = simhash.plan(sample, total, threshold)
        for _ in range(300):
            mask = sum(1 << int(b) for b in rng.choice(64, threshold, replace=False))
            assert any(sum(mask >> b & 1 for b in part) <= t for part, t in chosen)


def test_allocation_takes_the_cheapest_sum():
    costs = [[0, 5, 9], [0, 1, 2], [0, 4, 5]]
    cost, chosen = simhash.allocate(costs, 3)
    want = min(sum(r[k] for r, k in zip(costs, ks)) for ks in product(range(3), repeat=3) if sum(ks) == 3)
    assert cost == want and sum(t + 1 for t in chosen) == 3


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101)]
    out = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(1, 61)} | {101: 100}


def test_similar_groups_against_all_pairs(spark, rows):
    small = {i: t for i, t in rows if i is not None and len(t or "") < 100_000}
    base = "one two three four five six seven eight nine ten " * 2 + " ".join(f"w{k}" for k in range(200))
    small |= {3000: base, 3001: base.replace("w7 ", "other "), 3002: base.upper(), 3003: base.replace("w", "v")}
    ids = sorted(small)
    sets = [set(simhash.shingles(small[i] or "", 5)) for i in ids]
    root = groups(len(ids), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    frame = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()} == {i: least[r] for i, r in zip(ids, root)}


@pytest.mark.parametrize("meet_bytes", [8 << 20, 3000])
def test_no_link_of_a_template_family_is_lost(spark, meet_bytes, monkeypatch):
    """Pairs at 0.83 inside a family of 0.7 or less, whose bands others share."""
    monkeypatch.setattr(simhash, "MEET_BYTES", meet_bytes)
    rnd = np.random.default_rng(5)
    template, texts = [f"t{k}" for k in range(240)], []
    for k in range(60):
        words = [*template, *(f"own{k}x{j}" for j in range(60))]
        other = list(words)
        for at in rnd.choice(range(5, 295), 5, replace=False):
            other[at] = f"new{k}y{at}"
        texts += [" ".join(words), " ".join(other)]
    texts = [texts[k] for k in rnd.permutation(len(texts))]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = groups(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for k, r in enumerate(root):
        least[r] = min(k, least.get(r, k))
    assert 30 < len(least) < 120
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: least[r] for k, r in enumerate(root)}


@pytest.mark.parametrize("leaders", [1, 4, 16])
def test_a_family_led_by_few_keeps_all_links(spark, leaders, monkeypatch):
    """Near copies that any leader joins, and texts that only one of them is like."""
    monkeypatch.setattr(simhash, "MEET_BYTES", 4000)
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    rnd = np.random.default_rng(9)
    base = [f"t{k}" for k in range(300)]

    def changed(words, n, tag):
        out = list(words)
        for at in rnd.choice(300, n, replace=False):
            out[at] = f"{tag}x{at}"
        return out

    family = [changed(base, 2, f"f{k}") for k in range(40)]
    near = [changed(family[k], 6, f"n{k}") for k in range(10)]  # like their own, hardly like the others
    far = [changed(near[k], 6, f"m{k}") for k in range(5)]
    alone = [changed(base, 40, f"a{k}") for k in range(5)]
    texts = [" ".join(w) for w in (*family, *near, *far, *alone)]
    texts = [texts[k] for k in rnd.permutation(len(texts))]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    root = groups(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for k, r in enumerate(root):
        least[r] = min(k, least.get(r, k))
    assert 1 < len(least) < 20
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {k: least[r] for k, r in enumerate(root)}


def test_empty_tables(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.similar_groups(none).count() == 0


@pytest.mark.parametrize("postings", [1, 40, 400])
def test_frequent_shingles_are_dealt_by_their_texts(spark, postings, monkeypatch):
    """A shingle in every text, and a chain of templates: groups as by all pairs."""
    monkeypatch.setattr(simhash, "POSTINGS", postings)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    every = [word() for _ in range(12)]
    chain = [[word() for _ in range(60)]]
    for _ in range(25):  # each is near the one before, few are near others
        k = rnd.randrange(60)
        chain.append(chain[-1][:k] + [word()] + chain[-1][k + 1 :])
    texts = [" ".join(every + c) for c in chain] + [" ".join(every + [word() for _ in range(rnd.randint(0, 40))]) for _ in range(60)]
    texts += texts[:3] + [" ".join(every)] * 4
    sets = [set(simhash.hashed_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
