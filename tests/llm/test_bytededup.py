import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bytededup


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                k = b[p : p + length]
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def got(frame, length):
    out = bytededup.remove_repeats(frame, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("length,hot", [(50, 1024), (20, 1024), (50, 0), (20, 2)])
def test_against_every_substring(docs, rows, length, hot, monkeypatch):
    """Without split buckets, with nothing else, and with some."""
    monkeypatch.setattr(bytededup, "HOT_CHUNKS", hot)
    monkeypatch.setattr(bytededup, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(bytededup, "RANGE_BYTES", 60_000)
    monkeypatch.setattr(bytededup, "STRIP_BYTES", 5_000)
    assert got(docs, length) == brute(rows, length)


def test_spans_are_what_is_cut(docs):
    for r in bytededup.remove_repeats(docs).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)


def test_empty_table(none):
    assert got(none, 50) == []


def test_odd_length_is_refused(docs):
    with pytest.raises(ValueError):
        bytededup.remove_repeats(docs, 51)


def test_grams_do_not_depend_on_their_place():
    data = np.frombuffer(b"xx" + b"the same twenty-five byte" + b"-and-" + b"the same twenty-five byte", np.uint8)
    g = bytededup.gram_ids(data, 25)
    assert g[2] == g[32] and len(set(g.tolist())) == len(g) - 1


def test_pointers_order_and_group_all_strings():
    rnd = random.Random(8)
    for length, text in ((50, "".join(rnd.choice("ab") for _ in range(300)) * 2), (12, "".join(rnd.choice("abc") for _ in range(2000))), (50, "x" * 400), (8, ""), (4, "abcabcab"), (50, "short")):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        pointer, shared = bytededup.refined(data, length)
        strings = [text[k : k + length].ljust(length, "\0") for k in range(len(text))]
        assert shared.tolist() == [strings.count(x) > 1 for x in strings]
        ranks = {}
        for p, x in zip(pointer.tolist(), strings):
            assert ranks.setdefault(p, x) == x
        assert [x for _, x in sorted(ranks.items())] == sorted(set(strings))
