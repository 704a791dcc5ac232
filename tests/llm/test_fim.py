import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\x0b \u0085ab<é😀", max_size=60), st.integers(1, 5), st.integers(1, 9))
def test_offsets_of_every_unit(text, every, block):
    index = fim.Checkpoints.of(text.encode(), every, block)
    units = UNIT.findall(text)
    assert index.n == len(units)
    for k in range(len(units) + 1):
        part = "".join(units[:k])
        assert index.offset(k, block) == (len(part.encode()), len(part))


def test_checkpoints_are_sparse():
    index = fim.Checkpoints.of(b"word " * 100_000)
    assert len(index.units) == 100_000 // fim.EVERY + 1
    assert np.all(np.diff(index.units) == fim.EVERY)


def test_as_brute_force(spark, rows, docs):
    got = {}
    for r in fim.transform(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n, r.form, r.prefix_chars, r.middle_chars, r.output))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute(i, t))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert {x[1] for v in got.values() for x in v} == {"plain", "psm", "spm"}


def test_marks_and_long_texts(spark):
    long = ("ä" * 70_000 + " \n") * 12 + "x " * 200_000
    texts = [(k, t) for k in range(40) for t in ("a <P> b", "half <P", "<S", "> <M <", " <S>", long if k < 3 else "\n \n")]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, output string, n int")
    out = fim.transform(frame)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.where("form <> 'plain'").collect()) == sorted((k, *b) for k, t in texts if (b := brute(k, t))[1] != "plain")
    again = out.select("doc_id", fim.restored(out["output"], out["form"]).alias("text")).collect()
    assert sorted(map(tuple, again)) == sorted(texts)


def test_empty_table(none):
    assert fim.transform(none).collect() == []


def test_query_restores_every_text(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.restored_sha256 for r in queries.QUERIES["op11_fill_in_middle"](spark, sf).collect()}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in queries.table(spark, sf, "documents").collect()}
