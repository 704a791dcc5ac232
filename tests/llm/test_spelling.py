import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, least=7, typo_every=31):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return n


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    k = next((k for k, (x, y) in enumerate(zip(u, v)) if x != y), len(u))
    return u != v and (u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else len(v) == len(u) + 1 and u[k:] == v[k + 1 :])


def brute(n, ratio=10):
    near = {w: sorted((-n[o], o) for o in n if one_edit(w, o)) for w in n}
    form = {w: x[0][1] for w, x in near.items() if x and -x[0][0] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def result(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [1, 3, 24])
def test_as_brute_force_for_any_block(spark, block):
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) for _ in range(25)]
    texts = [(k, " ".join(rnd.choice(stems) * rnd.randint(1, 2) + rnd.choice(["", "a", "b"]) for _ in range(60))) for k in range(12)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want = {w: c for w, c in counted(texts, 1, 5).items() if c >= 1}
    assert result(spelling.variants(frame, least=1, min_count=1, ratio=2, typo_every=5, block=block)) == brute(want, 2)


def test_given_texts_and_odd_rows(spark, rows, docs):
    want = {w: c for w, c in counted(rows).items() if c >= 2}
    assert result(spelling.variants(docs)) == brute(want)


def test_forms_lead_to_roots(spark):
    n = {"abcdefgh": 1000, "abcdefg": 100, "abcdef": 10, "abcde": 1, "zbcdefgh": 1, "q": 1}
    frame = spark.createDataFrame([(w, c) for w, c in n.items()], "word string, n long")
    near = {(r.word, r.other) for r in spelling.near_words(frame).collect()}
    assert ("abcde", "abcdef") in near and ("q", "abcde") not in near
    docs = spark.createDataFrame([(1, " ".join([w] * c)) for w, c in n.items()], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling.variants(docs, least=1, min_count=1, typo_every=None).collect()}
    assert got == {"abcdefgh": (None, "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdef": ("abcdefg", "abcdefgh"), "abcde": ("abcdef", "abcdefgh"), "zbcdefgh": ("abcdefgh", "abcdefgh"), "q": (None, "q")}


def test_hot_beginning_and_end(spark):
    """A block that holds all words is subdivided; nothing is compared all against all."""
    rnd = random.Random(5)
    words = {"prefixed" + "".join(rnd.choice("abcd") for _ in range(5)) + "suffixed" for _ in range(500)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.word, r.other) for r in spelling.near_words(frame).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(u, v) for u in words for v in words if one_edit(u, v)}


def test_no_words(spark, none):
    assert spelling.variants(none).collect() == []
    frame = spark.createDataFrame([(None, "abcdefg ABCDEFG × ÷abcdefg"), (1, None), (2, "")], "doc_id long, text string")
    got = result(spelling.variants(frame, min_count=1, typo_every=None))
    assert got == {("abcdefg", None, "abcdefg", 2, 1, None), ("÷abcdefg", None, "÷abcdefg", 1, 1, None)}
