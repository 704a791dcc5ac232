import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bytecnn, classifier, queries
from ledgerlens.llm.bytecnn import ByteCNN, chunks_of, symbols_of

SF = "/root/testdata/sf0.01"


def repeats(text):
    """A byte's symbol by definition."""
    out = [0] * len(text)
    for p in bytecnn.PERIODS:
        for i in range(p, len(text) - bytecnn.LASTING + 1):
            if text[i : i + bytecnn.LASTING] == text[i - p : i - p + bytecnn.LASTING]:
                out[i : i + bytecnn.LASTING] = [256] * bytecnn.LASTING
    return [a + b for a, b in zip(text, out)]


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_symbols(block, monkeypatch):
    monkeypatch.setattr(bytecnn, "BLOCK", block)
    rnd = random.Random(1)
    texts = [b"".join(rnd.choice([b"ab", b"xyz ", b"q", bytes([rnd.randrange(256)])]) * rnd.randint(1, 30) for _ in range(rnd.randint(0, 9))) for _ in range(30)]
    texts += [b"", b"a", b""] * 9 + [b"ab" * 200]
    assert [s.tolist() for s in symbols_of(texts)] == [repeats(t) for t in texts]


def test_chunks_see_every_place_once():
    for n in (1, 8, 511, 512, 513, 1014, 1016, 1017, 5000):
        rows = chunks_of(np.arange(n, dtype=np.uint16) % 500)
        places = [k * bytecnn.STRIDE + p for k in range(len(rows)) for p in range(0, bytecnn.STRIDE, bytecnn.STEP)]
        assert len(rows) == bytecnn.chunks_in(n) and places == list(range(0, len(places) * bytecnn.STEP, bytecnn.STEP))
        assert n <= (len(rows) - 1) * bytecnn.STRIDE + bytecnn.CHUNK and (len(rows) == 1 or n > (len(rows) - 2) * bytecnn.STRIDE + bytecnn.CHUNK)
    assert len(chunks_of(np.zeros(0, np.uint16))) == 0


def test_gradients():
    rng = np.random.default_rng(2)
    model = ByteCNN(filters=3, embed=4)
    model.w = {k: v.astype(float) for k, v in model.w.items()}
    x, doc, y = rng.integers(0, 30, (5, bytecnn.CHUNK)), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    answers = type(model).answers

    def exact(self, x, at=False):  # in double precision, as differences are small
        table = np.einsum("se,pef->psf", self.w["embed"], self.w["conv"])
        z = sum(table[p][x[:, p : p + bytecnn.STRIDE : bytecnn.STEP]] for p in range(bytecnn.WIDTH))
        top = z.max(axis=1) + self.w["bias"]
        return (top, bytecnn.STEP * z.argmax(axis=1)) if at else top

    assert np.allclose(answers(model, x), exact(model, x), atol=1e-3)
    model.answers = exact.__get__(model)
    _, grads = model._loss(x, doc, y)
    for name, g in grads.items():
        w = model.w[name]
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(12)]:
            if name == "embed":
                at = (int(rng.integers(0, 30)), at[1])
            w[at] += 1e-6
            up = model._loss(x, doc, y)[0]
            w[at] -= 2e-6
            down = model._loss(x, doc, y)[0]
            w[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-3 + 0.01 * abs(g[at]), name


def test_score_is_a_texts_own():
    model = ByteCNN()
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"abc de\n") for _ in range(rnd.choice([0, 1, 9, 400, 3000, 90_000]))) for _ in range(25)]
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts], atol=1e-5)
    assert len(model.score([])) == 0


@pytest.fixture(scope="module")
def scored(spark):
    return queries.QUERIES["op12_quality_classifier"](spark, SF).join(queries.table(spark, SF, "labels"), "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    unseen = scored[scored.held_out & scored.quality.notna()]
    good, bad = unseen[unseen.quality == 1].score, unseen[unseen.quality == 0].score
    assert len(bad) >= 5 and np.mean([(g > bad).mean() for g in good]) > 0.95
    assert ((unseen.score >= 0.3) == (unseen.quality == 1)).mean() > 0.93 and (good >= 0.3).mean() > 0.97


def test_held_out_labels_and_other_columns_are_not_read(spark, scored):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.score(docs.withColumns({"lang": F.lit("x"), "score": F.lit(1), "label": F.lit(0)}).drop("n_chars"), turned)
    got = {r.doc_id: r.score for r in again.collect()}
    assert got == dict(zip(scored.doc_id, scored.score))


def test_the_end_of_a_long_text_counts(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    model = ByteCNN()
    model.w = classifier.trained(classifier.labelled_chunks(docs, labels, "doc_id", "text", "quality", 5))
    clean = " ".join(r.text for r in docs.join(labels, "doc_id").where("quality = 1 and lang = 'en'").orderBy("doc_id").limit(30).collect()).encode()
    one, both = model.score([clean, clean + b"Onan*** with*** ored*** at%% tible### was&&& " * 2000])
    assert one > 0.5 > both


def test_defined_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    alone = classifier.score(docs, labels).toPandas()
    assert len(alone) == docs.count() and alone.score.nunique() == 1
    assert alone[alone.doc_id.isna()].held_out.all()
    assert classifier.score(none, labels).collect() == []
    both = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (2004, 1), (2002, 0), (2000, 0)], "doc_id long, quality int")
    got = classifier.score(docs, both).toPandas()
    assert got.score.between(0, 1).all() and got[got.doc_id.isin([2000, 2001])].score.nunique() == 1


def test_spread_chunks(spark):
    texts = [(0, ""), (1, "é" * 100), (2, "x" * 5000 + "y" * 100), (3, "z" * 512), (4, "z" * 513)]
    frame = spark.createDataFrame(texts, "i long, text string")
    got = {r.i: [bytes(c) for c in r.c] for r in frame.select("i", classifier.spread_chunks(F.col("text")).alias("c")).collect()}
    assert got[0] == [] and got[1] == ["é".encode() * 50 + "é".encode() * 50][:1] and len(got[3]) == 1 and len(got[4]) == 2
    n = bytecnn.chunks_in(5100)
    assert len(got[2]) == classifier.SAMPLE_CHUNKS and got[2][0] == b"x" * 512 and got[2][-1] == (b"x" * 5000 + b"y" * 100)[(n - 1) * bytecnn.STRIDE :]
