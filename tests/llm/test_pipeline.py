import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontam, linededup, quality, simhash
from ledgerlens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontaminate", "bpe"]
    for _, after in stages[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS)


def test_quality_stage_keeps_what_is_judged_good(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in quality.judge(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and kept


def test_line_stage_keeps_all_documents(stages):
    before, after = stages[1]
    want = {r.doc_id: r.text for r in linededup.deduplicate(before).collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert {i: t for i, (t, _) in got.items()} == want and all(len(t) == n for t, n in got.values())


def test_near_copies_leave_one_of_each_group(stages):
    before, after = stages[2]
    rows = {r.doc_id: set(simhash.shingles(r.text, 5)) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert kept == {i for i in ids if root(i) == i}


def test_leaks_go_and_clean_documents_stay(spark, stages):
    before, after = stages[3]
    leaks = {r.doc_id for r in decontam.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks and leaks


def test_tokens_of_every_text(stages):
    before, after = stages[4]
    own = bpe.WordBPE(tokenizer_path())
    text = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert bytes(r.token_ids) == own.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) // 4
    assert after.count() == len(text)


def test_run_gives_the_last_stage(spark, stages):
    want = stages[-1][1]
    assert corpus_pipeline.run(spark, SF).exceptAll(want).count() == 0


def test_stages_take_odd_rows(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        stage(spark, docs, SF).count()


def test_a_repeated_one_line_passage_goes(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n {passage}\nd\nshort line"), (3, passage), (4, "e\nshort line\nf")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, frame, SF).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("c\nd\nshort line", 14), 3: ("", 0), 4: ("e\nshort line\nf", 14)}


def test_leaks_go_by_row_and_not_by_id(spark):
    leak = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    rows = [(1, leak), (1, "clean"), (None, leak), (None, "clean too"), (2, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.decontaminate(spark, frame, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, "clean"), (None, "clean too"), (2, None)], key=str)


def test_near_stage_counts_rows_of_one_id_once(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_dedup(spark, frame, SF).select(F.count("*")).first()[0] == 2


def test_near_stage_links_by_fingerprint_and_by_shingles(spark):
    """A refrain with other verses is near by SimHash alone; an edited text, by its shingles alone."""
    words = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    refrain, edited = " ".join(words("r", 7)) + " ", words("e", 180)
    other = [f"o{k}" if k in (30, 70, 110) else w for k, w in enumerate(edited)]
    texts = {1: refrain * 90 + " ".join(words("a", 15)), 2: refrain * 90 + " ".join(words("b", 15)), 3: " ".join(edited), 4: " ".join(other), 5: " ".join(words("x", 80))}
    sets = {i: set(simhash.shingles(t, 5)) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    bits = lambda a, b: (simhash.fingerprint_of(texts[a], 3) ^ simhash.fingerprint_of(texts[b], 3)).bit_count()
    assert not alike(1, 2) and bits(1, 2) <= 3 and alike(3, 4) and bits(3, 4) > 3
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()) == [1, 3, 5]
