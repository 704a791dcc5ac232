"""The corpus pipeline: five operators, one after the other, over documents.

Every stage takes all rows that the one before kept.  The first four return the
columns of ``documents``; the last adds the tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontam, linededup, quality, simhash
from ledgerlens.llm.common import scratch_run, small, written
from ledgerlens.llm.queries import table, tokenizer_path
from ledgerlens.staging import delete, new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no risk-controlled cutoff rejects."""
    judged = quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep_columns=True)
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines.

    A single line counts as a run if it has over ``linededup.PASSAGE_WORDS`` words.
    """
    out = linededup.deduplicate(docs.select(*COLUMNS))
    length = F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Texts are near copies if their SimHash fingerprints, as ``op3_simhash`` has them,
    differ in at most three bits.  Near copies that lie further apart are linked by
    their shared shingles, so that none at that similarity is lost; groups are what
    either kind of link joins.  Rows of one id count as one document; rows without
    id stay.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = named.select("key", "text")
    found = [simhash.near_duplicates(texts, size=3, threshold=3, id_col="key"), simhash.similar_groups(texts, size=5, similarity=0.8, id_col="key")]
    either = reduce(DataFrame.unionAll, [f.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for f in found])
    roots = simhash.components(either)
    least = written(named.groupBy("key").agg(F.min("doc_id").alias("least")), "least")
    of_group = least.join(small(roots.withColumnRenamed("node", "key")), "key", "left").groupBy(F.coalesce("root", "key").alias("root"))
    firsts = of_group.agg(F.min("least").alias("doc_id")).select("doc_id", F.lit(True).alias("first")).distinct()
    ids = written(named.groupBy("doc_id").agg(F.count("*").alias("n")).join(firsts, "doc_id", "left"), "ids")
    gone, repeated = ids.where("first is null").select("doc_id"), ids.where("first and n > 1").select("doc_id")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)
    if repeated.isEmpty():
        return left
    many = small(repeated)
    one = left.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(many, "doc_id", "left_anti").unionByName(one).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any phrase of ten words from the benchmark.

    Every row is judged by its own text, with or without an id: leaks are named
    by a hash of the text, so that equal texts fare alike.
    """
    docs = docs.select(*COLUMNS)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontam.decontaminate(docs.select(text.alias("row"), "text"), table(spark, sf_dir, "benchmark"), length=10, doc_id="row")
    leaks = written(found.where("n_hit > 0").select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return docs.withColumn("row", text).join(small(leaks), "row", "left_anti").select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every whole text and what they decode to."""
    out = bpe.encode_documents(docs.select(*COLUMNS), tokenizer_path(), ids_col="token_ids", decoded_col="decoded")
    return out.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe_tokens),
]

#: SQL can't express the near-duplicate groups; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written and read again by the next.

    What a stage wrote on its way goes once its rows are written, and those go
    once the next stage's are; what the result reads stays until the driver ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch_run(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
