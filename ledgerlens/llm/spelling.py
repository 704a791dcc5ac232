"""Spelling variants: words one edit apart, grouped under their common form.

Two words are near if one inserted, deleted or replaced code point makes them
equal.  One edit leaves a half intact: of two words whose shorter one has ``s``
code points, either the first ``s // 2`` agree or the last ``s - s // 2``.  So
words are filed twice, in a dictionary by their beginnings and in one by the
beginnings of the reversed words, once for every ``s`` that they can have in a
pair (their own length, and one less as the longer word).  The words of one
entry are a range of the sorted dictionary, a block, and only they are compared.

Blocks of more than ``BLOCK`` words are subdivided before anything is compared.
What two words of a block share is a beginning of ``a`` and an end of ``b`` code
points, so the edit is among the ``s - a - b`` between them, and again one half
of those is intact: each word goes to two narrower blocks.  Sizes are counted
beforehand, so that no block is ever gathered to find that it is too large.  Once
a single place is left, a block holds words that differ there alone; the letters
bound it.

A pair stands in several blocks, but one of them has the place at which the two
words first differ between its shared beginning and its shared end; there the
pair is verified and counts, so nothing has to be made distinct afterwards.

``form`` is the near word of largest count (ties: the smallest by code points)
if that is at least ``ratio`` times the word's own; ``root`` is where the forms
lead in the end.  Counts grow along forms, so there are no circles, and roots are
found by pointer doubling in few steps.

Occurrences: maximal runs of letters, A-Z lower-cased.  The operator can leave
out a letter of some of them, as typists do (``typo_every``): by a checksum of
id and run, always the same ones.

Defined results: a null text has no words; a null id reads as an empty one;
repeated rows count each; words are compared whole, however long; a table
without words gives an empty table; further columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_to_empty, small, written

#: Blocks of more words are subdivided.
BLOCK = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what words are made of.
LETTERS = "[A-Za-zÀ-ÿ]"
AT = ("s", "a", "b", "shared")


def lowered(run: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words_of(docs: DataFrame, least: int, typo_every: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of all occurrences of ``least`` code points and more."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = docs.select(blank_to_empty(F.col(f"`{id_col}`").cast("string")).alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("word"))
    if typo_every:
        h, word = F.crc32(F.concat_ws(":", "id", "word").cast("binary")), F.col("word")
        rows = rows.select("word", h.alias("h"))
        at = (F.col("h") % F.char_length(word)).cast("int")
        without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
        rows = rows.select(F.when(F.col("h") % typo_every == 0, without).otherwise(word).alias("word"))
    return rows.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _filed(rows: DataFrame) -> DataFrame:
    """Each row in the two narrower blocks: ``a`` or ``b`` grow by half of what is between."""
    between = F.col("s") - F.col("a") - F.col("b")
    half = F.floor(between / 2).cast("int")
    wider = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + between - half).alias("b")))
    rows = rows.select("word", "n", "size", "s", F.explode(wider).alias("at")).select("word", "n", "size", "s", "at.a", "at.b")
    beginning, end = F.substring("word", F.lit(1), F.col("a")), F.substring(F.reverse("word"), F.lit(1), F.col("b"))
    # the marks keep apart where the one ends and the other begins
    return rows.withColumn("shared", F.concat_ws("|", beginning, end))


def _near(block_rows: DataFrame) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n`` of the pairs of each block, both ways."""
    one = block_rows.where("size = s").select(*AT, F.col("word").alias("u"), F.col("n").alias("un"))
    two = block_rows.select(*AT, F.col("word").alias("v"), F.col("n").alias("vn"), "size")
    u, v = F.col("u"), F.col("v")
    ordered = (F.col("size") > F.col("s")) | (u < v)
    # those that agree up to where the shared end begins are another block's
    upto = F.col("s") - F.col("b")
    here = (F.col("b") == 0) | (F.substring(u, F.lit(1), upto) != F.substring(v, F.lit(1), upto))
    pairs = one.join(two, list(AT)).where(ordered & here & (F.levenshtein(u, v, 1) == 1))
    ways = F.array(F.struct(u.alias("word"), v.alias("other"), F.col("vn").alias("other_n")), F.struct(v.alias("word"), u.alias("other"), F.col("un").alias("other_n")))
    return pairs.select(F.inline(ways))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``other``, ``other_n`` of all near words; ``words`` has ``word`` and ``n``."""
    own = words.select("word", "n", F.char_length("word").alias("size"))
    roles = F.array(F.col("size"), F.col("size") - 1)
    rows = _filed(own.select("*", F.explode(roles).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b")).where("s > 0"))
    done = []
    while True:
        sizes = rows.groupBy(*AT).agg(F.count("*").alias("members"))
        # at one place left the letters bound a block
        large = written(sizes.where((F.col("members") > block) & (F.col("s") - F.col("a") - F.col("b") > 1)).select(*AT), "large_blocks")
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, [*done, _near(rows)])
        listed = small(large)
        done.append(written(_near(rows.join(listed, list(AT), "left_anti")), "near_words"))
        rows = written(_filed(rows.join(listed, list(AT), "left_semi")), "narrower_blocks")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``; ``forms`` has ``word`` and ``form``, without circles."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        inner = written(now.join(now.select(F.col("root").alias("word")).distinct(), "word", "left_semi"), "inner_forms")
        if inner.isEmpty():
            return now
        step = small(inner).select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, least: int = 7, min_count: int = 2, ratio: int = 10, typo_every: int | None = 31, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word of ``min_count`` occurrences: ``word``, ``n``, ``n_near``,
    ``form`` and ``form_n`` (null if none), ``root``."""
    words = written(words_of(docs, least, typo_every, id_col, text_col).where(F.col("n") >= min_count), "words")
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    form_n = -F.col("best.less")
    has_form = form_n >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, form_n).alias("form_n"))
    judged = written(judged, "judged_words")
    found = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(least: int = 7, min_count: int = 2, ratio: int = 10, typo_every: int = 31) -> str:
    """Rows of the query in DuckDB SQL: words without one letter meet."""
    return rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{LETTERS}{{{least},}}')), '{UPPER}', '{LOWER}') AS w FROM documents),
g AS (SELECT id, w, count(*) AS n, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x)::BIGINT >> 6), 128 | (unicode(x)::BIGINT & 63)] END)) AS b FROM r GROUP BY id, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM g, t),
o AS (SELECT CASE WHEN h % {typo_every} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {min_count}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (SELECT x.word, y.word AS other, y.n AS other_n FROM d AS x JOIN d AS y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, other := other)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {ratio} * n THEN best.other END AS form, CASE WHEN -best.less >= {ratio} * n THEN -best.less END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word)
SELECT f.word, form, coalesce(e.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON e.word = f.word
"""
