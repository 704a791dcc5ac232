"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Each rule compares one measure of a text with a cutoff.  Cutoffs come from a
fixed grid, and all rules are tightened together along one fixed path: the first
cutoff of every rule in turn, then the second of every rule, and so on.  Nothing
of this depends on the labels.  A point of the path rejects what any rule rejects
with its cutoff there, so points are nested, and every document has a first
point that rejects it.

For every stratum the points are tried from the most lenient one on: of the
labelled good documents of the stratum (the holdout) it counts those that the
point rejects, and the exact binomial tail says how likely so few were if the
true rate of false rejections, by all rules together, were ``alpha``.  The path
is followed while that is at most ``delta / strata``.  Trying nested points in a
fixed order needs no further correction, and the strata are corrected by
Bonferroni.  So, with probability ``1 - delta``, in every stratum at most
``alpha`` of the good documents are rejected.  A stratum can have cutoffs from
some 150 good labels on (with ``alpha`` 0.03 and four strata); with fewer it
rejects nothing beyond the base rules.

Defined results: a null text has no words and fails the base rules; a null
stratum is a stratum of its own; labels without id or value are left out, and
of several labels of one document the least counts; several rows of one
document are measured each; an empty holdout selects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
#: Positions take this many bits beside the hash; longer texts are sorted whole.
POSITION_BITS = 20


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _equal_neighbours(ordered: Column, key) -> Column:
    """The entries whose key equals that of a neighbour."""
    n = F.size(ordered)
    return F.filter(
        ordered,
        lambda x, k: F.coalesce((k > 0) & (key(F.get(ordered, k - 1)) == key(x)), F.lit(False))
        | F.coalesce((k < n - 1) & (key(F.get(ordered, k + 1)) == key(x)), F.lit(False)),
    )


def repeat_words(hashes: Column) -> Column:
    """Words in 3-word windows found twice or more, from the windows' hashes.

    Hash and position share one long, so that the sort is one of plain longs;
    what agrees in the shared bits is compared in full.
    """
    low = (1 << POSITION_BITS) - 1
    packed = F.sort_array(F.transform(hashes, lambda h, k: h.bitwiseAND(F.lit(~low)).bitwiseOR(k.cast("bigint"))))
    near = _let(packed, lambda p: F.transform(_equal_neighbours(p, lambda x: F.shiftright(x, POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    every = F.sequence(F.lit(0), F.size(hashes) - 1)
    maybe = F.when(F.size(hashes) <= low, near).otherwise(every)
    exact = _let(F.array_sort(F.transform(maybe, lambda k: F.struct(F.get(hashes, k).alias("h"), k.alias("k")))), lambda s: _equal_neighbours(s, lambda x: x["h"]))
    at = F.sort_array(F.transform(exact, lambda x: x["k"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, k: F.struct(k.alias("last"), (acc["n"] + F.least(F.lit(3), k - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("bigint"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts in ``MEASURES``; columns of these names are replaced."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = df.withColumn("_words", words_of(text))
    out = out.withColumn(
        "_hashes",
        F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda k: F.xxhash64(F.get("_words", k), F.get("_words", k + 1), F.get("_words", k + 2)))),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    big = lambda c: c.cast("bigint")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in MEASURES],
        big(F.size("_words")).alias("n_words"),
        big(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        big(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        big(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeat_words(F.col("_hashes")).alias("n_repeat_words"),
        big(F.size("_lines")).alias("n_lines"),
        big(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_capitals"),
        big(F.regexp_count(text, F.lit("[!?]"))).alias("n_marks"),
    )


@dataclass(frozen=True)
class Rule:
    """Rejects where ``1000 * part`` is over (or, ``below``, under) ``cutoff * whole``."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]  # from the most lenient on, in thousandths
    below: bool = False

    def rejects(self, cutoff: Column) -> Column:
        left, right = F.lit(1000) * F.col(self.part), cutoff * F.col(self.whole)
        return left < right if self.below else left > right


def _grid(lenient: int, strict: int, steps: int = 24) -> tuple[int, ...]:
    """Cutoffs in equal ratios."""
    return tuple(dict.fromkeys(round(lenient * (strict / lenient) ** (k / (steps - 1))) for k in range(steps)))


RULES = (
    Rule("symbols", "n_symbols", "n_words", _grid(4000, 50)),
    Rule("capitals", "n_capitals", "word_chars", _grid(900, 150)),
    Rule("marks", "n_marks", "n_words", _grid(2000, 50)),
    Rule("repeats", "n_repeat_words", "n_words", _grid(500, 150)),
    Rule("dup_lines", "n_dup_lines", "n_lines", _grid(900, 300)),
    Rule("long_words", "word_chars", "n_words", _grid(20000, 9000)),
    Rule("short_words", "word_chars", "n_words", _grid(1500, 2500), below=True),
)
#: Points of the path: all cutoffs of all rules.
POINTS = len(RULES) * max(len(r.cutoffs) for r in RULES)


def point_of(step: int, rule: int) -> int:
    """The point at which a rule takes its cutoff number ``step``."""
    return step * len(RULES) + rule


def first_point() -> Column:
    """The first point that rejects a document, ``POINTS`` if none does."""
    points = []
    for n, r in enumerate(RULES):
        at = F.lit(POINTS)
        for k in reversed(range(len(r.cutoffs))):
            at = F.when(r.rejects(F.lit(r.cutoffs[k])), point_of(k, n)).otherwise(at)
        points.append(at)
    return F.least(*points)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), term by term from the logarithm of the first."""
    import math

    first = n * F.lit(math.log1p(-p))
    odds = F.lit(math.log(p / (1 - p)))
    start = F.struct(first.cast("double").alias("term"), F.exp(first).cast("double").alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    return F.when(k <= 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint")), start, step, lambda acc: acc["total"]))


def reached(points: DataFrame, alpha: float, delta: float) -> DataFrame:
    """``_stratum`` and the strictest point (``at``) that its holdout allows.

    ``points`` has ``_stratum``, ``point`` and ``n``, the good documents that are
    first rejected there.
    """
    strata = max(1, points.select("_stratum").distinct().count())
    whole = Window.partitionBy("_stratum")
    upto = whole.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    tried = points.select("_stratum", "point", F.sum("n").over(whole).alias("n"), F.sum("n").over(upto).alias("k"))
    # beyond the mean the tail is near a half or more, so it isn't summed there
    tail = lambda k: F.when(k <= F.col("n") * alpha, binomial_tail(k, F.col("n"), alpha)).otherwise(F.lit(1.0))
    tried = tried.select("_stratum", "point", tail(F.col("k")).alias("tail"), tail(F.lit(0).cast("bigint")).alias("least"))
    level = delta / strata
    fails = F.when((F.col("point") < POINTS) & (F.col("tail") > level), F.col("point"))
    ends = tried.groupBy("_stratum").agg(F.min("least").alias("least"), (F.coalesce(F.min(fails), F.lit(POINTS)) - 1).alias("at"))
    return ends.where((F.col("at") >= 0) & (F.col("least") <= level)).select("_stratum", "at")


def cutoff_at(rule: int, at: Column) -> Column:
    """A rule's cutoff at a point; null before its first."""
    cutoffs = F.array(*map(F.lit, RULES[rule].cutoffs))
    step = F.floor((at - rule) / len(RULES)).cast("int")
    return F.when(step >= 0, F.get(cutoffs, F.least(step, F.size(cutoffs) - 1)))


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, stratum_col: str, id_col: str, label_col: str) -> DataFrame:
    """A row for each stratum with a cutoff (or null) for each rule's name."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).where("_label = 1")
    held = measured.join(good, measured[id_col] == good["_id"], "left_semi")
    points = written(held.groupBy(F.col(stratum_col).alias("_stratum"), first_point().alias("point")).agg(F.count("*").alias("n")), "points")
    return reached(points, alpha, delta).select("_stratum", *[cutoff_at(k, F.col("at")).alias(f"_cut_{r.name}") for k, r in enumerate(RULES)])


#: With at most this many strata the cutoffs are broadcast.
BROADCAST_STRATA = 4096


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_columns: bool = False) -> DataFrame:
    """Measures and verdict of every row: ``base_failed``, ``failed_rules``, ``kept``.

    With ``keep_columns`` all columns of ``docs`` come along, text included.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns] if keep_columns else [F.col(f"`{id_col}`"), F.col(f"`{stratum_col}`"), F.col(f"`{text_col}`")]
    measured = measures(docs.select(*kept, F.col(f"`{stratum_col}`").alias("_of")), text_col).drop("_words", "_hashes", "_lines")
    if not keep_columns:
        measured = measured.drop(text_col)
    measured = written(measured, "measures")
    cutoffs = written(select_cutoffs(measured, labels, alpha, delta, "_of", id_col, label_col), "cutoffs")
    small = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs
    joined = measured.join(small, measured["_of"].eqNullSafe(small["_stratum"]), "left")
    failed = F.array_compact(F.array(*[F.when(r.rejects(F.col(f"_cut_{r.name}")), F.lit(r.name)) for r in RULES]))
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_of", "_stratum", *[f"_cut_{r.name}" for r in RULES])


def oracle_sql(alpha: float = 0.03, delta: float = 0.05) -> str:
    """The query's rows in DuckDB SQL."""
    words = r"[^\x20\x09-\x0D]+"
    rejects = lambda r, cutoff: f"1000 * {r.part} {'<' if r.below else '>'} {cutoff} * {r.whole}"
    first = ", ".join("CASE " + " ".join(f"WHEN {rejects(r, c)} THEN {point_of(k, n)}" for k, c in enumerate(r.cutoffs)) + f" ELSE {POINTS} END" for n, r in enumerate(RULES))
    fails = " OR ".join(f"coalesce({rejects(r, f'c.{r.name}')}, false)" for r in RULES)
    cuts = ", ".join(f"CASE WHEN reach >= {n} THEN ({list(r.cutoffs)})[least((reach - {n}) // {len(RULES)}, {len(r.cutoffs) - 1}) + 1] END AS {r.name}" for n, r in enumerate(RULES))
    tail = lambda k: f"CASE WHEN {k} <= n * {alpha!r}::DOUBLE THEN list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}::DOUBLE) + (n - i) * ln(1 - {alpha!r}::DOUBLE)))) ELSE 1.0 END"
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{words}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks
    FROM w LEFT JOIN repw USING (doc_id)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM m WHERE doc_id IN (SELECT doc_id FROM good)),
points AS (SELECT lang, least({first}) AS point, count(*) AS n FROM held GROUP BY ALL),
tried AS (SELECT lang, point, sum(n) OVER (PARTITION BY lang) AS n, sum(n) OVER (PARTITION BY lang ORDER BY point) AS k FROM points),
tails AS (SELECT lang, point, n, {tail('k')} AS tail, {tail('0')} AS least_tail FROM (SELECT lang, point, n::BIGINT AS n, k::BIGINT AS k FROM tried)),
level AS (SELECT {delta!r}::DOUBLE / greatest(1, (SELECT count(*) FROM (SELECT DISTINCT lang FROM points))) AS level),
ends AS (SELECT lang, coalesce(min(point) FILTER (WHERE point < {POINTS} AND tail > level), {POINTS}) - 1 AS reach FROM tails, level GROUP BY lang, level HAVING min(least_tail) <= level),
cuts AS (SELECT lang, {cuts} FROM ends WHERE reach >= 0)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({fails}) AS kept
FROM m LEFT JOIN cuts c ON m.lang IS NOT DISTINCT FROM c.lang
"""
