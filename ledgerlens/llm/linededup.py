"""Line dedup by a suffix array over line numbers, built by prefix doubling.

Every line with a word is a symbol; a document is the sequence of its symbols,
and runs never cross documents.  Prefix doubling ranks the suffixes of all
sequences by their first 1, 2, 4, ... lines: the distinct pairs (rank of h lines
here, rank of h lines on) are sorted over the cluster, and a pair's place in
that order is the rank of 2 h lines.  Suffixes with one rank are neighbours in
the suffix array.  A pair that stands once has no repeat of that length, so its
suffix drops out; each round handles only what is still repeated, and rounds
end when nothing is.

Suffixes with equal ranks form the longest-common-prefix intervals.  The
interval of depth ``min_lines`` holds all places of a run.  Its smallest
(document, line) is kept; at every other place the copy goes on for the longest
common prefix of the two suffixes, which is read off the ranks from the largest
power of two down.  Places that continue the run of the line before them are
part of it, so only the first of each maximal run is followed.  These prefixes
are what is deleted.

Lines compare without white space at their ends.  Lines without a word are no
symbols and stay, as do all lines outside later copies.

Only ranks and places travel by symbol; sorting and counting go over distinct
pairs, so that a line in a third of all documents weighs one entry a task.  A
text is shuffled once, to meet its own deletions.

Defined results: a null text has no lines and stays null; documents come in the
order of their ids (null last), rows of one id in any fixed order; exact
repeats of a row count as copies of each other; an empty table gives an empty
table.  A text whose lines all go becomes the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: A repeated line of more words is a passage, not boilerplate.
PASSAGE_WORDS = 50
SPACE = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0d]+"
PLACE = "row bigint, at int, lines int"


def line_symbols(rows: DataFrame) -> DataFrame:
    """``row``, ``id``, ``at`` (place among lines with words), ``x`` and ``y``
    (a 128-bit name of the line) and ``passage``."""
    trimmed = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    line = F.col("line")
    # that many words have as many blanks between them
    passage = (F.char_length(line) > 2 * PASSAGE_WORDS) & (F.size(F.split(line, BLANKS)) > PASSAGE_WORDS)
    return rows.select("row", "id", F.posexplode(trimmed).alias("at", "line")).select("row", "id", "at", F.xxhash64(line).alias("x"), F.xxhash64(F.lit("second"), line).alias("y"), passage.alias("passage"))


def ranked(pairs: DataFrame) -> DataFrame:
    """``row``, ``id``, ``at`` and ``rank`` of the pairs (x, y) that stand twice or more.

    Ranks ascend in the order of the pairs.  Pairs are counted with partial
    sums and sorted once each; a short list of them goes to the suffixes, and a
    longer one meets them in a join without grouping above it, so that Spark
    splits frequent pairs.
    """
    often = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    # after a sort this number ascends from partition to partition
    order = written(often.orderBy("x", "y").withColumn("rank", F.monotonically_increasing_id()), "order")
    return written(pairs.join(small(order), ["x", "y"]).select("row", "id", "at", "rank"), "ranks")


def doubled(ranks: DataFrame, h: int) -> DataFrame:
    """Pairs of the rank here (``x``) and that ``h`` lines on (``y``)."""
    on = Window.partitionBy("row").orderBy("at").rangeBetween(h, h)
    return ranks.select("row", "id", "at", F.col("rank").alias("x"), F.first("rank").over(on).alias("y")).where("y is not null")


def suffix_ranks(symbols: DataFrame) -> list[tuple[int, DataFrame]]:
    """(h, repeated suffixes with their rank by h lines), from h = 1 on."""
    levels, h = [], 1
    ranks = ranked(symbols)
    while not ranks.isEmpty():
        levels.append((h, ranks))
        ranks = ranked(doubled(ranks, h))
        h *= 2
    return levels


def suffix_array(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rank``, ``row``, ``at`` and ``depth`` of the suffixes that repeat, sorted.

    ``depth`` is the largest power of two of lines that a suffix shares with
    another; ``rank`` orders the suffixes of one depth.
    """
    every = None
    for k, (h, ranks) in enumerate(levels):
        own = ranks if k + 1 == len(levels) else ranks.join(levels[k + 1][1].select("row", "at"), ["row", "at"], "left_anti")
        own = own.select(F.lit(h).alias("depth"), "rank", "row", "at")
        every = own if every is None else every.unionAll(own)
    return every.orderBy("depth", "rank", "row", "at")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("at").alias("at"))


def later_places(members: DataFrame, *interval: str) -> DataFrame:
    """``row``, ``at`` and the ``first`` place of the interval, of all but that."""
    least = written(members.groupBy(*interval).agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    return members.join(small(least), list(interval)).where(_place() > F.col("first")).select("row", "at", "first")


def maximal_copies(levels: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame | None:
    """``row``, ``at`` and ``lines`` of the maximal later copies, if there are any."""
    h = max((h for h, _ in levels if h <= min_lines), default=0)
    if 2 * h <= min_lines:
        return None
    ranks = dict(levels)[h]
    # two ranks that overlap spell a run between two powers
    members = ranks.withColumnRenamed("rank", "x").withColumn("y", F.lit(0)) if min_lines == h else doubled(ranks, min_lines - h)
    later = later_places(members, "x", "y").select("row", "at", F.col("first.row").alias("from_row"), F.col("first.at").alias("from_at"))
    before = Window.partitionBy("row").orderBy("at")
    goes_on = (F.lag("at").over(before) == F.col("at") - 1) & (F.lag("from_row").over(before) == F.col("from_row")) & (F.lag("from_at").over(before) == F.col("from_at") - 1)
    found = written(later.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).where("not goes_on").select("row", "at", "from_row", "from_at", F.lit(0).alias("lines")), "copies")
    for h, ranks in reversed(levels):
        here = ranks.select("row", F.col("at").alias("p"), F.col("rank").alias("here"))
        there = ranks.select(F.col("row").alias("from_row"), F.col("at").alias("q"), F.col("rank").alias("there"))
        tried = found.withColumns({"p": F.col("at") + F.col("lines"), "q": F.col("from_at") + F.col("lines")}).join(here, ["row", "p"], "left").join(there, ["from_row", "q"], "left")
        same = F.coalesce(F.col("here") == F.col("there"), F.lit(False))
        found = written(tried.select("row", "at", "from_row", "from_at", F.when(same, F.col("lines") + h).otherwise(F.col("lines")).alias("lines")), "copies")
    return found.select("row", "at", "lines")


def deletions(copies: DataFrame) -> DataFrame:
    """Per ``row``: ``gone``, the ascending disjoint (start, end) of what copies
    cover, and ``longest``, the lines of the longest copy."""
    before = Window.partitionBy("row").orderBy("at", "lines").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("lines")
    pieces = copies.select("row", "lines", F.greatest("at", F.max(end).over(before)).alias("start"), end.alias("end"))
    some = F.when(F.col("end") > F.col("start"), F.struct("start", "end"))
    return pieces.groupBy("row").agg(F.array_sort(F.collect_list(some)).alias("gone"), F.max("lines").cast("bigint").alias("longest"))


ADDED = ("n_lines", "n_removed_lines", "n_runs", "longest_run")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(lines: Column, worded: Column, gone: Column) -> Column:
    """The text of ``lines`` without those in ``gone``, numbered as in ``worded``."""
    numbers = F.flatten(F.transform(gone, lambda g: F.slice(worded, g["start"] + 1, g["end"] - g["start"])))

    def between(edges: Column) -> Column:
        kept = lambda k: F.slice(lines, F.get(edges, k) + 2, F.get(edges, k + 1) - F.get(edges, k) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), kept))

    return F.array_join(_let(F.concat(F.array(F.lit(-1)), numbers, F.array(F.size(lines))), between), "\n")


def deduplicate(docs: DataFrame, min_lines: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text.

    Runs have ``min_lines`` lines and more.  If that isn't given they have two
    and more, and a line of over ``PASSAGE_WORDS`` words is a run by itself.

    New columns: ``n_lines`` (with a word), ``n_removed_lines``, ``n_runs``
    (maximal deleted runs) and ``longest_run`` (lines of the longest later
    copy); columns of these names are replaced.
    """
    passages = min_lines is None
    payload = [c for c in docs.columns if c not in ADDED and c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in payload]).alias("rest"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows")
    symbols = written(line_symbols(rows), "symbols")
    levels = suffix_ranks(symbols)
    copies = maximal_copies(levels, 2 if passages else min_lines) if levels else None
    copies = docs.sparkSession.createDataFrame([], PLACE) if copies is None else copies
    if passages:
        copies = copies.unionAll(later_places(symbols.where("passage"), "x", "y").select("row", "at", F.lit(1).alias("lines")))
    joined = rows.join(written(deletions(copies), "deletions"), "row", "left")

    def judged(v: Column) -> Column:
        lines, worded = v["lines"], F.filter(v["numbers"], lambda k: k.isNotNull())
        return _let(worded, lambda w: F.struct(F.size(w).cast("bigint").alias("n_lines"), F.when(v["gone"].isNotNull(), _without(lines, w, v["gone"])).alias("left")))

    lines = F.split("text", "\n", -1)
    numbers = F.transform(lines, lambda x, k: F.when(F.btrim(x, F.lit(SPACE)) != "", k))
    seen = joined.select("rest", "text", "gone", "longest", F.when(F.col("text").isNotNull(), _let(F.struct(lines.alias("lines"), numbers.alias("numbers"), F.col("gone").alias("gone")), judged)).alias("seen"))
    removed = F.aggregate("gone", F.lit(0).cast("bigint"), lambda n, g: n + g["end"] - g["start"])
    runs = F.size(F.filter("gone", lambda g, k: (k == 0) | (F.get("gone", k - 1)["end"] != g["start"]))).cast("bigint")
    zero = F.lit(0).cast("bigint")
    out = seen.select(
        "rest",
        F.coalesce("seen.left", "text").alias("text"),
        F.coalesce("seen.n_lines", zero).alias("n_lines"),
        F.coalesce(removed, zero).alias("n_removed_lines"),
        F.when(F.col("gone").isNull(), zero).otherwise(runs).alias("n_runs"),
        F.coalesce("longest", zero).alias("longest_run"),
    )
    kept = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns if c in payload or c == text_col]
    return out.select(*kept, *ADDED)


def oracle_sql(min_lines: int | None = None) -> str:
    """Rows of the query in DuckDB SQL: windows of lines, then how far copies go on."""
    n = min_lines or 2
    window = ", ".join(f"lead(x, {k}) OVER w AS x{k}" for k in range(n))
    keys = ", ".join(f"x{k}" for k in range(n))
    blank = r"[\x20\x09-\x0D]+"
    passage = f"""UNION ALL SELECT r, p, 1 FROM (SELECT r, p, row_number() OVER (PARTITION BY x ORDER BY r, p) AS nth FROM a
    WHERE len(string_split_regex(x, '{blank}')) > {PASSAGE_WORDS}) WHERE nth > 1""" if min_lines is None else ""  # fmt: skip
    return f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r FROM documents),
s AS (SELECT r, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT r, unnest(ls) AS raw, unnest(range(len(ls))) AS line FROM s),
t AS (SELECT r, line, raw, regexp_replace(raw, '^{blank}|{blank}$', '', 'g') AS x FROM l),
a AS (SELECT r, line, x, row_number() OVER (PARTITION BY r ORDER BY line) AS p FROM t WHERE x <> ''),
g AS (SELECT r, p, {window} FROM a WINDOW w AS (PARTITION BY r ORDER BY p)),
f AS (SELECT r, p, first_value(r) OVER w AS fr, first_value(p) OVER w AS fp FROM g WHERE x{n - 1} IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY r, p)),
o AS (SELECT *, lag(p) OVER w IS DISTINCT FROM p - 1 OR lag(fr) OVER w IS DISTINCT FROM fr OR lag(fp) OVER w IS DISTINCT FROM fp - 1 AS opens FROM f WHERE (r, p) <> (fr, fp) WINDOW w AS (PARTITION BY r ORDER BY p)),
y AS (SELECT r, p, fr, fp FROM o WHERE opens),
z AS (SELECT y.r, y.p, min(CASE WHEN b.x IS DISTINCT FROM e.x THEN e.p - y.p END) AS differs, max(e.p) - y.p + 1 AS rest
    FROM y JOIN a AS e ON e.r = y.r AND e.p >= y.p LEFT JOIN a AS b ON b.r = y.fr AND b.p = y.fp + e.p - y.p GROUP BY y.r, y.p),
c AS (SELECT r, p, coalesce(differs, rest) AS n FROM z {passage}),
e AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(p, p + n)) AS p FROM c)),
q AS (SELECT a.r, a.p, a.line, e.p IS NOT NULL AS gone FROM a LEFT JOIN e ON e.r = a.r AND e.p = a.p),
u AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS starts FROM q),
n AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_runs FROM u GROUP BY r),
k AS (SELECT t.r, string_agg(raw, chr(10) ORDER BY t.line) AS kept FROM t LEFT JOIN q ON q.r = t.r AND q.line = t.line WHERE NOT coalesce(q.gone, false) GROUP BY t.r),
h AS (SELECT r, max(n) AS longest FROM c GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed_lines,
    CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest, 0) AS BIGINT) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r LEFT JOIN h ON h.r = d.r
"""
