"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Candidates of every kind are found in whole texts.  Each candidate's secret
value is hashed, and the hashes are aggregated by distinct repositories and
owners over the whole corpus: what many owners or many repositories have is an
example that is widely copied, what few have looks live.  The base kinds (``assign``,
``access``, ``hex``) always stay as spans; candidates of the further kind
``other`` (tokens of known services, private keys, credentials in URLs) stay
only where they look live.

Matches of a kind are the leftmost non-overlapping ones; a match that fails its
size is dropped and not retried.  Positions are code points, ends exclusive.

Skew: (value, owner, repository) is made distinct before anything is gathered
by value, so a value in a third of all documents weighs as much as its owners;
the join back to the candidates has no grouping by value above it, so Spark
splits hot values.

Defined results: a null text counts as empty; a null owner or repository is one
of its own; repeated rows are scanned each; a text without candidates has empty
spans; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Stands around matches; in a text it counts as the next character.
MARK, INSTEAD = "\x01", "\x02"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # the secret value, for the size and for the hash
    least: int  # characters of that group
    hint: str  # a text without this has no match


# The patterns and sizes of the base kinds.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"[:=]"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA"),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
# Shapes of public services' credentials.  No part repeats a
# group, which would recurse by its length, and no part before a fixed mark is
# longer than a bound (a scheme, a token's header), which keeps time linear.
OTHER = Kind(
    "other",
    "|".join(
        (
            r"gh[pousr]_[A-Za-z0-9]{36,}",
            r"github_pat_[A-Za-z0-9_]{40,}",
            r"glpat-[A-Za-z0-9_-]{20,}",
            r"xox[abprs]-[A-Za-z0-9-]{10,}",
            r"AIza[A-Za-z0-9_-]{35}",
            r"sk_live_[A-Za-z0-9]{16,}",
            r"eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
            r"-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----",
            r"[a-z][a-z0-9+.-]{0,31}://[^\x09-\x0d\x20/:@]*:[^\x09-\x0d\x20/:@]{6,}@[A-Za-z0-9.-]+",
            r"[0-9A-F]{32,}",
        )
    ),
    0,
    1,
    r"gh[pousr]_|github_pat_|glpat-|xox|AIza|sk_live_|eyJ|BEGIN|://|[0-9A-F]{32}",
)

SPAN = "array<struct<start:int,order:int,kind:string,end:int,value:bigint>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(lengths: Column) -> Column:
    """Sums of all numbers before each; square in their count, so for few."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


#: Parts whose places are summed up together; keeps texts of many matches fast.
SUMMED = 512


def _starts(lengths: Column) -> Column:
    """Sums of all numbers before each, by sections and inside them."""
    sections = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SUMMED).cast("int")), lambda k: F.slice(lengths, k * SUMMED + 1, SUMMED))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + n)
    return _let(sections, lambda c: F.flatten(F.zip_with(c, _scan(F.transform(c, total)), lambda inner, before: F.transform(_scan(inner), lambda x: x + before))))


def matches(text: Column, kind: Kind, order: int) -> Column:
    """The kind's spans in ``text`` (which holds no ``MARK``)."""
    parts = F.split(F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def spans(parts: Column) -> Column:
        # parts alternate: between matches, match, between matches, ...
        def of(starts: Column) -> Column:
            every = F.zip_with(parts, starts, lambda p, a: F.struct(p.alias("text"), a.alias("start")))
            found = F.filter(every, lambda p, k: (k % 2 == 1) & (F.char_length(F.regexp_extract(p["text"], kind.pattern, kind.group)) >= kind.least))
            return F.transform(found, lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), (p["start"] + F.char_length(p["text"])).alias("end"), F.xxhash64(F.regexp_extract(p["text"], kind.pattern, kind.group)).alias("value")))

        return _let(_starts(F.transform(parts, F.char_length)), of)

    return F.when(text.rlike(kind.hint), _let(parts, spans)).otherwise(F.array()).cast(SPAN)


def candidates(text: Column) -> Column:
    """All kinds' spans by start, then kind."""
    safe = F.translate(F.coalesce(text, F.lit("")), MARK, INSTEAD)
    return F.array_sort(F.concat(*[matches(safe, kind, k) for k, kind in enumerate((*BASE, OTHER))]))


def scan(docs: DataFrame, owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"), few_owners: int = 2, few_repos: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of start, order, kind, end,
    ``owners``, ``repos`` and ``live``.

    A value looks live if at most ``few_owners`` owners and ``few_repos``
    repositories have it.
    """
    hashed = lambda cols: F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), hashed(owner_cols).alias("owner"), hashed(repo_cols).alias("repo"), candidates(F.col(f"`{text_col}`")).alias("spans"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "candidates")
    each = rows.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    by_repo = each.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    spread = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = each.join(spread, "value").withColumn("live", (F.col("owners") <= few_owners) & (F.col("repos") <= few_repos))
    kept = judged.where((F.col("kind") != OTHER.name) | F.col("live"))
    found = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end", "owners", "repos", "live"))).alias("judged"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,owners:bigint,repos:bigint,live:boolean>>")
    # rows without candidates need no partner
    with_some = rows.where(F.size("spans") > 0).select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("judged", none).alias("spans"))
    return with_some.unionAll(rows.where(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle_sql(few_owners: int = 2, few_repos: int = 4) -> str:
    """Digest rows of the query in DuckDB SQL."""
    quoted = lambda p: p.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT r, {k} AS o, '{kind.name}' AS kind, {kind.least} AS least, string_split(regexp_replace(t, '{quoted(kind.pattern)}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts, {kind.group} AS grp FROM d WHERE regexp_matches(t, '{quoted(kind.hint)}')"
        for k, kind in enumerate((*BASE, OTHER))
    )
    value = f"CASE grp WHEN 2 THEN regexp_extract(part, '{quoted(BASE[0].pattern)}', 2) ELSE part END"
    base = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in BASE)
    listed_ = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o){0}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
k AS ({kinds}),
p AS (SELECT r, o, kind, least, grp, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM k),
s AS (SELECT *, CAST(sum(length(part)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) AS b FROM p),
m AS (SELECT r, o, kind, b - length(part) AS a, b, {value} AS v, least FROM s WHERE i % 2 = 1),
c AS (SELECT m.*, source, lang FROM m JOIN d USING (r) WHERE length(v) >= least),
w AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(lang, chr(0)))) AS repos FROM c GROUP BY v),
j AS (SELECT c.*, owners, repos, owners <= {few_owners} AND repos <= {few_repos} AS live FROM c JOIN w USING (v)),
f AS (SELECT r, {base}, {listed_.format(f" FILTER (WHERE kind <> '{OTHER.name}')")} AS base, {listed_.format("")} AS spans, CAST(count(*) FILTER (WHERE live) AS BIGINT) AS n_live, CAST(max(owners) AS BIGINT) AS most_owners, CAST(max(repos) AS BIGINT) AS most_repos FROM j WHERE kind <> '{OTHER.name}' OR live GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN f ON f.r = d.r
"""
