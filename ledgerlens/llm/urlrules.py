"""URL filter: fixed host and path rules, then mined association rules.

Fixed rules fit a host and its subdomains and paths that start with the rule's;
the longest wins.  For other URLs the verdict comes from token combinations:
FP-growth mines frequent combinations of URL tokens together with the label
"block" over labelled pages.  Without labels of their own, pages are labelled
from seeds: a page is to be blocked if a word of its host is on a short list.
The seeds themselves are no tokens of the mined pages, or mining would only find
the list again: what it finds are the other tokens that go with them, and these
block pages without a seed too.

A combination of at most ``MAX_TOKENS`` tokens becomes a rule if enough blocked
pages have it (``min_rows``, and ``min_support`` of the labelled pages) and the
share of blocked pages among those that have it is ``min_confidence``.  A rule
that holds all tokens of another at least as confident rule is pruned.

What can't change a rule is left out before mining, as combinations double with
every token: tokens that too few blocked pages have can stand in no rule, and
tokens that stand in the same pages throughout count as one class, of which a
URL needs any member.

Rules are matched by an inverted index: each is filed under the members of its
rarest class, so frequent tokens lead to few rules, and the other classes are
then asked for.  Support and confidence are counted again over all labelled
pages, through the index, before a rule has a say.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no fixed rule and no tokens; its verdict is allow.  Labels without id or
value are left out; a page with several labels is blocked if one says so.
Repeated rows are judged each and count as one page in mining; without labelled
pages there are no mined rules; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, written

#: Labelled pages that are mined; of more, a sample by hash.
MAX_LABELLED = 1_000_000
#: With at most this many mined rules the index is broadcast.
BROADCAST_RULES = 10_000
#: Most classes of tokens in a rule.
MAX_TOKENS = 3
BLOCK = "label:block"

# Words of hosts that label a page.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "lottery", "pills", "poker", "porn", "spam", "viagra", "xxx")
HOST_SPLIT = "[.:-]"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fixed_rule(host: Column, path: Column, rules: tuple[HostRule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host words, path words and query keys, marked by place."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    marked = lambda c, split, mark: F.transform(F.filter(F.split(c, split), lambda t: (t != "") & ~t.rlike("^[0-9]+$")), lambda t: F.concat(F.lit(mark), t))
    query = F.regexp_extract(lower(url), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda t: t != ""), lambda t: F.concat(F.lit("q:"), F.regexp_extract(t, "(?s)^([^=]*)", 1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(marked(host, HOST_SPLIT, "h:"), marked(lower(path), r"[^\p{L}\p{N}]+", "p:"), keys)))


def seeded(host: Column) -> Column:
    """Whether a word of the host is on the list."""
    return F.arrays_overlap(F.split(host, HOST_SPLIT), F.array(*map(F.lit, SEEDS)))


def held_out(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def classes_of(tokens: DataFrame, least: int) -> DataFrame:
    """``class`` (its first token) and ``members``, of tokens that ``least`` blocked pages have.

    ``tokens`` has ``page``, ``tokens`` and ``block``.  Tokens of equal count
    and equal sums of two hashes of their pages stand in the same pages.
    """
    each = tokens.select("page", "block", F.explode("tokens").alias("token"))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "page").cast("decimal(38,0)"))
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked"), total(1).alias("one"), total(2).alias("two"))
    return often.where(F.col("blocked") >= least).groupBy("n", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.get("members", F.lit(0)).alias("class"), "members", "n")


def mine(tokens: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """Pruned rules: ``rule`` (a number), ``wanted`` (members of each class),
    ``named`` (the classes), ``filed`` (its rarest class's members).

    ``tokens`` has ``page``, ``tokens`` and ``block``, a row for each labelled
    page; ``least`` blocked pages have to support a rule.
    """
    classes = written(classes_of(tokens, least), "classes")
    member = classes.select(F.col("class").alias("item"), F.explode("members").alias("token"))
    items = tokens.select("page", "block", F.explode("tokens").alias("token")).join(member, "token").groupBy("page").agg(F.collect_set("item").alias("items"), F.max("block").alias("block"))
    items = written(items.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), "transactions")
    n = items.count()
    # half a page less, as the share is multiplied back and rounded up
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(n, least), minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq").where(F.size("items") <= MAX_TOKENS + 1)
    sets = written(sets, "itemsets")
    blocked = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("named"), F.col("freq").alias("support"))
    rules = blocked.join(sets.withColumnRenamed("items", "named"), "named").withColumn("confidence", F.col("support") / F.col("freq"))
    rules = written(rules.where(F.col("confidence") >= min_confidence).select("named", "confidence", F.monotonically_increasing_id().alias("rule")), "rules")
    # a more general rule that is as confident makes the longer one needless
    own = F.col("named")
    picks = [F.when(F.size(own) == k, F.array(*[F.array(*[F.get(own, F.lit(i)) for i in c]) for size in range(1, k) for c in combinations(range(k), size)])) for k in range(2, MAX_TOKENS + 1)]
    shorter = rules.select("rule", "confidence", F.explode(F.coalesce(*picks)).alias("named"))
    needless = shorter.join(rules.select("named", F.col("confidence").alias("general")), "named").where("general >= confidence").select("rule").distinct()
    kept = rules.join(needless, "rule", "left_anti")
    spelt = kept.select("rule", "named", F.explode("named").alias("class")).join(classes, "class")
    return spelt.groupBy("rule", "named").agg(F.collect_list("members").alias("wanted"), F.min_by("members", F.struct("n", "class")).alias("filed"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[HostRule, ...] = RULES, min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 5, id_col: str = "page_id", url_col: str = "url", folds: int | None = None) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``,
    ``mined`` (the mined rule's classes) and ``confidence``.

    With ``folds``, pages whose checksum of the id it divides (``held_out``) are
    judged but not learnt from, for measuring.

    ``labels`` has ``id`` and ``block``; without it all pages are labelled from
    the seeds.  Of mined rules that fit, the most confident decides.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = written(rows.select("page_id", "host", "path", tokens_of(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), name.alias("rule"), verdict.alias("fixed"), F.monotonically_increasing_id().alias("row")), "urls")
    some = rows.where(F.size("tokens") > 0)
    if labels is None:
        others = F.array_except("tokens", F.array(*[F.lit(f"h:{w}") for w in SEEDS]))
        labelled = some.select("row", "page_id", others.alias("tokens"), seeded(F.col("host")).alias("block"))
    else:
        known = labels.where("id is not null and block is not null").groupBy("id").agg(F.max("block").alias("block"))
        labelled = some.join(known, some["page_id"] == known["id"]).select("row", "page_id", "tokens", "block")
    if folds:
        labelled = labelled.where(~held_out(F.col("page_id"), folds))
    # one row a page, whatever the size
    labelled = written(labelled.groupBy("page_id", "tokens", "block").agg(F.min("row").alias("page")), "labelled")
    n = labelled.count()
    share = lambda count: max(min_rows, math.ceil(min_support * count))
    sample = written(hashed_sample(labelled, MAX_LABELLED, n), "sample") if n > MAX_LABELLED else labelled
    mined = written(mine(sample, share(min(n, MAX_LABELLED)), min_confidence), "mined")
    index = mined.select("rule", "named", "wanted", F.explode("filed").alias("token"))
    index = F.broadcast(index) if mined.count() <= BROADCAST_RULES else index
    asked = rows.select("row", "fixed", "tokens", F.explode("tokens").alias("token"))
    fits = F.forall("wanted", lambda members: F.arrays_overlap(members, F.col("tokens")))
    # two members of the rarest class lead to a rule twice
    hits = written(asked.join(index, "token").where(fits).select("row", "fixed", "rule", "named").distinct(), "hits")
    counted = hits.join(labelled.select(F.col("page").alias("row"), "block"), "row").groupBy("rule").agg(F.count_if("block").alias("support"), F.count("*").alias("n"))
    sure = counted.where(F.col("support") >= share(n)).select("rule", "support", (F.col("support") / F.col("n")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    best = hits.where("fixed is null").join(sure, "rule").groupBy("row").agg(F.max(F.struct("confidence", "support", F.array_join("named", " ").alias("mined"))).alias("best"))
    return rows.join(best, "row", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("fixed", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("best.mined").alias("mined"),
        F.col("best.confidence").alias("confidence"),
        *([held_out(F.col("page_id"), folds).alias("held_out")] if folds else []),
    )


def oracle_sql(min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 5) -> str:
    """Rows of the query in DuckDB SQL: all combinations of up to three tokens."""
    parts = r"^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rule, verdict = "NULL", "NULL"
    for r in sorted(RULES, key=lambda r: (len(r.name), r.name)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r.name}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"
    marked = lambda text, split, mark: f"list_transform(list_filter(string_split_regex({text}, '{split}'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: '{mark}' || x)"
    words = marked("lower(path)", r"[^\p{L}\p{N}]+", "p:")
    keys = r"list_transform(list_filter(string_split(regexp_extract(lower(url), '\?([^#]*)', 1, 's'), '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_extract(x, '^([^=]*)', 1, 's'))"
    seeds, marks = ", ".join(f"'{x}'" for x in SEEDS), ", ".join(f"'h:{x}'" for x in SEEDS)
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '{parts}', 1, 's'), '{upper}', '{lower}') AS host, regexp_extract(coalesce(url, ''), '{parts}', 2, 's') AS path FROM pages),
f AS (SELECT *, {rule} AS rule, {verdict} AS fixed,
    CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat({marked('host', HOST_SPLIT, 'h:')}, {words}, {keys})) END AS tokens FROM u),
l AS (SELECT min(r) AS page, list_sort(list_filter(tokens, lambda x: NOT list_contains([{marks}], x))) AS tokens, list_has_any(string_split_regex(host, '{HOST_SPLIT}'), [{seeds}]) AS block FROM f WHERE len(tokens) > 0 GROUP BY page_id, list_sort(list_filter(tokens, lambda x: NOT list_contains([{marks}], x))), block),
least AS (SELECT greatest({min_rows}, ceil({min_support} * count(*))) AS least FROM l),
e AS (SELECT page, block, unnest(tokens) AS x FROM l),
b AS (SELECT x FROM e GROUP BY x HAVING count(*) FILTER (WHERE block) >= (SELECT least FROM least)),
g AS (SELECT page, block, x FROM e SEMI JOIN b USING (x)),
s AS (SELECT [x] AS rule, block FROM g UNION ALL SELECT [a.x, c.x], a.block FROM g AS a JOIN g AS c ON c.page = a.page AND c.x > a.x
    UNION ALL SELECT [a.x, c.x, d.x], a.block FROM g AS a JOIN g AS c ON c.page = a.page AND c.x > a.x JOIN g AS d ON d.page = a.page AND d.x > c.x),
m AS (SELECT rule FROM s GROUP BY rule HAVING count(*) FILTER (WHERE block) >= (SELECT least FROM least) AND count(*) FILTER (WHERE block) / count(*) >= {min_confidence}),
h AS (SELECT DISTINCT r FROM f JOIN m ON list_has_all(tokens, m.rule))
SELECT page_id, host, path, f.rule, coalesce(fixed, CASE WHEN h.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN h ON h.r = f.r
"""
