"""Records in the order of their chains, with what rules need of the chain.

One shuffle on ``object_id`` serves the chain order and all aggregates of a
chain; the per-record lookups (territories, generic owners, object class) are
expressions beside it.

An object of very many records would bring them all to one task that way.  Such
objects are counted beforehand and take another way: their records are sorted by
ranges of object and chain order, so that one chain lies in many segments; a
record's place is its place in its segment and what lies before that; aggregates
are summed up in parts, and the record before is found by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import certainly_before, describe
from ..functions.text import any_term, fold, normalise
from ..model import OBJECT_CLASSES, PRE_1945, RESOLVED
from ..numbering import numbered
from ..sources.lists import AnonymousPatterns, OnsetTable
from ..staging import broadcast_if_small, staged

CHAIN_ORDER = ("is_undated", "order_date", "source_order")


def matched_territories(location: Column, table: OnsetTable) -> Column:
    """Numbers of all territories with a term in the location, in table order."""
    folded = fold(location)
    return F.array_compact(F.array(*[F.when(folded.rlike(any_term(t.terms)), F.lit(t.index)) for t in table.territories]))


def matched_class(object_class: Column) -> Column:
    """The first object class that has a term in the value, or null."""
    text = normalise(object_class)
    out = F.lit(None).cast("string")
    for name in reversed(OBJECT_CLASSES):
        out = F.when(text.rlike(any_term(OBJECT_CLASSES[name])), F.lit(name)).otherwise(out)
    return out


def anonymous_hit(names: Column, patterns: AnonymousPatterns) -> Column:
    """The first name (in order) that has a pattern, and its first pattern."""
    every = any_term([p for _, p in patterns.patterns if p])

    def first(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for raw, p in reversed(patterns.patterns):
            if p:
                out = F.when(text.rlike(any_term([p])), F.lit(raw)).otherwise(out)
        return F.when(text.rlike(every), out)

    hits = F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), first(normalise(n)).alias("pattern"))), lambda h: h["pattern"].isNotNull())
    return F.get(hits, F.lit(0))


def owner_names() -> Column:
    return F.concat(F.array("owner_name"), F.coalesce("owner_name_variants", F.array().cast("array<string>")))


#: An object of more records is ordered in segments.
HOT_RECORDS = 200_000
#: What is known of the dated record before a record.
PREVIOUS = ("source_ref", "location", "country")


def keyed(records: DataFrame) -> DataFrame:
    """Records with what orders them."""
    return records.withColumns(
        {
            "is_dated": F.col("span").isNotNull(),
            "is_undated": F.col("span").isNull().cast("int"),
            # nominal bounds order the chain, not widened ones
            "order_date": F.coalesce(F.col("span.nominal_earliest"), F.col("span.nominal_latest")),
            "resolved": F.coalesce(F.col("transaction_state") == RESOLVED, F.lit(False)),
        }
    )


def parted(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(records of most objects, those of objects of more than ``most`` or None)."""
    hot = rows.groupBy("object_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("object_id")
    if hot.isEmpty():
        return rows, None
    listed = broadcast_if_small(staged(hot, "hot_objects"))
    return rows.join(listed, "object_id", "left_anti"), rows.join(listed, "object_id", "left_semi")


def in_segments(rows: DataFrame) -> DataFrame:
    """``rn`` of objects that no task can hold; ``number`` is the place among all."""
    placed = numbered(rows, "object_id", *CHAIN_ORDER)
    starts = staged(placed.groupBy("object_id").agg(F.min("number").alias("start")), "chain_starts")
    rn = (F.col("number") - F.col("start") + 1).cast("int")
    return placed.join(broadcast_if_small(starts), "object_id").withColumn("rn", rn).drop("start").select(*rows.columns, "rn", "number")


def in_chain_order(records: DataFrame, most: int = HOT_RECORDS) -> DataFrame:
    """``rn``: the place in the chain; undated records last, ties by input order."""
    usual, large = parted(keyed(records), most)
    usual = usual.withColumn("rn", F.row_number().over(Window.partitionBy("object_id").orderBy(*CHAIN_ORDER)))
    return usual if large is None else usual.unionByName(in_segments(large).drop("number"))


def of_chain(first, any_of, count, total) -> dict[str, Column]:
    """A chain's aggregates, made of first values, any, counts and sums."""
    span = F.col("span")
    possibly = F.col("is_dated") & (span["earliest"].isNull() | (span["earliest"] < F.lit(PRE_1945)))
    certainly = F.col("is_dated") & F.coalesce(certainly_before(span) < F.lit(PRE_1945), F.lit(False))
    return {
        "n_records": count(F.lit(1)).cast("int"),
        "n_dated": total(F.col("is_dated").cast("int")).cast("int"),
        "title": first("object_title"),
        "class": first("object_class"),
        "created": first("object_span"),
        "possibly_pre_1945": any_of(possibly),
        "certainly_pre_1945": any_of(certainly),
        "any_resolved": any_of(F.col("resolved")),
        "acquisition_never_set": count(F.col("is_institution_acquisition")) == 0,
        "any_acquisition": any_of(F.col("is_institution_acquisition")),
    }


def with_chain(records: DataFrame, most: int = HOT_RECORDS) -> DataFrame:
    """Chain aggregates and the dated record before (``previous``) on every record."""
    usual, large = parted(keyed(records), most)
    order = Window.partitionBy("object_id").orderBy(*CHAIN_ORDER)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda f: lambda c: f(c).over(whole)
    aggregates = of_chain(lambda c: F.first(c, ignorenulls=True).over(whole), lambda c: F.coalesce(F.max(c).over(whole), F.lit(False)), over(F.count), over(F.sum))
    # dated records come first, so what is before one is dated
    previous = F.when(F.col("is_dated"), F.lag(F.struct(*PREVIOUS)).over(order))
    out = usual.withColumns({"rn": F.row_number().over(order), "chain_seq": F.min("source_order").over(whole), **aggregates, "previous": previous})
    if large is not None:
        out = out.unionByName(with_chain_in_segments(large))
    return out.withColumns({"created_text": describe(F.col("created")), "created_after": F.coalesce(F.col("created.earliest") >= F.lit(PRE_1945), F.lit(False))})


def with_chain_in_segments(rows: DataFrame) -> DataFrame:
    """The same columns where one chain lies in many tasks."""
    placed = staged(in_segments(rows), "segments")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("number")))
    aggregates = of_chain(first, lambda c: F.coalesce(F.max(c), F.lit(False)), F.count, F.sum)
    chains = staged(placed.groupBy("object_id").agg(F.min("source_order").alias("chain_seq"), *[c.alias(n) for n, c in aggregates.items()]), "chains")
    before = placed.where("is_dated").select((F.col("number") + 1).alias("number"), F.col("object_id").alias("same"), F.struct(*PREVIOUS).alias("previous"))
    found = placed.join(before, "number", "left").withColumn("previous", F.when(F.col("is_dated") & (F.col("same") == F.col("object_id")), F.col("previous")))
    return found.drop("number", "same").join(broadcast_if_small(chains), "object_id")


def enriched(records: DataFrame, table: OnsetTable, patterns: AnonymousPatterns | None) -> DataFrame:
    """Records with their chain's aggregates and their own lookups."""
    names = owner_names()
    out = with_chain(records).withColumns({"territories": matched_territories(F.col("location"), table), "class_group": matched_class(F.col("class")), "names": names})
    hit = anonymous_hit(names, patterns) if patterns else F.lit(None).cast("struct<name:string,pattern:string>")
    return out.withColumn("anonymous", hit)
