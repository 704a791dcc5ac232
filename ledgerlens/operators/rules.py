"""The fourteen rules over enriched records.

Each returns flags (and notes where it could not run); nothing is grouped into
Python objects.  What a record decides by itself is a Column, null where there
is nothing to say: all such flags, and all such notes, come from one pass over
the records, as an array that is exploded once.  Lists of a chain's records
come from one aggregate for all notes that have them.  The other flags and
notes are DataFrames of the same columns.  A flag asks a question and cites the
fields it rests on, as JSON in ``cited_fields``.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import certainly_before, describe, overlap_certainty
from ..functions.names import match_names
from ..functions.text import normalise, quoted
from ..model import (
    ACTOR_WINDOW, CATALOGUE_EARLY, CATALOGUE_LATE, EVIDENCING_STATES, EXPORT_WINDOW, METHODOLOGY, PERSECUTION_STATES, PRE_1945, RULES, STATES,
)
from ..sources.lists import Config, NameList
from ..staging import broadcast_if_small, staged
from . import tiers

FLAG_COLUMNS = ("object_id", "chain_seq", "axis", "rule_id", "rule_seq", "rec_rn", "sub_seq", "source_ref", "presumption_tier", "rule_statement", "methodology", "cited_fields")
NOTE_COLUMNS = ("object_id", "chain_seq", "note_seq", "sub_seq", "note")
RULE_SEQ = {rule: k for k, rule in enumerate(RULES)}
DISCLAIMER = "A match cites the list entry as it stands. It makes no finding about this record, its parties or this object."


def cited(*parts: tuple[str, Column] | tuple[str, Column, bool | str]) -> Column:
    """A JSON object of named values, nulls included; a third item makes a
    value optional, left out where it is null; ``"json"``: it is JSON already."""
    runs: list[tuple[bool | None, list[Column]]] = []  # values that are always there go in one piece
    for name, value, *optional in parts:
        if optional and optional[0] == "json":
            runs.append((None, [F.concat(F.lit(f'"{name}":'), value)]))
        elif optional and optional[0]:
            runs.append((True, [value.alias(name)]))
        elif runs and runs[-1][0] is False:
            runs[-1][1].append(value.alias(name))
        else:
            runs.append((False, [value.alias(name)]))
    as_json = lambda fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if len(runs) == 1 and runs[0][0] is False:
        return as_json(runs[0][1])
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    texts = [fields[0] if optional is None else F.when(~as_json(fields).endswith(":null}"), inner(as_json(fields))) if optional else inner(as_json(fields)) for optional, fields in runs]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*texts)), ","), F.lit("}"))


def cite(*names: str) -> list[tuple[str, Column]]:
    """The record's own fields, after its reference."""
    return [("source_ref", F.col("source_ref")), *[(n, describe(F.col("span")) if n == "date_span" else F.col(n)) for n in names]]


RECORD = ("owner_name", "date_span", "location", "transaction_state")


def flag(rows: DataFrame | Column, rule: str, statement: Column, parts: list, tier: Column | str | None = "n/a", sub: Column | int = 0, methodology: str | None = None, of_object: bool = False, place: Column | None = None) -> DataFrame | Column:
    """Flags of some rows, or of the records for which a condition holds."""
    tier = F.lit(tier) if tier is None or isinstance(tier, str) else tier
    sub = F.lit(sub) if isinstance(sub, int) else sub
    place = (F.lit(0) if of_object else F.col("rn")) if place is None else place
    values = [
        F.lit(RULES.get(rule, "citation")).alias("axis"), F.lit(rule).alias("rule_id"), F.lit(RULE_SEQ.get(rule, len(RULE_SEQ))).alias("rule_seq"), place.cast("int").alias("rec_rn"), sub.cast("int").alias("sub_seq"),
        (F.lit(None) if of_object else F.col("source_ref")).cast("string").alias("source_ref"), tier.cast("string").alias("presumption_tier"),
        statement.alias("rule_statement"), F.lit(METHODOLOGY[methodology or rule]).alias("methodology"), cited(*parts).alias("cited_fields"),
    ]
    return F.when(rows, F.struct(*values)) if isinstance(rows, Column) else rows.select("object_id", "chain_seq", *values)


def note(rows: DataFrame | Column, seq: int, text: Column, sub: int | Column = 0) -> DataFrame | Column:
    values = [F.lit(seq).alias("note_seq"), (F.lit(sub) if isinstance(sub, int) else sub).cast("int").alias("sub_seq"), text.alias("note")]
    return F.when(rows, F.struct(*values)) if isinstance(rows, Column) else rows.select("object_id", "chain_seq", *values)


class Listed(NamedTuple):
    """A note that lists the chain's records for which a condition holds."""

    where: Column
    seq: int
    before: str
    after: str
    sub: int = 0


def references(where: Column) -> Column:
    """An aggregate of a chain: its records' references in order, or null."""
    found = F.array_sort(F.collect_list(F.when(where, F.struct("rn", "source_ref"))))
    return F.nullif(F.array_join(F.transform(found, lambda x: x["source_ref"]), ", "), F.lit(""))


def listed(rows: DataFrame, seq: int, rule: str, why: str) -> DataFrame:
    """The note of rows that are no plain records."""
    refs = rows.groupBy("object_id", "chain_seq").agg(references(F.lit(True)).alias("refs"))
    return note(refs, seq, F.concat(F.lit(f"{rule} not evaluated for "), F.col("refs"), F.lit(f": {why}")))


def not_evaluated(where: Column, seq: int, sub: int, rule: str, why: str) -> Listed:
    return Listed(where, seq, f"{rule} not evaluated for ", f": {why}", sub)


def together(records: DataFrame, found: list[DataFrame | Column | Listed]) -> DataFrame:
    """Flags, or notes, of all kinds as one frame."""
    frames = [f for f in found if isinstance(f, DataFrame)]

    def exploded(rows: DataFrame, columns: list[Column]) -> DataFrame:
        return rows.select("object_id", "chain_seq", F.explode(F.array_compact(F.array(*columns))).alias("f")).select("object_id", "chain_seq", "f.*")

    if columns := [f for f in found if isinstance(f, Column)]:
        frames.append(exploded(records, columns))
    if lists := [f for f in found if isinstance(f, Listed)]:
        chains = records.groupBy("object_id", "chain_seq").agg(*[references(x.where).alias(f"refs{k}") for k, x in enumerate(lists)])
        frames.append(exploded(chains, [note(F.col(f"refs{k}").isNotNull(), x.seq, F.concat(F.lit(x.before), F.col(f"refs{k}"), F.lit(x.after)), x.sub) for k, x in enumerate(lists)]))
    return reduce(DataFrame.unionByName, frames)


#: The first record of each chain, which carries the chain's aggregates.
FIRST = "rn = 1"


def objects(records: DataFrame) -> DataFrame:
    return records.where(FIRST)


def of_chain(condition: str) -> Column:
    """A condition on the chain, asked once for each."""
    return F.expr(f"{FIRST} and ({condition})")


def pc001(records: DataFrame) -> tuple[list, list]:
    """No record may be dated before 1945."""
    rows = objects(records).where("not possibly_pre_1945")
    in_order = records.where("not possibly_pre_1945 and not created_after").groupBy("object_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_dated"), F.struct("rn", "source_ref", describe(F.col("span")).alias("date"))))).alias("dated"),
        F.array_sort(F.collect_list(F.when(~F.col("is_dated"), F.struct("rn", "source_ref")))).alias("undated"),
    )
    open_ = rows.where("not created_after").join(in_order, "object_id")
    why = F.when(F.col("created_text").isNotNull(), F.concat(F.lit(" The object's creation is recorded as "), F.col("created_text"), F.lit(", so an earlier owner is possible."))).otherwise(" No creation date is recorded, so missing documentation and a later creation cannot be told apart; recording object_date would separate them.")
    parts = [
        ("records_in_chain", F.col("n_records")), ("dated_records_in_chain", F.col("n_dated")),
        ("recorded_dates", F.transform("dated", lambda d: F.struct(d["source_ref"], d["date"]))), ("undated_records", F.transform("undated", lambda d: d["source_ref"])),
        ("threshold", F.lit(str(PRE_1945))), ("object_date", F.col("created_text")),
    ]
    statement = F.concat(F.lit("Unverified: is any ownership before 1945 documented? At its stated precision no record of the chain is dated before 1 January 1945."), why)
    late = F.concat(F.lit("PC-001 not applicable: the object's creation is recorded as "), F.col("created_text"), F.lit(f", on or after {PRE_1945}, so earlier provenance cannot exist; nothing is said about its documentation."))
    return [flag(open_, "PC-001", statement, parts, of_object=True)], [note(of_chain("not possibly_pre_1945 and created_after"), 1, late)]


def pc002(records: DataFrame) -> tuple[list, list]:
    """The chain begins at the institution's own acquisition."""
    never = note(of_chain("acquisition_never_set"), 2, F.lit("PC-002 skipped: no record sets `is_institution_acquisition`, so the institution's accession cannot be told in the chain."))
    first = objects(records).where(F.coalesce("is_institution_acquisition", F.lit(False)))
    later = records.where("rn > 1 and not is_dated").groupBy("object_id").agg(references(F.lit(True)).alias("refs"))
    joined = first.join(later, "object_id", "left")
    unclear = note(joined.where("refs is not null"), 2, F.concat(F.lit("PC-002 skipped: undated records ("), F.col("refs"), F.lit(") may precede the accession, so chain order is not established.")))
    parts = [*cite("owner_name", "date_span", "transaction_state", "is_institution_acquisition"), ("records_earlier_in_chain", F.lit(0)), ("records_in_chain", F.col("n_records"))]
    statement = F.lit("Unverified: who held the object before the institution? The chain's first record is the institution's own acquisition and names no earlier owner.")
    return [flag(joined.where("refs is null"), "PC-002", statement, parts)], [never, unclear]


def windows_of(records: DataFrame, cfg: Config) -> DataFrame:
    """The table's windows, a handful of rows from the driver."""
    rows = [(t.index, k, t.name, t.note, w.id, w.earliest, w.latest, w.label, w.ends, w.tier, w.tier_basis, w.source) for t in cfg.onset.territories for k, w in enumerate(t.windows)]
    schema = "territory int, window_seq int, name string, note string, id string, earliest date, latest date, label string, ends date, tier string, tier_basis string, source string"
    frame = records.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(frame.select("territory", F.struct(*[c for c in frame.columns if c != "territory"]).alias("w")))


def window_hits(records: DataFrame, cfg: Config) -> DataFrame:
    """(record, territory, window) whose date intervals meet, with ``certainty``."""
    rows = records.where("not resolved and is_dated").withColumn("territory", F.explode("territories")).join(windows_of(records, cfg), "territory")
    return rows.withColumn("certainty", overlap_certainty(F.col("span"), F.col("w.earliest"), F.col("w.ends"))).where("certainty is not null")


def meets_a_window(cfg: Config) -> Column:
    """Whether the record's date meets a window of any of its territories."""
    every = [F.struct(F.lit(t.index).alias("territory"), F.lit(w.earliest).cast("date").alias("earliest"), F.lit(w.ends).cast("date").alias("ends")) for t in cfg.onset.territories for w in t.windows]
    return F.col("is_dated") & F.exists(F.array(*every), lambda w: F.array_contains("territories", w["territory"]) & overlap_certainty(F.col("span"), w["earliest"], w["ends"]).isNotNull())


def gloss(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in STATES.items() for x in p]), state)


def pc003(records: DataFrame, cfg: Config) -> tuple[list, list]:
    """A persecution window is met, or the record's own state says as much."""
    hits = window_hits(records, cfg)
    w = F.col("w")
    tier, basis = tiers.for_window(F.col("span"), F.col("transaction_state"), w, cfg.onset)
    parts = [
        *cite(*RECORD), ("territory", w["name"]), ("persecution_window", w["id"]), ("persecution_onset", w["label"]), ("onset_earliest", w["earliest"].cast("string")),
        ("onset_latest", w["latest"].cast("string")), ("window_ends", w["ends"].cast("string")), ("onset_table_source", w["source"]), ("onset_table_note", w["note"], True),
        ("overlap_certainty", F.col("certainty")), ("presumption_tier_basis", basis), ("onset_table_version", F.lit(cfg.onset.version)),
        ("onset_caveat", F.when(w["earliest"] != w["latest"], "the table gives this onset as a range; no single day is meant"), True),
        ("transaction_state_gloss", gloss(F.coalesce("transaction_state", F.lit(""))), True),
    ]
    how = F.when(F.col("certainty") == "certain", "overlaps").otherwise("may overlap, which its precision leaves open,")
    statement = F.concat(F.lit("Unverified: did a persecuted person make this transfer, at a fair price and free to use the proceeds? Its recorded date "), how, F.lit(" the persecution window of "), w["name"], F.lit(" (from "), w["label"], F.lit(" to "), w["ends"].cast("string"), F.lit("). The record says nothing either way."))
    by_window = flag(hits, "PC-003", statement, parts, tier, F.col("territory") * 1000 + w["window_seq"])
    by_state = ~F.col("resolved") & F.col("transaction_state").isin(*PERSECUTION_STATES) & ~F.coalesce(meets_a_window(cfg), F.lit(False))
    tier, basis = tiers.from_state(F.col("span"), F.col("transaction_state"), cfg.onset)
    parts = [*cite(*RECORD), ("presumption_tier_basis", basis), ("transaction_state_gloss", gloss(F.col("transaction_state"))), ("basis", F.lit("the record's own transaction_state; its place is outside the table, or not recorded, or no window is met"))]
    statement = F.concat(F.lit("Unverified: was a fair price received, and was the transferor free to use it? The record itself gives the transfer as "), quoted(F.col("transaction_state")), F.lit(" ("), gloss(F.col("transaction_state")), F.lit("). It says nothing further either way."))
    own_state = flag(by_state, "PC-003", statement, parts, tier, 1_000_000, "PC-003-state")
    return [by_window, own_state], [
        not_evaluated(F.expr("resolved"), 3, 0, "PC-003", "the record is itself a restitution or settlement."),
        not_evaluated(F.expr("not resolved and not is_dated and location is not null"), 3, 1, "PC-003", "the record has a location but no date to compare."),
        not_evaluated(F.expr("not resolved and is_dated and location is null"), 3, 2, "PC-003", "the record has no `location`, which the table of onsets goes by."),
    ]


def pc010(records: DataFrame) -> tuple[list, list]:
    """A sale abroad in flight."""
    rows = F.expr("transaction_state = 'fluchtgut'")
    parts = [*cite(*RECORD), ("transaction_state_gloss", gloss(F.col("transaction_state"))), ("category_status", F.lit("contested: whether such sales count as losses by persecution is open in law and research"))]
    statement = F.lit("Unverified: under what pressure was this sale made, and what became of the proceeds? The record gives it as a sale abroad in flight, a contested category on which it offers no evidence.")
    return [flag(rows, "PC-010", statement, parts)], []


def pc004(records: DataFrame, cfg: Config) -> tuple[list, list]:
    """A class of objects that moved without leaving chains."""
    start, end = cfg.onset.band
    rows = records.where("class_group is not null")
    dated = rows.where("is_dated and not resolved").withColumn("certainty", overlap_certainty(F.col("span"), start, end)).where("certainty is not null")
    # the first matched territory's first window that is met, else its first
    windows = windows_of(records, cfg).groupBy("territory").agg(F.array_sort(F.collect_list(F.col("w"))).alias("ws"))
    placed = dated.withColumn("territory", F.get("territories", F.lit(0))).join(F.broadcast(windows), "territory", "left")
    met = F.filter("ws", lambda w: overlap_certainty(F.col("span"), w["earliest"], w["ends"]).isNotNull())
    placed = placed.withColumn("w", F.coalesce(F.get(met, F.lit(0)), F.get("ws", F.lit(0))))
    w = F.col("w")
    in_place, place_basis = tiers.for_window(F.col("span"), F.col("transaction_state"), w, cfg.onset)
    in_band, band_basis = tiers.by_threshold(F.col("span"), start, end, cfg.onset)
    tier = F.when(w.isNotNull(), in_place).otherwise(in_band)
    basis = F.when(w.isNotNull(), F.concat(place_basis, F.lit(" (territory: "), w["name"], F.lit(")"))).otherwise(F.concat(band_basis, F.lit("; no territory matched the location, so the threshold alone decides")))
    common = [("object_class", F.col("class")), ("object_class_rule_group", F.col("class_group")), ("screening_band", F.lit(f"{start} to {end}")), ("basis", F.lit("class and date alone; neither a chain nor a matched place is asked for"))]
    statement = F.concat(F.lit("Unverified: by what channel did the object come here? It is recorded as "), quoted(F.col("class")), F.lit(", a class that often passed through confiscation without a chain, and this record falls in the screening band. The record says nothing about its channel."))
    by_record = flag(placed, "PC-004", statement, [*cite(*RECORD), *common, ("overlap_certainty", F.col("certainty")), ("presumption_tier_basis", basis)], tier)
    one = "class_group is not null and not certainly_pre_1945"
    parts = [*common, ("records_in_chain", F.col("n_records")), ("certainly_dated_before_1945", F.lit(False)), ("object_date", F.col("created_text"))]
    statement = F.concat(F.lit("Unverified: where was the object before 1945? It is recorded as "), quoted(F.col("class")), F.lit(", a class for which a missing chain is what confiscation would leave. No record is certainly dated before 1945."))
    absent = flag(of_chain(f"{one} and not created_after"), "PC-004", statement, parts, sub=1, of_object=True, place=F.lit(2**31 - 1))
    return [by_record, absent], [
        note(of_chain("class is null"), 4, F.lit("PC-004 skipped: no `object_class` is recorded.")),
        note(of_chain(f"{one} and created_after"), 4, F.concat(F.lit("PC-004 absent-chain limb not applicable: the object's creation is recorded as "), F.col("created_text"), F.lit(f", on or after {PRE_1945}."))),
    ]


#: What the rules of both lists read of a record.
HIT_RECORD = ("object_id", "chain_seq", "rn", "source_ref", "owner_name", "owner_name_variants", "span", "is_dated", "location", "transaction_state")


def list_hits(records: DataFrame, names: NameList) -> DataFrame:
    """A row for each (record, entry): the first of the record's names that
    matches, with ``hit`` and ``hit_seq`` in the order of names and entries.

    Matching sees distinct names; the answer joins back by name.  ``records`` are
    read twice, so they should be staged; of them only what the rules cite is read.
    Flags, notes and citations read the result.
    """
    read = records.select(*HIT_RECORD, "names")
    found = staged(match_names(read.select(F.explode("names").alias("name")), names.matching), "matched_names")
    found = broadcast_if_small(found.select("name", F.struct("index", "basis", "kind", "confirmed", "note").alias("hit")))
    each = read.select(*HIT_RECORD, F.posexplode("names").alias("name_pos", "name"))
    first = F.min(F.struct("name_pos", "name", "hit")).alias("first")
    hits = each.join(found, "name").groupBy(*HIT_RECORD, "hit.index").agg(first).select(*HIT_RECORD, "index", "first.*")
    entries = records.sparkSession.createDataFrame(entry_rows(names), ENTRY_SCHEMA)
    entries = entries.select("index", F.struct(*[c for c in entries.columns if c != "index"]).alias("entry"))
    hits = hits.join(F.broadcast(entries) if len(names.entries) <= BROADCAST_ENTRIES else entries, "index")
    return staged(hits.withColumn("hit_seq", F.col("name_pos") * 1_000_000 + F.col("index")), "hits")


#: Lists of more entries are joined by shuffle.
BROADCAST_ENTRIES = 5_000
#: The values of a list entry that rules cite; nested ones as JSON.
ENTRY_TEXTS = ("name", "location", "active_period", "verification_note", "entry_type", "annotation", "source_url")
ENTRY_SCHEMA = "index int, " + ", ".join(f"{t} string" for t in ENTRY_TEXTS) + ", bases string, cross_references string, implies boolean, exonerating boolean"


def entry_rows(names: NameList) -> list[tuple]:
    """The list's entries; the list is a JSON file that the driver holds."""

    def basis(b: dict) -> dict:
        optional = {"gate_basis": b.get("gate_basis"), "basis_period": b.get("period")}
        return {"documented_basis": b["summary"], "sources": b["sources"], "implies_persecution_of_former_owner": b["implies_persecution_of_former_owner"]} | {k: v for k, v in optional.items() if v}

    out = []
    for k, e in enumerate(names.entries):
        bases, cross = e.get("documented_basis"), e.get("cross_referenced_sources")
        out.append(
            (
                k, *[e.get(t) for t in ENTRY_TEXTS], json.dumps([basis(b) for b in bases], ensure_ascii=False) if bases else None, json.dumps(cross, ensure_ascii=False) if cross else None,
                any(b["implies_persecution_of_former_owner"] for b in bases or ()), e.get("entry_type") == "exonerating",
            )
        )
    return out


def match_parts() -> list:
    hit = F.col("hit")
    return [("matched_on", F.col("name")), ("match_basis", hit["basis"]), ("entry_kind", hit["kind"]), ("identity_confirmed", hit["confirmed"]), ("identity_caveat", F.when(hit["note"] != "", hit["note"]), True)]


def pc005(records: DataFrame, cfg: Config) -> tuple[list, list]:
    """A party matches a documented actor."""
    if cfg.actors is None:
        return [], [note(F.expr(FIRST), 5, F.lit(f"PC-005 skipped: {cfg.unavailable.get('PC-005', 'the list is not available')}"))]
    actors = cfg.actors
    start, end = ACTOR_WINDOW
    hits = list_hits(records.where("not resolved"), actors)
    undated = hits.where("not is_dated").dropDuplicates(["object_id", "rn"])
    rows = hits.where("is_dated").withColumn("certainty", overlap_certainty(F.col("span"), start, end)).where("certainty is not null")
    implies = F.col("entry.implies")
    evidence = F.coalesce(F.col("transaction_state").isin(*EVIDENCING_STATES), F.lit(False))
    by_date, date_basis = tiers.by_threshold(F.col("span"), start, end, cfg.onset)
    tier = F.when(implies | evidence, by_date).otherwise("n/a")
    basis = F.when(implies | evidence, date_basis).otherwise("no tier: see persecution_inference_basis")
    inference = (
        F.when(implies, "a documented basis of the entry bears on persecution of a former owner")
        .when(evidence, F.concat(F.lit("the entry's documented basis does NOT bear on persecution of a former owner; the question rests solely on this record's own transaction_state ("), F.col("transaction_state"), F.lit(")")))
        .otherwise("the entry's documented basis does not bear on persecution of a former owner, and the record's transaction_state does not raise it")
    )
    name = F.col("entry.name")
    parts = [
        *cite(*RECORD), *match_parts(), ("actor_entry", name), ("documented_bases", F.col("entry.bases"), "json"), ("actor_location", F.col("entry.location"), True),
        ("actor_active_period", F.col("entry.active_period"), True), ("verification_note", F.col("entry.verification_note"), True),
        ("actor_window", F.lit(f"{start} to {end}")), ("overlap_certainty", F.col("certainty")), ("citation_disclaimer", F.lit(DISCLAIMER)), ("persecution_inference_basis", inference), ("presumption_tier_basis", basis),
    ]
    statement = (
        F.when(implies, F.concat(F.lit("Unverified: in what circumstances was this transaction made? A party matches the entry for "), name, F.lit(", whose documented basis is cited. The match makes no finding about the transaction.")))
        .when(evidence, F.concat(F.lit("Unverified: in what circumstances was this transaction made? A party matches the entry for "), name, F.lit(", whose basis does not bear on a private former owner; the question comes from the record's own transaction_state.")))
        .otherwise(F.concat(F.lit("For context only: a party matches the entry for "), name, F.lit(". On the cited basis this does NOT indicate persecution of a former owner, and nothing else in the record suggests it. What does that basis cover?")))
    )
    statement = F.concat(statement, F.when(F.col("hit.confirmed"), "").otherwise(" IDENTITY NOT ESTABLISHED: a surname without a given name fits a different individual equally well."))
    return [flag(rows, "PC-005", statement, parts, tier, F.col("hit_seq"))], [listed(undated, 5, "PC-005", f"a party matches the list, but the record has no date to compare with {start.year}-{end.year}.")]


def pc006(records: DataFrame, cfg: Config) -> tuple[list, list]:
    """An anonymous or generic owner."""
    if cfg.patterns is None:
        return [], [note(F.expr(FIRST), 6, F.lit(f"PC-006 skipped: {cfg.unavailable.get('PC-006', 'the list is not available')}"))]
    start, end = cfg.patterns.band
    certainty = overlap_certainty(F.col("span"), start, end)
    rows = F.expr("not resolved and anonymous is not null and is_dated") & certainty.isNotNull()
    tier, basis = tiers.by_threshold(F.col("span"), start, end, cfg.onset)
    parts = [
        *cite("owner_name", "owner_name_variants", "date_span", "location"), ("matched_pattern", F.col("anonymous.pattern")), ("matched_on", F.col("anonymous.name")), ("band", F.lit(f"{start} to {end}")),
        ("band_source", F.lit(cfg.patterns.source)), ("pattern_list_version", F.lit(cfg.patterns.version)), ("overlap_certainty", certainty), ("presumption_tier_basis", basis),
    ]
    statement = F.concat(F.lit("Unverified: who held the object at this point? The owner entry "), quoted(F.col("anonymous.name")), F.lit(" is generic (it matches "), quoted(F.col("anonymous.pattern")), F.lit(f") and falls in {start.year}-{end.year}. The record names no party."))
    return [flag(rows, "PC-006", statement, parts, tier)], [not_evaluated(F.expr("not resolved and anonymous is not null and not is_dated"), 6, 0, "PC-006", f"the owner entry is generic, but the record has no date to compare with {start.year}-{end.year}.")]


def pc007(records: DataFrame) -> tuple[list, list]:
    """An owner in an early catalogue who is missing from later ones."""
    early_day, late_day = F.lit(CATALOGUE_EARLY), F.lit(CATALOGUE_LATE)
    span, stated = F.col("span"), F.col("owner_stated_in_catalogue")
    in_catalogue = F.col("catalogue_reference").isNotNull()
    early = in_catalogue & F.coalesce(stated, F.lit(False)) & F.coalesce(certainly_before(span) < early_day, F.lit(False))
    late = in_catalogue & F.coalesce(span["earliest"] > late_day, F.lit(False))
    missing = late & F.coalesce(~stated, F.lit(False))
    entries = lambda cond, *cols: F.array_sort(F.collect_list(F.when(cond, F.struct("rn", *cols))))
    when = describe(span).alias("date")
    chains = records.groupBy("object_id", "chain_seq").agg(
        F.count("catalogue_reference").alias("n"),
        entries(early, "source_ref", "owner_name", "catalogue_reference", when).alias("early"),
        F.count_if(late).alias("n_late"),
        entries(missing, "source_ref", "catalogue_reference", when, "owner_stated_in_catalogue").alias("missing"),
        F.array_sort(F.collect_list(F.when(in_catalogue & stated.isNull(), F.struct("rn", "source_ref")))).alias("unstated"),
    )
    drop_rn = lambda c, *names: F.transform(c, lambda e: F.struct(*[e[n].alias(n) for n in names]))
    before = ("pre_1933_catalogue_entries", drop_rn("early", "source_ref", "owner_name", "catalogue_reference", "date"))
    thresholds = ("comparison_thresholds", F.lit(f"before {CATALOGUE_EARLY} and after {CATALOGUE_LATE}"))
    owners = F.array_join(F.array_sort(F.array_distinct(F.transform("early", lambda e: e["owner_name"]))), ", ")
    compared = chains.where("size(early) > 0 and size(missing) > 0")
    parts = [before, ("post_1950_catalogue_entries_without_owner", drop_rn("missing", "source_ref", "catalogue_reference", "date", "owner_stated_in_catalogue")), thresholds]
    deleted = flag(compared, "PC-007", F.concat(F.lit("Unverified: why is an owner who was published before 1933 ("), owners, F.lit(") not named in a catalogue entry after 1950? The entries give no reason.")), parts, of_object=True)
    unclear = chains.where("size(early) > 0 and n_late = 0")
    parts = [before, ("post_1950_catalogue_entry_present", F.lit(False)), thresholds]
    unverifiable = flag(unclear, "PC-007", F.concat(F.lit("Unverifiable, requires catalogue raisonné cross-check: is the owner published before 1933 ("), owners, F.lit(") still named after 1950? No later entry is in the chain.")), parts, of_object=True)
    refs = F.array_join(F.transform("unstated", lambda u: u["source_ref"]), ", ")
    return [deleted, unverifiable], [
        note(chains.where("n = 0"), 7, F.lit("PC-007 skipped: no record has a `catalogue_reference` to compare.")),
        note(chains.where("size(unstated) > 0"), 7, F.concat(F.lit("PC-007 partially skipped: catalogue records "), refs, F.lit(" do not set `owner_stated_in_catalogue`."))),
    ]


def pc008(records: DataFrame) -> tuple[list, list]:
    """A settlement with a state, not with heirs."""
    statement = F.lit("Unverified: did the dispossessed persons or their heirs ever receive the object or its value? The settlement was made with a state or an institution; the record does not show what followed.")
    told = F.when(F.col("restitution_recipient_type").isNull(), F.concat(F.lit("PC-008 skipped for "), F.col("source_ref"), F.lit(": a restitution or settlement without `restitution_recipient_type`."))).otherwise(F.concat(F.lit("PC-008 not determinable for "), F.col("source_ref"), F.lit(": the recipient is recorded as unknown.")))
    return [flag(F.expr("resolved and restitution_recipient_type = 'state_or_institution'"), "PC-008", statement, cite(*RECORD, "restitution_recipient_type"))], [
        note(F.expr("resolved and (restitution_recipient_type is null or restitution_recipient_type = 'unknown')"), 8, told, F.col("rn"))
    ]


def pc009(records: DataFrame, cfg: Config) -> tuple[list, list]:
    """A border crossed without a recorded export licence."""
    start, end = EXPORT_WINDOW
    pairs = records.where("previous is not null and not resolved").withColumn("before", F.col("previous"))
    origin, here = F.col("before.country"), F.col("country")
    unlocated = pairs.where("before.country is null or country is null")
    moved = pairs.where(origin.isNotNull() & here.isNotNull() & (normalise(origin) != normalise(here)))
    rows = moved.withColumn("certainty", overlap_certainty(F.col("span"), start, end)).where(F.col("certainty").isNotNull() & ~F.coalesce("export_licence_present", F.lit(False)))
    tier, basis = tiers.by_threshold(F.col("span"), start, end, cfg.onset)
    parts = [
        *cite(*RECORD, "export_licence_present"), ("moved_from", F.col("before.location")), ("moved_from_source_ref", F.col("before.source_ref")), ("origin_country", origin), ("destination_country", here),
        ("country_derivation", F.lit("what follows the last comma of `location`; the whole value without one")), ("window", F.lit(f"{start} to {end}")), ("overlap_certainty", F.col("certainty")),
        ("export_licence_state", F.when(F.col("export_licence_present").isNull(), "not recorded either way").otherwise("recorded as absent")), ("presumption_tier_basis", basis),
    ]
    statement = F.concat(F.lit("Unverified: on what authority did the object cross a border? The chain moves from "), origin, F.lit(" to "), here, F.lit(f" within {start.year}-{end.year}, and no export licence is recorded."))
    pair = unlocated.withColumn("source_ref", F.concat(F.col("before.source_ref"), F.lit(" -> "), F.col("source_ref")))
    return [flag(rows, "PC-009", statement, parts, tier)], [listed(pair, 9, "PC-009", "`location` is missing on one side of the movement.")]


def nm001(records: DataFrame, cfg: Config) -> tuple[list, list, list]:
    """A name of the historical list; exonerating entries are citations."""
    if cfg.names is None:
        return [], [note(F.expr(FIRST), 10, F.lit(f"NM-001 skipped: {cfg.unavailable.get('NM-001', 'the list is not available')}"))], []
    names = cfg.names
    start, end = cfg.onset.band
    hits = list_hits(records, names)
    undated = hits.where("not is_dated").dropDuplicates(["object_id", "rn"])
    rows = hits.where("is_dated").withColumn("certainty", overlap_certainty(F.col("span"), start, end)).where("certainty is not null")
    value = lambda key: F.col(f"entry.{key}")
    parts = [
        *cite("owner_name", "owner_name_variants", "date_span"), *match_parts(), ("screening_band", F.lit(f"{start} to {end}")), ("aliu_entry_name", value("name")), ("aliu_entry_type", value("entry_type")),
        ("aliu_annotation", value("annotation")), ("source_url", value("source_url")), ("cross_referenced_sources", F.col("entry.cross_references"), "json"),
        ("verification_note", value("verification_note"), True), ("citation_disclaimer", F.lit(DISCLAIMER)), ("critical_scholarly_context", F.lit(names.context or None).cast("string"), True),
    ]
    exonerating = F.col("entry.exonerating")
    statement = F.concat(F.lit("Unverified: is the person or firm in this record the one that the list describes? An owner name matches the entry for "), value("name"), F.lit(". The entry's annotation is quoted in full; the match makes no finding."))
    statement = F.concat(statement, F.when(F.col("hit.confirmed"), "").otherwise(" IDENTITY NOT ESTABLISHED: a surname without a given name fits a different individual equally well."))
    context = F.concat(F.lit("An owner name matches the entry for "), value("name"), F.lit(", which is EXONERATING: its annotation, quoted in full, raises no concern. This is context, is not a flag and puts nothing in the queue."))
    told = F.concat(F.lit("NM-001 not applied to "), F.col("source_ref"), F.lit(f": without a date the record cannot be placed in {start} to {end}. The criterion could not run here; that is not a negative result."))
    return [flag(rows.where(~exonerating), "NM-001", statement, parts, "n/a", F.col("hit_seq"))], [note(undated, 10, told, F.col("rn"))], [flag(rows.where(exonerating), "NM-002", context, parts, None, F.col("hit_seq"))]


def dq001(records: DataFrame) -> tuple[list, list]:
    """No source is cited."""
    return [flag(F.col("source_citation").isNull(), "DQ-001", F.lit("Unverified: on what source does this record rest? It cites none."), cite("owner_name", "date_span", "transaction_state", "source_citation"), None)], []


def dq002(records: DataFrame, cfg: Config) -> tuple[list, list]:
    """Acquired after the commitment date without certain earlier records."""
    bought = F.coalesce("is_institution_acquisition", F.lit(False))
    rows = bought & F.coalesce(F.col("span.earliest") > F.lit(cfg.commitment_date), F.lit(False)) & ~F.col("certainly_pre_1945")
    parts = [
        *cite("owner_name", "date_span", "transaction_state"), ("commitment_date_applied", F.lit(str(cfg.commitment_date))), ("commitment_date_source", F.lit(cfg.commitment_source)),
        ("commitment_date_is_default", F.lit(cfg.commitment_is_default)), ("certainly_dated_before_1945", F.lit(False)), ("records_in_chain", F.col("n_records")),
    ]
    statement = F.lit(f"Unverified: what provenance before 1945 was established when the object was acquired? The acquisition is dated after {cfg.commitment_date}, and no record is certainly dated before 1945. The question is about the acquisition, not the object's past.")
    return [flag(rows, "DQ-002", statement, parts, None)], [
        note(of_chain("acquisition_never_set"), 11, F.lit("DQ-002 skipped: no record sets `is_institution_acquisition`, so the date of acquisition is not known.")),
        not_evaluated(bought & ~F.col("is_dated"), 11, 1, "DQ-002", "the acquisition has no date to compare with the commitment date."),
    ]


def general_notes(cfg: Config) -> list:
    """What every object's coverage says beyond single rules."""
    one = F.expr(FIRST)
    out = [
        note(of_chain("possibly_pre_1945 and not certainly_pre_1945"), 12, F.lit("PC-001 did not trigger, but only imprecisely dated records reach before 1945; none is certainly dated before it.")),
        Listed(F.col("resolved"), 13, "The chain records a restitution or settlement at ", ": the object counts as previously resolved and is held out of the active queue; its flags do not reopen a settled matter."),
        Listed(~F.col("is_dated"), 14, "Undated records in chain (", "): date-based criteria were skipped for them."),
    ]
    for rule, names, sub in (("NM-001", cfg.names, 0), ("PC-005", cfg.actors, 1)):
        if names and names.is_seed:
            out.append(note(one, 15, F.lit(f"{rule} ran against a list that calls itself partial ({names.status}; {len(names.entries)} entries). That no name matched is NOT evidence that none is concerned."), sub))
    out.append(note(one, 16, F.lit(f"Criteria evaluated: {', '.join(r for r in RULES if r not in cfg.unavailable)}.")))
    return out


def all_rules(records: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(flags, notes, citations or None) of enriched records."""
    flags, notes = [], []
    for found, said in (pc001(records), pc002(records), pc003(records, cfg), pc010(records), pc004(records, cfg), pc005(records, cfg), pc006(records, cfg), pc007(records), pc008(records), pc009(records, cfg), dq001(records), dq002(records, cfg)):
        flags += found
        notes += said
    named, said, citations = nm001(records, cfg)
    return together(records, flags + named), together(records, notes + said + general_notes(cfg)), together(records, citations) if citations else None
