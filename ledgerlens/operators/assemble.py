"""From flags, notes and citations to results per object and the coverage map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RULES
from ..sources.lists import Config

COVERAGE_NOTE = (
    "Counts say how much is documented, not how much is at risk. Objects whose own recorded creation is after 1945 can have no earlier "
    "provenance and are counted apart; where no creation date is recorded, or no record marks the institution's accession, that could not be told."
)


def flag_counts(records: DataFrame, flags: DataFrame) -> DataFrame:
    """Per object the flags on each axis; objects without flags have zeros."""
    per = flags.groupBy("object_id").agg(F.count_if(F.col("axis") == "persecution_context").alias("n_persecution"), F.count_if(F.col("axis") == "documentation_quality").alias("n_documentation"))
    one = records.where("rn = 1").select("object_id", "chain_seq")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return one.join(per, "object_id", "left").select("object_id", "chain_seq", zero("n_persecution"), zero("n_documentation"))


def statements(counts: DataFrame, cfg: Config) -> DataFrame:
    """The screening statement; it counts flags, and none is not a clearance."""
    n = sum(r not in cfg.unavailable for r in RULES)
    triggered = F.col("n_persecution") + F.col("n_documentation")
    none = f"Screened against {n} criteria, no criteria triggered. Absence of a flag is not evidence of a clear history; it means the supplied records raised no question that these criteria ask."
    some = F.concat(F.lit(f"Screened against {n} criteria; "), triggered.cast("string"), F.lit(" flags raised. Each flag is an open question for research, not a finding."))
    return counts.withColumn("screening_statement", F.when(triggered == 0, none).otherwise(some))


def coverage_notes(notes: DataFrame) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct("note_seq", "sub_seq", "note")))
    return notes.groupBy("object_id").agg(F.array_join(F.transform(pieces, lambda n: n["note"]), " ").alias("coverage_note"))


def coverage_map(records: DataFrame, flags: DataFrame) -> DataFrame:
    """One row of counts over all objects."""
    begins = flags.where("rule_id = 'PC-002'").select("object_id").distinct().withColumn("begins", F.lit(True))
    one = records.where("rn = 1").join(begins, "object_id", "left")
    count = lambda cond, name: F.count_if(cond).alias(name)
    possibly, begun = F.col("possibly_pre_1945"), F.col("begins").isNotNull()
    return one.agg(
        F.count("*").alias("objects_processed"),
        count(possibly, "with_any_pre_1945_provenance"),
        count(possibly & F.col("certainly_pre_1945"), "of_which_certainly_dated_pre_1945"),
        count(~possibly & ~F.col("created_after"), "with_no_pre_1945_provenance"),
        count(~possibly & F.col("created_after"), "created_after_the_risk_band"),
        count(F.col("created").isNull(), "creation_date_not_recorded"),
        count(begun, "chain_begins_at_institutional_acquisition"),
        count(~begun & F.col("acquisition_never_set"), "institutional_acquisition_not_determinable"),
        count(F.col("any_resolved"), "previously_resolved"),
    )


def results(records: DataFrame, flags: DataFrame, notes: DataFrame, citations: DataFrame | None, cfg: Config, resolved_override: DataFrame | None = None) -> DataFrame:
    """A row for each object: its statement, flags of both axes, citations,
    status and coverage note.  ``resolved_override`` (object_id, resolved) lets
    a person settle or reopen the status."""
    order = ("rule_seq", "rec_rn", "sub_seq")
    body = F.struct(*order, "rule_id", "rule_statement", "methodology", "presumption_tier", "cited_fields")
    axis = lambda name: F.array_sort(F.collect_list(F.when(F.col("axis") == name, body)))
    per = flags.groupBy("object_id").agg(axis("persecution_context").alias("persecution_context_flags"), axis("documentation_quality").alias("documentation_quality_flags"))
    out = statements(flag_counts(records, flags), cfg).join(per, "object_id", "left").join(coverage_notes(notes), "object_id", "left")
    if citations is not None:
        out = out.join(citations.groupBy("object_id").agg(F.array_sort(F.collect_list(body)).alias("name_list_citations")), "object_id", "left")
    else:
        out = out.withColumn("name_list_citations", F.lit(None))
    one = records.where("rn = 1").select("object_id", F.col("title").alias("object_title"), F.col("class").alias("object_class"), "any_resolved")
    out = out.join(one, "object_id")
    resolved = F.col("any_resolved")
    if resolved_override is not None:
        out = out.join(resolved_override.select("object_id", F.col("resolved").alias("set_by_hand")), "object_id", "left")
        resolved = F.coalesce("set_by_hand", resolved)
    return out.withColumn("resolved_status", F.when(resolved, "previously_resolved").otherwise("unresolved"))


def bands(results_: DataFrame) -> DataFrame:
    """Where the work queue shows an object.  For showing only, never stored."""
    has = lambda test: F.exists("persecution_context_flags", test)
    some = lambda test: F.coalesce(has(test), F.lit(False))
    band = (
        F.when(some(lambda f: f["presumption_tier"] == "heightened"), "heightened")
        .when(some(lambda f: f["presumption_tier"] == "ordinary"), "ordinary")
        .when(some(lambda f: f["rule_id"].isin("NM-001", "PC-005")), "namelist")
        .when(some(lambda f: f["rule_id"] == "PC-008"), "settlement")
        .when(F.coalesce(F.size("persecution_context_flags") > 0, F.lit(False)), "coverage")
        .when(F.coalesce(F.size("documentation_quality_flags") > 0, F.lit(False)), "documentation")
        .otherwise("none")
    )
    held = (F.col("resolved_status") == "previously_resolved") & ~some(lambda f: f["rule_id"] == "PC-008")
    return results_.select("object_id", band.alias("band"), held.alias("held_out"))
