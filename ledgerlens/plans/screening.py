"""The whole screening: input file to report, as one lazy plan with few actions."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import CIRCA_MARGIN, RULES
from ..operators.assemble import COVERAGE_NOTE, coverage_map, results
from ..operators.chains import enriched
from ..operators.explain import ANSWER, CONTEXT, AnswerStore, Generator, answers, context_key
from ..operators.rules import all_rules
from ..sources.dispatch import load_frames
from ..sources.lido import listed_notes
from ..sources.lists import Config, load_config
from ..staging import new_path, staged

DISCLAIMER = "Machine-generated triage of supplied records. Objects are screened, not cleared; every flag is an open question."


@dataclass
class Screening:
    """The frames of one run; all but ``coverage`` have rows per object or flag."""

    records: DataFrame
    flags: DataFrame
    notes: DataFrame
    citations: DataFrame | None
    objects: DataFrame
    coverage: DataFrame


def screen(records: DataFrame, cfg: Config, resolved_override: DataFrame | None = None) -> Screening:
    """All rules over typed records.  Every rule reads the enriched records, so
    they are staged once; each rule then scans the columns that it needs."""
    rich = staged(enriched(records, cfg.onset, cfg.patterns), "records")
    flags, notes, citations = all_rules(rich, cfg)
    return Screening(rich, flags, notes, citations, results(rich, flags, notes, citations, cfg, resolved_override), coverage_map(rich, flags))


def write(screening: Screening, folder: str, notes: DataFrame | None = None) -> None:
    """The scalable sink: flags by rule, citations, objects and ingest notes as Parquet."""
    if notes is not None:
        notes.write.mode("overwrite").parquet(f"{folder}/ingest_notes")
    screening.flags.drop("chain_seq").write.partitionBy("rule_id").mode("overwrite").parquet(f"{folder}/flags")
    screening.objects.drop("chain_seq").write.mode("overwrite").parquet(f"{folder}/objects")
    screening.coverage.write.mode("overwrite").parquet(f"{folder}/coverage")
    if screening.citations is not None:
        screening.citations.drop("chain_seq").write.mode("overwrite").parquet(f"{folder}/citations")


def list_status(names, count_exonerating: bool = False) -> dict | None:
    if names is None:
        return None
    out = {"status": names.status, "entries": len(names.entries), "is_incomplete": names.is_seed, "context": names.context}
    if count_exonerating:
        out["exonerating_entries"] = sum(e["entry_type"] == "exonerating" for e in names.entries)
    if names.is_seed:
        out["caveat"] = "That no name matched is not evidence that none is concerned."
    return out


def _flag(row, citation: bool = False, answer=None) -> dict:
    out = {"rule_id": row["rule_id"], "rule_statement": row["rule_statement"], "methodology": row["methodology"], "cited_fields": json.loads(row["cited_fields"])}
    if citation:
        out["entry_type"] = out["cited_fields"].get("aliu_entry_type")
    elif row["presumption_tier"] is not None:
        out["presumption_tier"] = row["presumption_tier"]
    return out | (dict(zip(ANSWER, answer(*[row[c] for c in CONTEXT]))) if answer else {"llm_explanation": None})


def object_dict(row, answer=None) -> dict:
    """An object's result; ``answer`` gives a flag's explanation and its status."""
    return {
        "object_id": row["object_id"],
        "object_title": row["object_title"],
        "object_class": row["object_class"],
        "screening_statement": row["screening_statement"],
        "persecution_context_flags": [_flag(f, False, answer) for f in row["persecution_context_flags"] or ()],
        "documentation_quality_flags": [_flag(f, False, answer) for f in row["documentation_quality_flags"] or ()],
        "name_list_citations": [_flag(c, True, answer) for c in row["name_list_citations"] or ()],
        "resolved_status": row["resolved_status"],
        "coverage_note": row["coverage_note"],
    }


def explained(screening: Screening, generator: Generator, store: AnswerStore | None = None) -> DataFrame:
    """The answer of each distinct context of all flags and citations."""
    flags = [f.select(*CONTEXT) for f in (screening.flags, screening.citations) if f is not None]
    store = store or AnswerStore(new_path(screening.flags.sparkSession, "answers"))
    return staged(answers(reduce(DataFrame.unionAll, flags), generator, store), "explanations")


def header(screening: Screening, cfg: Config, input_file: str, input_format: str, ingest_notes: list[dict], margin: int, generator=None) -> dict:
    """What a report says beside its objects."""
    coverage = screening.coverage.first().asDict() | {"note": COVERAGE_NOTE}
    return {
        "disclaimer": DISCLAIMER,
        "generated_at": datetime.now(UTC).replace(microsecond=0).isoformat(),
        "input_file": Path(input_file).name,
        "input_format": input_format,
        "ingest_notes": ingest_notes,
        "onset_table_version": cfg.onset.version,
        "onset_table_review_status": cfg.onset.review_status,
        "date_precision_handling": f"Dates are intervals with a precision; circa widens by {margin} years; imprecise dates never give certainty.",
        "commitment_date": {"applied": str(cfg.commitment_date), "source": cfg.commitment_source, "is_default": cfg.commitment_is_default},
        "reference_lists": {"aliu_red_flag_names": list_status(cfg.names, True), "confiscation_channel_actors": list_status(cfg.actors)},
        "llm_layer": generator.status() if generator is not None else {"enabled": False},
        "criteria_screened": list(RULES),
        "criteria_not_run": [{"rule_id": r, "reason": why} for r, why in sorted(cfg.unavailable.items())],
        "coverage_map": coverage,
    }


def report(screening: Screening, cfg: Config, input_file: str, input_format: str, ingest_notes: list[dict], margin: int, generator=None) -> dict:
    """The report of one collection, for JSON or HTML; it is collected here."""
    answer = None
    if generator is not None:
        told = {r.key: r[1:] for r in explained(screening, generator).toLocalIterator()}
        answer = lambda *context: told[context_key(generator.language_code, *context)]
    objects = [object_dict(r, answer) for r in screening.objects.orderBy("chain_seq").toLocalIterator()]
    return header(screening, cfg, input_file, input_format, ingest_notes, margin, generator) | {"objects": objects}


def screen_file(spark: SparkSession, path: str, cfg: Config, input_format: str | None = None, margin: int = CIRCA_MARGIN) -> tuple[Screening, DataFrame, str]:
    """(frames, ingest notes, format): read, validate (the whole input or nothing), screen."""
    records, notes, fmt = load_frames(spark, path, input_format, margin)
    return screen(records, cfg), notes, fmt


def run(spark: SparkSession, path: str, cfg: Config | None = None, input_format: str | None = None, margin: int = CIRCA_MARGIN, generator=None) -> dict:
    """The report of one input; everything is collected, so it is for one collection."""
    cfg = cfg or load_config()
    screening, notes, fmt = screen_file(spark, path, cfg, input_format, margin)
    return report(screening, cfg, path, fmt, listed_notes(notes), margin, generator)
