"""Scans of texts and artifacts for credentials before publication."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes of credentials, as (label, pattern).
PATTERNS = (
    ("bearer token", r"Bearer\s+[A-Za-z0-9._~+/-]{16,}"),
    ("generic api key assignment", r"(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"]?[A-Za-z0-9._~+/-]{16,}"),
)
EXCERPT = 24


def setting_patterns(*names: str) -> tuple[tuple[str, str], ...]:
    """Patterns for values given to settings of these names (such as a vendor's)."""
    return tuple((f"value of {n}", rf"{re.escape(n)}[ \t]*=[ \t]*\S+") for n in names)


def is_placeholder(match: str) -> bool:
    """Nothing but quotes stands after the first equals sign."""
    return not match.partition("=")[2].strip("'\" \t\r\n")


def scan_text(label: str, text: str, allow_placeholders: bool = False, known_safe: frozenset[tuple[str, str]] = frozenset(), patterns=PATTERNS) -> list[str]:
    """Findings; exemptions go by a value in a place, never by the place alone."""
    safe = [value for place, value in known_safe if place == label]
    found = [(kind, m) for kind, pattern in patterns for m in (x.group() for x in re.finditer(pattern, text))]
    kept = [(kind, m) for kind, m in found if not any(v in m for v in safe) and not (allow_placeholders and is_placeholder(m))]
    return [f"{label}: possible {kind} ({m if len(m) <= EXCERPT else m[:EXCERPT] + '…'})" for kind, m in kept]


def findings(text: Column, patterns=PATTERNS, allow_placeholders: bool = False, place: Column | None = None, known_safe: frozenset[tuple[str, str]] = frozenset()) -> Column:
    """(label, excerpt) of every match, in the order of the patterns, with the
    exemptions of ``scan_text``; ``place`` says where a text stands."""
    place = F.lit("") if place is None else place
    exempt = [lambda m, p=p, v=v: (place == p) & m.contains(v) for p, v in sorted(known_safe)]
    if allow_placeholders:
        # nothing but quotes after the first equals sign, or no such sign
        exempt.append(lambda m: F.regexp_extract(m, "(?s)^[^=]*=(.*)$", 1).rlike("^['\" \t\r\n]*$"))
    kept = lambda m: ~reduce(lambda a, b: a | b, [e(m) for e in exempt], F.lit(False))
    # a lambda of two parameters would get the index as its second
    labelled = lambda name: lambda m: F.struct(F.lit(name).alias("label"), F.substring(m, 1, EXCERPT).alias("excerpt"))
    each = [F.transform(F.filter(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), kept), labelled(name)) for name, p in patterns]
    return F.concat(*each)


def scan_tree(files: DataFrame, patterns=PATTERNS, placeholder_places: frozenset[str] = frozenset(), known_safe: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """``place``, ``label`` and ``excerpt`` of what a tree's files (``place``,
    ``text``) show; an empty value is none in places for placeholders."""
    place, text = F.col("place"), F.col("text")
    strict = findings(text, patterns, False, place, known_safe)
    found = F.when(place.isin(*placeholder_places), findings(text, patterns, True, place, known_safe)).otherwise(strict) if placeholder_places else strict
    return files.select("place", F.explode(found).alias("f")).select("place", "f.label", "f.excerpt")


def rejected_tokens(violations: DataFrame, limit: int = 40) -> DataFrame:
    """The tokens most often rejected, by kind: a top-k report."""
    return violations.groupBy("kind", "token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "token").limit(limit)


def acceptance(cases: DataFrame) -> DataFrame:
    """Accepted texts of ordinary and adversarial cases."""
    return cases.groupBy("adversarial").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))


def scan_artifact(path) -> list[str]:
    """Credentials in a written report, and flags without cited fields."""
    text = Path(path).read_text(encoding="utf-8")
    out = scan_text(Path(path).name, text)
    if str(path).endswith(".json"):
        for o in json.loads(text).get("objects", ()):
            for channel in ("persecution_context_flags", "documentation_quality_flags", "name_list_citations"):
                out += [f"{o['object_id']}: {f['rule_id']} cites no field" for f in o.get(channel, ()) if not f.get("cited_fields")]
    return out


def describe_artifact(path) -> dict[str, int]:
    """Objects and entries on all three channels of a JSON report."""
    objects = json.loads(Path(path).read_text(encoding="utf-8"))["objects"]
    channels = ("persecution_context_flags", "documentation_quality_flags", "name_list_citations")
    return {"objects": len(objects)} | {c: sum(len(o[c]) for o in objects) for c in channels}
