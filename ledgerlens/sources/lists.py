"""Loaders of the JSON tables.  They validate on the driver; all are small."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from ..functions.names import Entry
from ..functions.text import fold_text, normalise_text
from ..model import COMMITMENT_DATE, STATES, TIERS

DATA = Path(__file__).resolve().parent.parent / "data"


class ListError(ValueError):
    """A table that can't be used, with every problem found."""


def _read(path) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ListError(f"{path}: {e}") from e


@dataclass(frozen=True)
class Window:
    id: str
    earliest: date
    latest: date
    label: str
    ends: date
    tier: str | None
    tier_basis: str | None
    source: str | None

    @property
    def onset_is_range(self) -> bool:
        return self.earliest != self.latest


@dataclass(frozen=True)
class Territory:
    index: int
    id: str
    name: str
    terms: tuple[str, ...]
    windows: tuple[Window, ...]
    note: str | None = None


@dataclass(frozen=True)
class OnsetTable:
    version: str
    review_status: str
    heightened_from: date
    heightened_label: str
    band_end: date
    territories: tuple[Territory, ...]

    @property
    def band(self) -> tuple[date, date]:
        """From the first onset to the end of the risk band; moves with the table."""
        return min(w.earliest for t in self.territories for w in t.windows), self.band_end


def load_onset_table(path=DATA / "onset_table.json") -> OnsetTable:
    raw = _read(path)
    try:
        end = date.fromisoformat(raw["risk_band_end"]["date"])
        territories = []
        for k, t in enumerate(raw["territories"]):
            windows = tuple(
                Window(w["id"], date.fromisoformat(w["onset_earliest"]), date.fromisoformat(w["onset_latest"]), w["onset_label"], date.fromisoformat(w["ends"]) if w.get("ends") else end, w.get("presumption_tier"), w.get("tier_basis"), w.get("source"))
                for w in t["windows"]
            )
            if any(w.tier not in (None, *TIERS) for w in windows):
                raise ListError(f"{path}: {t['id']}: unknown presumption tier")
            territories.append(Territory(k, t["id"], t["territory"], tuple(fold_text(x) for x in t["match_terms"]), windows, t.get("_note")))
        threshold = raw["heightened_presumption_from"]
        return OnsetTable(str(raw["version"]), raw.get("review_status", ""), date.fromisoformat(threshold["date"]), threshold["label"], end, tuple(territories))
    except (KeyError, TypeError, ValueError) as e:
        raise ListError(f"{path}: {e!r}") from e


@dataclass(frozen=True)
class AnonymousPatterns:
    version: str
    band: tuple[date, date]
    source: str
    patterns: tuple[tuple[str, str], ...]  # as written, normalised


def load_anonymous_patterns(path=DATA / "anonymous_patterns.json") -> AnonymousPatterns:
    raw = _read(path)
    try:
        band = raw["band"]
        return AnonymousPatterns(str(raw["version"]), (date.fromisoformat(band["from"]), date.fromisoformat(band["to"])), band.get("source", ""), tuple((p["pattern"], normalise_text(p["pattern"])) for p in raw["patterns"]))
    except (KeyError, TypeError, ValueError) as e:
        raise ListError(f"{path}: {e!r}") from e


@dataclass(frozen=True)
class NameList:
    """Entries as read, what matching needs of them, and the list's own words."""

    status: str
    context: str
    entries: tuple[dict, ...]
    matching: tuple[Entry, ...]
    is_seed: bool


def _variants(raw: dict, *names: str) -> tuple[str, ...]:
    return tuple(v for n in names for v in raw.get(n) or ())


def _meta(raw: dict, key: str) -> tuple[str, str]:
    meta = raw.get("_meta") or {}
    return meta.get("status", ""), meta.get(key, "")


def load_name_list(path=DATA / "name_list.json") -> NameList:
    raw, problems, entries = _read(path), [], []
    for k, e in enumerate(raw.get("entries") or ()):
        problems += [f"entry {k + 1}: {f} is missing" for f in ("name", "entry_type", "annotation", "source_url") if not e.get(f)]
        kind = e.get("entry_kind", "person")
        if kind not in ("person", "organisation"):
            problems.append(f"entry {k + 1}: entry_kind {kind!r}")
        if e.get("entry_type") not in ("documented_concern", "exonerating"):
            problems.append(f"entry {k + 1}: entry_type {e.get('entry_type')!r}")
        entries.append(e | {"entry_id": str(e.get("entry_id", k + 1)), "entry_kind": kind})
    if not entries:
        problems.append("no entries")
    if problems:
        raise ListError(f"{path}: " + "; ".join(problems))
    status, context = _meta(raw, "critical_scholarly_context")
    matching = tuple(Entry.of(k, e["name"], _variants(e, "name_variants") or _variants(e, "match_terms"), e["entry_kind"]) for k, e in enumerate(entries))
    return NameList(status, context, tuple(entries), matching, any(w in status.lower() for w in ("seed", "incomplete")))


def load_actor_list(path=DATA / "actor_list.json") -> NameList:
    raw, problems, actors = _read(path), [], []
    for k, a in enumerate(raw.get("actors") or raw.get("entries") or ()):
        label = f"actor {k + 1}"
        if not a.get("name"):
            problems.append(f"{label}: name is missing")
        kind = a.get("entry_kind", "organisation")
        if kind not in ("person", "organisation"):
            problems.append(f"{label}: entry_kind {kind!r}")
        bases = a.get("documented_basis")
        bases = [bases] if isinstance(bases, dict) else [{"summary": bases, "sources": a.get("sources"), "implies_persecution_of_former_owner": a.get("implies_persecution_of_former_owner")}] if isinstance(bases, str) else bases
        if not bases:
            problems.append(f"{label}: documented_basis is missing")
        for b in bases or ():
            if not b.get("summary") or not b.get("sources"):
                problems.append(f"{label}: a basis needs a summary and sources")
            if not isinstance(b.get("implies_persecution_of_former_owner"), bool):
                problems.append(f"{label}: implies_persecution_of_former_owner has to be said for every basis")
        actors.append(a | {"actor_id": str(a.get("actor_id", k + 1)), "entry_kind": kind, "documented_basis": bases})
    if not actors:
        problems.append("no actors")
    if problems:
        raise ListError(f"{path}: " + "; ".join(problems))
    status, context = _meta(raw, "critical_context")
    matching = tuple(Entry.of(k, a["name"], _variants(a, "name_variants", "aliases", "match_terms"), a["entry_kind"]) for k, a in enumerate(actors))
    return NameList(status, context, tuple(actors), matching, any(w in status.lower() for w in ("seed", "not exhaustive")))


@dataclass(frozen=True)
class EventTypes:
    version: str
    mapped: dict[str, str]  # identifier or folded term -> state
    unmapped: dict[str, str]  # identifier or folded term -> reason

    def lookup(self, ids: list[str], term: str | None) -> tuple[str | None, str | None]:
        """(state, reason why there is none); identifiers come before terms."""
        keys = [*ids, *([fold_text(term.strip())] if term else [])]
        for table, place in ((self.mapped, 0), (self.unmapped, 1)):
            for key in keys:
                if key in table:
                    return (table[key], None) if place == 0 else (None, table[key])
        return None, None


def load_event_types(path=DATA / "event_type_map.json") -> EventTypes:
    raw = _read(path)
    try:
        mapped = {key: e["transaction_state"] for e in raw["mapped"] for key in (e["lido_id"], fold_text(e["term"]))}
        unmapped = {key: e["reason"] for e in raw["deliberately_unmapped"] for key in (e["lido_id"], fold_text(e["term"]))}
    except (KeyError, TypeError) as e:
        raise ListError(f"{path}: {e!r}") from e
    if wrong := sorted(set(mapped.values()) - set(STATES)):
        raise ListError(f"{path}: unknown states {wrong}")
    return EventTypes(str(raw.get("version", "")), mapped, unmapped)


@dataclass(frozen=True)
class Config:
    """What a screening run compares records with."""

    onset: OnsetTable
    patterns: AnonymousPatterns | None
    names: NameList | None
    actors: NameList | None
    commitment_date: date = COMMITMENT_DATE
    commitment_source: str = "default: Washington Conference Principles"
    commitment_is_default: bool = True
    unavailable: dict[str, str] = field(default_factory=dict)


def load_config(onset=DATA / "onset_table.json", patterns=DATA / "anonymous_patterns.json", names=DATA / "name_list.json", actors=DATA / "actor_list.json", commitment_date: date | None = None, commitment_source: str | None = None) -> Config:
    """The onset table is needed; a missing other list switches its rule off."""
    missing: dict[str, str] = {}

    def optional(path, load, rule):
        if path is None:
            missing[rule] = "no list was given"
            return None
        try:
            return load(path)
        except ListError as e:
            missing[rule] = str(e)
            return None

    table = load_onset_table(onset)
    lists = optional(patterns, load_anonymous_patterns, "PC-006"), optional(names, load_name_list, "NM-001"), optional(actors, load_actor_list, "PC-005")
    if commitment_date is None:
        return Config(table, *lists, unavailable=missing)
    return Config(table, *lists, commitment_date, commitment_source or "given for this run", False, missing)
