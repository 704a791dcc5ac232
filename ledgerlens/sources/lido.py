"""LIDO-XML: events of museum records to raw rows, with notes on the way.

Files are split at the ends of records, so that one large file is read by many
tasks; a task holds one record at a time as a tree.  It gives rows, problems and
notes in one pass, numbered inside its split, and the sizes of the splits before
it make them numbers of the file.

What stands outside the records (the wrapping element, the prolog) is looked at
for each file by itself.  A file that is not just a wrap of records in UTF-8,
or of which any record doesn't parse alone, is read whole by one task instead,
and that reading's rows and problems count.
"""

from __future__ import annotations

import calendar
import itertools
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_text
from ..model import CIRCA_MARGIN, FIELDS
from ..numbering import numbered
from ..staging import broadcast_if_small, staged
from .lists import EventTypes, load_event_types
from .records import typed, valid

#: Marks a line that gives a field: capitals and this ending.
EXTENSION = re.compile("[A-Z]+_EXT:")
DATE = re.compile(r"[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?")

# Role terms, compared folded.
RECEIVING = frozenset(
    ("owner", "new owner", "buyer", "purchaser", "recipient", "acquirer", "consignee", "holder", "eigentumer", "eigentuemer", "besitzer", "kaufer", "kaeufer", "erwerber", "empfanger", "empfaenger", "neuer eigentumer")
)
TRANSFERRING = frozenset(("seller", "vendor", "previous owner", "former owner", "consignor", "donor", "lender", "verkaufer", "vorbesitzer", "einlieferer", "schenker", "verausserer"))


class RowError(ValueError):
    pass


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def kids(element, *path: str) -> list:
    """All elements down a path of local names."""
    found = [element] if element is not None else []
    for name in path:
        found = [k for e in found for k in e if local(k.tag) == name]
    return found


def kid(element, *path: str):
    return next(iter(kids(element, *path)), None)


def text(element) -> str | None:
    return ("".join(element.itertext()).strip() or None) if element is not None else None


def attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if local(k) == name), None)


def appellations(holder, *path: str) -> list[str]:
    """Preferred forms first, each once."""
    values = [((attribute(a, "pref") or "").lower() != "preferred", text(a)) for a in kids(holder, *path, "appellationValue")]
    return list(dict.fromkeys(v for _, v in sorted((x for x in values if x[1]), key=lambda x: x[0])))


def place_text(place) -> str | None:
    """Innermost place first, then those it is part of."""
    names = []
    while place is not None:
        names += appellations(place, "namePlaceSet")[:1]
        place = kid(place, "partOfPlace")
    return ", ".join(names) or None


def plain_date(raw: str) -> str:
    """The date of a date or time; only full parts count."""
    value = raw.strip().partition("T")[0]
    if not DATE.fullmatch(value):
        raise RowError(f"not a date in the form YYYY-MM-DD: {raw!r}")
    return value


def coarsen(earliest: str | None, latest: str | None) -> tuple[str | None, str | None]:
    """A span of whole months or years is written as such."""
    if not earliest or not latest or len(earliest) < 10 or len(latest) < 10:
        return earliest, latest
    (y1, m1, d1), (y2, m2, d2) = (map(int, v.split("-")) for v in (earliest, latest))
    if d1 != 1 or not 1 <= m2 <= 12 or d2 != calendar.monthrange(y2, m2)[1]:
        return earliest, latest
    if (m1, m2) == (1, 12):
        return f"{y1:04}", f"{y2:04}"
    return earliest[:7], latest[:7]


GRANULARITY = {10: "exact", 7: "month", 4: "year"}


def extensions(lines: str, ref: str) -> tuple[dict[str, str], list[str]]:
    """Marked lines as fields (the last of a name counts), the rest as prose."""
    fields, prose = {}, []
    for line in lines.splitlines():
        line = line.strip()
        if not (mark := EXTENSION.match(line)):
            if line:
                prose.append(line)
            continue
        name, sign, value = line[mark.end() :].partition("=")
        if not sign or name.strip() not in FIELDS:
            raise RowError(f"{ref}: not a known extension: {line!r}")
        fields[name.strip()] = value.strip()
    return fields, prose


def owner_of(event, ref: str) -> tuple[str, list[str]]:
    """The receiving party's name and its other forms."""
    actors = []
    for actor in kids(event, "eventActor", "actorInRole"):
        names = appellations(actor, "actor", "nameActorSet")
        roles = {fold_text(text(r) or "") for r in kids(actor, "roleActor", "term")}
        if names:
            actors.append((names, roles))
    if not actors:
        raise RowError(f"{ref}: no named party, and owner_name is required")
    if len(actors) == 1:
        names, roles = actors[0]
        if roles & TRANSFERRING and not roles & RECEIVING:
            raise RowError(f"{ref}: the only named party parted with the object; the new owner is not named")
        return names[0], names[1:]
    receiving = [names for names, roles in actors if roles & RECEIVING]
    if len(receiving) != 1:
        raise RowError(f"{ref}: {len(actors)} parties, and not exactly one is the receiving party")
    return receiving[0][0], receiving[0][1:]


def event_row(event, fields: dict, ref: str, types: EventTypes, note) -> dict:
    """One event as a raw row; extension values replace what LIDO says."""
    described = [text(n) for n in kids(event, "eventDescriptionSet", "descriptiveNoteValue")]
    own, prose = extensions("\n".join(d for d in described if d), ref)
    row = dict.fromkeys(FIELDS) | fields
    row["notes"] = " ".join(prose) or None
    row["source_citation"] = text(kid(event, "eventDescriptionSet", "sourceDescriptiveNote"))
    if not own.get("owner_name"):
        name, variants = owner_of(event, ref)
        row["owner_name"], row["owner_name_variants"] = name, "|".join(variants) or None
    span = kid(event, "eventDate", "date")
    ends = [text(kid(span, n)) for n in ("earliestDate", "latestDate")] if span is not None else [None, None]
    if any(ends):
        try:
            first, last = coarsen(*[plain_date(e) if e else None for e in ends])
        except RowError as e:
            raise RowError(f"{ref}: {e}") from e
        given = [GRANULARITY[len(e)] for e in (first, last) if e]
        row["date_precision"] = next(p for p in ("year", "month", "exact") if p in given)
        row["date_from"], row["date_to"] = first, None if last == first else last
    elif (shown := text(kid(event, "eventDate", "displayDate"))) and "date_precision" not in own:
        note("display_date_not_parsed", f"display date {shown!r} is not read as a date; the record is undated")
    kind = kid(event, "eventType")
    ids = [v.rstrip("/").rpartition("/")[2] for c in kids(kind, "conceptID") if (v := text(c))]
    term = text(kid(kind, "term"))
    state, why = types.lookup(ids, term)
    row["transaction_state"] = state
    if state is None and "transaction_state" not in own:
        note("event_type_not_mapped", f"event type {term or ', '.join(ids) or 'not given'}: {why or 'not in the map'}")
    places = kids(event, "eventPlace")
    row["location"] = place_text(kid(places[0], "place")) if places else None
    if len(places) > 1:
        note("multiple_event_places", f"{len(places)} places are given; the first is used")
    return row | {k: v or None for k, v in own.items()}


def object_fields(record, ref: str) -> dict:
    ident = text(kid(record, "lidoRecID")) or text(kid(record, "administrativeMetadata", "recordWrap", "recordID"))
    if not ident:
        raise RowError(f"{ref}: object_id is required (lidoRecID or recordID)")
    described = kid(record, "descriptiveMetadata")
    return {
        "object_id": ident,
        "object_title": next(iter(appellations(described, "objectIdentificationWrap", "titleWrap", "titleSet")), None),
        "object_class": text(kid(described, "objectClassificationWrap", "objectWorkTypeWrap", "objectWorkType", "term")),
    }


def record_rows(record, file: str, label: str, types: EventTypes, order: int) -> Iterator[dict]:
    """Rows, problems and notes of one record, each with its ``kind``; events
    are numbered from ``order``.  A record without id has problems only."""
    fields = object_fields(record, f"{file}: {label}")
    sets = kids(record, "descriptiveMetadata", "eventWrap", "eventSet")
    for pos, event in enumerate((e for s in sets if (e := kid(s, "event")) is not None), 1):
        ref, notes = f"{file}:{fields['object_id']} event {pos}", []
        try:
            row = event_row(event, fields, ref, types, lambda kind, detail: notes.append((kind, detail)))  # noqa: B023
            yield row | {"kind": "row", "source_ref": ref, "source_order": order}
        except RowError as e:
            yield {"kind": "problem", "detail": str(e)}
        order += 1
        for kind, detail in notes:
            yield {"kind": kind, "source_ref": ref, "detail": detail, "source_order": order}
    yield {"kind": "end", "source_order": order}


def parse(content: bytes, file: str, types: EventTypes) -> Iterator[dict]:
    """Rows, problems and notes of one whole file."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        yield {"kind": "problem", "detail": f"{file}: not well-formed XML: {e}"}
        return
    records = [root] if local(root.tag) == "lido" else [k for k in root if local(k.tag) == "lido"]
    if not records:
        yield {"kind": "problem", "detail": f"{file}: no lido elements"}
    order = 0
    for n, record in enumerate(records, 1):
        try:
            for row in record_rows(record, file, f"record {n}", types, order):
                if row["kind"] == "end":
                    order = row["source_order"]
                else:
                    yield row
        except RowError as e:
            yield {"kind": "problem", "detail": str(e)}
    if records and not order:
        yield {"kind": "problem", "detail": f"{file}: no events"}


SCHEMA = "path string, kind string, detail string, source_ref string, source_order bigint, " + ", ".join(f"{f} string" for f in FIELDS)
COLUMNS = ["path", "kind", "detail", "source_ref", "source_order", *FIELDS]
#: Events that a file may have before the order of files and events mixes.
FILE_EVENTS = 1 << 32


def frame_of(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda d: d.notna(), None)


def read_whole(spark: SparkSession, paths: list[str], types: EventTypes) -> DataFrame:
    """Files that are parsed whole, each by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = [r | {"path": file} for r in parse(bytes(content), os.path.basename(file), types)]
                if rows:
                    yield frame_of(rows, COLUMNS)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, SCHEMA)


# --- reading by records ------------------------------------------------------

#: What start tags without attributes and end tags of records have in common.
MARK = "lido>"
#: What bytes become that are not UTF-8.
BAD = "\ufffd"
ENDED, BEGUN = re.compile(r"</(?:[\w.-]+:)?$"), re.compile(r"<(?:[\w.-]+:)?$")
SILENT = re.compile(r"<!--(?:(?!--).)*-->|\s+", re.DOTALL)
TAG = re.compile("<[^<>]*>")
#: Of an element or an attribute; text may have colons too.
PREFIX = re.compile(r"^</?([A-Za-z_][\w.-]*):[A-Za-z_]|\s([A-Za-z_][\w.-]*):[A-Za-z_][\w.-]*\s*=")
DECLARED = re.compile(r"xmlns:([\w.-]+)\s*=")
ENCODING = re.compile(r"<\?xml[^>]*encoding\s*=\s*[\"']([^\"']+)")

PIECE_COLUMNS = ["path", "block", "record", "kind", "detail", "source_ref", "source_order", *FIELDS]
PIECE_SCHEMA = "path string, block bigint, record bigint, kind string, detail string, source_ref string, source_order bigint, " + ", ".join(f"{f} string" for f in FIELDS)


def record_of(piece: str) -> tuple[str, str | None, set[str]]:
    """(what stands before a record, the record or None, prefixes from outside).

    A piece is what lies between two marks.  If an end tag stands at its end it
    holds a record, whose start tag the mark before has taken unless it has
    attributes.
    """
    if not (end := ENDED.search(piece)):
        begun = BEGUN.search(piece)
        return (piece[: begun.start()] if begun else piece), None, set()
    prefix = end.group()[2:]
    start = re.search(rf"<{re.escape(prefix)}lido(?=\s)", piece)
    before, body = (piece[: start.start()], piece[start.start() :]) if start else ("", f"<{prefix}{MARK}{piece}")
    used = {a or b for tag in TAG.findall(body + MARK) if ":" in tag for a, b in PREFIX.findall(tag)} - {"xml", "xmlns"}
    return before, body + MARK, used - set(DECLARED.findall(body))


def tree_of(record: str, prefixes: set[str]):
    """The record as a tree; only local names are read, so any namespace will do."""
    return ET.fromstring("<r" + "".join(f' xmlns:{p}="{p}"' for p in sorted(prefixes)) + f">{record}</r>")[0]


def read_pieces(spark: SparkSession, path: str, types: EventTypes) -> DataFrame:
    """Rows, problems and notes of every split's records; besides, for each split,
    ``count`` (records and events), ``outside`` (what stands there), ``prefix``
    (declared outside) and ``odd`` (a piece that isn't a record by itself)."""

    def split(file: str, block: int, pieces: Iterator[str]) -> Iterator[dict]:
        name, n, order, prefixes = os.path.basename(file), 0, 0, set()
        for piece in pieces:
            before, record, needed = record_of(piece)
            if SILENT.sub("", before) or BAD in before:
                yield {"kind": "outside", "detail": before, "record": n}
            if record is None:
                continue
            n += 1
            try:
                if BAD in record:
                    raise ET.ParseError("bytes that are not UTF-8")
                for row in record_rows(tree_of(record, needed), name, "record", types, order):
                    if row["kind"] == "end":
                        order = row["source_order"]
                    else:
                        yield row | {"record": n}
            except ET.ParseError:
                yield {"kind": "odd", "record": n}
            except RowError as e:
                yield {"kind": "problem", "detail": str(e), "record": n, "source_order": -1}
            for p in needed - prefixes:
                yield {"kind": "prefix", "detail": p}
            prefixes |= needed
        yield {"kind": "count", "record": n, "source_order": order}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((p, b, v) for batch in batches for p, b, v in zip(batch["path"], batch["block"], batch["value"]))
        rows: list[dict] = []
        for (file, block), group in itertools.groupby(pieces, key=lambda x: x[:2]):
            for row in split(file, block, (v for _, _, v in group)):
                rows.append(row | {"path": file, "block": block})
                if len(rows) >= 5_000:
                    yield frame_of(rows, PIECE_COLUMNS)
                    rows = []
        if rows:
            yield frame_of(rows, PIECE_COLUMNS)

    decoded = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    pieces = spark.read.option("lineSep", MARK).text(path).select(decoded.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"))
    return pieces.mapInPandas(run, PIECE_SCHEMA)


def regular(outside: list[str], records: int, prefixes: set[str]) -> bool:
    """Whether a file is a wrap of records, or one record, and nothing else."""
    if not records or len(outside) > 2:
        return False
    head = outside[0] if outside else ""
    encoding = ENCODING.search(head)
    if BAD in "".join(outside) or encoding and encoding[1].lower() not in ("utf-8", "utf8", "us-ascii") or "<!DOCTYPE" in head or prefixes - set(DECLARED.findall(head)):
        return False
    n = min(records, 2)
    try:
        root = ET.fromstring((head + "<lido/>" * n + "".join(outside[1:])).strip())
    except ET.ParseError:
        return False
    return local(root.tag) == "lido" or [local(k.tag) for k in root] == ["lido"] * n


def irregular_files(pieces: DataFrame) -> DataFrame:
    """Paths of files that have to be read whole."""
    is_kind = lambda k: F.col("kind") == k
    found = pieces.where(F.col("kind").isin("count", "outside", "odd", "prefix")).groupBy("path").agg(
        F.sum(F.when(is_kind("count"), F.col("record"))).alias("records"),
        F.count_if(is_kind("odd")).alias("odd"),
        F.count_if(is_kind("outside")).alias("n_outside"),
        # the first and the last are all that a regular file has
        F.min(F.when(is_kind("outside"), F.struct("block", "record", "detail"))).alias("first"),
        F.max(F.when(is_kind("outside"), F.struct("block", "record", "detail"))).alias("last"),
        F.collect_set(F.when(is_kind("prefix"), F.col("detail"))).alias("prefixes"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odd = []
            for r in batch.to_dict("records"):
                outside = [r["first"], r["last"]][: r["n_outside"]] if r["n_outside"] <= 2 else [""] * 3
                if r["odd"] or not regular(outside, r["records"], set(r["prefixes"])):
                    odd.append(r["path"])
            yield pd.DataFrame({"path": odd}, dtype=object)

    texts = found.select("path", "records", "odd", "n_outside", F.col("first.detail").alias("first"), F.col("last.detail").alias("last"), "prefixes")
    return texts.mapInPandas(run, "path string")


def read_events(spark: SparkSession, path: str, types: EventTypes) -> DataFrame:
    """Rows, problems and notes of all files; ``source_order`` counts inside one.
    They come from staged tables, so that many readers may each take their part."""
    pieces = staged(read_pieces(spark, path, types), "pieces")
    irregular = staged(irregular_files(pieces), "irregular")
    whole = [r.path for r in irregular.collect()]
    in_order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.where("kind = 'count'").select("path", "block", "record", "source_order")
    # one row a split; the splits of a file are added up
    before = staged(sizes.select("path", "block", *[F.coalesce(F.sum(c).over(in_order), F.lit(0)).alias(f"{c}s_before") for c in ("record", "source_order")]), "before")
    rows = pieces.where(~F.col("kind").isin("count", "outside", "odd", "prefix")).join(broadcast_if_small(before), ["path", "block"])
    # a problem of the record itself names its number in the file
    told = F.regexp_replace("detail", r"(?s)^(.*?): record: ", F.concat(F.lit("$1: record "), (F.col("records_before") + F.col("record")).cast("string"), F.lit(": ")))
    rows = rows.withColumns({"detail": F.when((F.col("kind") == "problem") & (F.col("source_order") == -1), told).otherwise(F.col("detail")), "source_order": F.when(F.col("source_order") >= 0, F.col("source_orders_before") + F.col("source_order"))}).select(*COLUMNS)
    totals = sizes.groupBy("path").agg(F.sum("record").alias("records"), F.sum("source_order").alias("events"))
    empty = totals.where("records > 0 and events = 0").select("path", F.lit("problem").alias("kind"), F.concat(F.element_at(F.split("path", "/"), -1), F.lit(": no events")).alias("detail"))
    rows = rows.unionByName(empty, allowMissingColumns=True)
    return rows.join(broadcast_if_small(irregular), "path", "left_anti").select(*COLUMNS).unionByName(staged(read_whole(spark, whole, types), "whole")) if whole else rows


def in_file_order(events: DataFrame) -> DataFrame:
    """``source_order`` over all files, which count by path; only paths are numbered."""
    files = numbered(events.select("path").distinct(), "path", number="file")
    return events.join(broadcast_if_small(files), "path").withColumn("source_order", F.col("file") * F.lit(FILE_EVENTS) + F.col("source_order")).drop("path", "file")


NOTES = "source_order bigint, source_ref string, kind string, detail string"


def load_frames(spark: SparkSession, path: str, margin: int = CIRCA_MARGIN, types: EventTypes | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed records, ingest notes); the whole input is rejected on problems."""
    read = read_events(spark, path, types or load_event_types())
    events = in_file_order(read)
    typed_rows = staged(typed(events.where("kind = 'row'").drop("kind", "detail"), margin), "typed")
    # a file that can't be read as a whole has no place in the order
    unread = read.where("kind = 'problem'").select(F.lit(-1).cast("bigint").alias("source_order"), F.col("detail").alias("problem"))
    records = valid(typed_rows, unread)
    return records, events.where("kind not in ('row', 'problem')").select("source_order", "source_ref", "kind", "detail")


def listed_notes(notes: DataFrame, most: int | None = None) -> list[dict]:
    """The notes of one collection, or the first of them, for its report."""
    found = notes.orderBy("source_order", "kind")
    return [r.asDict() for r in (found if most is None else found.limit(most)).select("source_ref", "kind", "detail").collect()]


def load_records(spark: SparkSession, path: str, margin: int = CIRCA_MARGIN, types: EventTypes | None = None) -> tuple[DataFrame, list[dict]]:
    """(typed records, ingest notes as a list).  The list is collected, so it is for
    one collection; ``load_frames`` leaves the notes where they are."""
    records, notes = load_frames(spark, path, margin, types)
    return records, listed_notes(notes)
