"""Record files in CSV: a closed header, and whole-file validation.

Files are split wherever the file system likes, so that one large file is read
by many tasks.  Quoted values may hold line ends, so whether a split begins
inside one is worked out first: each split says how it would end, were it to
begin outside a quoted value or inside one, and one look at these answers in the
order of the splits tells how each begins.  Then every task puts lines together
to rows; rows that lie across splits come in parts that are joined.

Files with other line ends than a line feed (with or without a carriage return)
are read whole by one task.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..model import CIRCA_MARGIN, FIELDS, REQUIRED
from ..numbering import numbered
from ..staging import staged
from .records import InputError, typed, valid

OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Rows that a file may have before the order of files and rows mixes.
FILE_ROWS = 1 << 40
#: Ways of writing the one header that are looked at.
HEADERS = 1_000


def file_path():
    """The path that a row was read from, as it is spelt."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins outside or inside a quoted value ends inside one."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line.startswith('"', at):  # a doubled quote is one of the value
                at += 1
                continue
            inside, at = False, line.find(",", at) + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:  # a quote inside a plain value is nothing special
            at = line.find(",", at) + 1
        if not at:
            return False


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Iterator]]:
    rows = (r for batch in batches for r in batch.itertuples(index=False, name=None))
    for (path, block), group in itertools.groupby(rows, key=lambda r: r[:2]):
        yield path, block, group


def split_ends(lines: DataFrame) -> DataFrame:
    """How each split ends if it begins outside, and inside, a quoted value, and
    whether a row ends in it in the second case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, block, group in _by_split(batches):
            out, in_, closed = False, True, False
            for _, _, line in group:
                if line is not None:
                    out, in_ = ends_inside(line, out), ends_inside(line, in_)
                closed = closed or not in_
            yield pd.DataFrame([(path, block, out, in_, closed)], columns=["path", "block", "out", "in", "closed"])

    # lines without quotes change nothing and needn't be told
    told = lines.select("path", "block", F.when(F.contains("line", F.lit('"')), F.col("line")).alias("line"))
    return told.mapInPandas(run, "path string, block bigint, out boolean, in boolean, closed boolean")


def split_begins(ends: DataFrame) -> DataFrame:
    """``inside``: whether a split begins inside a value; ``owner``: the split
    that the row begins in.  A row a split, by file."""

    def run(splits: pd.DataFrame) -> pd.DataFrame:
        inside, owner, rows = False, -1, []
        for r in splits.sort_values("block").to_dict("records"):
            rows.append((r["path"], r["block"], inside, owner if inside else r["block"]))
            after = r["in"] if inside else r["out"]
            if after and (not inside or r["closed"]):
                owner = r["block"]
            inside = after
        return pd.DataFrame(rows, columns=["path", "block", "inside", "owner"])

    return ends.groupBy("path").applyInPandas(run, "path string, block bigint, inside boolean, owner bigint")


ROWS = "path string, block bigint, seq bigint, kind string, text string"


def split_rows(lines: DataFrame, begins: DataFrame) -> DataFrame:
    """Rows of each split, numbered in it; ``part``: of a row across splits;
    ``count``: of the rows that begin in it; ``odd``: another line end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, block, group in _by_split(batches):
            rows, held, n, begun, odd, inside = [], [], 0, False, False, None
            for _, _, started, owner, line in group:
                if inside is None:
                    inside = begun = started  # ``begun``: the row began before
                odd = odd or "\r" in line[:-1]
                if not inside and not line.rstrip("\r"):
                    continue  # an empty line is no row
                held.append(line)
                inside = ends_inside(line, inside) if '"' in line else inside
                if not inside:
                    text = "\n".join(held)
                    rows.append((path, owner, block, "part", text) if begun else (path, block, n, "row", text))
                    n, held, begun = n + (not begun), [], False
                    if len(rows) >= 5_000:
                        yield pd.DataFrame(rows, columns=["path", "block", "seq", "kind", "text"])
                        rows = []
            if held:  # goes on in the next split
                rows.append((path, owner if begun else block, block, "part", "\n".join(held)))
                n += not begun
            rows.append((path, block, n, "count", None))
            if odd:
                rows.append((path, block, 0, "odd", None))
            yield pd.DataFrame(rows, columns=["path", "block", "seq", "kind", "text"])

    # a short row for each split that begins inside a value: broadcast, as a
    # shuffle would bring the lines out of their order
    placed = lines.join(F.broadcast(begins.where("inside")), ["path", "block"], "left")
    told = placed.select("path", "block", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("owner", "block").alias("owner"), "line")
    return told.mapInPandas(run, ROWS)


def read_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(``path``, ``row`` from 0 and ``text`` of every row, files to be read whole)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line"))
    found = staged(split_rows(lines, split_begins(split_ends(lines))), "rows")
    in_order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.where("kind = 'count'").select("path", "block", "seq", F.coalesce(F.sum("seq").over(in_order), F.lit(0)).alias("before"))
    # a row across splits is the last that begins in its first one
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"])
    across = found.where("kind = 'part'").groupBy("path", "block").agg(F.array_join(pieces, "\n").alias("text"))
    across = across.join(counts, ["path", "block"]).select("path", "block", (F.col("seq") - 1).alias("seq"), "text")
    whole = found.where("kind = 'row'").select("path", "block", "seq", "text").unionByName(across)
    rows = whole.join(counts.select("path", "block", "before"), ["path", "block"])
    odd = [r.path for r in found.where("kind = 'odd'").select("path").distinct().collect()]
    return rows.select("path", (F.col("before") + F.col("seq")).alias("row"), F.regexp_replace("text", "\r$", "").alias("text")), odd


def header_names(text: str) -> list[str]:
    """The columns that a header gives; empty and repeated ones get a number."""
    given = next(csv.reader(io.StringIO(text, newline="")), [])
    names = [n if n else f"_c{k}" for k, n in enumerate(given)]
    return [(f"{n}{k}" if names.count(n) > 1 else n).strip() for k, n in enumerate(names)]


def _checked(path: str, names: list[str]) -> None:
    problems = [f"{path}: unknown column {n!r}" for n in names if n not in FIELDS]
    problems += [f"{path}: column {n!r} is missing" for n in REQUIRED if n not in names]
    if problems:
        raise InputError(problems)


def read_whole(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """All input columns, ``path`` and ``row`` of files that one task each reads."""
    frame = spark.read.csv(files, header=True, multiLine=True, inferSchema=False, enforceSchema=False, **OPTIONS)
    names = [c.strip() for c in frame.columns]
    _checked(path, names)
    numbered_ = frame.toDF(*names).withColumns({"path": file_path(), "at": F.monotonically_increasing_id()})
    row = F.col("at") - F.min("at").over(Window.partitionBy("path")) + 1
    return numbered_.select("path", row.alias("row"), *[F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in FIELDS])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All input columns as strings, ``source_ref`` and ``source_order``.

    Rows are numbered inside their file, the header being the first; files
    follow by path.  Empty lines are no rows; rows of empty cells count but are
    left out.
    """
    path = str(path)
    try:
        rows, odd = read_rows(spark, path)
        headers = rows.where("row = 0")
        if odd:
            headers = headers.where(~F.col("path").isin(odd))
        seen = [(r.text, r.path) for r in headers.groupBy("text").agg(F.min("path").alias("path")).orderBy("path").limit(HEADERS).collect()]
    except Exception as e:
        raise InputError([f"{path}: can't be read: {str(e).splitlines()[0]}"]) from e
    names = header_names(seen[0][0]) if seen else []
    if seen or not odd:
        _checked(path, names)
    if others := [f"{file}: its header is not that of {seen[0][1]}" for text, file in seen if header_names(text) != names]:
        raise InputError(others)
    schema = ", ".join(f"`{n}` string" for n in names) or "none string"
    cells = F.from_csv("text", F.lit(schema), {**OPTIONS, "mode": "PERMISSIVE"})
    # a generator, so that a row is parsed once and not for every use of a cell
    parsed = rows.where("row > 0").select("path", "row", F.inline(F.array(cells)))
    given = [(F.col(f"`{n}`") if n in names else F.lit(None).cast("string")).alias(n) for n in FIELDS]
    out = parsed.select("path", "row", *given)
    if odd:
        out = out.where(~F.col("path").isin(odd)).unionByName(read_whole(spark, path, odd))
    files = numbered(rows.select("path").distinct(), "path", number="file")
    ref = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(":row "), (F.col("row") + 1).cast("string"))
    out = out.join(files, "path").select(*FIELDS, (F.col("file") * F.lit(FILE_ROWS) + F.col("row")).alias("source_order"), ref.alias("source_ref"))
    return out.where(F.coalesce(*[strip(F.col(n)) for n in FIELDS]).isNotNull())


def load_records(spark: SparkSession, path: str, margin: int = CIRCA_MARGIN) -> DataFrame:
    raw = read_raw(spark, path)
    if raw.isEmpty():
        raise InputError([f"{path}: no data rows"])
    return valid(staged(typed(raw, margin), "typed"))
