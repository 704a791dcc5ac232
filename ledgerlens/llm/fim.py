"""Fill-in-middle: documents cut twice between units and put in another order.

A unit is a run of blanks with the word after it, or the blanks that end the
text.  Units are counted in one scan over the text's bytes.  The scan leaves a
sparse index: after every ``EVERY`` units a checkpoint of the number of units,
the byte offset and the code-point offset.  A cut is then found by a binary
search among the checkpoints and a short rescan from the one before it, so a
text is never split into units, however long it is.

Where a document is cut, and which form it takes, follows from a hash of its id:
plain (as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle),
each part after its mark.  Texts that hold a mark themselves stay plain, so the
marks of an output are those that the transformation wrote, and ``restored``
gives the exact text back.

Defined results: a null text counts as empty; an empty text is plain with no
units; a null id is hashed as an empty one; repeated rows fare alike; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import blank_to_empty, bounded_batches

#: Units from one checkpoint to the next, and bytes that are scanned at a time.
EVERY = 256
BLOCK = 1 << 16

# The marks before prefix, suffix and middle; blanks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True


def _chars(data: np.ndarray) -> int:
    """Code points that begin in these bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _unit_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Offsets after the words that end in ``data[start:stop]``."""
    blank = _BLANK[data[start : stop + 1]]
    if stop >= len(data):
        blank = np.append(blank, True)
    return start + 1 + np.flatnonzero(~blank[:-1] & blank[1:])


@dataclass
class Checkpoints:
    """``n`` units of ``data``; checkpoints of units, bytes and code points."""

    data: np.ndarray
    n: int
    units: list[int]
    bytes: list[int]
    chars: list[int]

    @classmethod
    def of(cls, text: bytes, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
        data = np.frombuffer(text, np.uint8)
        n, units, at, chars = 0, [0], [0], [0]
        for start in range(0, len(data), block):
            ends = _unit_ends(data, start, min(start + block, len(data)))
            for end in ends[every - 1 - n % every :: every].tolist():
                units.append(units[-1] + every)
                chars.append(chars[-1] + _chars(data[at[-1] : end]))
                at.append(end)
            n += len(ends)
        return cls(data, n + bool(len(data) and _BLANK[data[-1]]), units, at, chars)

    def offset(self, unit: int, block: int = BLOCK) -> tuple[int, int]:
        """Bytes and code points of the first ``unit`` units."""
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        left, begin, end = unit - self.units[k], self.bytes[k], self.bytes[k]
        for start in range(begin, len(self.data) if left else begin, block):
            ends = _unit_ends(self.data, start, min(start + block, len(self.data)))
            if left <= len(ends):
                end = int(ends[left - 1])
                break
            left -= len(ends)
        else:  # the blanks that end the text
            end = len(self.data) if left else begin
        return end, self.chars[k] + _chars(self.data[begin:end])


PARTS = "n long, prefix_bytes long, prefix_chars long, middle_bytes long, middle_chars long"


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, ones, others in batches:
        rows = []
        for text, one, other in zip(texts, ones, others):
            index = Checkpoints.of(text)
            a, b = sorted((one % (index.n + 1), other % (index.n + 1)))
            (pb, pc), (mb, mc) = index.offset(a), index.offset(b)
            rows.append((index.n, pb, pc, mb - pb, mc - pc))
        yield pd.DataFrame(rows, columns=["n", "prefix_bytes", "prefix_chars", "middle_bytes", "middle_chars"])


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), blank_to_empty(id_col.cast("string"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n`` units, ``form``, ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``.

    ``rate`` in a hundred of the documents are cut, ``spm_rate`` in a hundred of
    those take the form spm.
    """
    bounded_batches(docs.sparkSession)
    row = F.col(f"`{id_col}`")
    one, other, cut, which = draws(row, seed)
    rows = docs.select(row.alias("doc_id"), blank_to_empty(F.col(f"`{text_col}`")).alias("text"), one.alias("one"), other.alias("other"), (cut % 100 < rate).alias("cut"), (which % 100 < spm_rate).alias("spm"))
    data = F.col("text").cast("binary")
    rows = rows.select("*", pandas_udf(_cuts, PARTS)(data, "one", "other").alias("at"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    rows = rows.withColumn("form", F.when((F.col("text") == "") | marked | ~F.col("cut"), "plain").when(F.col("spm"), "spm").otherwise("psm"))
    part = lambda start, length: F.substring(data, (start + 1).cast("int"), length.cast("int")).cast("string")
    a, b = F.col("at.prefix_bytes"), F.col("at.prefix_bytes") + F.col("at.middle_bytes")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.octet_length("text") - b)
    p, s, m = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix), F.concat(F.lit(MIDDLE), middle)
    plain = F.col("form") == "plain"
    return rows.select(
        "doc_id",
        F.col("at.n").alias("n"),
        "form",
        F.when(~plain, F.col("at.prefix_chars")).alias("prefix_chars"),
        F.when(~plain, F.col("at.middle_chars")).alias("middle_chars"),
        F.when(plain, F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m)).alias("output"),
    )


def oracle_sql(rate: int = 50, spm_rate: int = 80, seed: int = 42) -> str:
    """Rows of the query in DuckDB SQL, from the list of all units."""
    blank = r"[\x20\x09-\x0D]"
    h = lambda k: f"('0x' || substr(h, {1 + 8 * k}, 8))::UBIGINT"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{blank}*[^\x20\x09-\x0D]+|{blank}+') AS u FROM d),
c AS (SELECT *, len(u) AS n, least({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1))::BIGINT AS a, greatest({h(0)} % (len(u) + 1), {h(1)} % (len(u) + 1))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {h(2)} % 100 >= {rate} THEN 'plain' WHEN {h(3)} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""
