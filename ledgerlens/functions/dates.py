"""Partial dates and intervals with precision, as Column expressions.

A span is a struct: precision, nominal bounds, bounds widened for ``circa``,
and the two values as written.  A null bound is unbounded.  No length of an
interval is ever computed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CIRCA_MARGIN, PRECISE, PRECISIONS

PARTIAL = r"^([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?$"
SPAN = "struct<precision:string,nominal_earliest:date,nominal_latest:date,earliest:date,latest:date,raw_from:string,raw_to:string>"


class Partial:
    """``YYYY[-M[M][-D[D]]]`` in a string column."""

    def __init__(self, c: Column):
        parts = self.split(c)
        self._set(c, *[F.get(parts, F.lit(k)) for k in range(3)])

    @staticmethod
    def split(c: Column) -> Column:
        """Year, month and day as far as they are written; null for anything else."""
        return F.when(c.rlike(PARTIAL), F.transform(F.split(c, "-"), lambda x: x.cast("int")))

    def _set(self, c: Column, year: Column, month: Column, day: Column) -> None:
        self.given = c.isNotNull()
        self.year, self.month, self.day = year, month, day
        first = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
        # a CASE keeps make_date away from what isn't a month
        month_ok, day_ok = month.isNull() | month.between(1, 12), day.isNull() | ((day >= 1) & (day <= F.dayofmonth(F.last_day(first))))
        self._bounds(F.when(year.isNull() | (year < 1) | ~month_ok, F.lit(False)).otherwise(F.coalesce(day_ok, F.lit(False))))

    @property
    def granularity(self) -> Column:
        return F.when(self.day.isNotNull(), "exact").when(self.month.isNotNull(), "month").when(self.year.isNotNull(), "year")

    def _bounds(self, valid: Column) -> None:
        year, month, day = self.year, self.month, self.day
        first = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
        whole = F.make_date(year, month, day)
        self.valid = valid
        self.start = F.when(valid, F.when(day.isNotNull(), whole).otherwise(first))
        self.end = F.when(valid, F.when(day.isNotNull(), whole).when(month.isNotNull(), F.last_day(first)).otherwise(F.make_date(year, F.lit(12), F.lit(31))))

    @classmethod
    def added(cls, df: DataFrame, name: str) -> tuple[DataFrame, Partial]:
        """With the parts and bounds of column ``name`` as columns of their
        own, which keeps the expressions that use them small."""
        own = cls(F.col(name))
        col = lambda k: F.col(f"_{name}_{k}")
        df = df.withColumn(f"_{name}_parts", cls.split(F.col(name)))
        df = df.withColumns({f"_{name}_{k}": F.get(col("parts"), F.lit(i)) for i, k in enumerate(("year", "month", "day"))})
        own._set(F.col(name), col("year"), col("month"), col("day"))
        df = df.withColumn(f"_{name}_valid", own.valid)
        own._bounds(col("valid"))
        df = df.withColumns({f"_{name}_start": own.start, f"_{name}_end": own.end})
        own.start, own.end = col("start"), col("end")
        return df, own


def with_span(df: DataFrame, date_from: str, date_to: str, precision: str, out: str, margin: int = CIRCA_MARGIN, what: str = "date") -> DataFrame:
    """``df`` with the span in ``out`` and its problems in ``out`` + ``_problems``.

    What both are made of has columns of its own, so that it is computed once.
    """
    df, a = Partial.added(df, date_from)
    df, b = Partial.added(df, date_to)
    parts = SpanParts(F.col(date_from), F.col(date_to), F.col(precision), margin, a, b)
    for names in (("any_date", "p", "start", "end"), ("known", "bad_from", "bad_to", "coarse"), ("sound",), ("reversed", "low_ok", "high_ok"), ("off",)):
        df = df.withColumns({f"_{out}_{k}": parts.columns[k] for k in names})
        parts = parts.read_from({k: F.col(f"_{out}_{k}") for k in names})
    span, problems = parts.span_and_problems(margin, what)
    return df.withColumns({f"{out}_problems": problems, out: span})


class SpanParts:
    """What a span and its problems are made of, as Columns by name."""

    def __init__(self, date_from: Column, date_to: Column, precision: Column, margin: int, a: Partial, b: Partial, given: dict[str, Column] | None = None):
        self.inputs = date_from, date_to, precision, margin, a, b
        self.given = given or {}
        self.columns = c = dict(self.given)
        new = lambda name, value: c.setdefault(name, value)
        any_date, p = new("any_date", a.given | b.given), new("p", F.lower(precision))
        start, end = new("start", F.coalesce(a.start, b.start)), new("end", F.coalesce(b.end, a.end))
        known = new("known", F.coalesce(p.isin(*PRECISIONS), F.lit(False)))
        bad_from, bad_to = new("bad_from", a.given & ~a.valid), new("bad_to", b.given & ~b.valid)
        too_coarse = lambda x: F.when(p == "exact", x.given & x.day.isNull()).when(p == "month", x.given & x.month.isNull()).otherwise(F.lit(False))
        new("coarse", too_coarse(a) | too_coarse(b))
        sound = new("sound", any_date & known & ~bad_from & ~bad_to)
        new("reversed", F.coalesce(sound & ~p.isin("before", "after") & (start > end), F.lit(False)))
        low_ok, high_ok = new("low_ok", F.coalesce((p != "circa") | (F.year(start) > margin), F.lit(True))), new("high_ok", F.coalesce((p != "circa") | (F.year(end) + margin <= 9999), F.lit(True)))
        new("off", F.coalesce(sound & (p == "circa") & ~(low_ok & high_ok), F.lit(False)))

    def read_from(self, given: dict[str, Column]) -> SpanParts:
        """The same, with some parts read from columns."""
        return SpanParts(*self.inputs, self.given | given)

    def span_and_problems(self, margin: int, what: str) -> tuple[Column, Column]:
        """(span or null where unsound, array of problems)."""
        c = self.columns
        date_from, date_to, precision = self.inputs[:3]
        p, sound, any_date = c["p"], c["sound"], c["any_date"]
        n_from = F.when(p == "before", F.lit(None).cast("date")).otherwise(c["start"])
        n_to = F.when(p == "after", F.lit(None).cast("date")).otherwise(c["end"])
        # add_months clamps 29 February like the calendar does
        shift = lambda d, years, ok: F.when((p == "circa") & ok, F.add_months(d, 12 * years)).otherwise(d)
        problems = F.array_compact(
            F.array(
                F.when(~any_date & precision.isNotNull(), F.lit(f"{what}: a precision is given without a date")),
                F.when(any_date & precision.isNull(), F.lit(f"{what}: a date is given without a precision")),
                F.when(any_date & precision.isNotNull() & ~c["known"], F.concat(F.lit(f"{what}: unknown precision "), precision)),
                F.when(c["bad_from"], F.concat(F.lit(f"{what}: not a valid date: "), date_from)),
                F.when(c["bad_to"], F.concat(F.lit(f"{what}: not a valid date: "), date_to)),
                F.when(sound & c["coarse"], F.concat(F.lit(f"{what}: the value is coarser than the precision "), p)),
                F.when(c["reversed"], F.lit(f"{what}: the range is reversed")),
                F.when(c["off"], F.lit(f"{what}: the margin leaves the calendar")),
            )
        )
        span = F.when(
            F.coalesce(sound & ~c["coarse"] & ~c["reversed"] & ~c["off"], F.lit(False)),
            F.struct(
                p.alias("precision"), n_from.alias("nominal_earliest"), n_to.alias("nominal_latest"),
                shift(n_from, -margin, c["low_ok"]).alias("earliest"), shift(n_to, margin, c["high_ok"]).alias("latest"),
                date_from.alias("raw_from"), date_to.alias("raw_to"),
            ),
        )
        return span.cast(SPAN), problems


def build_span(date_from: Column, date_to: Column, precision: Column, margin: int = CIRCA_MARGIN, what: str = "date") -> tuple[Column, Column]:
    """(span or null where unsound, array of problems) of trimmed strings."""
    return SpanParts(date_from, date_to, precision, margin, Partial(date_from), Partial(date_to)).span_and_problems(margin, what)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals; a null bound is unbounded."""
    return (a_end.isNull() | b_start.isNull() | (a_end >= b_start)) & (a_start.isNull() | b_end.isNull() | (a_start <= b_end))


def as_date(d) -> Column:
    return F.lit(d) if isinstance(d, date) else d


def overlap_certainty(span: Column, start, end) -> Column:
    """Null, ``certain`` or ``possible``; an imprecise date is never certain."""
    s, e = as_date(start), as_date(end)
    sure = span["precision"].isin(*PRECISE) & span["nominal_earliest"].isNotNull() & span["nominal_latest"].isNotNull() & overlaps(span["nominal_earliest"], span["nominal_latest"], s, e)
    return F.when(span.isNotNull() & overlaps(span["earliest"], span["latest"], s, e), F.when(sure, "certain").otherwise("possible"))


def clipped_end(span: Column, start, end, nominal: bool = False) -> Column:
    """The later bound of the part inside the window; null if there is none."""
    s, e = as_date(start), as_date(end)
    low, high = (span["nominal_earliest"], span["nominal_latest"]) if nominal else (span["earliest"], span["latest"])
    return F.when(span.isNotNull() & overlaps(low, high, s, e), F.least(high, e))


def clipped_start(span: Column, start, end, nominal: bool = False) -> Column:
    s, e = as_date(start), as_date(end)
    low, high = (span["nominal_earliest"], span["nominal_latest"]) if nominal else (span["earliest"], span["latest"])
    return F.when(span.isNotNull() & overlaps(low, high, s, e), F.greatest(low, s))


def certainly_before(span: Column) -> Column:
    """The latest day, of a precise span only."""
    return F.when(span["precision"].isin(*PRECISE), span["latest"])


def describe(span: Column) -> Column:
    """``from–to (precision)``; one value where the other is equal or missing."""
    a, b = span["raw_from"], span["raw_to"]
    text = F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise(F.concat(a, F.lit("–"), b))
    return F.when(span.isNotNull(), F.concat(text, F.lit(" ("), span["precision"], F.lit(")")))
