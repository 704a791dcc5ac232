"""Presumption tiers and what they rest on, as (tier, basis) Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import as_date, clipped_end, clipped_start, describe, overlap_certainty
from ..model import IMPRECISE, INTRINSIC_TIERS
from ..sources.lists import OnsetTable


def intrinsic(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tier in INTRINSIC_TIERS.items():
        out = F.when(state == name, F.lit(tier)).otherwise(out)
    return out


def by_threshold(span: Column, start, end, table: OnsetTable) -> tuple[Column, Column]:
    """The tier from where the date stands to the heightened threshold."""
    limit, label = F.lit(table.heightened_from), f"{table.heightened_from} ({table.heightened_label})"
    tier = F.when(clipped_end(span, start, end) >= limit, "heightened").otherwise("ordinary")
    low, high = clipped_start(span, start, end, True), clipped_end(span, start, end, True)
    basis = (
        F.when(span["precision"].isin(*IMPRECISE) | high.isNull(), F.concat(F.lit("undetermined: the stated precision '"), span["precision"], F.lit(f"' does not settle on which side of {label} the transfer lies")))
        .when(low >= limit, f"the recorded date lies wholly on or after {label}")
        .when(high < limit, f"the recorded date lies wholly before {label}")
        .otherwise(f"the recorded date straddles {label}; the transfer may fall on or after it, so the heightened tier is given")
    )
    return tier, basis


def for_window(span: Column, state: Column, window: Column, table: OnsetTable) -> tuple[Column, Column]:
    """The state's own tier, else the window's, else by the threshold."""
    tier, basis = by_threshold(span, window["earliest"], window["ends"], table)
    own = intrinsic(state)
    return (
        F.coalesce(own, window["tier"], tier),
        F.when(own.isNotNull(), F.concat(F.lit("given by the record's transaction_state "), state)).when(window["tier"].isNotNull(), F.coalesce(window["tier_basis"], F.lit("given by the table for this window"))).otherwise(basis),
    )


def from_state(span: Column, state: Column, table: OnsetTable) -> tuple[Column, Column]:
    """The tier where no window gives bounds; none wherever the date settles nothing."""
    start, end = table.band
    limit, label = F.lit(table.heightened_from), f"{table.heightened_from} ({table.heightened_label})"
    none = F.lit("n/a")
    outside = overlap_certainty(span, start, end).isNull()
    own = intrinsic(state)
    after = F.coalesce(span["earliest"] >= limit, F.lit(False))
    before = F.coalesce(span["latest"] < limit, F.lit(False))
    tier = F.when(span.isNull() | outside, none).when(own.isNotNull(), own).when(after, "heightened").when(before, "ordinary").otherwise(none)
    when = describe(span)
    basis = (
        F.when(span.isNull(), "no tier: the record has no date, and its transaction_state has no tier that needs none; no territory window was matched")
        .when(outside, F.concat(F.lit("no tier: the recorded date ("), when, F.lit(f") lies wholly outside the screening band {start} to {end}; the date and the transaction_state do not agree, so check the date first")))
        .when(own.isNotNull(), F.concat(F.lit("given by the record's transaction_state "), state, F.lit("; no territory window was matched")))
        .when(after, f"the recorded date, at its precision, lies wholly on or after {label}; no territory window was matched")
        .when(before, f"the recorded date, at its precision, lies wholly before {label}; no territory window was matched")
        .otherwise(F.concat(F.lit("no tier: the recorded date ("), when, F.lit(f") cannot be placed wholly on either side of {label}; no territory window was matched")))
    )
    return tier, basis


def bounds_text(start, end) -> Column:
    return F.concat(as_date(start).cast("string"), F.lit(" to "), as_date(end).cast("string"))
