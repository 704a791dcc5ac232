"""Raw rows to typed records, with every problem of every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import with_span
from ..functions.text import strip
from ..model import CIRCA_MARGIN, FIELDS, RECIPIENTS, RESOLVED, STATES
from ..staging import new_path


#: Problems that an error lists itself; all of them are in its table.
LISTED_PROBLEMS = 10_000


class InputError(ValueError):
    """A rejected input file; ``problems`` lists what there is to mend.

    Beyond ``LISTED_PROBLEMS`` the message says how many there are and names
    ``table``, the Parquet folder that has them all.
    """

    def __init__(self, problems: list[str], total: int | None = None, table: str | None = None):
        rest = [] if total is None or total <= len(problems) else [f"{total - len(problems)} more problems; all {total} are in {table}"]
        super().__init__("\n".join([*problems, *rest]))
        self.problems, self.total, self.table = problems, len(problems) if total is None else total, table


TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def parse_bool(c: Column, name: str) -> tuple[Column, Column]:
    """True, false or null, and a problem for anything else."""
    low = F.lower(c)
    value = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return value, F.when(c.isNotNull() & ~low.isin(*TRUE, *FALSE), F.concat(F.lit(f"{name}: not a yes or no value: "), c))


def parse_enum(c: Column, name: str, values) -> tuple[Column, Column]:
    low = F.lower(c)
    return F.when(low.isin(*values), low), F.when(c.isNotNull() & ~low.isin(*values), F.concat(F.lit(f"{name}: unknown value "), c))


def split_list(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x.isNotNull())
    return parts


def country_of(location: Column) -> Column:
    """What follows the last comma; the whole value without one."""
    return strip(F.element_at(F.split(location, ","), -1))


def typed(raw: DataFrame, margin: int = CIRCA_MARGIN) -> DataFrame:
    """Records with a ``problems`` array; ``raw`` has all input columns as
    strings, ``source_ref`` and ``source_order``."""
    trimmed = raw.select("source_ref", "source_order", *[(F.col(n) if n == "owner_name_variants" else strip(F.col(n))).alias(n) for n in FIELDS])
    spans = with_span(trimmed, "date_from", "date_to", "date_precision", "span", margin)
    spans = with_span(spans, "object_date", "object_date_to", "object_date_precision", "object_span", margin, "creation date")
    v = F.col
    licence, licence_problem = parse_bool(v("export_licence_present"), "export_licence_present")
    bought, bought_problem = parse_bool(v("is_institution_acquisition"), "is_institution_acquisition")
    stated, stated_problem = parse_bool(v("owner_stated_in_catalogue"), "owner_stated_in_catalogue")
    state, state_problem = parse_enum(v("transaction_state"), "transaction_state", tuple(STATES))
    recipient, recipient_problem = parse_enum(v("restitution_recipient_type"), "restitution_recipient_type", RECIPIENTS)
    needed = [F.when(v(n).isNull(), F.lit(f"{n} is required")) for n in ("object_id", "owner_name")]
    off_state = F.when(recipient.isNotNull() & ~F.coalesce(state == RESOLVED, F.lit(False)), F.lit("restitution_recipient_type is only for a restitution"))
    single = F.array_compact(F.array(*needed, licence_problem, bought_problem, stated_problem, state_problem, recipient_problem, off_state))
    return spans.select(
        "source_ref", F.col("source_order").cast("bigint").alias("source_order"),
        v("object_id").alias("object_id"), v("object_title").alias("object_title"), v("object_class").alias("object_class"), "object_span",
        v("owner_name").alias("owner_name"), split_list(F.col("owner_name_variants")).alias("owner_name_variants"), "span",
        state.alias("transaction_state"), v("location").alias("location"), country_of(v("location")).alias("country"), v("source_citation").alias("source_citation"),
        licence.alias("export_licence_present"), bought.alias("is_institution_acquisition"), v("catalogue_reference").alias("catalogue_reference"),
        stated.alias("owner_stated_in_catalogue"), recipient.alias("restitution_recipient_type"), v("notes").alias("notes"),
        F.concat(single, "span_problems", "object_span_problems").alias("problems"),
    )


def valid(records: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The records without the ``problems`` column, or ``InputError``.

    ``others`` has further problems (``source_order``, ``problem``).
    """
    bad = records.where(F.size("problems") > 0).select("source_order", F.posexplode("problems").alias("k", "text"), "source_ref")
    found = bad.select("source_order", "k", F.concat("source_ref", F.lit(": "), "text").alias("problem"))
    if others is not None:
        found = found.unionAll(others.select("source_order", F.lit(0).alias("k"), "problem"))
    if not found.isEmpty():
        spark = records.sparkSession
        path = new_path(spark, "problems")
        found.orderBy("source_order", "k").write.parquet(path)
        every = spark.read.schema(found.schema).parquet(path)
        first = every.orderBy("source_order", "k", "problem").limit(LISTED_PROBLEMS).collect()
        raise InputError([r.problem for r in first], every.count(), path)
    return records.drop("problems")
