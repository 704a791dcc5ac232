"""One query for each operator, and what DuckDB gives for it.

The SQL is written from the rules' semantics, not from the operators: it works
on the derived events directly, with windows and list identities as VALUES.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.dates import Partial, certainly_before, clipped_end, clipped_start, describe, overlap_certainty
from ..functions.names import candidate_forms, match_names, parse_person
from ..functions.text import fold, normalise
from ..model import CIRCA_MARGIN, FIELDS, STATES
from ..operators import assemble, chains, explain, guard, hygiene, rules, tiers
from ..plans.screening import screen
from ..sources import csv, lido
from ..sources.lists import load_config, load_event_types
from ..sources.records import country_of, parse_bool, parse_enum, split_list, typed
from ..staging import new_path, staged
from .derived import ORACLE_EVENTS, events, raw_rows, records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def vectorised(schema: str):
    """An Arrow UDF that is made where it is used: importing needs no session."""
    return lambda f: lambda *columns: pandas_udf(f, schema)(*columns)


CFG = load_config()
BAND = f"DATE '{CFG.onset.band[0]}'", f"DATE '{CFG.onset.band[1]}'"
ACTOR, EXPORT, PATTERN = ("DATE '1938-01-01'", "DATE '1945-12-31'"), ("DATE '1933-01-01'", "DATE '1945-12-31'"), ("DATE '1933-01-01'", "DATE '1950-12-31'")
LIMIT = f"DATE '{CFG.onset.heightened_from}'"


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.enriched(records(spark, sf_dir), CFG.onset, CFG.patterns)


# --- pieces of SQL ---------------------------------------------------------


def meets(start: str, end: str, e: str = "e", l: str = "l") -> str:  # noqa: E741
    return f"(date_precision IS NOT NULL AND ({l} IS NULL OR {l} >= {start}) AND ({e} IS NULL OR {e} <= {end}))"


def certainty(start: str, end: str) -> str:
    return f"CASE WHEN {meets(start, end)} THEN CASE WHEN date_precision IN ('exact', 'month', 'year') AND {meets(start, end, 'n_from', 'n_to')} THEN 'certain' ELSE 'possible' END END"


def threshold_tier(start: str, end: str) -> str:
    return f"CASE WHEN {meets(start, end)} AND least(coalesce(l, DATE '9999-12-31'), {end}) >= {LIMIT} THEN 'heightened' ELSE 'ordinary' END"


OWN_TIER = "CASE transaction_state WHEN 'vermutung_der_entziehung' THEN 'ordinary' WHEN 'verschaerfte_vermutung' THEN 'heightened' END"
OPEN = "coalesce(transaction_state, '') <> 'restitution_erfolgt_or_vergleich'"
WINDOWS = ", ".join(f"({t.index}, {k}, '{w.id}', DATE '{w.earliest}', DATE '{w.ends}', {repr(w.tier) if w.tier else 'NULL'})" for t in CFG.onset.territories for k, w in enumerate(t.windows))
TERMS = ", ".join(f"({t.index}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(t.terms)})($|[^\\p{{L}}\\p{{N}}_])')" for t in CFG.onset.territories)
# What each derived owner name is to the lists, by the identity rules.
NAMES = "('Haberstock, Karl', 0, 'given_name_compatible', true), ('Lange', 1, 'surname_only', false), ('Wolff Metternich, Franz', 2, 'given_name_compatible', true)"
ACTORS = "('Galerie Fischer Lucerne', 1, 'full_name', true), ('Fischer', 1, 'organisation_name', true), ('Kunsthaus Lempertz AG', 2, 'full_name', true), ('Dorotheum', 3, 'organisation_name', true), ('E.R.R.', 5, 'full_name', true)"
ANONYMOUS = "('Private collection, Switzerland', 'private collection'), ('unbekannt', 'unbekannt')"

EV = f"WITH ev AS ({ORACLE_EVENTS})"
CHAIN = f"""{EV},
ch AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY CASE WHEN date_precision IS NULL THEN 1 ELSE 0 END, coalesce(n_from, n_to), source_order) AS rn FROM ev),
ob AS (SELECT object_id, count(*) AS n, count(date_precision) AS n_dated, min(object_class) AS object_class, min(created_e) AS created_e, min(object_date) AS object_date,
  coalesce(bool_or(date_precision IS NOT NULL AND (e IS NULL OR e < DATE '1945-01-01')), false) AS possibly,
  coalesce(bool_or(date_precision IN ('exact', 'month', 'year') AND l < DATE '1945-01-01'), false) AS certainly,
  coalesce(min(created_e) >= DATE '1945-01-01', false) AS created_after, count(is_institution_acquisition) = 0 AS never_set,
  coalesce(bool_or(transaction_state = 'restitution_erfolgt_or_vergleich'), false) AS any_resolved FROM ch GROUP BY object_id),
terms(territory, term) AS (VALUES {TERMS}),
win(territory, window_seq, window_id, w_from, w_to, w_tier) AS (VALUES {WINDOWS}),
places AS (SELECT location, territory FROM (SELECT DISTINCT location FROM ev) JOIN terms ON regexp_matches(lower(strip_accents(location)), term)),
hit AS (SELECT ch.*, territory FROM ch JOIN places USING (location)),
nm(owner_name, entry, basis, confirmed) AS (VALUES {NAMES}),
ac(owner_name, entry, basis, confirmed) AS (VALUES {ACTORS}),
an(owner_name, pattern) AS (VALUES {ANONYMOUS})"""

PC003_WINDOW = f"SELECT object_id, source_ref, territory, window_id, {certainty('w_from', 'w_to')} AS certainty, coalesce({OWN_TIER}, w_tier, {threshold_tier('w_from', 'w_to')}) AS tier FROM hit JOIN win USING (territory) WHERE {OPEN} AND {meets('w_from', 'w_to')}"
PERSECUTION = "('entziehung', 'zwangsverkauf', 'vermutung_der_entziehung', 'verschaerfte_vermutung')"
STATE_TIER = f"""CASE WHEN date_precision IS NULL OR NOT {meets(*BAND)} THEN 'n/a' WHEN {OWN_TIER} IS NOT NULL THEN {OWN_TIER}
  WHEN e >= {LIMIT} THEN 'heightened' WHEN l < {LIMIT} THEN 'ordinary' ELSE 'n/a' END"""
CLASS = "CASE object_class WHEN 'silver' THEN 'silver' WHEN 'Judaica' THEN 'Judaica' WHEN 'Münzen' THEN 'coins' WHEN 'Kunstgewerbe' THEN 'decorative art' END"
CATALOGUE = """cat AS (SELECT object_id,
  count(*) FILTER (WHERE owner_stated_in_catalogue AND date_precision IN ('exact', 'month', 'year') AND l < DATE '1933-01-01') AS n_early,
  count(*) FILTER (WHERE e > DATE '1950-12-31') AS n_late, count(*) FILTER (WHERE e > DATE '1950-12-31' AND NOT owner_stated_in_catalogue) AS n_missing
  FROM ch WHERE catalogue_reference IS NOT NULL GROUP BY object_id)"""
PAIRS = """pr AS (SELECT *, lag(location) OVER (PARTITION BY object_id ORDER BY rn) AS before, lag(source_ref) OVER (PARTITION BY object_id ORDER BY rn) AS before_ref,
  row_number() OVER (PARTITION BY object_id ORDER BY rn) AS k FROM ch WHERE date_precision IS NOT NULL)"""
COUNTRY = "trim(list_last(string_split({0}, ',')))"


def found_by(spark, sf_dir, rule, which=slice(None), channel: int = 0) -> DataFrame:
    """A rule's flags (or what else it returns) over the derived records."""
    # the rules of the lists read the records more than once
    rows = staged(rich(spark, sf_dir), "records") if rule in (rules.pc005, rules.nm001) else rich(spark, sf_dir)
    given = (rows, CFG)[: rule.__code__.co_argcount]
    return rules.together(rows, rule(*given)[channel][which])


def flags_of(spark, sf_dir, rule, which=slice(None)) -> DataFrame:
    """Object, record, tier and a count: records may have several flags."""
    return found_by(spark, sf_dir, rule, which).groupBy("object_id", "source_ref", F.col("presumption_tier").alias("tier")).agg(F.count("*").alias("n"))


def flag_sql(body: str) -> str:
    return f"{CHAIN} SELECT object_id, source_ref, tier, count(*) AS n FROM ({body}) GROUP BY ALL"


OBJECT_FLAG = "SELECT object_id, CAST(NULL AS VARCHAR) AS source_ref, 'n/a' AS tier FROM ob"

# --- dates -----------------------------------------------------------------


@query("date_span_build", f"{EV} SELECT source_ref, date_precision AS precision, n_from, n_to, e, l FROM ev")
def date_span_build(spark, sf_dir):
    out = typed(raw_rows(spark, sf_dir), CIRCA_MARGIN)
    return out.select("source_ref", F.col("span.precision").alias("precision"), F.col("span.nominal_earliest").alias("n_from"), F.col("span.nominal_latest").alias("n_to"), F.col("span.earliest").alias("e"), F.col("span.latest").alias("l"))


@query("overlap_certainty", f"{EV} SELECT source_ref, {certainty(*BAND)} AS certainty FROM ev")
def overlap(spark, sf_dir):
    return records(spark, sf_dir).select("source_ref", overlap_certainty(F.col("span"), *CFG.onset.band).alias("certainty"))


@query("clipped_interval", f"{EV} SELECT source_ref, CASE WHEN {meets(*BAND)} THEN greatest(coalesce(e, {BAND[0]}), {BAND[0]}) END AS clip_from, CASE WHEN {meets(*BAND)} THEN least(coalesce(l, {BAND[1]}), {BAND[1]}) END AS clip_to FROM ev")
def clipped(spark, sf_dir):
    s = F.col("span")
    return records(spark, sf_dir).select("source_ref", clipped_start(s, *CFG.onset.band).alias("clip_from"), clipped_end(s, *CFG.onset.band).alias("clip_to"))


@query("date_describe", f"{EV} SELECT source_ref, date_text || ' (' || date_precision || ')' AS described, CASE WHEN date_precision IN ('exact', 'month', 'year') THEN l END AS certainly_before FROM ev")
def described(spark, sf_dir):
    return records(spark, sf_dir).select("source_ref", describe(F.col("span")).alias("described"), certainly_before(F.col("span")).alias("certainly_before"))


@query("date_granularity", f"{EV} SELECT source_ref, CASE date_precision WHEN 'exact' THEN 'exact' WHEN 'month' THEN 'month' ELSE CASE WHEN date_precision IS NOT NULL THEN 'year' END END AS granularity, CASE date_precision WHEN 'exact' THEN n_from WHEN 'month' THEN n_from ELSE make_date(y, 1, 1) END AS starts FROM ev WHERE date_precision IS NOT NULL")
def granularity(spark, sf_dir):
    part = Partial(F.col("date_text"))
    return events(spark, sf_dir).where("date_precision is not null").select("source_ref", part.granularity.alias("granularity"), part.start.alias("starts"))


@query("bool_list_enum_parsers", f"{EV} SELECT source_ref, CASE source_order % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, transaction_state AS state, CAST(CASE WHEN owner_name IS NULL THEN 0 ELSE 2 END AS INT) AS n_names FROM ev")
def parsers(spark, sf_dir):
    n = F.col("source_order") % 4
    flag, _ = parse_bool(F.when(n == 0, "YES").when(n == 1, "0").when(n == 2, "perhaps"), "flag")
    state, _ = parse_enum(F.upper("transaction_state"), "transaction_state", tuple(STATES))
    names = split_list(F.concat(F.col("owner_name"), F.lit(" | |x")))
    return events(spark, sf_dir).select("source_ref", flag.alias("flag"), state.alias("state"), F.size(names).alias("n_names"))


BAD = "SELECT source_ref, CASE source_order % 8 WHEN 0 THEN 'exact' WHEN 1 THEN NULL WHEN 2 THEN 'sometime' ELSE 'year' END AS p, CASE source_order % 8 WHEN 3 THEN '1938-13' WHEN 4 THEN '1938-04-31' ELSE '1938' END AS f, CASE source_order % 8 WHEN 5 THEN '1930' END AS t, CASE source_order % 8 WHEN 6 THEN 'perhaps' END AS b, CASE source_order % 8 WHEN 7 THEN 'heirs' END AS r FROM ev"


@query("validate_problems", f"{EV}, bad AS ({BAD}) SELECT source_ref, CAST(1 AS INT) AS n_problems FROM bad")
def validate_problems(spark, sf_dir):
    n = F.col("source_order") % 8
    rows = raw_rows(spark, sf_dir).withColumns(
        {
            "date_precision": F.when(n == 0, "exact").when(n == 1, F.lit(None)).when(n == 2, "sometime").otherwise("year"),
            "date_from": F.when(n == 3, "1938-13").when(n == 4, "1938-04-31").otherwise("1938"),
            "date_to": F.when(n == 5, "1930"),
            "export_licence_present": F.when(n == 6, "perhaps"),
            "restitution_recipient_type": F.when(n == 7, "heirs"),
            "object_id": F.concat(F.lit(" "), "object_id"),
        }
    )
    return typed(rows).select("source_ref", F.size("problems").alias("n_problems"))


# --- chains ----------------------------------------------------------------


@query("chain_order", f"{CHAIN} SELECT object_id, source_ref, CAST(rn AS INT) AS rn FROM ch")
def chain_order(spark, sf_dir):
    return chains.in_chain_order(records(spark, sf_dir)).select("object_id", "source_ref", "rn")


@query("chain_first_nonnull", f"{CHAIN} SELECT object_id, object_class, object_date AS created, n, n_dated FROM ob")
def chain_first(spark, sf_dir):
    return rules.objects(chains.with_chain(records(spark, sf_dir))).select("object_id", F.col("class").alias("object_class"), F.col("created.raw_from").alias("created"), F.col("n_records").cast("bigint").alias("n"), F.col("n_dated").cast("bigint").alias("n_dated"))


@query("country_derivation", f"{EV} SELECT source_ref, {COUNTRY.format('location')} AS country FROM ev")
def country(spark, sf_dir):
    return events(spark, sf_dir).select("source_ref", country_of(F.col("location")).alias("country"))


@query("pre1945_status", f"{CHAIN} SELECT object_id, possibly, certainly, created_after FROM ob")
def pre1945(spark, sf_dir):
    return rules.objects(chains.with_chain(records(spark, sf_dir))).select("object_id", F.col("possibly_pre_1945").alias("possibly"), F.col("certainly_pre_1945").alias("certainly"), "created_after")


@query("object_class_group", f"{EV} SELECT source_ref, {CLASS} AS class_group FROM ev")
def object_class(spark, sf_dir):
    return events(spark, sf_dir).select("source_ref", chains.matched_class(F.col("object_class")).alias("class_group"))


# --- joins -----------------------------------------------------------------


@query("territory_join", f"{CHAIN} SELECT source_ref, territory FROM hit")
def territory_join(spark, sf_dir):
    return events(spark, sf_dir).select("source_ref", F.explode(chains.matched_territories(F.col("location"), CFG.onset)).alias("territory"))


@query("window_overlap_join", f"{CHAIN} SELECT source_ref, territory, CAST(window_seq AS INT) AS window_seq, {certainty('w_from', 'w_to')} AS certainty FROM hit JOIN win USING (territory) WHERE {OPEN} AND {meets('w_from', 'w_to')}")
def window_overlap(spark, sf_dir):
    return rules.window_hits(rich(spark, sf_dir), CFG).select("source_ref", "territory", F.col("w.window_seq").alias("window_seq"), "certainty")


@query("match_anonymous", f"{CHAIN} SELECT source_ref, pattern FROM ev JOIN an USING (owner_name)")
def match_anonymous(spark, sf_dir):
    hit = chains.anonymous_hit(chains.owner_names(), CFG.patterns)
    return records(spark, sf_dir).select("source_ref", hit["pattern"].alias("pattern")).where("pattern is not null")


def list_matches(spark, sf_dir, names):
    found = match_names(records(spark, sf_dir).select(F.col("owner_name").alias("name")), names.matching)
    return records(spark, sf_dir).join(found, F.col("owner_name") == F.col("name")).select("source_ref", F.col("index").alias("entry"), "basis", "confirmed")


@query("match_aliu", f"{CHAIN} SELECT source_ref, entry, basis, confirmed FROM ev JOIN nm USING (owner_name)")
def match_aliu(spark, sf_dir):
    return list_matches(spark, sf_dir, CFG.names)


@query("match_actors", f"{CHAIN} SELECT source_ref, entry, basis, confirmed FROM ev JOIN ac USING (owner_name)")
def match_actors(spark, sf_dir):
    return list_matches(spark, sf_dir, CFG.actors)


# A list made from suppliers, persons and firms in turn, and names that may meet it.
SPELT = "translate(CAST({} AS STRING), '0123456789', 'bcdfghjklm')"
LISTED = f"""SELECT CAST(s_suppkey AS INT) AS index, s_suppkey % 2 = 0 AS person, concat('Zor', {SPELT.format('s_suppkey % 60')}) AS surname,
  CASE s_suppkey % 3 WHEN 0 THEN 'Anna' WHEN 1 THEN 'A.' ELSE 'Berta' END AS given, concat('Hax', {SPELT.format('s_suppkey % 50')}) AS firm FROM {{supplier}}"""
ASKED = f"""SELECT DISTINCT o_orderkey % 7 AS form, surname, given, firm, CASE o_orderkey % 7 WHEN 0 THEN concat(surname, ', ', given) WHEN 1 THEN concat(given, ' ', upper(surname)) WHEN 2 THEN surname
  WHEN 3 THEN concat('Sammlung ', surname, ' und Erben') WHEN 4 THEN concat('KUNSTHAUS ', firm, ' Veit AG') WHEN 5 THEN firm ELSE concat('Veit ', firm) END AS name
  FROM (SELECT o_orderkey, concat('Zor', {SPELT.format('o_custkey % 75')}) AS surname, CASE o_custkey % 4 WHEN 0 THEN 'Anna' WHEN 1 THEN 'A.' WHEN 2 THEN 'Amalia' ELSE 'Berta Maria' END AS given, concat('Hax', {SPELT.format('o_custkey % 65')}) AS firm FROM {{orders}})"""


@query("match_long_list", f"""WITH e AS ({LISTED.format(supplier='supplier')}), a AS ({ASKED.format(orders='orders')}),
p AS (SELECT name, index, CASE WHEN form IN (2, 3) THEN 'surname_only' ELSE 'given_name_compatible' END AS basis, form < 2 AS confirmed FROM a JOIN e USING (surname) WHERE person AND (form IN (2, 3) OR form = 0 AND
  (split_part(a.given, ' ', 1) = e.given OR a.given = 'A.' AND e.given LIKE 'A%' OR e.given = 'A.' AND a.given LIKE 'A%') OR form = 1 AND (a.given = e.given OR a.given = 'A.' AND e.given LIKE 'A%' OR e.given = 'A.' AND a.given LIKE 'A%'))),
s AS (SELECT name, index, 'surname_only' AS basis, false AS confirmed FROM a JOIN e USING (surname) WHERE person AND form = 1 AND a.given = 'Berta Maria'),
f AS (SELECT name, index, CASE form WHEN 4 THEN 'full_name' ELSE 'organisation_name' END AS basis, true AS confirmed FROM a JOIN e USING (firm) WHERE NOT person AND form IN (4, 5))
SELECT * FROM p UNION SELECT * FROM s UNION SELECT * FROM f""")  # fmt: skip
def match_long_list(spark, sf_dir):
    listed = spark.sql(LISTED, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    entries = listed.select("index", F.when(F.col("person"), F.concat_ws(", ", "surname", "given")).otherwise(F.concat_ws(" ", F.lit("Kunsthaus"), "firm", F.lit("Veit"))).alias("name"), F.array().cast("array<string>").alias("variants"), F.when(F.col("person"), "person").otherwise("organisation").alias("kind"))
    asked = spark.sql(ASKED, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return match_names(asked, entries).select("name", "index", "basis", "confirmed")


@query("consecutive_records", f"{CHAIN}, {PAIRS} SELECT source_ref, before_ref FROM pr WHERE k > 1")
def consecutive(spark, sf_dir):
    return chains.with_chain(records(spark, sf_dir)).select("source_ref", F.col("previous.source_ref").alias("before_ref")).where("before_ref is not null")


# --- names and texts -------------------------------------------------------


@query("fold_text", f"{EV} SELECT source_ref, lower(strip_accents(location)) AS folded FROM ev")
def fold_query(spark, sf_dir):
    return events(spark, sf_dir).select("source_ref", fold(F.col("location")).alias("folded"))


@query("normalise", f"{EV} SELECT source_ref, trim(regexp_replace(lower(strip_accents(owner_name)), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS normalised FROM ev")
def normalise_query(spark, sf_dir):
    return events(spark, sf_dir).select("source_ref", normalise(F.col("owner_name")).alias("normalised"))


@vectorised("struct<surname:string,given:string>")
def _person(names):
    import pandas as pd

    found = [parse_person(n) if n else None for n in names]
    return pd.DataFrame({"surname": [p and p.surname for p in found], "given": [" ".join(p.given) if p else None for p in found]})


@query("parse_person_name", f"""{EV}, p(owner_name, surname, given) AS (VALUES ('Private collection, Switzerland', 'private collection', 'switzerland'), ('Haberstock, Karl', 'haberstock', 'karl'), ('Lange, Elisabeth', 'lange', 'elisabeth'),
  ('Wolff Metternich, Franz', 'wolff metternich', 'franz'), ('Almqvist, H.', 'almqvist', 'h')) SELECT source_ref, surname, given FROM ev LEFT JOIN p USING (owner_name)""")  # fmt: skip
def parse_person_query(spark, sf_dir):
    names = events(spark, sf_dir).select("owner_name").distinct().withColumn("p", _person("owner_name")).select("owner_name", "p.surname", "p.given")
    return events(spark, sf_dir).join(names, "owner_name", "left").select("source_ref", "surname", "given")


@vectorised("string")
def _forms(names):
    return names.map(lambda n: "|".join(candidate_forms(n)), na_action="ignore")


@query("candidate_forms", f"""{EV} SELECT DISTINCT owner_name, CASE WHEN contains(owner_name, ',') THEN norm || '|' || trim(regexp_replace(lower(list_last(string_split(owner_name, ','))), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' || trim(lower(string_split(owner_name, ',')[1]))
  WHEN owner_name = 'E.R.R.' THEN 'e r r|err' ELSE norm END AS forms FROM (SELECT owner_name, trim(regexp_replace(lower(strip_accents(owner_name)), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS norm FROM ev)""")  # fmt: skip
def candidate_forms_query(spark, sf_dir):
    return events(spark, sf_dir).select("owner_name").distinct().withColumn("forms", _forms("owner_name"))


# --- tiers -----------------------------------------------------------------


@query("tier_by_nuremberg", f"{EV} SELECT source_ref, {threshold_tier(*BAND)} AS tier FROM ev WHERE date_precision IS NOT NULL")
def tier_by_nuremberg(spark, sf_dir):
    return records(spark, sf_dir).where("span is not null").select("source_ref", tiers.by_threshold(F.col("span"), *CFG.onset.band, CFG.onset)[0].alias("tier"))


@query("tier_from_state", f"{EV} SELECT source_ref, {STATE_TIER} AS tier FROM ev WHERE transaction_state IN {PERSECUTION}")
def tier_from_state(spark, sf_dir):
    rows = records(spark, sf_dir).where(F.col("transaction_state").isin("entziehung", "zwangsverkauf", "vermutung_der_entziehung", "verschaerfte_vermutung"))
    return rows.select("source_ref", tiers.from_state(F.col("span"), F.col("transaction_state"), CFG.onset)[0].alias("tier"))


# --- rules -----------------------------------------------------------------


@query("pc001_no_early_record", flag_sql(f"{OBJECT_FLAG} WHERE NOT possibly AND NOT created_after"))
def pc001(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc001)


@query("pc002_begins_at_acquisition", flag_sql("SELECT object_id, source_ref, 'n/a' AS tier FROM ch WHERE rn = 1 AND is_institution_acquisition AND NOT EXISTS (SELECT 1 FROM ch o WHERE o.object_id = ch.object_id AND o.rn > 1 AND o.date_precision IS NULL)"))
def pc002(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc002)


@query("pc003_window", f"{CHAIN} {PC003_WINDOW}")
def pc003_window(spark, sf_dir):
    hits = rules.window_hits(rich(spark, sf_dir), CFG)
    tier = tiers.for_window(F.col("span"), F.col("transaction_state"), F.col("w"), CFG.onset)[0]
    return hits.select("object_id", "source_ref", "territory", F.col("w.id").alias("window_id"), "certainty", tier.alias("tier"))


PC003_STATE = f"SELECT object_id, source_ref, {STATE_TIER} AS tier FROM ch WHERE transaction_state IN {PERSECUTION} AND source_ref NOT IN (SELECT source_ref FROM ({PC003_WINDOW}))"


@query("pc003_persecution", flag_sql(f"SELECT object_id, source_ref, tier FROM ({PC003_WINDOW}) UNION ALL {PC003_STATE}"))
def pc003(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc003)


@query("pc003_state", flag_sql(PC003_STATE))
def pc003_state(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc003, slice(1, None))


@query("pc010_flight", flag_sql("SELECT object_id, source_ref, 'n/a' AS tier FROM ch WHERE transaction_state = 'fluchtgut'"))
def pc010(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc010)


# every derived place matches one territory at most; Italy alone has two windows
PC004_TIER = f"""CASE WHEN territory IS NULL THEN {threshold_tier(*BAND)} ELSE coalesce({OWN_TIER},
  CASE WHEN territory = 11 THEN CASE WHEN {meets("DATE '1938-01-01'", "DATE '1943-08-31'")} THEN 'ordinary' WHEN {meets("DATE '1943-09-01'", BAND[1])} THEN 'heightened' ELSE 'ordinary' END
  ELSE {threshold_tier("(SELECT min(w_from) FROM win WHERE win.territory = x.territory)", BAND[1])} END) END"""


@query("pc004_object_class", flag_sql(f"""SELECT object_id, source_ref, {PC004_TIER} AS tier FROM (SELECT ch.*, hit.territory FROM ch LEFT JOIN hit ON hit.source_ref = ch.source_ref) x WHERE {CLASS} IS NOT NULL AND {OPEN} AND {meets(*BAND)}
  UNION ALL {OBJECT_FLAG} WHERE {CLASS} IS NOT NULL AND NOT certainly AND NOT created_after"""))  # fmt: skip
def pc004(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc004)


EVIDENCE = "coalesce(transaction_state IN ('entziehung', 'zwangsverkauf', 'vermutung_der_entziehung', 'verschaerfte_vermutung', 'fluchtgut'), false)"


@query("pc005_actors", flag_sql(f"SELECT object_id, source_ref, CASE WHEN entry <> 1 OR {EVIDENCE} THEN {threshold_tier(*ACTOR)} ELSE 'n/a' END AS tier FROM ch JOIN ac USING (owner_name) WHERE {OPEN} AND {meets(*ACTOR)}"))
def pc005(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc005)


@query("pc006_anonymous", flag_sql(f"SELECT object_id, source_ref, {threshold_tier(*PATTERN)} AS tier FROM ch JOIN an USING (owner_name) WHERE {OPEN} AND {meets(*PATTERN)}"))
def pc006(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc006)


@query("pc007_deleted_owner", f"{CHAIN}, {CATALOGUE} SELECT object_id, n_missing > 0 AS compared FROM cat WHERE n_early > 0 AND (n_missing > 0 OR n_late = 0)")
def pc007(spark, sf_dir):
    deleted, unclear = rules.pc007(rich(spark, sf_dir))[0]
    return deleted.select("object_id", F.lit(True).alias("compared")).unionAll(unclear.select("object_id", F.lit(False).alias("compared")))


@query("pc008_settlement", flag_sql("SELECT object_id, source_ref, 'n/a' AS tier FROM ch WHERE transaction_state = 'restitution_erfolgt_or_vergleich' AND restitution_recipient_type = 'state_or_institution'"))
def pc008(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc008)


@query("pc009_export", f"""{CHAIN}, {PAIRS} SELECT object_id, source_ref, tier, count(*) AS n FROM (SELECT object_id, source_ref, {threshold_tier(*EXPORT)} AS tier FROM pr WHERE k > 1 AND {OPEN} AND before IS NOT NULL AND location IS NOT NULL
  AND lower(strip_accents({COUNTRY.format('before')})) <> lower(strip_accents({COUNTRY.format('location')})) AND {meets(*EXPORT)} AND NOT coalesce(export_licence_present, false)) GROUP BY ALL""")  # fmt: skip
def pc009(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.pc009)


@query("nm001_names", flag_sql(f"SELECT object_id, source_ref, 'n/a' AS tier FROM ch JOIN nm USING (owner_name) WHERE entry <> 2 AND {meets(*BAND)}"))
def nm001(spark, sf_dir):
    return flags_of(spark, sf_dir, rules.nm001)


@query("nm002_citations", f"{CHAIN} SELECT object_id, source_ref FROM ch JOIN nm USING (owner_name) WHERE entry = 2 AND {meets(*BAND)}")
def nm002(spark, sf_dir):
    return found_by(spark, sf_dir, rules.nm001, channel=2).select("object_id", "source_ref")


@query("dq001_no_source", f"{CHAIN} SELECT object_id, source_ref FROM ch WHERE source_citation IS NULL")
def dq001(spark, sf_dir):
    return found_by(spark, sf_dir, rules.dq001).select("object_id", "source_ref")


@query("dq002_late_acquisition", f"{CHAIN} SELECT ch.object_id, source_ref FROM ch JOIN ob USING (object_id) WHERE is_institution_acquisition AND e > DATE '1998-12-03' AND NOT certainly")
def dq002(spark, sf_dir):
    return found_by(spark, sf_dir, rules.dq002).select("object_id", "source_ref")


# --- files, written from the derived events and read back ---------------------


@query("csv_read", f"{EV} SELECT object_id, owner_name, CAST(e AS VARCHAR) AS earliest, CAST(l AS VARCHAR) AS latest, date_precision, transaction_state, location, {COUNTRY.format('location')} AS country, object_class, source_citation, is_institution_acquisition, export_licence_present, restitution_recipient_type FROM ev")
def csv_read(spark, sf_dir):
    folder = new_path(spark, "csv")
    raw_rows(spark, sf_dir).select(*FIELDS).write.option("header", True).option("escape", '"').csv(folder)
    span = F.col("span")
    return csv.load_records(spark, folder).select(
        "object_id", "owner_name", span["earliest"].cast("string").alias("earliest"), span["latest"].cast("string").alias("latest"), span["precision"].alias("date_precision"), "transaction_state", "location", "country",
        "object_class", "source_citation", "is_institution_acquisition", "export_licence_present", "restitution_recipient_type",
    )


#: Objects in a file.
LIDO_OBJECTS = 200


def lido_files(spark: SparkSession, sf_dir: str) -> str:
    """The derived events as LIDO files: preferred and other names, two parties,
    nested places, whole months and years as ranges, types by concept or extension."""
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in inner], F.lit(f"</{name.split(' ')[0]}>"))
    name = lambda value, more="": tag("nameActorSet", more, tag("appellationValue pref='preferred'", value))
    actor = lambda role, value, more="": tag("eventActor", tag("actorInRole", tag("actor", name(value, more)), tag("roleActor", tag("term", role))))
    place = F.split("location", ", ")
    named = lambda k: tag("namePlaceSet", tag("appellationValue", F.get(place, F.lit(k))))
    whole = F.col("date_precision").isin("exact", "month", "year")
    own = F.col("transaction_state").isNotNull() & (F.col("transaction_state") != "purchase")
    notes = tag("eventDescriptionSet", tag("descriptiveNoteValue", "A note. &amp; more", F.when(own, F.concat(F.lit("\nRECORD_EXT:transaction_state="), F.col("transaction_state")))), F.when(F.col("source_citation").isNotNull(), tag("sourceDescriptiveNote", F.col("source_citation"))))
    event = tag(
        "eventSet",
        tag(
            "event",
            tag("eventType", F.when(F.col("transaction_state") == "purchase", F.lit("<conceptID>http://terminology.lido-schema.org/lido01016</conceptID>")), "<term>nothing that is mapped</term>"),
            actor("Verkäufer", F.lit("Somebody Else")),
            actor("Käufer", F.col("owner_name"), "<appellationValue pref='alternate'>Other name</appellationValue>"),
            F.when(whole, tag("eventDate", tag("date", tag("earliestDate", F.col("n_from").cast("string")), tag("latestDate", F.col("n_to").cast("string"))))).otherwise(tag("eventDate", "<displayDate>some time</displayDate>")),
            F.when(F.col("location").isNotNull(), tag("eventPlace", tag("place", named(0), tag("partOfPlace", named(1))))),
            notes,
        ),
    )
    rows = events(spark, sf_dir).select("object_id", "object_class", "source_order", event.alias("event"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_order", "event"))), lambda x: x["event"]), "")
    kind = F.when(F.first("object_class").isNotNull(), tag("objectClassificationWrap", tag("objectWorkTypeWrap", tag("objectWorkType", tag("term", F.first("object_class"))))))
    record = rows.groupBy("object_id").agg(tag("lido", tag("lidoRecID", F.col("object_id")), tag("descriptiveMetadata", kind, tag("eventWrap", inner))).alias("record"))
    files = max(1, -(-record.count() // LIDO_OBJECTS))
    folder = new_path(spark, "lido")
    by_file = record.groupBy(F.pmod(F.xxhash64("object_id"), F.lit(files)).alias("file")).agg(F.concat(F.lit("<lidoWrap xmlns='http://www.lido-schema.org'>"), F.array_join(F.collect_list("record"), ""), F.lit("</lidoWrap>")).alias("value"))
    by_file.write.partitionBy("file").text(folder)
    return folder


WHOLE = "CASE WHEN date_precision IN ('exact', 'month', 'year') THEN {0} END"


@query("lido_read", f"""{EV} SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY source_order) AS place, owner_name, 'Other name' AS variants, CAST({WHOLE.format('n_from')} AS VARCHAR) AS earliest, CAST({WHOLE.format('n_to')} AS VARCHAR) AS latest,
  {WHOLE.format('date_precision')} AS date_precision, transaction_state, location, {COUNTRY.format('location')} AS country, object_class, source_citation, 'A note. & more' AS notes FROM ev""")  # fmt: skip
def lido_read(spark, sf_dir):
    records, _ = lido.load_frames(spark, lido_files(spark, sf_dir))
    span = F.col("span")
    return records.select(
        "object_id", F.row_number().over(Window.partitionBy("object_id").orderBy("source_order")).cast("bigint").alias("place"), "owner_name", F.array_join("owner_name_variants", "|").alias("variants"), span["earliest"].cast("string").alias("earliest"),
        span["latest"].cast("string").alias("latest"), span["precision"].alias("date_precision"), "transaction_state", "location", "country", "object_class", "source_citation", "notes",
    )


@query("lido_notes", f"""{EV} SELECT object_id, kind, count(*) AS n FROM (SELECT object_id, 'display_date_not_parsed' AS kind FROM ev WHERE date_precision IS NULL OR date_precision NOT IN ('exact', 'month', 'year')
  UNION ALL SELECT object_id, 'event_type_not_mapped' FROM ev WHERE transaction_state IS NULL) GROUP BY ALL""")  # fmt: skip
def lido_notes(spark, sf_dir):
    """What reading says beside the records, by object."""
    notes = lido.in_file_order(lido.read_events(spark, lido_files(spark, sf_dir), load_event_types())).where("kind not in ('row', 'problem')")
    return notes.groupBy(F.regexp_extract("source_ref", ":(.*) event [0-9]+$", 1).alias("object_id"), "kind").agg(F.count("*").alias("n"))


# --- what flags say and cite ------------------------------------------------

RECORD_KEYS = ",".join(("source_ref", *rules.RECORD))
GLOSS = "CASE transaction_state " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in STATES.items()) + " END"
TEXTS = f"""{CHAIN}, {PAIRS}, tx AS (
  SELECT object_id, source_ref, owner_name, 'DQ-001' AS rule_id, 'Unverified: on what source does this record rest? It cites none.' AS rule_statement, 'source_ref,owner_name,date_span,transaction_state,source_citation' AS keys FROM ch WHERE source_citation IS NULL
  UNION ALL SELECT object_id, source_ref, owner_name, 'PC-010', 'Unverified: under what pressure was this sale made, and what became of the proceeds? The record gives it as a sale abroad in flight, a contested category on which it offers no evidence.', '{RECORD_KEYS},transaction_state_gloss,category_status' FROM ch WHERE transaction_state = 'fluchtgut'
  UNION ALL SELECT object_id, source_ref, owner_name, 'PC-008', 'Unverified: did the dispossessed persons or their heirs ever receive the object or its value? The settlement was made with a state or an institution; the record does not show what followed.', '{RECORD_KEYS},restitution_recipient_type' FROM ch WHERE transaction_state = 'restitution_erfolgt_or_vergleich' AND restitution_recipient_type = 'state_or_institution'
  UNION ALL SELECT object_id, source_ref, owner_name, 'PC-006', 'Unverified: who held the object at this point? The owner entry ''' || owner_name || ''' is generic (it matches ''' || pattern || ''') and falls in 1933-1950. The record names no party.', 'source_ref,owner_name,owner_name_variants,date_span,location,matched_pattern,matched_on,band,band_source,pattern_list_version,overlap_certainty,presumption_tier_basis' FROM ch JOIN an USING (owner_name) WHERE {OPEN} AND {meets(*PATTERN)}
  UNION ALL SELECT object_id, source_ref, owner_name, 'PC-009', 'Unverified: on what authority did the object cross a border? The chain moves from ' || {COUNTRY.format('before')} || ' to ' || {COUNTRY.format('location')} || ' within 1933-1945, and no export licence is recorded.', '{RECORD_KEYS},export_licence_present,moved_from,moved_from_source_ref,origin_country,destination_country,country_derivation,window,overlap_certainty,export_licence_state,presumption_tier_basis' FROM pr WHERE k > 1 AND {OPEN} AND before IS NOT NULL AND location IS NOT NULL
    AND lower(strip_accents({COUNTRY.format('before')})) <> lower(strip_accents({COUNTRY.format('location')})) AND {meets(*EXPORT)} AND NOT coalesce(export_licence_present, false)
  UNION ALL SELECT object_id, source_ref, owner_name, 'PC-003', 'Unverified: was a fair price received, and was the transferor free to use it? The record itself gives the transfer as ''' || transaction_state || ''' (' || {GLOSS} || '). It says nothing further either way.', '{RECORD_KEYS},presumption_tier_basis,transaction_state_gloss,basis' FROM ch WHERE source_ref IN (SELECT source_ref FROM ({PC003_STATE})))
SELECT object_id, source_ref, owner_name, rule_id, rule_statement, keys FROM tx"""


@query("flag_texts", TEXTS)
def flag_texts(spark, sf_dir):
    """Statements, the owner cited and the names of all cited fields, of rules on single records."""
    rows = rich(spark, sf_dir)
    found = [f for rule in (rules.dq001, rules.pc010, rules.pc008) for f in rule(rows)[0]] + [f for rule in (rules.pc006, rules.pc009) for f in rule(rows, CFG)[0]] + rules.pc003(rows, CFG)[0][1:]
    keys = F.array_join(F.json_object_keys("cited_fields"), ",")
    return rules.together(rows, found).select("object_id", "source_ref", F.get_json_object("cited_fields", "$.owner_name").alias("owner_name"), "rule_id", "rule_statement", keys.alias("keys"))


#: Values that flags cite, by rule; compared with what the SQL derives.
VALUES = {
    "PC-001": ("records_in_chain", "dated_records_in_chain", "threshold", "object_date"),
    "PC-002": ("owner_name", "date_span", "is_institution_acquisition", "records_earlier_in_chain", "records_in_chain"),
    "PC-003": ("owner_name", "date_span", "location", "transaction_state", "territory", "persecution_window", "persecution_onset", "onset_earliest", "onset_latest", "window_ends", "overlap_certainty"),
    "PC-005": ("date_span", "matched_on", "match_basis", "entry_kind", "identity_confirmed", "actor_entry", "actor_window", "overlap_certainty"),
    "NM-001": ("date_span", "matched_on", "match_basis", "entry_kind", "identity_confirmed", "screening_band", "aliu_entry_name", "aliu_entry_type", "aliu_annotation", "source_url"),
    "DQ-002": ("owner_name", "date_span", "transaction_state", "commitment_date_applied", "commitment_date_is_default", "certainly_dated_before_1945", "records_in_chain"),
}
VALUES["NM-002"] = VALUES["NM-001"]


def value_sql(rule: str, **values: str) -> str:
    assert tuple(values) == VALUES[rule], rule
    return " || '|' || ".join(f"'{k}=' || coalesce(CAST({v} AS VARCHAR), '')" for k, v in values.items())


def text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DESCRIBED = "date_text || ' (' || date_precision || ')'"
CREATED = "object_date || ' (' || CASE object_date WHEN '1948' THEN 'circa' WHEN '1930' THEN 'before' ELSE 'year' END || ')'"
ONSETS = ", ".join(f"({t.index}, {k}, {text_sql(t.name)}, {text_sql(w.label)}, '{w.earliest}', '{w.latest}', '{w.ends}')" for t in CFG.onset.territories for k, w in enumerate(t.windows))
ACTOR_ROWS = ", ".join(f"({k}, {text_sql(e['name'])}, '{e['entry_kind']}', {str(any(b['implies_persecution_of_former_owner'] for b in e['documented_basis'])).lower()})" for k, e in enumerate(CFG.actors.entries))
NAME_ROWS = ", ".join(f"({k}, {text_sql(e['name'])}, '{e['entry_kind']}', '{e['entry_type']}', {text_sql(e['annotation'])}, {text_sql(e['source_url'])})" for k, e in enumerate(CFG.names.entries))
UNSURE = "CASE WHEN confirmed THEN '' ELSE ' IDENTITY NOT ESTABLISHED: a surname without a given name fits a different individual equally well.' END"
LISTED_VALUES = {"date_span": DESCRIBED, "matched_on": "owner_name", "match_basis": "basis", "entry_kind": "kind", "identity_confirmed": "confirmed"}


@query("flag_values", f"""{CHAIN}, onset(territory, window_seq, name, label, earliest, latest, ends) AS (VALUES {ONSETS}), actor(entry, name, kind, implies) AS (VALUES {ACTOR_ROWS}), listed(entry, name, kind, type, annotation, url) AS (VALUES {NAME_ROWS})
SELECT object_id, CAST(NULL AS VARCHAR) AS source_ref, 'PC-001' AS rule_id, 'Unverified: is any ownership before 1945 documented? At its stated precision no record of the chain is dated before 1 January 1945.' || CASE WHEN object_date IS NOT NULL THEN ' The object''s creation is recorded as ' || {CREATED} || ', so an earlier owner is possible.'
    ELSE ' No creation date is recorded, so missing documentation and a later creation cannot be told apart; recording object_date would separate them.' END AS rule_statement, {value_sql('PC-001', records_in_chain='n', dated_records_in_chain='n_dated', threshold="'1945-01-01'", object_date=CREATED)} AS cited FROM ob WHERE NOT possibly AND NOT created_after
UNION ALL SELECT object_id, source_ref, 'PC-002', 'Unverified: who held the object before the institution? The chain''s first record is the institution''s own acquisition and names no earlier owner.', {value_sql('PC-002', owner_name='owner_name', date_span=DESCRIBED, is_institution_acquisition='true', records_earlier_in_chain='0', records_in_chain='n')}
    FROM ch JOIN ob USING (object_id) WHERE rn = 1 AND is_institution_acquisition AND NOT EXISTS (SELECT 1 FROM ch o WHERE o.object_id = ch.object_id AND o.rn > 1 AND o.date_precision IS NULL)
UNION ALL SELECT object_id, source_ref, 'PC-003', 'Unverified: did a persecuted person make this transfer, at a fair price and free to use the proceeds? Its recorded date ' || CASE {certainty('w_from', 'w_to')} WHEN 'certain' THEN 'overlaps' ELSE 'may overlap, which its precision leaves open,' END || ' the persecution window of ' || name || ' (from ' || label || ' to ' || ends || '). The record says nothing either way.',
    {value_sql('PC-003', owner_name='owner_name', date_span=DESCRIBED, location='location', transaction_state='transaction_state', territory='name', persecution_window='window_id', persecution_onset='label', onset_earliest='earliest', onset_latest='latest', window_ends='ends', overlap_certainty=certainty('w_from', 'w_to'))}
    FROM hit JOIN win USING (territory) JOIN onset USING (territory, window_seq) WHERE {OPEN} AND {meets('w_from', 'w_to')}
UNION ALL SELECT object_id, source_ref, 'PC-005', CASE WHEN implies THEN 'Unverified: in what circumstances was this transaction made? A party matches the entry for ' || name || ', whose documented basis is cited. The match makes no finding about the transaction.'
    WHEN {EVIDENCE} THEN 'Unverified: in what circumstances was this transaction made? A party matches the entry for ' || name || ', whose basis does not bear on a private former owner; the question comes from the record''s own transaction_state.'
    ELSE 'For context only: a party matches the entry for ' || name || '. On the cited basis this does NOT indicate persecution of a former owner, and nothing else in the record suggests it. What does that basis cover?' END || {UNSURE},
    {value_sql('PC-005', **LISTED_VALUES, actor_entry='name', actor_window="'1938-01-01 to 1945-12-31'", overlap_certainty=certainty(*ACTOR))} FROM ch JOIN ac USING (owner_name) JOIN actor USING (entry) WHERE {OPEN} AND {meets(*ACTOR)}
UNION ALL SELECT object_id, source_ref, CASE type WHEN 'exonerating' THEN 'NM-002' ELSE 'NM-001' END, CASE type WHEN 'exonerating' THEN 'An owner name matches the entry for ' || name || ', which is EXONERATING: its annotation, quoted in full, raises no concern. This is context, is not a flag and puts nothing in the queue.'
    ELSE 'Unverified: is the person or firm in this record the one that the list describes? An owner name matches the entry for ' || name || '. The entry''s annotation is quoted in full; the match makes no finding.' || {UNSURE} END,
    {value_sql('NM-001', **LISTED_VALUES, screening_band=f"'{CFG.onset.band[0]} to {CFG.onset.band[1]}'", aliu_entry_name='name', aliu_entry_type='type', aliu_annotation='annotation', source_url='url')} FROM ch JOIN nm USING (owner_name) JOIN listed USING (entry) WHERE {meets(*BAND)}
UNION ALL SELECT ch.object_id, source_ref, 'DQ-002', 'Unverified: what provenance before 1945 was established when the object was acquired? The acquisition is dated after 1998-12-03, and no record is certainly dated before 1945. The question is about the acquisition, not the object''s past.',
    {value_sql('DQ-002', owner_name='owner_name', date_span=DESCRIBED, transaction_state='transaction_state', commitment_date_applied="'1998-12-03'", commitment_date_is_default='true', certainly_dated_before_1945='false', records_in_chain='n')} FROM ch JOIN ob USING (object_id) WHERE is_institution_acquisition AND e > DATE '1998-12-03' AND NOT certainly""")  # fmt: skip
def flag_values(spark, sf_dir):
    """Statements and cited values of the rules on chains, windows and lists."""
    rows = staged(rich(spark, sf_dir), "records")
    named, _, cited = rules.nm001(rows, CFG)
    found = rules.pc001(rows)[0] + rules.pc002(rows)[0] + rules.pc003(rows, CFG)[0][:1] + rules.pc005(rows, CFG)[0] + named + cited + rules.dq002(rows, CFG)[0]
    told = F.lit(None).cast("string")
    for rule, names in VALUES.items():
        told = F.when(F.col("rule_id") == rule, F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(F.get_json_object("cited_fields", f"$.{n}"), F.lit(""))) for n in names])).otherwise(told)
    return rules.together(rows, found).select("object_id", "source_ref", "rule_id", "rule_statement", told.alias("cited"))


# --- assembly --------------------------------------------------------------

ALL_FLAGS = f"""{CHAIN}, {CATALOGUE}, {PAIRS}, fl AS (
  SELECT object_id, 'PC-001' AS rule_id, 'n/a' AS tier FROM ob WHERE NOT possibly AND NOT created_after
  UNION ALL SELECT object_id, 'PC-002', 'n/a' FROM ch WHERE rn = 1 AND is_institution_acquisition AND NOT EXISTS (SELECT 1 FROM ch o WHERE o.object_id = ch.object_id AND o.rn > 1 AND o.date_precision IS NULL)
  UNION ALL SELECT object_id, 'PC-003', tier FROM (SELECT object_id, source_ref, tier FROM ({PC003_WINDOW}) UNION ALL {PC003_STATE})
  UNION ALL SELECT object_id, 'PC-010', 'n/a' FROM ch WHERE transaction_state = 'fluchtgut'
  UNION ALL SELECT object_id, 'PC-004', {PC004_TIER} FROM (SELECT ch.*, hit.territory FROM ch LEFT JOIN hit ON hit.source_ref = ch.source_ref) x WHERE {CLASS} IS NOT NULL AND {OPEN} AND {meets(*BAND)}
  UNION ALL SELECT object_id, 'PC-004', 'n/a' FROM ob WHERE {CLASS} IS NOT NULL AND NOT certainly AND NOT created_after
  UNION ALL SELECT object_id, 'PC-005', CASE WHEN entry <> 1 OR {EVIDENCE} THEN {threshold_tier(*ACTOR)} ELSE 'n/a' END FROM ch JOIN ac USING (owner_name) WHERE {OPEN} AND {meets(*ACTOR)}
  UNION ALL SELECT object_id, 'PC-006', {threshold_tier(*PATTERN)} FROM ch JOIN an USING (owner_name) WHERE {OPEN} AND {meets(*PATTERN)}
  UNION ALL SELECT object_id, 'PC-007', 'n/a' FROM cat WHERE n_early > 0 AND (n_missing > 0 OR n_late = 0)
  UNION ALL SELECT object_id, 'PC-008', 'n/a' FROM ch WHERE transaction_state = 'restitution_erfolgt_or_vergleich' AND restitution_recipient_type = 'state_or_institution'
  UNION ALL SELECT object_id, 'PC-009', {threshold_tier(*EXPORT)} FROM pr WHERE k > 1 AND {OPEN} AND before IS NOT NULL AND location IS NOT NULL
    AND lower(strip_accents({COUNTRY.format('before')})) <> lower(strip_accents({COUNTRY.format('location')})) AND {meets(*EXPORT)} AND NOT coalesce(export_licence_present, false)
  UNION ALL SELECT object_id, 'NM-001', 'n/a' FROM ch JOIN nm USING (owner_name) WHERE entry <> 2 AND {meets(*BAND)}
  UNION ALL SELECT object_id, 'DQ-001', NULL FROM ch WHERE source_citation IS NULL
  UNION ALL SELECT ch.object_id, 'DQ-002', NULL FROM ch JOIN ob USING (object_id) WHERE is_institution_acquisition AND e > DATE '1998-12-03' AND NOT certainly),
cnt AS (SELECT ob.object_id, count(rule_id) FILTER (WHERE rule_id NOT LIKE 'DQ%') AS n_persecution, count(rule_id) FILTER (WHERE rule_id LIKE 'DQ%') AS n_documentation FROM ob LEFT JOIN fl USING (object_id) GROUP BY ob.object_id)"""


def screened(spark: SparkSession, sf_dir: str):
    return screen(records(spark, sf_dir), CFG)


@query("screening_flags", f"{ALL_FLAGS} SELECT object_id, rule_id, tier, count(*) AS n FROM fl GROUP BY ALL")
def screening_flags(spark, sf_dir):
    return screened(spark, sf_dir).flags.groupBy("object_id", "rule_id", F.col("presumption_tier").alias("tier")).agg(F.count("*").alias("n"))


@query("flag_counts", f"{ALL_FLAGS} SELECT * FROM cnt")
def flag_counts(spark, sf_dir):
    s = screened(spark, sf_dir)
    return assemble.flag_counts(s.records, s.flags).drop("chain_seq")


@query("screening_statement", f"{ALL_FLAGS} SELECT object_id, CASE WHEN n_persecution + n_documentation = 0 THEN 'none' ELSE CAST(n_persecution + n_documentation AS VARCHAR) END AS triggered FROM cnt")
def screening_statement(spark, sf_dir):
    text = F.col("screening_statement")
    said = F.when(text.contains("no criteria triggered"), "none").otherwise(F.regexp_extract(text, "; ([0-9]+) flags", 1))
    return screened(spark, sf_dir).objects.select("object_id", said.alias("triggered"))


@query("coverage_map", f"""{ALL_FLAGS}, bg AS (SELECT DISTINCT object_id FROM fl WHERE rule_id = 'PC-002')
SELECT count(*) AS objects_processed, count(*) FILTER (WHERE possibly) AS with_any_pre_1945_provenance, count(*) FILTER (WHERE possibly AND certainly) AS of_which_certainly_dated_pre_1945,
  count(*) FILTER (WHERE NOT possibly AND NOT created_after) AS with_no_pre_1945_provenance, count(*) FILTER (WHERE NOT possibly AND created_after) AS created_after_the_risk_band,
  count(*) FILTER (WHERE object_date IS NULL) AS creation_date_not_recorded, count(bg.object_id) AS chain_begins_at_institutional_acquisition,
  count(*) FILTER (WHERE bg.object_id IS NULL AND never_set) AS institutional_acquisition_not_determinable, count(*) FILTER (WHERE any_resolved) AS previously_resolved
FROM ob LEFT JOIN bg USING (object_id)""")  # fmt: skip
def coverage_map(spark, sf_dir):
    return screened(spark, sf_dir).coverage


@query("work_queue_band", f"""{ALL_FLAGS} SELECT ob.object_id, CASE WHEN count(*) FILTER (WHERE tier = 'heightened') > 0 THEN 'heightened' WHEN count(*) FILTER (WHERE tier = 'ordinary') > 0 THEN 'ordinary'
  WHEN count(*) FILTER (WHERE rule_id IN ('NM-001', 'PC-005')) > 0 THEN 'namelist' WHEN count(*) FILTER (WHERE rule_id = 'PC-008') > 0 THEN 'settlement' WHEN count(rule_id) FILTER (WHERE rule_id NOT LIKE 'DQ%') > 0 THEN 'coverage'
  WHEN count(rule_id) > 0 THEN 'documentation' ELSE 'none' END AS band, bool_or(any_resolved) AND count(*) FILTER (WHERE rule_id = 'PC-008') = 0 AS held_out FROM ob LEFT JOIN fl USING (object_id) GROUP BY ob.object_id""")  # fmt: skip
def work_queue_band(spark, sf_dir):
    return assemble.bands(screened(spark, sf_dir).objects)


@query("coverage_notes", f"""{CHAIN}, {PAIRS}, {CATALOGUE} SELECT ob.object_id, any_resolved AS resolved, count(ch.source_ref) > count(ch.date_precision) AS undated, ob.never_set AS pc002_skipped_unset, possibly AND NOT certainly AS imprecise_only,
  count(catalogue_reference) = 0 AS pc007_skipped, ob.object_class IS NULL AS pc004_skipped, coalesce(bool_or(transaction_state = 'restitution_erfolgt_or_vergleich' AND restitution_recipient_type IS NULL), false) AS pc008_skipped,
  coalesce(bool_or(date_precision IS NOT NULL AND location IS NULL AND {OPEN}), false) AS pc003_unlocated FROM ob JOIN ch USING (object_id) GROUP BY ALL""")  # fmt: skip
def coverage_notes(spark, sf_dir):
    text = F.col("coverage_note")
    said = {
        "resolved": "previously resolved", "undated": "Undated records in chain", "pc002_skipped_unset": "PC-002 skipped: no record sets", "imprecise_only": "only imprecisely dated records",
        "pc007_skipped": "PC-007 skipped", "pc004_skipped": "PC-004 skipped", "pc008_skipped": "PC-008 skipped", "pc003_unlocated": "the record has no `location`",
    }
    return screened(spark, sf_dir).objects.select("object_id", *[text.contains(v).alias(k) for k, v in said.items()])


# --- event files, piece by piece -------------------------------------------

LIDO_ID = "CASE source_order % 6 WHEN 0 THEN 'lido01016' WHEN 1 THEN 'lido00996' WHEN 2 THEN 'lido01011' WHEN 3 THEN 'lido99999' END"
LIDO_TERM = "CASE source_order % 6 WHEN 3 THEN 'Exchange' WHEN 4 THEN 'Théft' WHEN 5 THEN 'RESTITUTION' END"


@vectorised("struct<state:string,reason:string>")
def _event_type(ids, terms):
    import pandas as pd

    types = load_event_types()
    return pd.DataFrame([types.lookup([i] if i else [], t) for i, t in zip(ids, terms)], columns=["state", "reason"])


@query("event_type_lookup", f"{EV} SELECT source_ref, CASE source_order % 6 WHEN 0 THEN 'purchase' WHEN 1 THEN 'gift' WHEN 3 THEN 'exchange' WHEN 5 THEN 'restitution_erfolgt_or_vergleich' END AS state, source_order % 6 IN (2, 4) AS left_out FROM ev")
def event_type_lookup(spark, sf_dir):
    out = events(spark, sf_dir).select("source_ref", _event_type(F.expr(LIDO_ID), F.expr(LIDO_TERM)).alias("s"))
    return out.select("source_ref", "s.state", F.col("s.reason").isNotNull().alias("left_out"))


@vectorised("struct<first:string,last:string>")
def _coarsen(first, last):
    import pandas as pd

    return pd.DataFrame([lido.coarsen(a, b) for a, b in zip(first, last)], columns=["first", "last"])


COARSE = """SELECT source_ref, y, m, CASE source_order % 4 WHEN 0 THEN make_date(y, 1, 1) ELSE make_date(y, m, 1) END AS a,
  CASE source_order % 4 WHEN 0 THEN make_date(y, 12, 31) WHEN 1 THEN last_day(make_date(y, m, 1)) WHEN 2 THEN make_date(y, m, 15) ELSE make_date(y, 12, 31) END AS b, source_order % 4 AS k FROM ev"""


@query("lido_coarsen", f"""{EV}, c AS ({COARSE}) SELECT source_ref, CASE WHEN k = 0 OR (k = 3 AND m = 1) THEN CAST(y AS VARCHAR) WHEN k IN (1, 3) THEN substr(CAST(a AS VARCHAR), 1, 7) ELSE CAST(a AS VARCHAR) END AS first,
  CASE WHEN k = 0 OR (k = 3 AND m = 1) THEN CAST(y AS VARCHAR) WHEN k IN (1, 3) THEN substr(CAST(b AS VARCHAR), 1, 7) ELSE CAST(b AS VARCHAR) END AS last FROM c""")  # fmt: skip
def lido_coarsen(spark, sf_dir):
    c = spark.sql(COARSE.replace("FROM ev", "FROM {ev}"), ev=events(spark, sf_dir))
    return c.select("source_ref", _coarsen(F.col("a").cast("string"), F.col("b").cast("string")).alias("s")).select("source_ref", "s.first", "s.last")


@vectorised("struct<owner:string,notes:string>")
def _extensions(texts):
    import pandas as pd

    found = [lido.extensions(t, "row") for t in texts]
    return pd.DataFrame([(f.get("owner_name"), " ".join(p)) for f, p in found], columns=["owner", "notes"])


@query("lido_extensions", f"{EV} SELECT source_ref, owner_name AS owner, 'Seen in ' || CAST(y AS VARCHAR) AS notes FROM ev")
def lido_extensions(spark, sf_dir):
    text = F.concat(F.lit("Seen in "), F.col("y").cast("string"), F.lit("\nRECORD_EXT:owner_name=first\n\nRECORD_EXT:owner_name = "), F.col("owner_name"))
    return events(spark, sf_dir).select("source_ref", _extensions(text).alias("s")).select("source_ref", "s.owner", "s.notes")


# --- texts -----------------------------------------------------------------


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


NUMBERS = "list_sort(list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+'), lambda p: CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END)))"


@query("guard_numbers", f"SELECT doc_id, array_to_string(list_filter({NUMBERS.format('text')}, lambda n: NOT list_contains({NUMBERS.format(chr(39) + 'given: 1938-11-04, 0 and 16' + chr(39))}, n)), ',') AS added FROM documents")
def guard_numbers(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(guard.new_numbers(F.col("text"), F.lit("given: 1938-11-04, 0 and 16")), ",").alias("added"))


SHORTS = "|".join(guard.ABBREVIATIONS)
# no look-behind there, so the character before comes along; neighbours need a second pass
MASKED = "regexp_replace(regexp_replace({0}, '(^|[^\\p{{L}}\\p{{N}}_])(\\p{{L}})\\.', '\\1\\2~', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])(\\p{{L}})\\.', '\\1\\2~', 'g')"
MASKED_ALL = f"regexp_replace({MASKED}, '(?i)(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])({SHORTS})\\.', '\\1\\2~', 'g')"
SENTENCES = f"len(list_filter(regexp_split_to_array({MASKED_ALL.format('text')}, '[.!?]+'), lambda s: regexp_matches(s, '[^\\s]')))"


@query("guard_sentences", f"SELECT doc_id, CAST({SENTENCES} AS INT) AS n_sentences FROM documents")
def guard_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", guard.sentence_count(F.col("text")).alias("n_sentences"))


@query("guard_length_framing", f"SELECT doc_id, length(text) > 700 OR {SENTENCES} > 3 AS too_long, NOT (contains(lower(text), '?') OR contains(lower(text), 'unverified')) AS not_a_question FROM documents")
def guard_length_framing(spark, sf_dir):
    kinds = guard.length_and_framing(F.col("text"), guard.load_language_pack().get("en"))
    return documents(spark, sf_dir).select("doc_id", F.array_contains(kinds, "too_long").alias("too_long"), F.array_contains(kinds, "not_phrased_as_a_question").alias("not_a_question"))


FOUND = "len(regexp_extract_all(text, '{0}'))"


@query("secret_scan", f"""SELECT doc_id, CAST({FOUND.format('Bearer' + chr(92) + 's+[A-Za-z0-9._~+/-]{16,}')}
  + {FOUND.format('(?i)' + chr(92) + 'b(?:api[_-]?key|secret|token|password)' + chr(92) + 'b' + chr(92) + 's*[:=]' + chr(92) + 's*[' + chr(39) * 2 + '"]?[A-Za-z0-9._~+/-]{16,}')} AS BIGINT) AS n_findings FROM documents""")  # fmt: skip
def secret_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(hygiene.findings(F.col("text"))).cast("bigint").alias("n_findings"))


@query("rejected_token_topk", """SELECT 'introduced_number' AS kind, token, count(*) AS n FROM (SELECT doc_id, unnest(""" + NUMBERS.format("text") + """) AS token FROM documents) GROUP BY token ORDER BY n DESC, kind, token LIMIT 40""")
def rejected_tokens(spark, sf_dir):
    found = documents(spark, sf_dir).select(F.explode(guard.numbers(F.col("text"))).alias("token")).withColumn("kind", F.lit("introduced_number"))
    return hygiene.rejected_tokens(found)


@query("acceptance_rates", f"SELECT source_is_odd AS adversarial, count(*) AS n, count(*) FILTER (WHERE ok) AS n_accepted FROM (SELECT doc_id % 2 = 1 AS source_is_odd, length(text) <= 700 AND {SENTENCES} <= 3 AS ok FROM documents) GROUP BY 1")
def acceptance_rates(spark, sf_dir):
    kinds = guard.length_and_framing(F.col("text"), guard.load_language_pack().get("en"))
    return hygiene.acceptance(documents(spark, sf_dir).select((F.col("doc_id") % 2 == 1).alias("adversarial"), (~F.array_contains(kinds, "too_long")).alias("accepted")))


GIVEN = {"rule_statement": "Unverified: was the object sold in 1938?", "cited_fields": {"owner_name": "The Almqvist Estate", "date_span": "1938-11-04 (exact)", "location": "Munich, Germany", "n": 16}}


def verdicts_sql() -> str:
    """All English checks over the documents, against the fields in ``GIVEN``."""
    pack = guard.load_language_pack()
    given = guard.Given.of(GIVEN, pack.get("en"), pack)
    of, listed = given.language, lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"
    word = r"[\p{L}\p{N}_]"
    whole = lambda phrases, tail="": "(?:^|[^" + word[1:] + f")(?:{'|'.join(re.escape(x) for x in phrases)}){tail}(?:$|[^" + word[1:] + ")"
    terms = [t for t in pack.terms if not re.search(rf"(?<!\w){re.escape(t)}(?:{'|'.join(guard.TERM_SUFFIXES)})?(?!\w)", given.folded)]
    quoted = lambda p: p.replace("'", "''")
    grounded = given.tokens | {w for w, group in pack.groups.items() if given.tokens & set(group)}
    folded = "replace(lower(strip_accents({0})), 'ß', 'ss')"
    sentences = SENTENCES.replace("text", "t")
    names = (
        f"list_filter(flatten(list_transform(regexp_split_to_array({MASKED_ALL.format('t')}, '[.!?]'), lambda s: list_transform(regexp_extract_all(s, '[\\p{{L}}]+'), lambda w, k: {{'w': w, 'k': k}}))),"
        f" lambda x: regexp_matches(x.w, '^\\p{{Lu}}') AND length(x.w) >= {guard.SHORTEST_NAME} AND NOT (x.k = 1 AND list_contains({listed(of.positional)}, {folded.format('x.w')}))"
        f" AND NOT list_contains({listed(of.allowed | grounded)}, {folded.format('x.w')}))"
    )
    return f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents), f AS (SELECT *, {folded.format('t')} AS folded FROM d)
SELECT doc_id, CASE WHEN t = '' THEN 'empty_output' ELSE array_to_string(list_sort(list_filter([
    CASE WHEN len(list_filter({NUMBERS.format('t')}, lambda n: NOT list_contains({listed(given.numbers)}, n))) > 0 THEN 'introduced_number' END,
    CASE WHEN regexp_matches(folded, '{quoted(whole(terms, '(?:' + '|'.join(guard.TERM_SUFFIXES) + ')?'))}') THEN 'introduced_historical_context' END,
    CASE WHEN regexp_matches(folded, '{quoted(whole(of.assertions))}') THEN 'asserted_a_finding' END,
    CASE WHEN len({names}) > 0 THEN 'introduced_proper_noun' END,
    CASE WHEN length(t) > {of.max_characters} OR {sentences} > {of.max_sentences} THEN 'too_long' END,
    CASE WHEN NOT ({' OR '.join(f"contains(folded, '{quoted(m)}')" for m in of.markers)}) THEN 'not_phrased_as_a_question' END], lambda x: x IS NOT NULL)), ',') END AS kinds FROM f"""


@query("guard_verdicts", verdicts_sql())
def guard_verdicts(spark, sf_dir):
    """All six checks over every document: the kinds of violations."""
    verdict = guard.verified(F.col("text"), F.lit(json.dumps(GIVEN)), "en", guard.load_language_pack())
    checked = documents(spark, sf_dir).select("doc_id", verdict.alias("v"))
    return checked.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("v.violations", lambda x: x["kind"]))), ",").alias("kinds"))


class Answer:
    """A transport that gives the same answer always."""

    def __init__(self, text: str):
        self.text = text

    def complete(self, system: str, user: str) -> str:
        return self.text


@query("explanations", f"""{CHAIN}, x AS (SELECT object_id, source_ref, list_contains({NUMBERS.format("source_ref || ' ' || coalesce(date_text, '')")}, '1938') AS given FROM ch WHERE transaction_state = 'fluchtgut')
  SELECT object_id, source_ref, CASE WHEN given THEN 'Was this sale made in 1938?' END AS llm_explanation, CASE WHEN given THEN 'generated_and_verified' ELSE 'withheld: ''1938'' is not in the cited fields' END AS llm_explanation_status FROM x""")  # fmt: skip
def explanations(spark, sf_dir):
    """The explanation step over one rule's flags: an answer stands where the fields have its number."""
    flags = found_by(spark, sf_dir, rules.pc010)
    return explain.explain_flags(flags, explain.Generator(Answer("Was this sale made in 1938?"))).select("object_id", "source_ref", "llm_explanation", "llm_explanation_status")


@query("verify_flag_statements")
def verify_flag_statements(spark, sf_dir):
    """The verifier over the engine's own statements: what it would reject."""
    return guard.own_statements(screened(spark, sf_dir).flags, "en", guard.load_language_pack())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole screening: a row for each flag."""
    return screened(spark, sf_dir).flags.select("object_id", "axis", "rule_id", "source_ref", "presumption_tier", "rule_statement")


