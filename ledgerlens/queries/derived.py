"""Ownership records derived from ``orders``: one event per order, one object
per customer.  The same SQL text runs in Spark and in DuckDB; each key has a
modulus of its own, so that states, places, owners and precisions combine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import SPAN
from ..sources.records import country_of

EVENTS = """
WITH k AS (
  SELECT o_custkey, o_orderkey,
    (o_orderkey * 7919 + o_custkey * 104729) % 1000003 AS a,
    (o_orderkey * 31 + o_custkey * 17 + 5) % 997 % 12 AS b,
    (o_orderkey * 131 + o_custkey * 7 + 3) % 1009 % 11 AS c,
    (o_orderkey * 53 + o_custkey * 11) % 991 % 12 AS d
  FROM {orders}),
loc AS (SELECT * FROM (VALUES (0, 'Munich, Germany'), (1, 'Vienna, Austria'), (2, 'Prague, Bohemia'), (3, 'Paris, France'), (4, 'Rome, Italy'),
  (5, 'Bern, Switzerland'), (6, 'Amsterdam, Netherlands'), (7, 'Budapest, Hungary'), (8, 'Copenhagen, Denmark'), (9, 'Wien, Österreich'), (10, 'Geneva, Switzerland')) AS t(d_key, location)),
own AS (SELECT * FROM (VALUES (0, 'Private collection, Switzerland'), (1, 'Haberstock, Karl'), (2, 'Lange, Elisabeth'), (3, 'Lange'), (4, 'Galerie Fischer Lucerne'),
  (5, 'Dorotheum'), (6, 'Kunsthaus Lempertz AG'), (7, 'Wolff Metternich, Franz'), (8, 'unbekannt'), (9, 'Almqvist, H.'), (10, 'E.R.R.'), (11, 'Fischer')) AS t(b_key, owner_name)),
st AS (SELECT * FROM (VALUES (0, 'entziehung'), (1, 'zwangsverkauf'), (2, 'vermutung_der_entziehung'), (3, 'verschaerfte_vermutung'), (4, 'fluchtgut'),
  (5, 'restitution_erfolgt_or_vergleich'), (6, 'purchase'), (7, 'gift'), (8, 'exchange'), (9, 'unknown')) AS t(c_key, transaction_state)),
raw AS (
  SELECT concat('OBJ-', lpad(CAST(o_custkey AS STRING), 6, '0')) AS object_id, concat('orders:', CAST(o_orderkey AS STRING)) AS source_ref, CAST(o_orderkey AS BIGINT) AS source_order,
    CAST(1880 + a % 130 AS INT) AS y, CAST(1 + a % 12 AS INT) AS m, CAST(1 + a % 28 AS INT) AS dy,
    CASE a % 7 WHEN 0 THEN 'exact' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'circa' WHEN 4 THEN 'before' WHEN 5 THEN 'after' END AS date_precision,
    owner_name, transaction_state, location,
    CASE o_custkey % 6 WHEN 0 THEN 'painting' WHEN 1 THEN 'silver' WHEN 2 THEN 'Judaica' WHEN 3 THEN 'Münzen' WHEN 4 THEN 'Kunstgewerbe' END AS object_class,
    CASE o_custkey % 5 WHEN 1 THEN '1650' WHEN 2 THEN '1948' WHEN 3 THEN '1962' WHEN 4 THEN '1930' END AS object_date,
    CASE o_custkey % 5 WHEN 1 THEN 'year' WHEN 2 THEN 'circa' WHEN 3 THEN 'year' WHEN 4 THEN 'before' END AS object_date_precision,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('Register no. ', CAST(o_orderkey AS STRING)) END AS source_citation,
    CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS export_licence_present,
    CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN true WHEN o_orderkey % 9 = 1 THEN NULL ELSE false END AS is_institution_acquisition,
    CASE WHEN o_orderkey % 4 = 0 THEN concat('Catalogue ', CAST(o_orderkey AS STRING)) END AS catalogue_reference,
    CASE WHEN o_orderkey % 12 = 0 THEN true WHEN o_orderkey % 12 = 4 THEN false END AS owner_stated_in_catalogue,
    CASE WHEN c = 5 THEN CASE o_orderkey % 4 WHEN 0 THEN 'individual_or_heirs' WHEN 1 THEN 'state_or_institution' WHEN 2 THEN 'unknown' END END AS restitution_recipient_type
  FROM k LEFT JOIN loc ON loc.d_key = k.d LEFT JOIN own ON own.b_key = k.b LEFT JOIN st ON st.c_key = k.c),
nominal AS (
  SELECT *,
    CASE date_precision WHEN 'exact' THEN make_date(y, m, dy) WHEN 'month' THEN make_date(y, m, 1) WHEN 'year' THEN make_date(y, 1, 1) WHEN 'circa' THEN make_date(y, 1, 1) WHEN 'after' THEN make_date(y, 1, 1) END AS n_from,
    CASE date_precision WHEN 'exact' THEN make_date(y, m, dy) WHEN 'month' THEN last_day(make_date(y, m, 1)) WHEN 'year' THEN make_date(y, 12, 31) WHEN 'circa' THEN make_date(y, 12, 31) WHEN 'before' THEN make_date(y, 12, 31) END AS n_to,
    CASE date_precision WHEN 'exact' THEN concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(dy AS STRING), 2, '0'))
      WHEN 'month' THEN concat(CAST(y AS STRING), '-', CAST(m AS STRING)) ELSE CASE WHEN date_precision IS NOT NULL THEN CAST(y AS STRING) END END AS date_text
  FROM raw)
SELECT *,
  CASE date_precision WHEN 'circa' THEN make_date(y - 5, 1, 1) ELSE n_from END AS e,
  CASE date_precision WHEN 'circa' THEN make_date(y + 5, 12, 31) ELSE n_to END AS l,
  CASE object_date WHEN '1650' THEN make_date(1650, 1, 1) WHEN '1948' THEN make_date(1943, 1, 1) WHEN '1962' THEN make_date(1962, 1, 1) END AS created_e
FROM nominal
"""

ORACLE_EVENTS = EVENTS.format(orders="orders")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows of an input file: all strings."""
    ev = events(spark, sf_dir)
    one = F.col("date_precision")
    text = lambda name: F.col(name).cast("string").alias(name)
    return ev.select(
        "source_ref", "source_order", "object_id", F.lit(None).cast("string").alias("object_title"), "object_class", "object_date", F.lit(None).cast("string").alias("object_date_to"), "object_date_precision",
        "owner_name", F.lit(None).cast("string").alias("owner_name_variants"), F.when(one != "before", F.col("date_text")).alias("date_from"), F.when(one == "before", F.col("date_text")).alias("date_to"), "date_precision",
        "transaction_state", "location", "source_citation", text("export_licence_present"), text("is_institution_acquisition"), "catalogue_reference", text("owner_stated_in_catalogue"), "restitution_recipient_type", F.lit(None).cast("string").alias("notes"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as typed records."""
    ev = events(spark, sf_dir)
    p = F.col("date_precision")
    span = F.when(p.isNotNull(), F.struct(p.alias("precision"), F.col("n_from").alias("nominal_earliest"), F.col("n_to").alias("nominal_latest"), F.col("e").alias("earliest"), F.col("l").alias("latest"), F.when(p != "before", F.col("date_text")).alias("raw_from"), F.when(p == "before", F.col("date_text")).alias("raw_to")))
    q = F.col("object_date_precision")
    year = F.col("object_date").cast("int")
    start, end = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))
    low = F.when(q != "before", start)
    made = F.when(q.isNotNull(), F.struct(q.alias("precision"), low.alias("nominal_earliest"), end.alias("nominal_latest"), F.when(q == "circa", F.add_months(low, -60)).otherwise(low).alias("earliest"), F.when(q == "circa", F.add_months(end, 60)).otherwise(end).alias("latest"), F.col("object_date").alias("raw_from"), F.lit(None).cast("string").alias("raw_to")))
    return ev.select(
        "source_ref", "source_order", "object_id", F.lit(None).cast("string").alias("object_title"), "object_class", made.cast(SPAN).alias("object_span"), "owner_name", F.array().cast("array<string>").alias("owner_name_variants"),
        span.cast(SPAN).alias("span"), "transaction_state", "location", country_of(F.col("location")).alias("country"), "source_citation", "export_licence_present", "is_institution_acquisition",
        "catalogue_reference", "owner_stated_in_catalogue", "restitution_recipient_type", F.lit(None).cast("string").alias("notes"),
    )
