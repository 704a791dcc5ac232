"""The functions under SQL names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from .text import fold_text, normalise_text


def register_functions(spark: SparkSession) -> list[str]:
    """``prov_fold``, ``prov_normalise``, ``prov_date_span``, ``prov_match_name``
    and ``prov_verify_text``."""
    from ..operators.guard import load_language_pack, verify
    from ..sources.lists import load_actor_list, load_name_list
    from .names import match_name

    fold = pandas_udf(lambda s: s.map(fold_text, na_action="ignore"), "string")
    normal = pandas_udf(lambda s: s.map(normalise_text, na_action="ignore"), "string")
    lists = {"names": load_name_list().matching, "actors": load_actor_list().matching}
    pack = load_language_pack()

    @pandas_udf("string")
    def matched(names: pd.Series, kinds: pd.Series) -> pd.Series:
        """The entries that a name matches, as JSON."""
        return pd.Series([json.dumps([{"entry": e.name, "basis": m.basis, "confirmed": m.confirmed} for e in lists.get(k, ()) if n and (m := match_name(n, e))], ensure_ascii=False) for n, k in zip(names, kinds)])

    @pandas_udf("array<string>")
    def verified(texts: pd.Series, contexts: pd.Series, languages: pd.Series) -> pd.Series:
        """The kinds of violations of a text."""
        return pd.Series([[k for k, _, _ in verify(t, json.loads(c or "{}"), pack.get(code), pack)] for t, c, code in zip(texts, contexts, languages)])

    for name, f in (("prov_fold", fold), ("prov_normalise", normal), ("prov_match_name", matched), ("prov_verify_text", verified)):
        spark.udf.register(name, f)
    # native: SQL expressions need no Python
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION prov_date_span(v STRING) RETURNS STRUCT<earliest DATE, latest DATE>
        RETURN CASE
          WHEN v RLIKE '^[0-9]{4}$' THEN named_struct('earliest', make_date(CAST(v AS INT), 1, 1), 'latest', make_date(CAST(v AS INT), 12, 31))
          WHEN v RLIKE '^[0-9]{4}-[0-9]{1,2}$' AND CAST(split(v, '-')[1] AS INT) BETWEEN 1 AND 12 THEN named_struct('earliest', make_date(CAST(split(v, '-')[0] AS INT), CAST(split(v, '-')[1] AS INT), 1), 'latest', last_day(make_date(CAST(split(v, '-')[0] AS INT), CAST(split(v, '-')[1] AS INT), 1)))
          WHEN try_to_date(v, 'y-M-d') IS NOT NULL THEN named_struct('earliest', try_to_date(v, 'y-M-d'), 'latest', try_to_date(v, 'y-M-d'))
        END"""
    )
    return ["prov_fold", "prov_normalise", "prov_date_span", "prov_match_name", "prov_verify_text"]
