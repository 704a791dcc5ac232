"""Golden results, invariants and corner cases of the screening engine."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlens import cli
from ledgerlens.functions.dates import build_span, describe, overlap_certainty
from ledgerlens.functions.names import Entry, match_name, parse_person
from ledgerlens.functions.text import fold, fold_text, normalise, normalise_text
from ledgerlens.model import FIELDS, METHODOLOGY, RULES
from ledgerlens.operators.assemble import bands
from ledgerlens.plans.html import render
from ledgerlens.plans.screening import object_dict, report, screen, write
from ledgerlens.sources import csv, dispatch
from ledgerlens.sources.lists import ListError, load_actor_list, load_config, load_event_types, load_name_list
from ledgerlens.sources.records import InputError, typed, valid

CFG = load_config()


def raw(spark, rows):
    full = [dict.fromkeys(FIELDS) | {"object_id": "O", "owner_name": "Almqvist, H."} | r | {"source_ref": f"r{k}", "source_order": k} for k, r in enumerate(rows)]
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", source_ref string, source_order bigint"
    return spark.createDataFrame([tuple(r[c] for c in (*FIELDS, "source_ref", "source_order")) for r in full], schema)


def screened(spark, *rows, cfg=CFG, margin=5):
    result = screen(valid(typed(raw(spark, rows), margin)), cfg)
    return {r["object_id"]: object_dict(r) for r in result.objects.collect()}


def day(text, precision="exact", **more):
    return {"date_from": text, "date_precision": precision} | more


def rules_of(o, axis="persecution_context_flags"):
    return [(f["rule_id"], f.get("presumption_tier")) for f in o[axis]]


# A collection of our own: one chain for each situation.
COLLECTION = [
    day("1938", "year", object_id="window", location="Munich, Germany", source_citation="s"),
    day("1998-12-04", object_id="bought", is_institution_acquisition="yes", source_citation="s"),
    day("1938", "circa", object_id="circa", location="Berlin, Deutschland"),
    day("1934-06", "month", object_id="straddle", location="Berlin, Germany", object_class="silver", transaction_state="vermutung_der_entziehung", source_citation="s"),
    day("1938", "year", object_id="resolved", location="Wien, Österreich", source_citation="s"),
    day("1950", "year", object_id="resolved", transaction_state="restitution_erfolgt_or_vergleich", restitution_recipient_type="state_or_institution", source_citation="s"),
    day("1938", "year", object_id="state", location="Geneva, Switzerland", transaction_state="zwangsverkauf", source_citation="s"),
    day("1943", "year", object_id="both tiers", date_from="1942", date_to="1944", location="Rome, Italy", source_citation="s"),
    {"object_id": "undated", "location": "Paris, France", "source_citation": "s"},
    day("1936", "year", object_id="export", location="Vienna, Austria", source_citation="s"),
    day("1939", "year", object_id="export", location="Bern, Switzerland", source_citation="s"),
    day("1940", "year", object_id="actor", owner_name="Dorotheum", source_citation="s"),
    day("1940", "year", object_id="gated", owner_name="Galerie Fischer", source_citation="s"),
    day("1940", "year", object_id="named", owner_name="Haberstock, K.", source_citation="s"),
    day("1940", "year", object_id="exonerated", owner_name="Franz Graf|x", owner_name_variants="Wolff Metternich, Franz", source_citation="s"),
    day("1940", "year", object_id="generic", owner_name="Swiss private collection", source_citation="s"),
    day("1939", "year", object_id="flight", transaction_state="fluchtgut", source_citation="s"),
    day("1920", "year", object_id="deleted", owner_name="A", catalogue_reference="c1", owner_stated_in_catalogue="true", source_citation="s"),
    day("1960", "year", object_id="deleted", owner_name="B", catalogue_reference="c2", owner_stated_in_catalogue="false", source_citation="s"),
    day("1920", "year", object_id="unverifiable", owner_name="A", catalogue_reference="c1", owner_stated_in_catalogue="true", source_citation="s"),
    day("1920", "year", object_id="clear", source_citation="s"),
]

GOLDEN = {
    "window": [("PC-003", "heightened")],
    "bought": [("PC-001", "n/a"), ("PC-002", "n/a")],
    "circa": [("PC-003", "heightened")],
    "straddle": [("PC-003", "ordinary"), ("PC-004", "ordinary")],
    "resolved": [("PC-003", "heightened"), ("PC-008", "n/a")],
    "state": [("PC-003", "heightened")],
    "both tiers": [("PC-003", "ordinary"), ("PC-003", "heightened")],
    "undated": [("PC-001", "n/a")],
    "export": [("PC-009", "heightened")],
    "actor": [("PC-005", "heightened")],
    "gated": [("PC-005", "n/a")],
    "named": [("NM-001", "n/a")],
    "exonerated": [],
    "generic": [("PC-006", "heightened")],
    "flight": [("PC-010", "n/a")],
    "deleted": [("PC-007", "n/a")],
    "unverifiable": [("PC-007", "n/a")],
    "clear": [],
}


@pytest.fixture(scope="module")
def collection(spark):
    return screen(valid(typed(raw(spark, COLLECTION))), CFG)


@pytest.fixture(scope="module")
def objects(collection):
    return {r["object_id"]: object_dict(r) for r in collection.objects.collect()}


def test_golden_flags(objects):
    assert {i: rules_of(o) for i, o in objects.items()} == GOLDEN
    assert {i for i, o in objects.items() if o["documentation_quality_flags"]} == {"circa", "bought"}
    assert rules_of(objects["bought"], "documentation_quality_flags") == [("DQ-002", None)]
    assert [c["rule_id"] for c in objects["exonerated"]["name_list_citations"]] == ["NM-002"]


def test_statements_and_notes(objects):
    note = lambda i: objects[i]["coverage_note"]
    assert "no criteria triggered" in objects["clear"]["screening_statement"] and "not evidence" in objects["clear"]["screening_statement"]
    assert "PC-002 skipped" in note("window") and "PC-004 skipped" in note("window") and "PC-007 skipped" in note("window") and "DQ-002 skipped" in note("window")
    assert "held out of the active queue" in note("resolved") and objects["resolved"]["resolved_status"] == "previously_resolved"
    assert "has a location but no date" in note("undated") and "is NOT evidence" in note("clear")
    assert note("clear").endswith("Criteria evaluated: " + ", ".join(RULES) + ".")
    assert "does NOT indicate persecution" in objects["gated"]["persecution_context_flags"][0]["rule_statement"]


def test_every_flag_cites_and_nothing_scores(objects):
    text = json.dumps(objects, ensure_ascii=False).lower()
    for o in objects.values():
        for f in o["persecution_context_flags"] + o["documentation_quality_flags"] + o["name_list_citations"]:
            assert f["cited_fields"] and f["methodology"] in METHODOLOGY.values() and f["rule_statement"]
    for word in ("score", "ranking", "low risk", "high risk", "is clear", "guilty"):
        assert word not in text


def test_cited_keys(objects):
    keys = lambda i, k=0: list(objects[i]["persecution_context_flags"][k]["cited_fields"])
    record = ["source_ref", "owner_name", "date_span", "location", "transaction_state"]
    assert keys("window") == record + ["territory", "persecution_window", "persecution_onset", "onset_earliest", "onset_latest", "window_ends", "onset_table_source", "overlap_certainty", "presumption_tier_basis", "onset_table_version"]
    assert keys("state") == record + ["presumption_tier_basis", "transaction_state_gloss", "basis"]
    assert keys("gated")[5:11] == ["matched_on", "match_basis", "entry_kind", "identity_confirmed", "actor_entry", "documented_bases"]
    bases = objects["actor"]["persecution_context_flags"][0]["cited_fields"]["documented_bases"]
    assert [list(b) for b in bases] == [["documented_basis", "sources", "implies_persecution_of_former_owner"]]
    assert keys("export") == record + ["export_licence_present", "moved_from", "moved_from_source_ref", "origin_country", "destination_country", "country_derivation", "window", "overlap_certainty", "export_licence_state", "presumption_tier_basis"]
    assert objects["circa"]["documentation_quality_flags"][0]["cited_fields"]["source_citation"] is None


def test_coverage_map_and_bands(collection, objects):
    c = collection.coverage.first().asDict()
    assert c["objects_processed"] == len(GOLDEN) and c["previously_resolved"] == 1 and c["chain_begins_at_institutional_acquisition"] == 1
    assert c["with_any_pre_1945_provenance"] + c["with_no_pre_1945_provenance"] + c["created_after_the_risk_band"] == c["objects_processed"]
    shown = {r.object_id: (r.band, r.held_out) for r in bands(collection.objects).collect()}
    assert shown["window"] == ("heightened", False) and shown["clear"] == ("none", False) and shown["gated"] == ("namelist", False) and shown["bought"] == ("coverage", False)
    assert "band" not in collection.objects.columns


def test_less_information_gives_no_more_certainty(spark):
    one = lambda o: o["persecution_context_flags"][0]["cited_fields"]["overlap_certainty"]
    for margin in (0, 5, 30):
        got = screened(spark, day("1938", "circa", location="Germany"), margin=margin)
        assert one(got["O"]) == "possible"
    assert one(screened(spark, day("1933", "year", location="Germany"))["O"]) == "certain"


def test_every_persecution_state_reaches_a_flag(spark):
    states = ("entziehung", "zwangsverkauf", "vermutung_der_entziehung", "verschaerfte_vermutung", "fluchtgut")
    got = screened(spark, *[day("1938", "year", object_id=s, transaction_state=s, location="Bern, Switzerland") for s in states])
    assert all(got[s]["persecution_context_flags"] for s in states)


def test_creation_date_boundary(spark):
    rows = [day("1990", "year", object_id=f"{d}{p}", object_date=d, object_date_precision=p) for d, p in (("1944", "year"), ("1945", "year"), ("1948", "circa"), ("1962", "circa"))]
    got = screened(spark, *rows)
    assert [i for i, o in got.items() if ("PC-001", "n/a") in rules_of(o)] == ["1944year", "1948circa"]


def test_missing_lists_are_said(spark, tmp_path):
    cfg = load_config(patterns=None, names=tmp_path / "none.json", actors=None, commitment_date=date(2000, 1, 1))
    got = screened(spark, day("1940", "year", owner_name="Dorotheum", location="Bern, Switzerland"), cfg=cfg)["O"]
    assert all(f"{r} skipped" in got["coverage_note"] for r in ("PC-005", "PC-006", "NM-001"))
    assert "Screened against 10 criteria" in got["screening_statement"]


def test_resolved_can_be_set_by_hand(spark):
    records = valid(typed(raw(spark, [day("1938", "year", object_id="a"), day("1938", "year", object_id="b")])))
    by_hand = spark.createDataFrame([("a", True)], "object_id string, resolved boolean")
    assert {r.object_id: r.resolved_status for r in screen(records, CFG, by_hand).objects.collect()} == {"a": "previously_resolved", "b": "unresolved"}


# --- dates -----------------------------------------------------------------

SPANS = [
    ("1938", None, "year", "1938-01-01", "1938-12-31", 0),
    ("1938-05-04", None, "year", "1938-05-04", "1938-05-04", 0),
    ("1938-2", None, "month", "1938-02-01", "1938-02-28", 0),
    ("1936-02-29", None, "circa", "1931-02-28", "1941-02-28", 0),
    (None, "1940", "before", None, "1940-12-31", 0),
    ("1940", None, "before", None, "1940-12-31", 0),
    ("1940-03", None, "after", "1940-03-01", None, 0),
    (None, None, None, None, None, 0),
    (None, None, "year", None, None, 1),
    ("1938", None, None, None, None, 1),
    ("1938", None, "exact", None, None, 1),
    ("1938", None, "month", None, None, 1),
    ("1940", "1938", "year", None, None, 1),
    ("1938-04-31", None, "exact", None, None, 1),
    ("0000", None, "year", None, None, 1),
    ("0003", None, "circa", None, None, 1),
    ("38", None, "year", None, None, 1),
]


@pytest.mark.parametrize("case", SPANS, ids=str)
def test_spans(spark, case):
    a, b, p, low, high, problems = case
    frame = spark.createDataFrame([(a, b, p)], "a string, b string, p string")
    span, found = build_span(F.col("a"), F.col("b"), F.col("p"))
    r = frame.select(span.alias("s"), found.alias("f")).first()
    assert len(r.f) == problems
    if not problems and p:
        assert [str(d) if d else None for d in (r.s.earliest, r.s.latest)] == [low, high]
    else:
        assert r.s is None


def test_description_and_open_overlap(spark):
    frame = spark.createDataFrame([("1935", "1936", "year"), (None, "1940", "before"), ("1938", "1938", "circa")], "a string, b string, p string")
    span, _ = build_span(F.col("a"), F.col("b"), F.col("p"))
    out = frame.select(describe(span).alias("d"), overlap_certainty(span, date(1900, 1, 1), date(1935, 6, 1)).alias("c")).collect()
    assert [r.d for r in out] == ["1935–1936 (year)", "1940 (before)", "1938 (circa)"] and [r.c for r in out] == ["certain", "possible", "possible"]


# --- texts and names -------------------------------------------------------


def test_native_fold_is_the_python_fold(spark):
    words = ["Österreich", "STRAẞE ﬁn", "Łódź Ørsted", "Ĳssel", "é é", "ΑΣ", "Ǆ", "plain ASCII", "Ünï_ço-de!  x", "İ"]
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f"), normalise(F.col("w")).alias("n")).collect()
    assert [(r.f, r.n) for r in out] == [(fold_text(w), normalise_text(w)) for w in words]


HABERSTOCK = Entry.of(0, "Haberstock, Karl", ("Karl Haberstock",), "person")
METTERNICH = Entry.of(1, "Wolff Metternich, Franz", (), "person")
LEMPERTZ = Entry.of(2, "Kunsthaus Lempertz", (), "organisation")
NAMES = [
    ("Haberstock", HABERSTOCK, "surname_only", False),
    ("K. Haberstock", HABERSTOCK, "given_name_compatible", True),
    ("Haberstock, Magdalene", HABERSTOCK, None, None),
    ("Franz", METTERNICH, None, None),
    ("Wolff Metternich", METTERNICH, "surname_only", False),
    ("Kunsthaus Lempertz AG", LEMPERTZ, "full_name", True),
    ("Lempertz", LEMPERTZ, "organisation_name", True),
    ("Kunsthaus", LEMPERTZ, None, None),
    ("Lempertz, Cologne", LEMPERTZ, None, None),  # reads as a person
]


@pytest.mark.parametrize("raw_name,entry,basis,confirmed", NAMES)
def test_name_identity(raw_name, entry, basis, confirmed):
    m = match_name(raw_name, entry)
    assert (m and m.basis, m and m.confirmed) == (basis, confirmed)


def test_persons():
    assert parse_person("Anna B. Clark").surname == "clark" and parse_person("Galerie Fischer") is None and parse_person("One Two Three") is None


# --- files -----------------------------------------------------------------

HEAD = "object_id,owner_name,date_precision,date_from,notes\n"


def load(spark, tmp_path, text, name="in.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return csv.load_records(spark, str(tmp_path / name))


def test_csv(spark, tmp_path):
    out = load(spark, tmp_path, "﻿object_id , owner_name,date_precision,date_from,notes\nA,\"X, \"\"Y\"\"\",year,1938,\"two\nlines\"\n,,,,\n\nB, Z ,,,\n").orderBy("source_order").collect()
    assert [(r.object_id, r.owner_name, r.notes, r.source_ref) for r in out] == [("A", 'X, "Y"', "two\nlines", "in.csv:row 2"), ("B", "Z", None, "in.csv:row 4")]


@pytest.mark.parametrize(
    "text,parts",
    [
        (HEAD.replace("notes", "price") + "A,B,,,1\n", ["unknown column 'price'"]),
        ("object_id,owner_name\nA,B\n", ["'date_precision' is missing"]),
        (HEAD, ["no data rows"]),
        (HEAD + "A,,year,,\nB,C,exact,1938,\n", ["row 2: owner_name", "row 2: date", "row 3: date"]),
    ],
)
def test_csv_rejections(spark, tmp_path, text, parts):
    with pytest.raises(InputError) as e:
        load(spark, tmp_path, text)
    assert all(p in str(e.value) for p in parts)


def test_report_files_and_cli(spark, tmp_path, collection):
    write(collection, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/flags")).where("rule_id = 'PC-003'").count() == sum(r == "PC-003" for g in GOLDEN.values() for r, _ in g)
    data = report(collection, CFG, "in.csv", "csv", [], 5)
    assert list(data)[:3] == ["disclaimer", "generated_at", "input_file"] and len(data["criteria_screened"]) == 13
    page = render(data | {"x": "</script><!-- -->"})
    assert "__TRIAGE_DATA__" not in page and page.count("</script>") == 2
    with pytest.raises(ValueError):
        render(data, __file__.replace("test_engine", "conftest"))
    (tmp_path / "in.csv").write_text(HEAD + "A,B,year,1938,\n", encoding="utf-8")
    assert cli.main([str(tmp_path / "in.csv"), "--out", str(tmp_path / "r.json"), "--html", str(tmp_path / "r.html")], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())["objects"][0]["object_id"] == "A"
    assert cli.main([str(tmp_path / "in.csv"), "--institution-commitment-date", "soon"], spark) == 2
    assert cli.main([str(tmp_path / "in.csv"), "--llm-endpoint", "http://x", "--env-file", str(tmp_path / "no")], spark) == 2
    with pytest.raises(InputError):
        dispatch.detect_format("a.txt")


def test_csv_of_several_files_and_parquet_output(spark, tmp_path):
    lines = [HEAD.strip(), "o1,A,year,1938,", "o2,B,year,1950,"]
    folder = tmp_path / "many"
    folder.mkdir()
    for name, rows in (("a.csv", lines[1:]), ("b 1.csv", lines[1:2])):
        (folder / name).write_text("\n".join([lines[0], *rows]) + "\n", encoding="utf-8")
    refs = sorted(r.source_ref for r in csv.load_records(spark, str(folder)).collect())
    assert refs == ["a.csv:row 2", "a.csv:row 3", "b 1.csv:row 2"]
    assert cli.main([str(folder), "--format", "csv", "--parquet", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "objects")).count() == 2


def test_every_problem_is_kept(spark, tmp_path, monkeypatch):
    from ledgerlens.sources import records as module

    monkeypatch.setattr(module, "LISTED_PROBLEMS", 3)
    (tmp_path / "bad.csv").write_text(HEAD + "".join(f"o{k},A,decade,1938,\n" for k in range(8)))
    with pytest.raises(InputError) as e:
        csv.load_records(spark, str(tmp_path / "bad.csv"))
    assert len(e.value.problems) == 3 and e.value.total == 8 and "5 more problems" in str(e.value)
    assert {r.problem.split(": ")[0] for r in spark.read.parquet(e.value.table).collect()} == {f"bad.csv:row {k + 2}" for k in range(8)}


def test_lists_are_checked(tmp_path):
    assert load_event_types().lookup(["lido01016"], "Gift")[0] == "purchase"
    for load_, text in ((load_name_list, '{"entries": []}'), (load_name_list, '{"entries": [{"name": "x"}]}'), (load_actor_list, '{"actors": [{"name": "x", "documented_basis": {"summary": "s", "sources": ["u"]}}]}'), (load_actor_list, "{")):
        (tmp_path / "l.json").write_text(text)
        with pytest.raises(ListError):
            load_(tmp_path / "l.json")


def test_queries_and_sql_agree(spark):
    import duckdb

    from ledgerlens.queries import ORACLE_SQL, QUERIES

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("date_span_build", "validate_problems", "pc003_persecution", "pc004_object_class", "pc005_actors", "pc009_export", "screening_flags", "coverage_notes", "guard_sentences"):
        frame = QUERIES[name](spark, sf)
        answer = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in answer.description]
        want = sorted(repr(tuple(dict(zip(names, r))[c] for c in sorted(names))) for r in answer.fetchall())
        assert sorted(repr(tuple(r[c] for c in sorted(frame.columns))) for r in frame.collect()) == want, name


def test_rescreening_a_stream(spark, tmp_path):
    from ledgerlens.streaming.rescreen import rescreen_batch

    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    rescreen_batch(raw(spark, [day("1938", "year", object_id="a", location="Germany"), day("1938", "exact", object_id="bad")]), 0, table, out, CFG)
    rescreen_batch(raw(spark, [day("1950", "year", object_id="a", transaction_state="restitution_erfolgt_or_vergleich")]), 1, table, out, CFG)
    status = {(r.batch, r.object_id): r.resolved_status for r in spark.read.parquet(out + "/objects").collect()}
    assert status == {(0, "a"): "unresolved", (1, "a"): "previously_resolved"}
    assert spark.read.parquet(out + "/rejected").count() == 1


def test_sql_functions(spark):
    from ledgerlens.functions.register import register_functions

    register_functions(spark)
    r = spark.sql("SELECT prov_fold('Wien, Österreich') AS f, prov_normalise('A.-B') AS n, prov_date_span('1938-02').latest AS d, prov_match_name('Dorotheum', 'actors') AS m, prov_verify_text('It was looted.', '{}', 'en') AS v").first()
    assert r.f == "wien, osterreich" and r.n == "a b" and str(r.d) == "1938-02-28" and "Dorotheum" in r.m and "asserted_a_finding" in r.v


def test_a_report_in_parts(spark, collection, tmp_path):
    """Joined, it is the report; pages hold every object once."""
    from ledgerlens.plans.parts import joined, write_parts

    args = ("in.csv", "csv", [{"source_ref": "r", "kind": "k", "detail": "d"}], 5)
    whole = report(collection, CFG, *args)
    footer = write_parts(collection, CFG, str(tmp_path / "out"), *args, page=4)
    parts = json.loads("".join(joined(str(tmp_path / "out"))))
    assert parts | {"generated_at": None} == whole | {"generated_at": None} and len(whole["objects"]) == len(GOLDEN)
    pages = sorted((tmp_path / "out" / "pages").glob("page-*.html"))
    assert footer == {"objects": len(GOLDEN), "pages": len(pages), "objects_on_a_page": 4} and len(pages) == -(-len(GOLDEN) // 4)
    held = [json.loads(p.read_text(encoding="utf-8").partition('id="data">')[2].partition("</script>")[0].replace("<\\/", "</")) for p in pages]
    assert [o for h in held for o in h["objects"]] == whole["objects"] and [h["page"] for h in held] == list(range(len(pages)))
    index = (tmp_path / "out" / "index.html").read_text(encoding="utf-8")
    assert all(f"pages/{p.name}" in index for p in pages)
