import contextlib
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import battery, guard, hygiene
from ledgerlens.operators.explain import AnswerStore, Generator, SuffixTransport, annotate, answers, as_prompt, context_key, context_rows, explain_flags, key_column, uncited
from ledgerlens.sources.env import load_env_file
from ledgerlens.sources.lists import ListError

PACK = guard.load_language_pack()
FLAG = {
    "rule_id": "PC-003",
    "rule_statement": "Unverified: did a persecuted person make this transfer?",
    "methodology": "Compares dates.",
    "presumption_tier": "heightened",
    "cited_fields": {"owner_name": "Almqvist, H.", "date_span": "1938-11-04 (exact)", "location": "Munich, Germany", "source_ref": "r1"},
}
CASES = [
    ("en", "Was the transfer by Almqvist in Munich in November 1938 made freely?", []),
    ("en", "Was the transfer in 1939 made freely?", ["introduced_number"]),
    ("en", "Was this after Kristallnacht?", ["introduced_historical_context", "introduced_proper_noun"]),
    ("en", "This was certainly a forced sale?", ["asserted_a_finding"]),
    ("en", "Was it sold to Gurlitt or Smith?", ["introduced_historical_context", "introduced_proper_noun"]),
    ("en", "The record names Almqvist.", ["not_phrased_as_a_question"]),
    ("en", "Was it? Was it? Was it? Was it?", ["too_long"]),
    ("en", "", ["empty_output"]),
    ("fr", "Le transfert en Allemagne, en novembre 1938, est-il libre?", []),
    ("de", "Wurde der Gegenwert der Übertragung im November 1938 gezahlt?", []),
    ("de", "Hat Hildebrand Becker das Objekt erworben?", ["introduced_proper_noun"]),
    ("it", "Il trasferimento a Monaco nel 1938 era libero?", []),
]


def test_months_that_are_spelt_out_ground_their_names():
    given = {"cited_fields": {"notes": "sold in November"}}
    names = lambda text, code: [t for k, _, t in guard.verify(text, given, PACK.get(code), PACK) if k == "introduced_proper_noun"]
    assert names("Was it sold in Novembre?", "en") == [] and names("Was it sold in Juni?", "en") == ["Juni"]


def test_months_of_dates():
    assert guard.months_in("1938-11-04, 1938-02 and (1940-12)") == {11, 2, 12}
    assert guard.months_in("2026-08-09b 38-11 1938-13 11938-04 1938-04-1 x1938-05 1938") == set()


def test_scans_share_their_exemptions(spark):
    safe = frozenset({("a", "abcdef0123456789")})
    texts = [("a", "api_key = abcdef0123456789abcdef"), ("b", "api_key = abcdef0123456789abcdef"), ("a", "token: ZZZZZZZZZZZZZZZZZZZZ=''"), ("c", "Bearer abcdefghijklmnop=")]
    frame = spark.createDataFrame(texts, "p string, t string")
    for placeholders in (False, True):
        own = frame.select(F.size(hygiene.findings(F.col("t"), allow_placeholders=placeholders, place=F.col("p"), known_safe=safe)).alias("n")).collect()
        assert [r.n for r in own] == [len(hygiene.scan_text(p, t, placeholders, safe)) for p, t in texts]


@pytest.mark.parametrize("code,text,kinds", CASES)
def test_verdicts(code, text, kinds):
    assert sorted({k for k, _, _ in guard.verify(text, FLAG, PACK.get(code), PACK)}) == kinds


def test_pack():
    assert set(PACK.languages) == {"en", "de", "fr", "it"} and PACK.get("de").max_characters == 900 and all(x.max_sentences == 3 for x in PACK.languages.values())
    with pytest.raises(ListError):
        PACK.get("es")
    assert guard.count_sentences("Inv. no. 7 by H. Almqvist. Is it known?") == 2


def test_native_forms_agree_with_python(spark):
    texts = ["In 1938-11-04, no. 007 and 16.5", "H. A. Meyer, ca. 1900! Really?", "", "...", "Jh. Bd. 3. x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    out = frame.select(guard.numbers(F.col("t")).alias("n"), guard.sentence_count(F.col("t")).alias("s")).collect()
    assert [(set(r.n), r.s) for r in out] == [(guard.numbers_in(t), guard.count_sentences(t)) for t in texts]
    verdict = spark.createDataFrame([(CASES[0][1], "{}"), (None, None)], "t string, c string").select(guard.verified(F.col("t"), F.col("c"), "en", PACK).alias("v")).collect()
    assert [r.v.accepted for r in verdict] == [False, False]


class Scripted:
    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def complete(self, system, user):
        self.seen.append((system, user))
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_explanations():
    good = CASES[0][1]
    assert Generator(Scripted(good)).explain(FLAG) == (good, "generated_and_verified", 1)
    retry = Scripted("It was stolen in 1950.", good)
    assert Generator(retry).explain(FLAG)[1:] == ("generated_and_verified", 2) and len(retry.seen[1][0]) > len(retry.seen[0][0])
    text, status, tries = Generator(Scripted("It was stolen in 1950.")).explain(FLAG)
    assert text is None and status.startswith("withheld") and tries == 2
    assert Generator(Scripted(OSError("down"))).explain(FLAG)[1] == "not_generated: transport error: down"
    assert Generator(Scripted(good)).explain(FLAG | {"methodology": "by Almqvist, Private Street 5"}, {"address": "Private Street 5"})[2] == 0
    rows = context_rows(FLAG | {"methodology": "x Private, Höhe y"})
    assert uncited(rows, {"a": "private", "b": "abc", "c": "Almqvist, H.", "d": "PRIVATE hohe", "e": "Priv", "f": "Private y"}) == ["a", "d"]
    nested = context_rows({"rule_id": "X", "cited_fields": {"a": [{"b": 1, "c": None}, {"b": "two\nlines"}], "d": True}})
    assert nested == [("rule_id", "X"), ("b", "1"), ("c", "not recorded"), ("b", "two\nlines"), ("d", "True")]
    assert as_prompt(nested, PACK.get("en")).splitlines()[1:] == ["1 | rule_id | X", "2 | b | 1", "3 | c | not recorded", "4 | b | two lines", "5 | d | True"]
    result = annotate({"persecution_context_flags": [dict(FLAG)], "documentation_quality_flags": [], "name_list_citations": [dict(FLAG)]}, Generator(Scripted(good)))
    assert result["name_list_citations"][0]["llm_explanation"] == good


class Fixed:
    def complete(self, system, user):
        return CASES[0][1]


def test_explanations_on_executors_and_battery(spark):
    import json

    frame = spark.createDataFrame([(FLAG["rule_id"], FLAG["rule_statement"], FLAG["methodology"], "heightened", json.dumps(FLAG["cited_fields"]))], "rule_id string, rule_statement string, methodology string, presumption_tier string, cited_fields string")
    assert explain_flags(frame, Generator(Fixed())).first().llm_explanation_status == "generated_and_verified"
    cases, _ = battery.run_battery(spark, Fixed(), [FLAG])
    rates = {r.adversarial: (r.n, r.n_accepted) for r in hygiene.acceptance(cases).collect()}
    assert rates[False][0] == rates[True][0] == 4
    assert [battery.exit_code(False, []), battery.exit_code(True, [(False, False)]), battery.exit_code(True, [(False, True), (True, True)], True), battery.exit_code(True, [(False, True), (True, True)])] == [4, 3, 2, 0]
    assert SuffixTransport(Scripted("x"), "more").complete("s", "u") == "x"


class Counting:
    """Leaves a file for each call, and dies once in the midst of a task."""

    def __init__(self, folder):
        self.folder = str(folder)

    def complete(self, system, user):
        import os
        import uuid

        open(f"{self.folder}/call-{uuid.uuid4().hex}", "w").close()
        if "K7" in user:
            with contextlib.suppress(FileExistsError):
                os.mkdir(f"{self.folder}/died")
                os.remove(next(p.path for p in os.scandir(self.folder) if p.is_file()))  # the lost call
                os._exit(1)
        return CASES[0][1]


def test_each_context_is_asked_once(spark, tmp_path):
    import json

    asked = tmp_path / "asked"
    asked.mkdir()
    rows = [(FLAG["rule_id"], FLAG["rule_statement"], FLAG["methodology"], "heightened" if k % 2 else None, json.dumps(FLAG["cited_fields"] | {"source_ref": f"K{k % 12}"}), k) for k in range(240)]
    frame = spark.createDataFrame(rows, "rule_id string, rule_statement string, methodology string, presumption_tier string, cited_fields string, n int").repartition(6)
    store, generator = AnswerStore(f"file://{tmp_path}/answers"), Generator(Counting(asked), max_retries=0)
    attempts = answers(frame.coalesce(1), generator, store, 1)
    with contextlib.suppress(Exception):  # a local session doesn't try a task again
        attempts.collect()
    out = explain_flags(frame, generator, store).collect()
    assert (asked / "died").exists() and len(out) == 240 and {r.llm_explanation_status for r in out} == {"generated_and_verified"}
    assert len([p for p in asked.iterdir() if p.is_file()]) == 12
    assert explain_flags(frame.limit(5), generator, store).count() == 5 and len([p for p in asked.iterdir() if p.is_file()]) == 12
    keys = {r.k for r in frame.select(key_column("en").alias("k")).collect()}
    assert keys == {context_key("en", *r[:5]) for r in rows}


def test_hygiene(spark, tmp_path):
    key = "api_key = " + "abcdef0123456789" * 2
    assert hygiene.scan_text("f", key) and not hygiene.scan_text("f", "API_KEY=", True) and not hygiene.scan_text("f", key, known_safe=frozenset({("f", "abcdef0123456789")}))
    r = spark.createDataFrame([(key,)], "t string").select(hygiene.findings(F.col("t")).alias("f")).first()
    assert [x.label for x in r.f] == ["generic api key assignment"]
    (tmp_path / "r.json").write_text('{"objects": [{"object_id": "a", "persecution_context_flags": [{"rule_id": "PC-001", "cited_fields": {}}], "documentation_quality_flags": [], "name_list_citations": []}]}')
    assert hygiene.scan_artifact(tmp_path / "r.json") == ["a: PC-001 cites no field"] and hygiene.describe_artifact(tmp_path / "r.json")["objects"] == 1
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='x y'\nC\n")
    assert load_env_file(tmp_path / ".env") == {"A": "1", "B": "x y"} and load_env_file(tmp_path / "none") == {}


def test_a_working_tree(spark, tmp_path):
    """Planted values are found in every kind of file; exemptions go by place."""
    from ledgerlens.sources.tree import read_tree, tree_files

    key = "abcdef0123456789" * 2
    planted = {
        "a.py": f"api_key = '{key}'\n", "pkg/__init__.py": f"token: {key}", ".env": f"VENDOR_KEY={key}\n", ".env.example": "VENDOR_KEY=\nVENDOR_KEY=''\n", "docs/x/deep.md": f"`Bearer {key}`",
        "safe.py": f"password = '{key}'", "clean.txt": "nothing of the kind", ".git/config": f"token = {key}", "empty": "",
    }
    for name, text in planted.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "image.bin").write_bytes(b"\xff\xfe" + f"token = {key}".encode())
    assert tree_files(str(tmp_path)) == sorted([n for n in planted if not n.startswith(".git/")] + ["image.bin"])
    patterns = hygiene.PATTERNS + hygiene.setting_patterns("VENDOR_KEY")
    files = read_tree(spark, str(tmp_path))
    found = hygiene.scan_tree(files, patterns, frozenset({".env.example"}), frozenset({("safe.py", key)}))
    places = sorted({r.place for r in found.collect()})
    assert places == [".env", "a.py", "docs/x/deep.md", "pkg/__init__.py"]
    assert all(len(r.excerpt) <= hygiene.EXCERPT for r in found.collect())
    by_text = {n for n, t in planted.items() if not n.startswith(".git/") and hygiene.scan_text(n, t, n == ".env.example", frozenset({("safe.py", key)}), patterns)}
    assert by_text == set(places)
    elsewhere = hygiene.scan_tree(files, patterns, frozenset(), frozenset({("a.py", key)}))
    assert {r.place for r in elsewhere.collect()} == {".env", ".env.example", "docs/x/deep.md", "pkg/__init__.py", "safe.py"}
    assert hygiene.scan_tree(read_tree(spark, str(tmp_path), ["gone.py", "clean.txt"]), patterns).collect() == []
    assert read_tree(spark, str(tmp_path), []).count() == 0


def test_own_statements_are_judged_once_and_as_with_all_fields(spark, monkeypatch):
    from ledgerlens.queries import QUERIES, catalog

    sf = "/root/testdata/sf0.001"
    flags = catalog.screened(spark, sf).flags.select("rule_id", "rule_statement", "methodology", "cited_fields").collect()
    want = {}
    for f in flags:
        accepted = not guard.verify(f.rule_statement, f.asDict(), PACK.get("en"), PACK)
        want[f.rule_id, accepted] = want.get((f.rule_id, accepted), 0) + 1
    assert {r[:2]: r.n for r in QUERIES["verify_flag_statements"](spark, sf).collect()} == want
    judged = spark.sparkContext.accumulator(0)

    @F.pandas_udf(guard.VERDICT)
    def counted(texts: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        judged.add(len(texts))
        return pd.DataFrame({"accepted": [True] * len(texts), "violations": [[] for _ in texts]})

    monkeypatch.setattr(guard, "verified", lambda text, context, *_: counted(text, context))
    assert sum(r.n for r in QUERIES["verify_flag_statements"](spark, sf).collect()) == len(flags)
    assert judged.value == len({f[:2] for f in flags}) < len(flags)
