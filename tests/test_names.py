"""The inverted index of name lists against all pairs."""

import random

import pytest

from ledgerlens.functions.names import ENTRIES, Entry, _common, candidates, entry_keys, match_name, match_names, name_keys
from ledgerlens.model import GENERIC_TOKENS

WORDS = ["Fischer", "Müller", "Hans", "Hanna", "H.", "H", "Galerie", "Kunsthaus", "von", "de", "Lucerne", "E", "R", "Err", "E.R.R.", "Wolff-Metternich", "Sammlung", "Mulle", "Lempertz", "AG", "x", "???", ","]


def made(rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5))).replace(" ,", ",")


@pytest.fixture(scope="module")
def drawn():
    rnd = random.Random(11)
    entries = tuple(Entry.of(k, made(rnd), tuple(made(rnd) for _ in range(rnd.randint(0, 2))), rnd.choice(["person", "organisation"])) for k in range(60))
    names = sorted({made(rnd) for _ in range(500)} | {"", " ", "Fischer", "Fischer, H."})
    return names, entries


@pytest.fixture(scope="module")
def every(drawn):
    names, entries = drawn
    return {(n, e.index, m.basis, m.kind, m.confirmed, m.note) for n in names if n for e in entries if (m := match_name(n, e))}


@pytest.mark.parametrize("common", [{}, {"fischer": 9, "galerie": 5, "von": 3, "h": 2}, dict.fromkeys(sorted(GENERIC_TOKENS), 7)])
def test_no_match_without_a_common_key(drawn, every, common):
    names, entries = drawn
    for n in names:
        asked = name_keys(n, common) if n else set()
        for e in entries:
            if n and match_name(n, e):
                assert asked & entry_keys(e, common), (n, e.name)


def test_index_and_join_as_all_pairs(spark, drawn, every):
    names, entries = drawn
    frame = spark.createDataFrame([(n,) for n in names * 2 + [None]], "name string").repartition(3)
    listed = match_names(frame, entries)
    joined = match_names(frame, entries, index_entries=0)
    for found in (listed, joined):
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == every
    assert len(every) > 500


def test_long_list_is_not_met_whole(spark):
    """Frequent words of a long list lead to few pairs."""
    letters = str.maketrans("0123456789", "bcdfghjklm")
    spelt = lambda k: str(k).translate(letters)
    entries = [(k, f"Galerie Zor{spelt(k)} am Markt", ["Galerie am Markt Nord"] if k % 1000 == 0 else [], "organisation") for k in range(20_000)]
    names = [(f"Galerie Zor{spelt(k)} am Markt Nord",) for k in range(0, 40_000, 20)] + [(f"Galerie Unbekannt Nr {spelt(k)} Markt",) for k in range(2_000)]
    entries, names = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(names, "name string")
    pairs = candidates(names, entries).count()
    # each of the first kind meets its own entry and the 20 with a rarer word; all pairs are 80 millions
    assert pairs < 2_000 * 25
    hits = {(r["name"], r["index"]) for r in match_names(names, entries).collect()}
    own = {(f"Galerie Zor{spelt(k)} am Markt Nord", k) for k in range(0, 20_000, 20)}
    assert own <= hits and len(hits) <= pairs


def test_no_names_and_no_entries(spark):
    none = spark.createDataFrame([], "name string")
    entries = (Entry.of(0, "Fischer, Hans", (), "person"),)
    assert match_names(none, entries).collect() == [] and match_names(none, entries, 0).collect() == []
    some = spark.createDataFrame([("Fischer",)], "name string")
    assert match_names(some, ()).collect() == [] and match_names(some, spark.createDataFrame([], ENTRIES)).collect() == []


def test_common_tokens():
    assert _common([("a", 3), ("b", 1)]) == {"a": 3}
