"""CSV in splits against Spark's own reader of whole files."""

import csv as python_csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.model import FIELDS
from ledgerlens.sources import csv
from ledgerlens.sources.records import InputError

COLUMNS = ["object_id", "owner_name", "date_precision", "notes"]


def written(rows, end="\n", quoting=python_csv.QUOTE_MINIMAL):
    out = io.StringIO()
    python_csv.writer(out, lineterminator=end, quoting=quoting).writerows([COLUMNS, *rows])
    return out.getvalue()


def drawn(seed, n):
    rnd = random.Random(seed)
    part = lambda: "".join(rnd.choice(["a", " ", ",", '"', '""', "\n", "é", "x" * 30, "\n\n", '",\n"']) for _ in range(rnd.randint(0, 12)))
    return [(f"O{k}", part() or "n", rnd.choice(["year", ""]), part()) for k in range(n)]


FILES = {
    "quoted.csv": written(drawn(1, 60)),
    "b+c d.csv": written(drawn(2, 60), "\r\n"),
    "every.csv": written(drawn(3, 30), quoting=python_csv.QUOTE_ALL),
    "plain.csv": ",".join(COLUMNS) + "\n" + "".join(f"O{k},n,year,\n" for k in range(200)),
    "loose.csv": ",".join(COLUMNS) + '\nO1,5" disk,year,a"b\n\nO2,"a"b,year,"x"\n\n,,,\nO3, "a,year,"""q"""\n"O4",x,y\nO5,n,year,z,more,"and\nmore"\nO6,n,year,"end"',
    "long.csv": written([("O1", "n", "year", "line\n" * 3000), ("O2", 'q"' * 500, "year", "\n"), ("O3", "n", "", "")]),
    "header.csv": ",".join(COLUMNS),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8", newline="")
    (folder / "mac.csv").write_text(written(drawn(4, 9), "\r"), encoding="utf-8", newline="")
    return folder


def as_rows(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


@pytest.mark.parametrize("size", ["1777", "128m"])
def test_splits_give_what_whole_files_give(spark, folder, size):
    names = ("path", "row", *COLUMNS)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    whole = as_rows(csv.read_whole(spark, "", [str(folder / n) for n in FILES]), *names)
    spark.conf.set(key, size)
    try:
        assert spark.read.text(str(folder / "long.csv")).rdd.getNumPartitions() > (5 if size == "1777" else 0)
        rows, odd = csv.read_rows(spark, str(folder))
        assert [p.rpartition("/")[2] for p in odd] == ["mac.csv"]
        cells = F.from_csv("text", F.lit(", ".join(f"{c} string" for c in COLUMNS)), csv.OPTIONS)
        assert as_rows(rows.where(~F.col("path").isin(odd)).where("row > 0").select("path", "row", cells.alias("c")).select("path", "row", "c.*"), *names) == whole
        raw = csv.read_raw(spark, str(folder))
        refs = [r.source_ref for r in raw.orderBy("source_order").collect()]
    finally:
        spark.conf.set(key, before)
    assert raw.count() == sum(any((c or "").strip() for c in r[2:]) for r in whole) + 9
    files = [r.rpartition(":row ")[0] for r in refs]
    assert files == sorted(files) and [int(r.rpartition(" ")[2]) for r in refs if r.startswith("plain")] == list(range(2, 202))
    assert "b+c d.csv" in files and "mac.csv" in files


@pytest.mark.parametrize("line,out,inside", [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""b', True, False), ('"a","b', True, True), ('a",b', False, False), ('""', False, True), ('"""', True, False), ("", False, True), ('x","y', True, True)])
def test_line_states(line, out, inside):
    assert (csv.ends_inside(line, False), csv.ends_inside(line, True)) == (out, inside)


def test_headers(spark, tmp_path):
    assert csv.header_names('a," b ",,a,"c\nd"') == ["a0", "b", "_c2", "a3", "c\nd"]
    (tmp_path / "a.csv").write_text("object_id,owner_name,date_precision\n1,2,year\n")
    (tmp_path / "b.csv").write_text("owner_name,object_id,date_precision\n1,2,year\n")
    with pytest.raises(InputError, match="its header is not that of"):
        csv.read_raw(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "empty.csv").write_text("")
    with pytest.raises(InputError, match="is missing"):
        csv.read_raw(spark, str(tmp_path / "c"))
    with pytest.raises(InputError, match="can't be read"):
        csv.read_raw(spark, str(tmp_path / "nothing.csv"))
    assert set(COLUMNS) < set(FIELDS)
