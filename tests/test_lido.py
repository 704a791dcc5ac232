import pytest

from ledgerlens.numbering import numbered
from ledgerlens.sources import dispatch, lido
from ledgerlens.plans.screening import screen
from ledgerlens.sources.lists import load_config
from ledgerlens.sources.records import InputError

ACTOR = "<eventActor><actorInRole><actor><nameActorSet><appellationValue pref='alternate'>{1}</appellationValue><appellationValue pref='preferred'>{0}</appellationValue></nameActorSet></actor><roleActor><term>{2}</term></roleActor></actorInRole></eventActor>"


def event(actors=ACTOR.format("Kühn, A.", "A. Kühn", "Käufer"), date="<earliestDate>1938-01-01</earliestDate><latestDate>1938-12-31</latestDate>", kind="<conceptID>http://terminology.lido-schema.org/lido01016</conceptID><term>Purchase</term>", more="", display=""):
    return f"<eventSet><event><eventType>{kind}</eventType>{actors}<eventDate>{display}<date>{date}</date></eventDate><eventPlace><place><namePlaceSet><appellationValue>Munich</appellationValue></namePlaceSet><partOfPlace><namePlaceSet><appellationValue>Germany</appellationValue></namePlaceSet></partOfPlace></place></eventPlace>{more}</event></eventSet>"


def record(*events, ident="<lidoRecID>L1</lidoRecID>"):
    body = f"{ident}<descriptiveMetadata><objectClassificationWrap><objectWorkTypeWrap><objectWorkType><term>silver</term></objectWorkType></objectWorkTypeWrap></objectClassificationWrap><objectIdentificationWrap><titleWrap><titleSet><appellationValue>Cup</appellationValue></titleSet></titleWrap></objectIdentificationWrap><eventWrap>{''.join(events)}</eventWrap></descriptiveMetadata>"
    return f"<lido>{body}</lido>"


def load(spark, tmp_path, *records, wrap=True):
    text = "".join(records)
    (tmp_path / "in.xml").write_text(f'<lidoWrap xmlns="http://www.lido-schema.org">{text}</lidoWrap>' if wrap else text, encoding="utf-8")
    return dispatch.load_input(spark, str(tmp_path / "in.xml"))


def test_an_event_becomes_a_record(spark, tmp_path):
    records, notes, fmt = load(spark, tmp_path, record(event()))
    r = records.first()
    assert (fmt, notes) == ("lido", [])
    assert (r.object_id, r.object_title, r.object_class, r.owner_name, r.owner_name_variants) == ("L1", "Cup", "silver", "Kühn, A.", ["A. Kühn"])
    assert (r.location, r.country, r.transaction_state, r.span.precision, r.span.raw_from, r.source_ref) == ("Munich, Germany", "Germany", "purchase", "year", "1938", "in.xml:L1 event 1")


def test_notes(spark, tmp_path):
    odd = event(kind="<conceptID>x/lido01011</conceptID><term>Looting</term>", date="", display="<displayDate>before the war</displayDate>", more="<eventPlace><place/></eventPlace>")
    records, notes, _ = load(spark, tmp_path, record(odd))
    r = records.first()
    assert r.transaction_state is None and r.span is None
    assert sorted(n["kind"] for n in notes) == ["display_date_not_parsed", "event_type_not_mapped", "multiple_event_places"]


def test_extensions_win(spark, tmp_path):
    text = "<eventDescriptionSet><descriptiveNoteValue>Prose.\nRECORD_EXT:owner_name=Other\nRECORD_EXT:location=\nRECORD_EXT:export_licence_present=no</descriptiveNoteValue><sourceDescriptiveNote>File 7</sourceDescriptiveNote></eventDescriptionSet>"
    r = load(spark, tmp_path, record(event(actors="", more=text)))[0].first()
    assert (r.owner_name, r.location, r.export_licence_present, r.notes, r.source_citation) == ("Other", None, False, "Prose.", "File 7")


def test_actors(spark, tmp_path):
    both = ACTOR.format("New", "N", "Neuer Eigentümer") + ACTOR.format("Old", "O", "Seller")
    assert load(spark, tmp_path, record(event(actors=both)))[0].first().owner_name == "New"


@pytest.mark.parametrize(
    "records,part",
    [
        ([record(event(), ident="")], "object_id"),
        ([record(event(actors=""))], "owner_name"),
        ([record(event(actors=ACTOR.format("Old", "O", "Verkäufer")))], "parted with the object"),
        ([record(event(actors=ACTOR.format("A", "a", "Buyer") + ACTOR.format("B", "b", "Owner")))], "receiving party"),
        ([record(event(date="<earliestDate>1938-1-1</earliestDate>"))], "not a date"),
        ([record(event(more="<eventDescriptionSet><descriptiveNoteValue>RECORD_EXT:price=1</descriptiveNoteValue></eventDescriptionSet>"))], "extension"),
        ([record()], "no events"),
        (["<other/>"], "no lido elements"),
        (["<lido>"], "not well-formed"),
        ([record(event(date="<earliestDate>1940-01-01</earliestDate><latestDate>1938-05-02</latestDate>"), event(actors=""))], "reversed"),
    ],
)
def test_rejections(spark, tmp_path, records, part):
    with pytest.raises(InputError) as e:
        load(spark, tmp_path, *records)
    assert part in str(e.value)


@pytest.mark.parametrize("span,want", [(("1938-01-01", "1938-12-31"), ("1938", "1938")), (("1938-02-01", "1938-02-28"), ("1938-02", "1938-02")), (("1938-02-03", "1938-05-04"), ("1938-02-03", "1938-05-04")), (("1936-01-01", "1938-12-31"), ("1936", "1938")), (("1938", None), ("1938", None))])
def test_coarsen(span, want):
    assert lido.coarsen(*span) == want


def test_single_record_and_recordid(spark, tmp_path):
    one = record(event(), ident="").replace("</lido>", "<administrativeMetadata><recordWrap><recordID>R9</recordID></recordWrap></administrativeMetadata></lido>")
    assert load(spark, tmp_path, one, wrap=False)[0].first().object_id == "R9"


def test_an_object_in_two_files(spark, tmp_path):
    """Records of one object keep apart, in the order of files."""
    forced = event(kind="<conceptID>x</conceptID><term>Sale</term>", more="<eventDescriptionSet><descriptiveNoteValue>RECORD_EXT:transaction_state=zwangsverkauf\nRECORD_EXT:location=Oslo, Norway</descriptiveNoteValue></eventDescriptionSet>")
    for name, part in (("a.xml", record(event())), ("b.xml", record(forced, event()))):
        (tmp_path / name).write_text(f'<lidoWrap xmlns="http://www.lido-schema.org">{part}</lidoWrap>', encoding="utf-8")
    records, _ = lido.load_records(spark, str(tmp_path))
    rows = records.orderBy("source_order").collect()
    assert [r.source_ref for r in rows] == ["a.xml:L1 event 1", "b.xml:L1 event 1", "b.xml:L1 event 2"] and len({r.source_order for r in rows}) == 3
    flags = screen(records, load_config()).flags.where("rule_id = 'PC-003'").collect()
    assert {f.source_ref for f in flags} >= {"a.xml:L1 event 1", "b.xml:L1 event 2", "b.xml:L1 event 1"}


def prefixed(text):
    return text.replace("</", "</lido:").replace("<", "<lido:").replace("<lido:/lido:", "</lido:").replace("<appellationValue pref", "<appellationValue lido:pref")


def as_read(frame):
    return sorted((tuple(r) for r in frame.select(*lido.COLUMNS).collect()), key=str)


FILES = {
    "plain.xml": f"<lidoWrap xmlns='http://www.lido-schema.org'>{''.join(record(event(), event(actors=''), ident=f'<lidoRecID>P{k}</lidoRecID>') for k in range(14))}</lidoWrap>",
    "a+b c.xml": f"<?xml version='1.0' encoding='UTF-8'?>\n<!-- c -->\n<lido:lidoWrap xmlns:lido='x'>\n{' '.join(prefixed(record(event(), ident='' if k % 7 == 3 else f'<lidoRecID>Q{k}</lidoRecID>')) for k in range(12))}\n</lido:lidoWrap>\n",
    "attributes.xml": f"<lidoWrap>{''.join(record(event(), event()).replace('<lido>', f'<lido n=\"{k}\">') for k in range(6))}<!-- </lido> gone --></lidoWrap>",
    "mixed.xml": f"<lidoWrap>{record(event()).replace('<lido>', '<lido n=\"1\">')}<!-- between -->{record(event())}  {record(event()).replace('<lido>', '<lido >')}</lidoWrap>",
    "single.xml": record(event()),
    "none.xml": "<lidoWrap><other/></lidoWrap>",
    "no_events.xml": f"<lidoWrap>{record()}{record()}</lidoWrap>",
    "cut.xml": f"<lidoWrap>{record(event())}{record(event())}",
    "two.xml": record(event()) * 2,
    "open.xml": f"<lidoWrap>{record(event())}<lido><lidoRecID>x</lido></lidoWrap>",
    "cdata.xml": f"<lidoWrap>{record(event(more='<eventDescriptionSet><descriptiveNoteValue><![CDATA[a </lido> b]]></descriptiveNoteValue></eventDescriptionSet>'))}</lidoWrap>",
    "words.xml": f"<lidoWrap>{record(event(more='<eventDescriptionSet><descriptiveNoteValue>see lido> there</descriptiveNoteValue></eventDescriptionSet>'))}</lidoWrap>",
    "nested.xml": f"<lidoWrap><group>{record(event())}</group>{record(event())}</lidoWrap>",
    "entity.xml": f"<!DOCTYPE lidoWrap [<!ENTITY k 'K&#252;hn'>]><lidoWrap>{record(event(actors=ACTOR.format('&k;', 'b', 'Käufer')))}</lidoWrap>",
    "unbound.xml": f"<lidoWrap>{record(event(more='<gml:x>1</gml:x>'))}</lidoWrap>",
    "bound.xml": f"<lidoWrap xmlns:gml='g'>{record(event(more='<gml:x>1</gml:x>'))}{record(event(more='<z:x xmlns:z=\"q\">1</z:x>'))}</lidoWrap>",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lido")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "latin.xml").write_text(f"<?xml version='1.0' encoding='ISO-8859-1'?><lidoWrap>{record(event())}</lidoWrap>", encoding="latin-1")
    (folder / "wide.xml").write_text(f"<?xml version='1.0' encoding='UTF-16'?><lidoWrap>{record(event())}</lidoWrap>", encoding="utf-16")
    (folder / "broken.xml").write_bytes(f"<lidoWrap>{record(event())}</lidoWrap>".encode("latin-1"))
    return folder


@pytest.mark.parametrize("size", ["1500", "128m"])
def test_splits_read_as_whole_files(spark, folder, size):
    """Rows, problems and notes in their order, wherever a file is split."""
    types = lido.load_event_types()
    whole = as_read(lido.read_whole(spark, [str(folder)], types))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert spark.read.option("lineSep", lido.MARK).text(str(folder / "plain.xml")).rdd.getNumPartitions() > (8 if size == "1500" else 0)
        assert as_read(lido.read_events(spark, str(folder), types)) == whole
        pieces = lido.read_pieces(spark, str(folder), types)
        odd = {r.path.rpartition("/")[2] for r in lido.irregular_files(pieces).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not odd & {"plain.xml", "a+b c.xml", "mixed.xml", "single.xml", "no_events.xml", "bound.xml"}
    assert odd >= {"none.xml", "cut.xml", "two.xml", "open.xml", "cdata.xml", "nested.xml", "entity.xml", "unbound.xml", "latin.xml", "wide.xml", "broken.xml"}


def test_files_are_numbered_without_one_task_for_all(spark):
    paths = [f"f{k:04}" for k in range(2_000)]
    events = spark.createDataFrame([(p, k) for p in reversed(paths) for k in (1, 0)], "path string, source_order long").repartition(7)
    out = lido.in_file_order(events)
    assert [r.source_order for r in out.orderBy("source_order").collect()] == [f * lido.FILE_EVENTS + k for f in range(2_000) for k in (0, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert numbered(spark.createDataFrame([], "path string"), "path").collect() == []


def test_the_query_keeps_notes_off_the_driver_and_splits_its_files(spark, monkeypatch):
    """Text after a line break may have a colon without being a prefix."""
    from ledgerlens.queries import QUERIES, catalog

    sf = "/root/testdata/sf0.001"

    def collected(*_):
        raise AssertionError("all notes go to the driver")

    monkeypatch.setattr(lido, "listed_notes", collected)
    assert QUERIES["lido_read"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    pieces = lido.read_pieces(spark, catalog.lido_files(spark, sf), lido.load_event_types())
    assert pieces.where("detail like '%is not read as a date%'").count() > 0 and lido.irregular_files(pieces).collect() == []


def test_prefixes_are_those_of_tags():
    piece = "<a:b c:d='e f:g'>h i:j\nRECORD_EXT:k=l</a:b ><m/></"
    assert lido.record_of(piece)[2] == {"a", "c"}
