"""Readers, layout shapes, role parsing and the streaming wrapper on small inputs."""

import datetime as dt
import json

from tallyforge.operators import layout as L
from tallyforge.operators import roles as R
from tallyforge.operators.packed import split_packed
from tallyforge.sources import readers
from tallyforge.streaming import ingest

TEXT = "Name\n\nEXPERIENCE\nData Engineer, Oakford, Corfield Labs    Jan 2010 to Mar 2012\nRemote\n• built it\n  twice\n• ran it\n\nAnalyst at Balford    13/2008 – present\n- one\n\nUndated thing\n* two\n\nSKILLS\nGo\n"


def test_roles(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (3, "no section")], "k long, t string")
    got = [(r.role_ix, r.title, r.company, r.subtitle, r.start_date, r.end_date, r.is_current, list(r.bullets), r.line_index) for r in R.parsed_roles(df, "k", "t").orderBy("role_ix").collect()]
    assert got == [
        (0, "Data Engineer", "Oakford, Corfield Labs", "Remote", dt.date(2010, 1, 1), dt.date(2012, 3, 1), False, ["built it twice", "ran it"], 3),
        (1, "Analyst", "Balford", "", dt.date(2008, 12, 1), None, True, ["one"], 9),
        (2, "Undated thing", "", "", None, None, False, ["two"], 12),
    ]
    assert [R.parse_date(x) for x in ("Sept. 2011", "0/2011", "2011", "someday")] == [dt.date(2011, 9, 1), dt.date(2011, 1, 1), dt.date(2011, 1, 1), None]


def test_hidden_spans_and_colours(spark):
    rows = [(1, 0, i, c, 10.0, [1.0] if 2 <= i < 8 else [0.0]) for i, c in enumerate("ab secret cd")] + [(1, 0, 99, "x", 1.0, None)]
    chars = spark.createDataFrame(rows, "doc_id long, page int, char_ix int, text string, size double, color array<double>")
    assert [(r.first, r.span) for r in L.hidden_spans(chars).collect()] == [(2, "secre")]


def test_gutter_edges_fold_fonts(spark):
    words = [(1, 0, f"w{i}", x, x + 20.0, 50.0 + 10 * (i // 2), 58.0 + 10 * (i // 2)) for i in range(60) for x in ([60.0] if i % 2 else [360.0])] + [(1, 0, "foot", 60.0, 80.0, 780.0, 790.0)]
    w = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double")
    p = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    assert [(r.doc_id, r.left_x) for r in L.gutters(w, p).collect()] == [(1, 70.0)]
    assert [r.text for r in L.edge_words(w, p).collect()] == ["foot"]
    assert L.fold_text(w, p).first().fold.startswith("w1 w0 w3 w2")
    fonts = spark.createDataFrame([(1, "ABCDEF+Arial-Bold"), (1, "Arial"), (1, "Times-Roman")], "doc_id long, font_name string")
    assert L.font_families(fonts).first().families == 2


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("# source: here\n# level: Senior\nBODY Text\nmore")
    row = readers.labelled_texts(spark, str(tmp_path / "t")).first()
    assert (row.name, row.labels, row.body) == ("one", {"source": "here", "level": "Senior"}, "body text\nmore")
    (tmp_path / "j").mkdir()
    for n in (1, 2):
        (tmp_path / "j" / f"p{n}.json").write_text(json.dumps({"title": "Data Engineer", "company": "Acme!", "raw_text": "x"}))
    named = readers.with_file_names(readers.json_postings(spark, str(tmp_path / "j")), "name")
    assert sorted(r.file_name for r in named.collect()) == ["acme-data-engineer", "acme-data-engineer-2"]
    (tmp_path / "u").mkdir()
    for name, data in (("a.pdf", b"%PDF-1.4"), ("b.pdf", b""), ("c.pdf", b"hello")):
        (tmp_path / "u" / name).write_bytes(data)
    assert {r.name: r.reason for r in readers.checked_uploads(spark, str(tmp_path / "u")).collect()} == {"a": None, "b": "empty", "c": "not a document"}


def test_runs_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, "c")], "k long, t string")
    for run in ("r1", "r2"):
        readers.save_run(df, str(tmp_path / "runs"), run)
    assert readers.load_run(spark, str(tmp_path / "runs"), "r1").count() == 2
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.arriving(spark, str(tmp_path / "in"), "k long, t string")
    ingest.apply_per_batch(stream, lambda b: split_packed(b, "k", "t"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_windowed_counts(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    path_schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = spark.readStream.schema(path_schema).option("pathGlobFilter", "events.parquet").parquet(small)
    q = ingest.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windowed").first()[0] == events.count()
