import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from foliant.sources import files, sinks


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/><item id="m" href="missing.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="m"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.xhtml", "<html><body><nav>n</nav><h1>One</h1><p>first</p></body></html>")
        z.writestr("O/b.xhtml", "<html><body><p>second é</p></body></html>")
    return out.getvalue()


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello </w:t><w:t>you</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    for name, data in {"a.txt": "plain é".encode(), "b.TXT": "你好".encode("gb18030"), "c.epub": epub(), "d.docx": docx(), "e.pdf": b"%PDF", "f.epub": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].text, got["a.txt"].encoding) == ("plain é", "utf-8")
    assert got["b.TXT"].text == "你好"
    assert got["c.epub"].text == "One\n\nfirst\n\nsecond é"
    assert got["d.docx"].text == "Hello you\n\nEnd"
    assert got["e.pdf"].text is None and "unsupported" in got["e.pdf"].error and got["f.epub"].error
    with_pdf = files.read_documents(spark, str(tmp_path), {"pdf": lambda b: b.decode()}).where("format = 'pdf'").first()
    assert with_pdf.text == "%PDF"
    (tmp_path / "f.epub").unlink()
    layout = files.read_epub_layout(spark, str(tmp_path)).orderBy("text_id").collect()
    assert [(r.text_id, r.text) for r in layout] == [("a-0000", "One"), ("a-0001", "first"), ("b-0000", "second é")]


def test_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame([("剑", "jian", "x, \"y\"")], "CN string, Pinyin string, Notes string")
    sinks.write_dictionary(rows, str(tmp_path / "g"), ["CN", "Pinyin", "Notes", "Type"])
    got = files.read_dictionary(spark, str(tmp_path / "g")).first()
    assert got.asDict() == {"Original_Term_CN": "剑", "Original_Term_Pinyin": "jian", "Original_Term_EN": "", "Translated_Term_VI": "", "Translated_Term_EN": "", "Type": "", "Notes": 'x, "y"'}


def test_profile_and_progress(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.json").write_text('{"a": {"b": 2}}')
    (tmp_path / "p/y.json").write_text("no json")
    got = files.read_profile(spark, str(tmp_path / "p")).select(F.try_variant_get("profile", "$.a.b", "int").alias("b")).collect()
    assert sorted(r.b is None for r in got) == [False, True]
    assert files.normalise_keys({"A": [{"A": 1}]}, {"A": "a"}) == {"a": [{"a": 1}]}
    store = tmp_path / "s"
    store.mkdir()
    (store / "chunk_1.txt").write_text("one")
    (store / "chunk_2.txt.gz").write_bytes(gzip.compress(b"two"))
    (store / "state.json").write_text(json.dumps({"completed_chunks": {"3": "three"}}))
    assert {(r.chunk_id, r.text) for r in files.read_progress(spark, str(store)).collect()} == {(1, "one"), (2, "two"), (3, "three")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2")], "chunk_id int, source string, text string")
    sinks.write_chunks(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    sinks.append_residuals(df, str(tmp_path / "r"))
    sinks.append_residuals(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
    sinks.write_progress(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_encodings_and_confidence():
    chinese = "他说：你好，世界。这是一个测试，我们在学习中文。" * 3
    assert files.decode(chinese.encode("gb18030"))[0] == chinese
    assert files.decode("這是一個測試，我們在學習中文，他說你好。".encode("big5")) == ("這是一個測試，我們在學習中文，他說你好。", "big5")
    assert files.decode("Überfälle im Süden — “vorbei”, sagte Müller.".encode("cp1252"))[1] == "cp1252"
    assert files.decode("déjà vu à l’été".encode("cp1252"))[0] == "déjà vu à l’été"
    noise = bytes([0x81, 0x20, 0xFF, 0x41, 0x8D, 0x9D])
    assert files.detect(noise)[1] < files.CONFIDENT and files.decode(noise)[1] == "utf-8"
    assert files.decode(b"") == ("", "utf-8")


def test_epub_without_a_container(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.xhtml", "<p>two</p>")
        z.writestr("a.html", "<p>one</p>")
    assert files.parse_epub(out.getvalue()) == "one\n\ntwo"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><manifest><item id="a" href="x%20y.xhtml" media-type="application/xhtml+xml"/><item id="c" href="s.css" media-type="text/css"/></manifest><spine/></package>')
        z.writestr("O/x y.xhtml", "<p>named</p>")
    assert files.parse_epub(out.getvalue()) == "named"


def test_chunk_files_are_whole_and_packed_when_long(spark, tmp_path):
    df = spark.createDataFrame([(1, "short"), (2, "long " * 2000)], "chunk_id long, text string")
    made = {r.path.rpartition("/")[2] for r in sinks.write_files(df, f"file://{tmp_path}/c", sinks.chunk_file).collect()}
    assert made == {"chunk_1.txt", "chunk_2.txt.gz"}
    assert {r.chunk_id: len(r.text) for r in files.read_progress(spark, f"{tmp_path}/c").collect()} == {1: 5, 2: 10_000}


def test_metrics_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "kind string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("kind string, value double").parquet(f"{tmp_path}/in")
    running = sinks.export_metrics(stream, f"{tmp_path}/out", "1 second", lambda df: df.groupBy("kind").agg(F.sum("value").alias("total")), f"{tmp_path}/check")
    running.processAllAvailable()
    running.stop()
    assert {r.kind: r.total for r in spark.read.json(f"{tmp_path}/out").collect()} == {"a": 3.0, "b": 5.0}


def test_profiles_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no list of the files, whatever their number and depth; hidden names are no data."""
    for k in range(300):
        (tmp_path / f"{k % 7}/{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{k % 7}/{k % 3}/{k}.json").write_text(json.dumps({"k": k}))
    (tmp_path / "top.json").write_text('{"k": 300}')
    (tmp_path / "1/.301.json.7").write_text('{"k": 301}')
    (tmp_path / "_made").mkdir()
    (tmp_path / "_made/302.json").write_text('{"k": 302}')
    got = files.read_profile(spark, f"file://{tmp_path}/")
    assert got.inputFiles() == []
    rows = got.select("path", F.try_variant_get("profile", "$.k", "int").alias("k")).collect()
    assert sorted(r.k for r in rows) == list(range(301))
    assert {r.path for r in rows if r.k in (5, 300)} == {f"file://{tmp_path}/5/2/5.json", f"file://{tmp_path}/top.json"}
    assert [r.path for r in files.read_profile(spark, str(tmp_path / "top.json")).collect()] == [f"file:{tmp_path}/top.json"]
    assert files.read_profile(spark, f"{tmp_path}/[0-6]/*/*.json").count() == 300


def test_progress_is_listed_by_tasks(spark, tmp_path):
    df = spark.range(200).selectExpr("id chunk_id", "repeat('x', int(id) * 60) text")
    sinks.write_files(df, f"file://{tmp_path}", lambda k, t: (f"{k % 5}/{sinks.chunk_file(k, t)[0]}", sinks.chunk_file(k, t)[1])).collect()
    (tmp_path / "state.json").write_text(json.dumps({"completed_chunks": {"200": "three"}}))
    (tmp_path / "0/.chunk_0.txt.9").write_text("half of a file")
    got = files.read_progress(spark, str(tmp_path))
    assert got.inputFiles() == []
    assert sorted((r.chunk_id, len(r.text)) for r in got.collect()) == [*((k, 60 * k) for k in range(200)), (200, 5)]


def test_documents_are_listed_by_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"{k % 6}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 6}/{k}.txt").write_bytes(f"text {k} é".encode(("utf-8", "utf-8-sig", "utf-16")[k % 3]))
    (tmp_path / "1/b.epub").write_bytes(epub())
    got = files.read_documents(spark, str(tmp_path))
    assert got.inputFiles() == []
    rows = got.collect()
    assert {(r.text, r.encoding) for r in rows if r.format == "txt"} == {(f"text {k} é", ("utf-8", "utf-8-sig", "utf-16")[k % 3]) for k in range(150)}
    layout = files.read_epub_layout(spark, str(tmp_path))
    assert layout.inputFiles() == [] and len(rows) == 151 and layout.count() == 3


def test_docx_files_are_listed_by_tasks(spark, tmp_path):
    df = spark.range(120).selectExpr("id", "concat('one ', id, '\n\n two ') text")
    sinks.write_files(df, f"file://{tmp_path}", lambda k, t: sinks.docx_file(f"{k % 4}/{k}", t)).collect()
    got = files.read_documents(spark, str(tmp_path))
    assert got.inputFiles() == []
    assert {(r.text, r.error) for r in got.collect()} == {(f"one {k}\n\ntwo", None) for k in range(120)}
