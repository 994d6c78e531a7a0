"""Archives, written tables, page data and streams that fail half-way."""

import hashlib
import json
import os
import zipfile
from io import StringIO

import pytest
from pyspark.sql import functions as F

from quern.operators import ingest, telemetry, web
from quern.sources import archives
from quern.sources.tables import AppendTable, VersionedTable
from quern.streaming.ingest import document_stream, ingest_stream
from quern.streaming.telemetry import TelemetryLog, log_stream, totals_stream

NODES = {
    "n2": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["late", {"image": 1}, "reply"]}, "create_time": 2.5}},
    "n1": {"message": {"author": {"role": "user"}, "content": {"parts": ["ask"]}, "create_time": 1}},
    "n0": {"message": {"author": {"role": "system"}, "content": "no"}}, "n3": {"message": None}, "n4": {"message": {"author": {"role": "user"}, "content": {"parts": [""]}}},
}


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_elements(piece):
    values = [1, "a]b\\\"", {"x": [1, {"y": "é"}]}, [], None, -2.5, 123456]
    assert list(archives.elements(StringIO(" \n" + json.dumps(values, indent=1)), piece)) == values
    assert list(archives.elements(StringIO('﻿{"a": 1}'), piece)) == [{"a": 1}] and list(archives.elements(StringIO(""), piece)) == []
    with pytest.raises(ValueError):
        list(archives.elements(StringIO('[1, {"a"'), piece))


def test_conversation_archives(spark, tmp_path):
    listed = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": ["a", {"no": 1}, "b"]}, {"role": "user", "content": None}]}
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.json", json.dumps([listed, {"mapping": NODES}, "odd", {}]))
        z.writestr("sub/two.JSON", json.dumps({"mapping": NODES, "messages": []}))
        z.writestr("half.json", json.dumps([listed])[:-5])
        z.writestr("notes.txt", "no")
    (tmp_path / "bad.zip").write_text("no archive")
    (tmp_path / "plain.json").write_text(json.dumps([listed]))
    rows = archives.exported(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 5
    got = {(os.path.basename(r.archive), r.member, r.place): (r.turns and [tuple(t) for t in r.turns], r.error) for r in rows.collect()}
    assert got["x.zip", "one.json", 0] == ([("user", "q"), ("assistant", "a\nb"), ("user", "")], None)
    assert got["x.zip", "one.json", 1][0] == got["x.zip", "sub/two.JSON", 0][0] == [("user", "ask"), ("assistant", "late\nreply")]
    assert got["x.zip", "one.json", 2] == ([], None) == got["x.zip", "one.json", 3]
    assert "ValueError" in got["x.zip", "half.json", None][1] or "JSONDecodeError" in got["x.zip", "half.json", None][1]
    assert "not a ZIP" in got["bad.zip", None, None][1] and got["plain.json", None, 0][1] is None
    table = archives.turn_table(rows)
    assert table.count() == 3 + 2 + 2 + 3 and table.select("conv_id").distinct().count() == 4
    (tmp_path / "none").mkdir()
    assert archives.exported(spark, f"file://{tmp_path}/none").count() == 0


def test_tables(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"))
    first = table.replace(spark.range(3))
    table.replace(spark.range(5))
    assert table.read().count() == 5 and spark.read.parquet(f"{tmp_path}/v/{first}").count() == 3
    late = VersionedTable(spark, str(tmp_path / "v"))
    late._pointer = lambda: 1  # a writer that read the pointer before the second version
    with pytest.raises(RuntimeError):
        late.replace(spark.range(9))
    assert table.read().count() == 5
    log = AppendTable(spark, str(tmp_path / "a"))
    assert log.read() is None
    log.add(spark.range(2), "one")
    log.add(spark.range(7), "one")
    log.add(spark.range(3))
    os.makedirs(tmp_path / "a" / "half")
    assert log.read().count() == 5


def test_page_data():
    data = {"page": "/p", "props": {"pageProps": {"metadata": {"title": "T  t", "description": "about"}, "pageHeading": {"title": "T  t"}, "pageContent": [{"id": "no no", "b": ["one  two", "/no", "#no", "ab"]}, {"url": "/a"}], "mdxSource": {"compiledSource": 'x`code \\`here\\`\\nand \\u00e9` "href": "/deep" `no`'}, "href": "#top"}}}
    html = f'<p>short</p><script id="__NEXT_DATA__" type="x">{json.dumps(data).replace("&", "&amp;")}</script>'
    title, text, links = web.data_page(html, "https://H.example/base/")
    assert (title, text) == ("T t", "# T t\nabout\none two\ncode `here` and é") and links == ["https://H.example/a", "https://H.example/base/#top", "https://H.example/deep"]
    assert web.best_page(html, "https://h.example/")[1] == text
    deep = value = {}
    for _ in range(300):
        value["k"] = [{}]
        value = value["k"][0]
    value["k"] = "bottom text"
    assert list(web.walk(deep, lambda *_: True)) == [("k", "bottom text")]
    for odd in ("", None, "<script id='__NEXT_DATA__'>{broken</script>", "<script id='__NEXT_DATA__'>[1]</script>"):
        assert web.data_page(odd, "u") is None
    assert web.data_page("<script id='__NEXT_DATA__'>{\"props\": 3}</script>", "u") == ("u", "", [])


def test_pages_of_one_address(spark):
    rows = spark.createDataFrame([(3, "http://h/a#x", "c"), (1, "http://H/a", "a"), (2, "http://h/b", "b")], "page_id long, url string, text string")
    assert {r["at"]: r.text for r in web.by_address(rows).collect()} == {"http://h/a": "a", "http://h/b": "b"}


def test_stream_that_fails_half_way(spark, tmp_path):
    schema, flag = "source string, text string", tmp_path / "fail"
    text = lambda i: f"A chunk that is long enough to be kept, number {i}."
    write = lambda lo, hi: spark.createDataFrame([(f"s{i}", text(i)) for i in range(lo, hi)], schema).repartition(4).write.mode("append").parquet(str(tmp_path / "in"))

    def run(at):
        def maybe(batches):
            for b in batches:
                if os.path.exists(flag) and any("number 25." in t for t in b.column(1).to_pylist()):
                    raise RuntimeError("lost")
                yield b

        q = ingest_stream(document_stream(spark, str(tmp_path / "in"), schema, 2).mapInArrow(maybe, schema), str(tmp_path / "out"), str(tmp_path / at))
        q.awaitTermination(120)
        return q

    write(0, 20)
    run("check")
    write(10, 40)
    flag.write_text("")
    with pytest.raises(Exception, match="lost"):
        run("check")
    seen = {r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {text(i) for i in range(20)} <= seen and len(seen) == spark.read.parquet(str(tmp_path / "out")).count() and text(25) not in seen
    flag.unlink()
    q = run("check")
    got = [r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(text(i) for i in range(40))
    # Known contents are state: the plan of a batch doesn't read what has been ingested.
    plan = q._jsq.explainInternal(False)
    assert "StreamingDeduplicate" in plan and str(tmp_path / "out") not in plan


def test_known_chunks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "A chunk that is long enough to be kept."), ("b", "Another chunk that is long enough.")], "source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("A chunk that is long enough to be kept.",)], "c string").select(F.md5(F.lower("c")).alias("hash"))
    ingest_stream(document_stream(spark, str(tmp_path / "in"), "source string, text string"), str(tmp_path / "out"), str(tmp_path / "c"), known=known).awaitTermination(120)
    assert [r.source for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b"]


@pytest.mark.parametrize("files", [1, 3, 9])
def test_telemetry_streams(spark, tmp_path, files):
    """The totals and the last records are the same however the stream is cut into batches."""
    rows = [(i % 13, i, i * 3, i % 7, i % 2 == 0) for i in range(90)]
    records = spark.createDataFrame(rows, "ts long, event_id long, elapsed_ms long, chars long, used boolean")
    records.repartition(9).write.parquet(str(tmp_path / "in"))
    stream = lambda: document_stream(spark, str(tmp_path / "in"), "ts long, event_id long, elapsed_ms long, chars long, used boolean", files)
    totals_stream(stream(), str(tmp_path / "totals"), str(tmp_path / "c1")).awaitTermination(120)
    assert VersionedTable(spark, str(tmp_path / "totals")).read().first() == telemetry.summary(records).first()
    log_stream(stream(), str(tmp_path / "log"), str(tmp_path / "c2"), 10).awaitTermination(120)
    log = TelemetryLog(spark, str(tmp_path / "log"), 10)
    assert [tuple(r) for r in log.read().collect()] == [tuple(r) for r in telemetry.tail(records, 10).collect()]
    log.add(records.limit(90), 0)
    log.add(records.limit(90), 0)
    assert log.table.read().count() == 10 and log.read(3).count() == 3


def test_counts_of_an_ingest_need_no_texts(spark):
    """Counts are made from written hashes: their plan chunks nothing anew. Equal chunks are inserted for the smallest source."""
    a, b = "The first of two texts, long enough.", "The second text, which is long enough too."
    docs = spark.createDataFrame([("b", a), ("a", a), ("a", a.upper()), ("b", b), ("a", b), ("c", "short"), ("d", None)], "source string, text string")
    known = spark.createDataFrame([(hashlib.md5(b.lower().encode()).hexdigest(),)], "hash string")
    for stored, new in ((None, 2), (known, 1)):
        fresh, counts = ingest.ingested(docs, stored)
        assert counts.inputFiles() and all("chunk-hashes" in f for f in counts.inputFiles())
        got = {r.source: (r.chunks, r.valid, r.invalid, r.inserted, r.duplicates) for r in counts.collect()}
        assert got == {"a": (3, 3, 0, new, 3 - new), "b": (2, 2, 0, 0, 2), "c": (1, 0, 1, 0, 0)} and fresh.count() == new
