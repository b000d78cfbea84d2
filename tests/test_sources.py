import json
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memloom.sources import formats as fm
from memloom.streaming import usage


def test_session_blocks_and_fact_tables(spark):
    block = json.dumps({"sessionId": "s1", "messages": [{"role": "user", "content": "a | b"}, {"role": "assistant", "content": "é"}]})
    text = f"---\nbatch_id: b7\n---\n\n```context-session\n{block}\n```\n\n```context-session\nnot json\n```"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id bigint, text string")
    assert [tuple(r) for r in fm.session_messages(df, "doc_id", "text").orderBy("position").collect()] == [(1, "b7", "s1", 0, "user", "a | b"), (1, "b7", "s1", 1, "assistant", "é")]
    tables = spark.createDataFrame([(1, "| factText | factType | confidence |\n|---|---|---|\n| It rains. | event | high |\r\n| Two |x|\nno row"), (2, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in fm.fact_rows(tables, "doc_id", "text").orderBy("line").collect()] == [(1, 2, "It rains.", "event", "high"), (1, 3, "Two", "x", None)]


def test_inbox_reads_word_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("é")
    (tmp_path / "d.exe").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in fm.inbox(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "Hello\ntwo".replace("Hello", "Hello you"), "b.docx": None, "c.txt": "é"}


def test_results_are_written_once_and_without_secrets(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1, "token=abc http://u:p@h/x"), ("c1", 1, "token=abc http://u:p@h/x"), ("c2", 2, None)], "id string, at int, note string")
    fm.write_results(df, str(tmp_path / "out"), "id", ["note"])
    got = fm.read_results(spark, str(tmp_path / "out"), "id string, at int, note string", "id", "at").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("c1", 1, "token=[redacted] http://[redacted]@h/x"), ("c2", 2, None)]


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 4, "x"), (2, 5, "y"), (3, 1, "z")], "id int, at int, v string")
    assert sorted(tuple(r) for r in fm.upsert(old, new, "id", "at").collect()) == [(1, 5, "a"), (2, 5, "y"), (3, 1, "z")]


def test_streams_over_growing_files(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(1, "u", t0 + timedelta(seconds=s)) for s in (0, 10, 25, 60, 65, 200)] + [(2, "v", t0), (9, "w", t0 + timedelta(days=1))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id int, k int, name string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = usage.source(spark, str(tmp_path / "events"))
    out = usage.available_now(usage.debounced(stream.select("k", "ts"), "k", "ts"))
    zero = int((t0 - datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.k, r.first_us // 10**6 - zero, r.last_us // 10**6 - zero, r.n) for r in out.collect())
    assert got[:2] == [(1, 0, 25, 3), (1, 60, 65, 2)]
    again = df.unionByName(df).withColumn("ts", F.col("ts"))
    again.coalesce(1).write.parquet(str(tmp_path / "again"))
    once = usage.available_now(usage.once(usage.source(spark, str(tmp_path / "again")), "event_id", "ts", "10 days").select("event_id"))
    assert once.count() == len(rows)
