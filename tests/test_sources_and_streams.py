import json
import zipfile

import pytest

from quernel.sources import files
from quernel.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nBody")
    (tmp_path / "b.html").write_text("<p>One</p><script>no()</script><p>Two &amp; three</p>")
    (tmp_path / "c.TXT").write_bytes(b"ok \xff text")
    (tmp_path / "d.xyz").write_text("?")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "f.docx").write_text("broken")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.md"].text.startswith("# Title") and got["b.html"].text == "One\nTwo & three" and got["c.TXT"].text == "ok  text"
    assert got["e.docx"].text == "First\n\nSecond" and got["d.xyz"].text is None and got["d.xyz"].error and got["f.docx"].error


def test_golden_and_search(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"question": "q", "gold_source": "s", "gold_snippets": ["x"]}\n\n{"gold_source": "t"}\n')
    assert [r.question for r in files.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == ["q"]
    body = json.dumps({"results": [{"title": "a", "url": "u1", "content": "c"}, {"title": "b"}, {"url": "u1"}, {"url": "u2"}, {"url": "u3"}]})
    got = files.search_results(spark.createDataFrame([("q", body), ("r", "broken"), ("s", None)], "query string, body string"), 2).collect()
    assert [(r.query, r.rank, r.url) for r in sorted(got, key=lambda r: r.rank)] == [("q", 1, "u1"), ("q", 2, "u2")]


def stream(spark, tmp_path, name, batches, schema):
    """Each batch a file, and each file a micro-batch."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        import os

        os.utime(folder / f"{i}.json", (1000 + i, 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_token_bucket(spark, tmp_path):
    at = lambda s: f"2026-01-01T00:00:{s:02d}"
    batches = [[{"user_id": 1, "event_id": i, "ts": at(0)} for i in range(4)], [{"user_id": 1, "event_id": 10, "ts": at(1)}, {"user_id": 1, "event_id": 11, "ts": at(1)}, {"user_id": 2, "event_id": 12, "ts": at(1)}]]
    df = stream(spark, tmp_path, "bucket", batches, "user_id bigint, event_id bigint, ts timestamp")
    got = {r.event_id: r.allowed for r in drain(spark, jobs.token_bucket(df, 1.0, 3.0), tmp_path, "bucket_out")}
    assert got == {0: True, 1: True, 2: True, 3: False, 10: True, 11: False, 12: True}


def test_citation_filter_over_pieces(spark, tmp_path):
    batches = [[{"stream_id": "s", "seq": 1, "text": "port [1"}], [{"stream_id": "s", "seq": 2, "text": "] and [9"}], [{"stream_id": "s", "seq": 3, "text": "] end ["}], [{"stream_id": "s", "seq": 4, "text": None}]]
    df = stream(spark, tmp_path, "cites", batches, "stream_id string, seq bigint, text string")
    got = drain(spark, jobs.citation_filter(df, 2), tmp_path, "cites_out")
    assert "".join(r.text for r in sorted(got, key=lambda r: r.seq)) == "port [1] and  end ["


def test_service_levels_equal_the_batch(spark, tmp_path):
    rows = [{"event_id": i, "ts": f"2026-01-01T00:{i:02d}:00", "event_type": "error" if i % 4 == 0 else "view"} for i in range(60)]
    df = stream(spark, tmp_path, "levels", [rows], "event_id bigint, ts timestamp, event_type string")
    got = drain(spark, jobs.service_levels(df, size="10 minutes", step="10 minutes"), tmp_path, "levels_out", "complete")
    assert len(got) == 6 and sum(r.n for r in got) == 60 and sum(r.errors for r in got) == 15
    twice = stream(spark, tmp_path, "twice", [rows, rows], "event_id bigint, ts timestamp, event_type string")
    assert len(drain(spark, jobs.deduplicated(twice, "2 hours"), tmp_path, "twice_out")) == 60


def test_frames(spark):
    df = spark.createDataFrame([(1, 2, "done", "view")], "run_id int, event_id int, kind string, action string")
    assert files.server_sent(df).first().frame == 'id: 2\nevent: done\ndata: {"run_id":1,"action":"view"}\n\n'


def test_catalog_without_the_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, *a, **k):
        if name.startswith("quernel.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("quernel.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", blocked)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not [q for q in entry.queries() if q.startswith("p1")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__")
