"""Uploads as a stream, listings without bytes, and model calls against a local server."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import extract, requests
from fieldweave.sources import files
from fieldweave.streaming import uploads



def test_each_upload_lands_once(spark, tmp_path, monkeypatch):
    inbox, root, landings, checkpoint = tmp_path / "in", tmp_path / "root", tmp_path / "landings", tmp_path / "checkpoint"
    for folder in (inbox / "x", inbox / "y", root / "inputs"):
        folder.mkdir(parents=True)
    (root / "inputs" / "a.pdf").write_bytes(b"there before")
    for name, content in (("x/a.pdf", b"A1"), ("y/a.pdf", b"A2"), ("x/b.PDF", b"B"), ("x/no.txt", b"T"), ("x/large.pdf", b"L" * 100)):
        (inbox / name).write_bytes(content)
    own, calls, opened = uploads.write_files, [], []
    monkeypatch.setattr(uploads, "with_bytes", lambda rows, col: opened.append(sorted(r[0] for r in rows.select("source").collect())) or files.with_bytes(rows, col))

    def cut_short(rows, aside):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("driver lost before the bytes")
        own(rows, aside=aside)
        if len(calls) == 2:
            raise OSError("driver lost behind the bytes")

    monkeypatch.setattr(uploads, "write_files", cut_short)
    run = lambda: uploads.land_uploads(uploads.read_uploads(spark, str(inbox)), str(root), str(landings), str(checkpoint), max_bytes=50, at=F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")).awaitTermination()
    for _ in range(2):
        with pytest.raises(Exception, match="driver lost"):
            run()
    run()
    (inbox / "x" / "c.pdf").write_bytes(b"C")
    run()
    found = {p.name: p.read_bytes() for p in (root / "inputs").iterdir() if not p.name.startswith(".")}
    assert found == {"a.pdf": b"there before", "a_20250102_030405.pdf": b"A1", "a_20250102_030405_2.pdf": b"A2", "b.PDF": b"B", "c.pdf": b"C"}
    rows = {(r["source"].rsplit("/", 1)[1], r["status"], r["reason"]) for r in uploads.landed(spark, str(landings)).collect()}
    assert {("no.txt", 400, "not_a_pdf"), ("large.pdf", 413, "too_large"), ("b.PDF", 200, None)} <= rows
    assert all("large" not in x for batch in opened for x in batch)


def test_a_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    rows = files.listing(spark, str(tmp_path), "*.pdf")
    assert [(r["path"], r["size"]) for r in rows.collect()] == [(f"{tmp_path}/d/a.pdf", 5)]
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([(1, f"{tmp_path}/d/a.pdf"), (2, f"{tmp_path}/none"), (3, None), (4, f"file://{tmp_path}/b.txt")], "k int, path string")
    assert {r["k"]: r["content"] and bytes(r["content"]) for r in files.with_bytes(wanted, batch_bytes=1).collect()} == {1: b"12345", 2: None, 3: None, 4: b"1"}


def test_a_listing_has_empty_and_hidden_files(spark, tmp_path):
    aside = tmp_path / f"_aside-{'0' * 32}"
    for folder in (tmp_path / "_d" / ".e" / "f", tmp_path / "none", aside):
        folder.mkdir(parents=True)
    names = ["_a.pdf", ".b.pdf", "c.pdf", "_d/d.pdf", "_d/.e/f/e.pdf", "x._COPYING_"]
    for name in names:
        (tmp_path / name).write_bytes(b"")
    (aside / "0").write_bytes(b"not yet there")
    rows = files.listing(spark, f"file://{tmp_path}").collect()
    assert sorted((r["path"], r["size"]) for r in rows) == sorted((f"{tmp_path}/{name}", 0) for name in names)
    assert {r["path"]: r["modified"].timestamp() for r in rows}[f"{tmp_path}/c.pdf"] == pytest.approx((tmp_path / "c.pdf").stat().st_mtime, abs=1e-3)
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.listing(spark, f"{tmp_path}/gone").collect()


def test_a_listing_is_not_sent_to_every_task(spark, tmp_path):
    """By what is measured of the files, not of the folders."""
    (tmp_path / "d").mkdir()
    for k in range(3000):
        (tmp_path / "d" / f"{k}.pdf").touch()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        wanted = spark.range(6000).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".pdf")).alias("path"))
        rows = requests.checked_files(wanted, files.listing(spark, str(tmp_path)), str(tmp_path))
        assert sorted(r["status"] for r in rows.collect()) == [200] * 3000 + [404] * 3000
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_upload_leaves_an_empty_file_that_is_there(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "root"
    for folder in (inbox, root / "inputs"):
        folder.mkdir(parents=True)
    (root / "inputs" / "a.pdf").write_bytes(b"")
    (inbox / "a.pdf").write_bytes(b"A")
    uploads.land_uploads(uploads.read_uploads(spark, str(inbox)), str(root), str(tmp_path / "landings"), str(tmp_path / "checkpoint"), at=F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")).awaitTermination()
    assert {p.name: p.read_bytes() for p in (root / "inputs").iterdir() if not p.name.startswith(".")} == {"a.pdf": b"", "a_20250102_030405.pdf": b"A"}


class Model(BaseHTTPRequestHandler):
    """Answers by what the prompt says; counts calls and how many are open at once."""

    lock, open_now, most, calls = threading.Lock(), 0, 0, []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["prompt"]
        with Model.lock:
            Model.open_now += 1
            Model.most = max(Model.most, Model.open_now)
            Model.calls.append(prompt)
            times = Model.calls.count(prompt)
        time.sleep(0.3 if "slow" in prompt else 0.02)
        with Model.lock:
            Model.open_now -= 1
        failed = "fails" in prompt or ("twice" in prompt and times < 3)
        answer = b"no json" if "broken" in prompt else json.dumps({"other": 1} if "keyless" in prompt else {"response": f"to {prompt}", "model": body["model"]}).encode()
        self.send_response(500 if failed else 200)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *args):
        pass


@pytest.fixture
def model():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Model.open_now, Model.most, Model.calls = 0, 0, []
    yield extract.http_client(f"http://127.0.0.1:{server.server_port}/", timeout=5)
    server.shutdown()


def test_calls_to_a_server(spark, model):
    prompts = [f"plain {k}" for k in range(20)] + ["fails", "twice", "keyless", "broken", "slow"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(prompts)], "k int, prompt string").coalesce(1)
    got = {r["prompt"]: (r["response"], r["error"]) for r in extract.call_model(rows, model, in_flight=4).collect()}
    assert all(got[p] == (f"to {p}", None) for p in [*prompts[:20], "twice", "slow"])
    assert got["fails"][0] is None and "500" in got["fails"][1] and "KeyError" in got["keyless"][1] and "JSONDecodeError" in got["broken"][1]
    assert 1 < Model.most <= 4 and [Model.calls.count(p) for p in ("plain 0", "fails", "twice", "keyless")] == [1, 3, 3, 3]


def test_a_task_that_runs_out_of_time_keeps_what_it_has(spark, model):
    rows = spark.createDataFrame([(k, f"slow {k}") for k in range(12)], "k int, prompt string").coalesce(1)
    got = extract.call_model(rows, model, in_flight=2, budget_s=0.5).collect()
    done = [r for r in got if r["response"]]
    assert len(got) == 12 and 2 <= len(done) <= 6 and all(r["error"].startswith("OutOfTime") for r in got if not r["response"])


def test_a_server_that_is_not_there(spark):
    rows = spark.createDataFrame([("a",)], "prompt string")
    (r,) = extract.call_model(rows, extract.http_client("http://127.0.0.1:9", timeout=1), attempts=2).collect()
    assert r["response"] is None and r["error"].startswith("URLError")
