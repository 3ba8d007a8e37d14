"""Job state: the stream, the table and a plain fold give the same."""

import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quirefold.operators import pages
from quirefold.sources import files
from quirefold.streaming import jobs

SCHEMA = (
    "job_id long, seq long, ts timestamp, type string, status string, current_page int, total_pages int, memory_mb double, worker_progress array<struct<worker_id:int,completed:int,total:int>>, "
    "level string, message string, code string, recoverable boolean, page int, output_path string, split_parts array<string>, total_parts int"
)
NAMES = [f.split()[0] for f in SCHEMA.replace("struct<worker_id:int,completed:int,total:int>", "x").split(", ")]
TYPES = ["init", "progress", "progress", "progress", "page_error", "error", "complete", "split_complete", "log", "download", "split_progress"]


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    key, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, name)
    yield
    spark.conf.set(key, before)


def _events(seed, n_jobs=40, n=25):
    r, out = random.Random(seed), []
    for job in range(n_jobs):
        for seq in range(r.randint(1, n)):
            at = f"2024-01-01 00:{seq:02d}:00"
            e = dict.fromkeys(NAMES) | {"job_id": job, "seq": seq, "ts": at, "type": r.choice(TYPES if r.random() < 0.9 else ["progress"])}
            e |= {"status": r.choice([None, "ocr_processing", "post_processing", "generating_pdf"]), "current_page": r.choice([None, seq]), "total_pages": r.choice([None, 9]), "memory_mb": r.choice([None, 1.5 * seq])}
            e |= {"level": r.choice(["warn", "info", None]), "message": r.choice([None, "low memory", "x"]), "code": r.choice([None, f"E{seq}"]), "recoverable": r.choice([None, True, False]), "page": r.choice([None, seq])}
            e |= {"output_path": f"out/{seq}", "split_parts": r.choice([None, [], [f"p{seq}"]]), "total_parts": r.choice([None, 4])}
            if e["type"] == "progress" and r.random() < 0.3:
                e["worker_progress"] = [(r.randrange(3), seq, 9)]
            out.append(e)
    return out


def _frame(spark, events):
    plain = SCHEMA.replace("ts timestamp", "ts string")
    return spark.createDataFrame([tuple(e[n] for n in NAMES) for e in events], plain).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(events, splits, finished):
    """One event after another."""
    out = {}
    for job in {e["job_id"] for e in events}:
        s = {"app_state": "idle", "started": False, "phase": None, "phase_start": None, "current_page": None, "total_pages": None, "memory_mb": None, "skipped": 0, "output_path": None, "pending_path": None, "pending": False, "parts": None, "error_code": None, "warning": None}
        for e in sorted((e for e in events if e["job_id"] == job), key=lambda e: e["seq"]):
            s = jobs.advance(s, Row(**e), splits, jobs.FRESH, "memory")
        if finished:
            s = jobs.ended(s)
        out[job] = {k: v for k, v in s.items() if k not in ("started", "pending_path")}
    return out


@pytest.mark.parametrize("splits,finished", [(1, False), (2, False), (2, True), (1, True)])
def test_table_follows_the_fold(spark, splits, finished):
    events = _events(splits)
    want = _plain(events, splits, finished)
    for r in jobs.job_table(_frame(spark, events), splits=splits, finished=finished).withColumn("phase_start", F.date_format("phase_start", "yyyy-MM-dd HH:mm:ss")).collect():
        got = r.asDict()
        assert {k: got[k] for k in want[r.job_id]} == want[r.job_id], r.job_id


def _stream(spark, source, checkpoint, name, timeout_ms=None):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    states = jobs.job_states(stream, splits=2, timeout_ms=timeout_ms)
    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: df.write.mode("append").parquet(name))


def _newest(spark, path):
    """The last row of each job, by what it has seen and by the file it is in."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_modification_time").alias("at")).withColumn("phase_start", F.date_format("phase_start", "yyyy-MM-dd HH:mm:ss"))
    return {r.job_id: r for r in rows.orderBy("at").collect()}


def test_stream_in_two_batches_with_late_events(spark, tmp_path):
    events = _events(7)
    early, later = [e for e in events if e["seq"] < 10], [e for e in events if e["seq"] >= 10]
    late = [e for e in early if e["seq"] == 3]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (early, later + late):
        _frame(spark, batch).coalesce(1).write.mode("append").parquet(source)
        query = _stream(spark, source, str(tmp_path / "c"), out).trigger(availableNow=True).start()
        assert query.awaitTermination(100)
    want, got = _plain(events, 2, False), _newest(spark, out)
    for job, s in want.items():
        assert {k: got[job][k] for k in s} == s, job
        assert got[job].late == sum(e["job_id"] == job for e in late)
        mine = sorted((e for e in events if e["job_id"] == job), key=lambda e: e["seq"])
        assert got[job].logs == sum(e["type"] == "log" for e in mine)
        inits = [e["seq"] for e in mine if e["type"] == "init"]
        begun = min([e["seq"] for e in mine if e["type"] in ("init", "progress") and e["seq"] >= max(inits, default=0)], default=99)
        assert got[job].failed == [e["page"] for e in mine if e["seq"] > begun and e["page"] is not None and (e["type"] == "page_error" or e["type"] == "error" and e["recoverable"])]


def test_silence_ends_a_stream(spark, tmp_path):
    e = lambda job, seq, kind, **more: dict.fromkeys(NAMES) | {"job_id": job, "seq": seq, "ts": "2024-01-01 00:00:00", "type": kind} | more
    events = [e(1, 0, "init"), e(1, 1, "progress", worker_progress=[(2, 1, 4), (0, 3, 4)]), e(2, 0, "init"), e(2, 1, "complete", output_path="a.pdf"), e(3, 0, "init"), e(3, 1, "end"), *[e(4, i, "log", message=f"m{i}") for i in range(70)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _frame(spark, events).coalesce(1).write.parquet(source)
    query = _stream(spark, source, str(tmp_path / "c"), out, timeout_ms=3000).trigger(processingTime="1 second").start()
    until, got = time.time() + 60, {}
    while time.time() < until and (2 not in got or got[2].app_state != "complete" or got[1].app_state != "error"):
        time.sleep(1)
        got = _newest(spark, out) if list((tmp_path / "out").glob("*.parquet")) else {}
    query.stop()
    assert (got[1].app_state, got[2].app_state, got[2].output_path, got[3].app_state, got[4].app_state) == ("error", "complete", "a.pdf", "error", "idle")
    assert [tuple(w) for w in got[1].workers] == [(0, 3, 4), (2, 1, 4)] and got[4].logs == 50


def test_workers_and_pace(spark):
    done = [(1, 0, 0, "page_done"), (1, 1, 2, "page_done"), (1, 2, None, "page_done"), (1, 3, 2, "page_error"), (1, 4, 2, "page_done"), (2, 0, 1, "page_done")]
    rows = jobs.worker_progress(spark.createDataFrame(done, "job_id long, seq long, worker_id int, type string")).collect()
    assert {(r.job_id, r.seq): [tuple(w) for w in r.workers] for r in rows} == {(1, 0): [(0, 1)], (1, 1): [(0, 1), (2, 1)], (1, 2): [(0, 2), (2, 1)], (1, 4): [(0, 2), (2, 2)], (2, 0): [(1, 1)]}
    phases = [(1, 0, 0, "ocr_processing", 0, 10), (1, 1, 50, "ocr_processing", 10, 10), (1, 2, 110, "post_processing", 0, 10), (1, 3, 120, "post_processing", 5, 10), (1, 4, 130, None, 6, 10)]
    events = spark.createDataFrame(phases, "job_id long, seq long, s int, status string, current int, total int").withColumn("ts", F.timestamp_seconds("s"))
    got = pages.job_pace(events).orderBy("seq").collect()
    assert [(r.seconds_per_page, r.remaining) for r in got] == [(0, 0), (5, 0), (0, 0), (2, 10), (20 / 6, 4 * 20 / 6)]


def test_status_lines(spark):
    lines = ['{"type": "log", "message": "a", "level": "warn"}', "Fetching 3 files", "  ", "some warning", "tokenizer ready", '{"type": "other", "message": "model"}', "[1]", "{broken model"]
    got = files.parse_status_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.type, r.message) for r in got] == [("log", "a"), ("modelSetup", "Fetching 3 files"), ("modelSetup", "tokenizer ready"), ("modelSetup", "{broken model")]
