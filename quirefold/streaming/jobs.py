"""Job state from event streams, and the same from tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOGS = 50
#: Statuses whose begin restarts a phase's clock.
FRESH = ("post_processing", "generating_pdf", "writing_output")
#: The state's columns and their types.
_KINDS = {"job_id": "long", "app_state": "string", "phase": "string", "phase_start": "timestamp", "current_page": "int", "total_pages": "int", "memory_mb": "double", "skipped": "long", "failed": "array<int>", "output_path": "string", "pending": "boolean"}
_KINDS |= {"parts": "int", "error_code": "string", "warning": "string", "logs": "long", "workers": "array<struct<worker_id:int,completed:int,total:int>>", "late": "long"}
STATE_NAMES = tuple(_KINDS)
STATE = ", ".join(f"{n} {k}" for n, k in _KINDS.items())
#: What is kept in one value; logs, failed pages and workers have states of their own.
_SCALAR_KINDS = {n: k for n, k in _KINDS.items() if n not in ("job_id", "failed", "logs", "workers")} | {"started": "boolean", "pending_path": "string", "last_seq": "long"}
_SCALAR_NAMES = tuple(_SCALAR_KINDS)
_SCALARS = ", ".join(f"{n} {k}" for n, k in _SCALAR_KINDS.items())
_COLUMNS = ("job_id", "seq", "ts", "type", "status", "current_page", "total_pages", "memory_mb", "worker_progress", "level", "message", "code", "recoverable", "page", "output_path", "split_parts", "total_parts")


def advance(s: dict, e: Row, splits: int, fresh: tuple[str, ...], alarm: str) -> dict:
    """The scalars of a job's state after an event; lists of logs, failed pages and workers are kept elsewhere."""
    kind = e["type"]
    if kind == "download":
        return s | {"app_state": "downloading"}
    if kind == "init":
        return s | {"app_state": "processing", "started": True, "phase": "", "phase_start": None, "current_page": 0, "total_pages": e["total_pages"] or 0, "memory_mb": 0.0, "skipped": 0}
    if kind == "progress":
        status = e["status"] or ""
        if not s["started"]:
            return s | {"app_state": "processing", "started": True, "phase": status, "phase_start": None, "current_page": e["current_page"] or 0, "total_pages": e["total_pages"] or 0, "memory_mb": e["memory_mb"] or 0.0, "skipped": 0}
        changed = status != s["phase"] and status in fresh
        later = {k: e[k] for k in ("current_page", "total_pages", "memory_mb") if e[k] is not None}
        return s | later | {"app_state": "processing", "phase": status, "phase_start": e["ts"] if changed or s["phase_start"] is None else s["phase_start"]}
    if kind in ("error", "page_error"):
        if kind == "page_error" or e["recoverable"]:
            return s | {"skipped": s["skipped"] + 1} if s["started"] else s
        return s | {"app_state": "error", "error_code": e["code"]}
    if kind == "complete":
        if splits >= 2:
            return s | {"pending": True, "pending_path": e["output_path"]}
        return s | {"app_state": "complete", "output_path": e["output_path"]}
    if kind == "split_complete":
        parts = e["split_parts"] or []
        path = s["pending_path"] if s["pending"] else parts[0] if parts else None
        return s | {"app_state": "complete", "output_path": path, "pending": False, "pending_path": None, "parts": e["total_parts"] if e["total_parts"] is not None else len(parts)}
    if kind == "log" and e["level"] == "warn" and alarm in (e["message"] or ""):
        return s | {"warning": e["message"]}
    return ended(s) if kind == "end" else s


def ended(s: dict) -> dict:
    """At the end of a job's stream a pending result counts as complete, and a job that is still processing as broken off."""
    if s["pending"]:
        return s | {"app_state": "complete", "output_path": s["pending_path"], "pending": False, "pending_path": None}
    return s | {"app_state": "error"} if s["app_state"] == "processing" else s


class JobProcessor(StatefulProcessor):
    """Scalars in a value, workers in a map, logs and failed pages in lists, the end of a silent stream by a timer."""

    def __init__(self, splits: int, fresh: tuple[str, ...], alarm: str, timeout_ms: int | None):
        self.settings, self.timeout_ms = (splits, fresh, alarm), timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", _SCALARS)
        self.workers = handle.getMapState("workers", "worker_id int", "completed int, total int")
        self.logs = handle.getListState("logs", "message string")
        self.failed = handle.getListState("failed", "page int")

    def _row(self, job: int, s: dict) -> Row:
        workers = [Row(worker_id=k, completed=c, total=n) for k, c, n in sorted((k[0], *v) for k, v in self.workers.iterator())]
        shown = {n: s[n] for n in ("app_state", "phase", "phase_start", "current_page", "total_pages", "memory_mb", "skipped", "output_path", "pending", "parts", "error_code", "warning", "late")}
        shown |= {"job_id": job, "failed": [p[0] for p in self.failed.get()], "logs": sum(1 for _ in self.logs.get()), "workers": workers}
        return Row(**{n: shown[n] for n in STATE_NAMES})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = _SCALAR_NAMES
        s = dict(zip(names, self.scalars.get(), strict=True)) if self.scalars.exists() else dict.fromkeys(names) | {"app_state": "idle", "started": False, "skipped": 0, "pending": False, "last_seq": -(1 << 63), "late": 0}
        for e in sorted(rows, key=lambda r: r["seq"]):
            if e["seq"] <= s["last_seq"]:
                s["late"] += 1
                continue
            was = s["skipped"]
            s = advance(s, e, *self.settings) | {"last_seq": e["seq"]}
            if e["type"] == "init":
                self.workers.clear()
                self.failed.clear()
            elif e["type"] == "progress":
                if e["worker_progress"]:
                    self.workers.clear()
                for w in e["worker_progress"] or []:
                    self.workers.updateValue((w["worker_id"],), (w["completed"], w["total"]))
            elif e["type"] == "log":
                kept = [x[0] for x in self.logs.get()][-(LOGS - 1) :]
                self.logs.put([(m,) for m in [*kept, e["message"]]])
            if s["skipped"] > was and e["page"] is not None and e["type"] != "init":
                self.failed.appendValue((e["page"],))
        self.scalars.update(tuple(s[n] for n in names))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield self._row(key[0], s)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names = _SCALAR_NAMES
        s = ended(dict(zip(names, self.scalars.get(), strict=True)))
        self.scalars.update(tuple(s[n] for n in names))
        yield self._row(key[0], s)

    def close(self) -> None:
        pass


def _typed(events: DataFrame) -> DataFrame:
    """The columns that the fold reads; columns that events lacks are null."""
    kinds = {"worker_progress": "array<struct<worker_id:int,completed:int,total:int>>", "split_parts": "array<string>", "recoverable": "boolean", "ts": "timestamp", "memory_mb": "double", "job_id": "long", "seq": "long"}
    kinds |= dict.fromkeys(("current_page", "total_pages", "page", "total_parts"), "int")
    return events.select(*[(F.col(c) if c in events.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in _COLUMNS])


def job_states(events: DataFrame, splits: int = 1, fresh: tuple[str, ...] = FRESH, alarm: str = "memory", timeout_ms: int | None = 600_000) -> DataFrame:
    """A stream of events folded into each job's state, a row (STATE) for each job that a micro-batch touches.

    Events of a micro-batch go by seq; those at or before the last one seen are late and only counted. An event of the type
    end, or timeout_ms without any event (None: never), is the end of a job's stream; with it, micro-batches go on without new
    events, so an available-now trigger does not end. splits of 2 or more: a complete result is pending until
    split_complete. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return _typed(events).groupBy("job_id").transformWithState(JobProcessor(splits, fresh, alarm, timeout_ms), STATE, "Update", "None" if timeout_ms is None else "ProcessingTime")


def _last(c: Column, when: Column) -> Column:
    return F.max_by(c, F.when(when & c.isNotNull(), F.col("seq")))


def job_table(events: DataFrame, splits: int = 1, fresh: tuple[str, ...] = FRESH, alarm: str = "memory", finished: bool = False) -> DataFrame:
    """R02 to R04 over a table: what job_states has after all events in order of seq, which are distinct within a job; no event is late.

    finished applies the end-of-stream rule. Events since a job's last init decide its progress; without one, those from its
    first progress on.
    """
    e = _typed(events)
    kind, seq = F.col("type"), F.col("seq")
    is_ = lambda *k: kind.isin(*k)
    job = Window.partitionBy("job_id").orderBy("seq")
    before = job.rowsBetween(Window.unboundedPreceding, -1)
    inits = F.max(F.when(is_("init"), seq)).over(Window.partitionBy("job_id"))
    e = e.withColumn("_init", inits).withColumn("_now", F.col("_init").isNull() | (seq >= F.col("_init")))
    e = e.withColumn("_started", F.max(F.col("_now") & is_("init", "progress")).over(before))
    status = F.coalesce("status", F.lit(""))
    on = F.col("_now") & is_("progress")
    shown = F.last(F.when(F.col("_now"), F.when(is_("progress"), status).when(is_("init"), "")), ignorenulls=True).over(before)
    e = e.withColumn("_fresh", on & F.col("_started") & (status != shown) & status.isin(*fresh))
    e = e.withColumn("_counted", on & F.col("_started"))
    skip = F.col("_now") & F.coalesce("_started", F.lit(False)) & (is_("page_error") | (is_("error") & F.coalesce("recoverable", F.lit(False))))
    fatal = is_("error") & ~F.coalesce("recoverable", F.lit(False))
    direct = is_("complete") if splits < 2 else F.lit(False)
    app = F.when(is_("init", "progress"), "processing").when(is_("download"), "downloading").when(fatal, "error").when(direct | is_("split_complete"), "complete")
    # a result is pending from a complete on, until the next split_complete takes its path
    waiting = F.last(F.when(is_("complete", "split_complete"), F.struct(is_("complete").alias("yes"), F.col("output_path").alias("path"))), ignorenulls=True).over(before)
    waiting = F.when(waiting["yes"], waiting)
    first_part = F.get("split_parts", F.lit(0))
    result = F.when(is_("split_complete"), F.struct(F.when(waiting.isNotNull() & F.lit(splits >= 2), waiting["path"]).otherwise(first_part).alias("path")))
    result = F.when(direct, F.struct(F.col("output_path").alias("path"))).otherwise(result)
    e = e.withColumn("_result", result).withColumn("_app", app).withColumn("_skip", skip)
    number = lambda c, zero: F.coalesce(_last(F.when(is_("init"), F.coalesce(c, zero) if c is total else zero).otherwise(c), F.col("_now") & is_("init", "progress")), F.max(F.when(F.col("_now") & is_("init", "progress"), zero)))
    total, page, memory = F.col("total_pages"), F.col("current_page"), F.col("memory_mb")
    parts = F.when(is_("split_complete"), F.coalesce("total_parts", F.when(F.col("split_parts").isNotNull(), F.size("split_parts")).otherwise(0)))
    out = e.groupBy("job_id").agg(
        F.coalesce(_last(F.col("_app"), F.lit(True)), F.lit("idle")).alias("app_state"),
        _last(F.when(is_("progress"), status).when(is_("init"), ""), F.col("_now")).alias("phase"),
        F.coalesce(_last(F.col("ts"), F.col("_fresh")), F.min_by("ts", F.when(F.col("_counted"), seq))).alias("phase_start"),
        number(page, F.lit(0)).alias("current_page"),
        number(total, F.lit(0)).alias("total_pages"),
        number(memory, F.lit(0.0)).alias("memory_mb"),
        F.count_if("_skip").alias("skipped"),
        _last(F.col("_result"), F.lit(True))["path"].alias("output_path"),
        (_last(F.when(is_("complete", "split_complete"), is_("complete")), F.lit(True)) if splits >= 2 else F.lit(False)).alias("pending"),
        _last(F.col("output_path"), is_("complete")).alias("_path"),
        _last(parts, F.lit(True)).alias("parts"),
        F.max_by("code", F.when(fatal, seq)).alias("error_code"),
        _last(F.col("message"), is_("log") & (F.col("level") == "warn") & F.col("message").contains(alarm)).alias("warning"),
        F.least(F.count_if(is_("log")), F.lit(LOGS)).alias("logs"),
    ).withColumn("pending", F.coalesce("pending", F.lit(False)))
    if finished:
        done = F.when(F.col("pending"), "complete").when(F.col("app_state") == "processing", "error").otherwise(F.col("app_state"))
        out = out.withColumns({"app_state": done, "output_path": F.when(F.col("pending"), F.col("_path")).otherwise(F.col("output_path")), "pending": F.lit(False)})
    return out.drop("_path")


def worker_progress(events: DataFrame) -> DataFrame:
    """Per page_done message (job_id, seq, worker_id) of a job's workers how many pages each of them has done so far, as an array by worker, and all of them.

    A message stands once for each of its job's workers, of which there are few, so that each worker's count is a running sum.
    """
    done = events.where("type = 'page_done'").select("job_id", "seq", F.coalesce("worker_id", F.lit(0)).alias("worker_id"))
    workers = done.select("job_id", F.col("worker_id").alias("worker")).distinct()
    counts = done.join(workers, "job_id").withColumn("completed", F.sum((F.col("worker_id") == F.col("worker")).cast("long")).over(Window.partitionBy("job_id", "worker").orderBy("seq")))
    entry = F.struct(F.col("worker").alias("worker_id"), "completed")
    return counts.where("completed > 0").groupBy("job_id", "seq").agg(F.array_sort(F.collect_list(entry)).alias("workers"), F.sum("completed").alias("completed"))


def job_counters(events: DataFrame) -> DataFrame:
    """A11, R02 over a table: each job's events by type, and its last type."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("init", "progress", "page_error", "complete", "log")]
    return events.groupBy("job_id").agg(*counts, F.max_by("type", F.struct("ts", "seq")).alias("last_type"))


def last_logs(events: DataFrame, n: int = LOGS) -> DataFrame:
    """The last n log events of each job."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return events.where("type = 'log'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def failed_pages(events: DataFrame, n: int = 5) -> DataFrame:
    """The first n failed pages of each job as text, and how many more there are; a job's other pages are only counted."""
    errors = events.where("type = 'page_error'").select("job_id", "seq", "page")
    counts = errors.groupBy("job_id").agg(F.count("*").alias("_all"))
    first = errors.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).where(F.col("_n") <= n)
    shown = first.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "page"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["page"].cast("string")), ", ")
    return shown.join(counts, "job_id").select("job_id", joined.alias("pages"), F.greatest(F.col("_all") - n, F.lit(0)).alias("more"))


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and event-time window, with a watermark for late ones. Works on streams and tables."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every), "type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "type", "n", "total")
