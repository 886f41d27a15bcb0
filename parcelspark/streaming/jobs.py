"""Jobs that many watch: their log and registry, changes of a task, and requests that wait for a running job, as stateful streams.

Each is a StatefulProcessor over events of a job (job, ms, seq, kind, text), keyed by job, in event time. State lives in the state store
of the executors and is rebuilt from the checkpoint after a failure or a restart; nothing is kept on the driver. A batch of a job is
gone through in the order of (ms, seq), and what falls due between two events is emitted before the later one, so the output
doesn't depend on how the stream is cut into batches. Events at or before the watermark of the batch before are late and fall out, as always in Spark;
`late` says how far it trails. Kinds of events: start (a request), message, done, error, watch.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds between heartbeats, and how long after its start a job that has ended is kept.
HEARTBEAT_MS, PURGE_MS = 5_000, 600_000
LOG = "job string, watcher long, at_ms long, kind string, n int, text string"
CHANGES = "job string, seq long, ms long, kind string"
ANSWERS = "job string, seq long, asked_ms long, computes boolean, kind string, answered_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows) -> list[tuple]:
    out = []
    for b in rows:
        out += zip(b["ms"].tolist(), b["seq"].tolist(), b["kind"], b["text"], strict=True)
    return sorted(out, key=lambda e: e[:2])


class JobLog(StatefulProcessor):
    """The messages of a job for each of its watchers: what there is at once, then what comes, a heartbeat every five seconds, and the end.

    A start while the job runs reconnects to it; one after its end begins anew. A job that has ended can be read until PURGE_MS
    after its start, then it is forgotten, by a timer or by the next event, whichever comes first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "started long, final string, n int")
        self.messages = handle.getListState("messages", "n int, text string")
        self.watchers = handle.getMapState("watchers", "watcher long", "due long")

    def _load(self, key: tuple) -> None:
        self.job, self.out = key[0], []
        known = self.state.get() if self.state.exists() else (None, None, 0)
        self.started, self.final, self.n = known
        self.due = {w[0]: v[0] for w, v in self.watchers.iterator()} if self.running else {}
        self.old, self.new, self.fresh = None, [], False

    @property
    def running(self) -> bool:
        return self.started is not None and self.final is None

    def _forget(self) -> None:
        self.started, self.final, self.n, self.due, self.old, self.new, self.fresh = None, None, 0, {}, [], [], True

    def _all(self) -> list[tuple]:
        """The messages so far; those of earlier batches are read once, and only if someone asks."""
        if self.old is None:
            self.old = list(self.messages.get()) if self.messages.exists() else []
        return [*self.old, *self.new]

    def _emit(self, watcher: int, ms: int, kind: str, n: int | None = None, text: str | None = None) -> None:
        self.out.append((self.job, watcher, ms, kind, n, text))

    def _beat(self, before: int) -> None:
        for w, due in self.due.items():
            while due < before:
                self._emit(w, due, "heartbeat")
                due += HEARTBEAT_MS
            self.due[w] = due

    def _replay(self, watcher: int, ms: int) -> None:
        for n, text in self._all():
            self._emit(watcher, ms, "message", n, text)

    def _event(self, ms: int, seq: int, kind: str, text: str | None) -> None:
        if self.final is not None and ms - self.started > PURGE_MS:
            self._forget()
        if self.running:
            self._beat(ms)
        if kind == "start" and not self.running:
            self._forget()
            self.started = ms
            self._emit(seq, ms, "started")
            self.due[seq] = ms + HEARTBEAT_MS
        elif kind in ("start", "watch") and self.running:
            if kind == "start":
                self._emit(seq, ms, "reconnected", None, str(ms - self.started))
            self._replay(seq, ms)
            self.due[seq] = ms + HEARTBEAT_MS
        elif kind == "watch" and self.started is None:
            self._emit(seq, ms, "missing")
        elif kind == "watch":
            self._replay(seq, ms)
            self._emit(seq, ms, self.final)
        elif kind == "message" and self.running:
            self.new.append((self.n, text))
            for w in self.due:
                self._emit(w, ms, "message", self.n, text)
            self.n += 1
        elif kind in ("done", "error") and self.running:
            for w in self.due:
                self._emit(w, ms, kind)
            self.final, self.due = kind, {}

    def _save(self, watermark: int) -> None:
        if self.fresh:
            self.messages.clear()
        for m in self.new:
            self.messages.appendValue(m)
        self.watchers.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.started is None:
            self.state.clear()
            return
        self.state.update((self.started, self.final, self.n))
        for w, due in self.due.items():
            self.watchers.updateValue((w,), (due,))
        next_ = min(self.due.values()) + 1 if self.due else self.started + PURGE_MS + 1 if self.final is not None else None
        if next_ is not None:
            self.handle.registerTimer(max(next_, watermark + 1))

    def _rows(self):
        yield pd.DataFrame(self.out, columns=[x.split()[0] for x in LOG.split(", ")]).astype({"n": "Int32"})

    def handleInputRows(self, key, rows, timerValues):
        self._load(key)
        for e in in_order(rows):
            self._event(*e)
        self._save(timerValues.getCurrentWatermarkInMs())
        return self._rows()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load(key)
        now = timerValues.getCurrentWatermarkInMs()
        if self.running:
            self._beat(now)
        elif self.started is not None and now - self.started > PURGE_MS:
            self._forget()
        self._save(now)
        return self._rows()

    def close(self) -> None:
        pass


class OnChange(StatefulProcessor):
    """Events whose kind isn't that of the one before of the same job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "kind string")

    def handleInputRows(self, key, rows, timerValues):
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for ms, seq, kind, _ in in_order(rows):
            if kind != last:
                out.append((key[0], seq, ms, kind))
                last = kind
        self.last.update((last,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])

    def close(self) -> None:
        pass


class InFlight(StatefulProcessor):
    """Requests of a job: the first one computes, those that come while it runs wait; the end of the job answers them all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "seq long, ms long, computes boolean")

    def handleInputRows(self, key, rows, timerValues):
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        out, cleared, stored = [], False, len(waiting)
        for ms, seq, kind, _ in in_order(rows):
            if kind == "start":
                waiting.append((seq, ms, not waiting))
            elif kind in ("done", "error") and waiting:
                out += [(key[0], s, asked, computes, kind, ms) for s, asked, computes in waiting]
                waiting, cleared, stored = [], True, 0
        if cleared:
            self.waiting.clear()
        for w in waiting[stored:]:
            self.waiting.appendValue(w)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    def close(self) -> None:
        pass


def stateful(events: DataFrame, processor: StatefulProcessor, schema: str, late: str = "0 seconds") -> DataFrame:
    """events: a stream of job, ms (event time), seq, kind, text."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.selectExpr("job", "ms", "seq", "kind", "text", "timestamp_millis(ms) AS at").withWatermark("at", late)
    return timed.groupBy("job").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")
