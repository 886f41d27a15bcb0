"""Stateful streams, cut into batches and restarted, against SQL over the whole and against plain literals."""

import random

import duckdb
import pandas as pd
import pytest

from parcelspark.plans import events as E
from parcelspark.streaming import jobs as J
from parcelspark.streaming import progress as S

EVENT = "job string, ms long, seq long, kind string, text string"
NAMES = {"start": "signup", "watch": "view", "message": "click", "done": "purchase", "error": "error"}


def plain(rows):
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=repr)


def sql(rows, name):
    """The registered SQL of a stream over the rows."""
    con = duckdb.connect()
    table = pd.DataFrame([(j.removeprefix("j"), s, pd.Timestamp(ms * 3600000, unit="us"), NAMES[k]) for j, ms, s, k, _ in rows], columns=["user_id", "event_id", "ts", "event_type"])
    con.register("events", table)
    found = con.execute(E.ORACLES[name])
    at = [x[0] for x in found.description]
    return at, found.fetchall()


def streamed(spark, folder, files, processor, schema, restart_after=None):
    """The rows of the files, one batch each; with restart_after the query ends after so many and a new one goes on."""
    source, path = folder / "in", str(folder / "run")
    source.mkdir()
    df = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    for n, rows in enumerate(files):
        pd.DataFrame(rows, columns=[x.split()[0] for x in EVENT.split(", ")]).astype({"text": "string"}).to_parquet(source / f"{n:03d}.parquet")
        if restart_after == n + 1:
            S.run_to_end(J.stateful(df, processor(), schema), path=path)
    return S.run_to_end(J.stateful(df, processor(), schema), path=path).collect()


def events(n=260, seed=6):
    r = random.Random(seed)
    ms, out = 0, []
    for seq in range(n):
        ms += r.choice([0, 1, 400, 3000, 5000, 9000]) + (seq % 60 == 0)  # what isn't after the last batch's watermark would be late
        job = f"{r.randrange(5)}"
        out.append((job, ms, seq, r.choice(["start", "message", "message", "watch", "watch", "done" if seq % 2 else "error"]), f"m{seq}"))
    return out


@pytest.mark.parametrize(("name", "processor", "schema"), [("stream_job_log", J.JobLog, J.LOG), ("stream_on_change", J.OnChange, J.CHANGES), ("stream_in_flight", J.InFlight, J.ANSWERS)])
def test_streams_in_batches_with_a_restart(spark, tmp_path, name, processor, schema):
    rows = events()
    at, want = sql(rows, name)
    files = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    (tmp_path / "a").mkdir()
    got = streamed(spark, tmp_path / "a", files, processor, schema, restart_after=2)
    assert plain(tuple(r[c] for c in at) for r in got) == plain(want) and len(want) > 40


def test_job_log_by_hand(spark, tmp_path):
    rows = [
        ("j", 500, 0, "watch", None), ("j", 1000, 1, "start", None), ("j", 2000, 2, "message", "one"), ("j", 3000, 3, "watch", None), ("j", 4000, 4, "start", None), ("j", 12500, 5, "message", "two"), ("j", 13000, 6, "done", None),
        ("j", 14000, 7, "message", "lost"), ("j", 20000, 8, "watch", None), ("j", 601001, 9, "watch", None), ("k", 700000, 10, "start", None),
    ]
    got = streamed(spark, tmp_path, [rows[:5], rows[5:8], rows[8:]], J.JobLog, J.LOG, restart_after=1)
    by = {w: [tuple(r)[2:] for r in sorted(got, key=lambda r: (r["at_ms"], r["n"] or 0, r["kind"])) if r["watcher"] == w] for w in (0, 1, 3, 4, 8, 9, 10)}
    beat = lambda *ms: [(x, "heartbeat", None, None) for x in ms]
    end, two = (13000, "done", None, None), (12500, "message", 1, "two")
    assert by[0] == [(500, "missing", None, None)] and by[9] == [(601001, "missing", None, None)]
    assert by[1] == [(1000, "started", None, None), (2000, "message", 0, "one"), *beat(6000, 11000), two, end]
    assert by[3] == [(3000, "message", 0, "one"), *beat(8000), two, end]  # 13,000 is the end
    assert by[4] == [(4000, "message", 0, "one"), (4000, "reconnected", None, "3000"), *beat(9000), two, end]
    assert by[8] == [(20000, "done", None, None), (20000, "message", 0, "one"), (20000, "message", 1, "two")]
    assert by[10] == [(700000, "started", None, None)]
    state = spark.read.format("statestore").option("path", f"{tmp_path}/run/state").option("stateVarName", "job").load()
    assert [r["key"]["job"] for r in state.collect()] == ["k"]  # the timer has let go of the other
