"""Queries over progress events, batch and streaming."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelspark.sources import views as V
from parcelspark.sources.views import oracle
from parcelspark.streaming import jobs as J
from parcelspark.streaming import progress as S

c = F.col


def task():
    return Window.partitionBy("task_id").orderBy("seq")


def progress_last_value(spark, d):
    last = F.max_by(F.struct("status", "progress"), "seq")
    return V.progress(spark, d).groupBy("task_id").agg(last.alias("l")).select("task_id", "l.status", F.round("l.progress", 6).alias("progress"))


def progress_on_change(spark, d):
    """Events whose status differs from the one before of the same task."""
    before = F.lag("status").over(task())
    df = V.progress(spark, d).withColumn("changed", before.isNull() | (before != c("status")))
    return df.where("changed").select("task_id", "seq", "status")


def message_tail(spark, d):
    """What a consumer that has read 60 messages of each task still has to read."""
    return V.progress(spark, d).withColumn("n", F.row_number().over(task())).where("n > 60").select("task_id", "seq", "n")


def running_pct(spark, d):
    """Rows read so far, as progress of a scan: at most 70."""
    df = V.progress(spark, d).withColumn("rows", F.count(F.lit(1)).over(task()))
    return df.select("task_id", "seq", F.least(F.lit(70), 5 + F.floor(65 * c("rows") / 500.0)).cast("int").alias("pct"))


def _admitted(batches):
    """Rows sorted by task and time: those an hour or more after the last one of their task that was let in. Only that one is held."""
    task, last = None, None
    for batch in batches:
        keep = []
        for t, ts in zip(batch["task_id"].tolist(), batch["us"].tolist(), strict=True):
            let_in = t != task or ts - last >= 3600 * 1000000
            if let_in:
                task, last = t, ts
            keep.append(let_in)
        yield batch[keep]


def job_dedup_inflight(spark, d):
    """Requests of a task less than an hour after its last one that was let in wait for that one's job and do not start one. Sequential by
    task; a task's requests stream through one task in order."""
    df = V.progress(spark, d).where("task_id is not null").select("task_id", F.unix_micros(c("ts").cast("timestamp")).alias("us"), "seq")
    df = df.repartition("task_id").sortWithinPartitions("task_id", "us", "seq")
    return df.mapInPandas(_admitted, df.schema).groupBy("task_id").agg(F.count(F.lit(1)).alias("jobs"))


def stream_tumbling(spark, d):
    out = S.run_to_end(S.tumbling(S.event_stream(spark, d)))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_session(spark, d):
    out = S.run_to_end(S.sessions(S.event_stream(spark, d)))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def job_events(spark, d):
    """The events as a stream of jobs: one second of a job is an hour of the table."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "start", "click", "message", "view", "watch", "purchase", "done", "error", "error")])
    df = S.event_stream(spark, d).where("user_id is not null")
    return df.select(c("user_id").cast("string").alias("job"), F.expr("unix_micros(ts) div 3600000").alias("ms"), c("event_id").alias("seq"), F.try_element_at(kinds, c("event_type")).alias("kind"), F.concat(F.lit("m"), c("event_id").cast("string")).alias("text"))


def stream_job_log(spark, d):
    """What each watcher of a job is sent: replay, messages, heartbeats, the end."""
    return S.run_to_end(J.stateful(job_events(spark, d), J.JobLog(), J.LOG))


def stream_on_change(spark, d):
    return S.run_to_end(J.stateful(job_events(spark, d), J.OnChange(), J.CHANGES))


def stream_in_flight(spark, d):
    """Requests and when they were answered; those of jobs that still run aren't yet."""
    return S.run_to_end(J.stateful(job_events(spark, d), J.InFlight(), J.ANSWERS))


#: Jobs in SQL: every event with the number of its job and whether that ran when it came.
JOBS_SQL = """WITH e AS (SELECT user_id::VARCHAR AS job, event_id AS seq, epoch_us(ts) // 3600000 AS ms, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'watch' WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS kind FROM events WHERE user_id IS NOT NULL),
 s AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('start', 'done', 'error') THEN kind END IGNORE NULLS) OVER (PARTITION BY job ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start', false) AS running FROM e),
 j AS (SELECT *, kind = 'start' AND NOT running AS new, sum((kind = 'start' AND NOT running)::INT) OVER (PARTITION BY job ORDER BY ms, seq) AS k FROM s),
 jb AS (SELECT job, k, min(ms) FILTER (new) AS started, min(ms) FILTER (running AND kind IN ('done', 'error')) AS ended, min(kind) FILTER (running AND kind IN ('done', 'error')) AS final FROM j WHERE k > 0 GROUP BY job, k),
 m AS (SELECT job, k, ms, (row_number() OVER (PARTITION BY job, k ORDER BY ms, seq) - 1)::INT AS n, 'm' || seq AS text FROM j WHERE running AND kind = 'message'),
 w AS (SELECT j.job, j.k, seq AS watcher, ms, kind, new, running OR new AS active, started, ended, final, NOT (running OR new) AND (started IS NULL OR ms - started > 600000) AS missing FROM j LEFT JOIN jb USING (job, k) WHERE kind IN ('start', 'watch'))"""


ORACLES = {
    "stream_job_log": JOBS_SQL + """
     SELECT job, watcher, ms AS at_ms, CASE WHEN missing THEN 'missing' WHEN new THEN 'started' ELSE 'reconnected' END AS kind, NULL::INT AS n, CASE WHEN kind = 'start' AND NOT new THEN (ms - started)::VARCHAR END AS text FROM w WHERE missing OR kind = 'start'
     UNION ALL SELECT job, watcher, greatest(w.ms, m.ms), 'message', n, text FROM w JOIN m USING (job, k) WHERE NOT missing
     UNION ALL SELECT job, watcher, greatest(ms, ended), final, NULL, NULL FROM w WHERE NOT missing AND final IS NOT NULL
     UNION ALL SELECT job, watcher, h, 'heartbeat', NULL, NULL FROM (SELECT job, watcher, unnest(range(ms + 5000, coalesce(ended, (SELECT max(ms) FROM e)), 5000)) AS h FROM w WHERE active)""",
    "stream_on_change": JOBS_SQL + " SELECT job, seq, ms, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY job ORDER BY ms, seq) AS b FROM e) WHERE b IS NULL OR b <> kind",
    "stream_in_flight": JOBS_SQL + " SELECT job, watcher AS seq, ms AS asked_ms, new AS computes, final AS kind, ended AS answered_ms FROM w WHERE kind = 'start' AND final IS NOT NULL",
    "progress_last_value": oracle("prog", "SELECT task_id, status, round(progress, 6) AS progress FROM prog QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1"),
    "progress_on_change": oracle("prog", "SELECT task_id, seq, status FROM (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY seq) AS b FROM prog) WHERE b IS NULL OR b <> status"),
    "message_tail": oracle("prog", "SELECT task_id, seq, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM prog) WHERE n > 60"),
    "running_pct": oracle("prog", "SELECT task_id, seq, least(70, 5 + floor(65 * count(*) OVER (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING) / 500::DOUBLE))::INT AS pct FROM prog"),
    "job_dedup_inflight": oracle("prog", "SELECT task_id, count(*) AS jobs FROM j GROUP BY task_id", ", j AS (SELECT task_id, min(ts) AS ts FROM prog WHERE task_id IS NOT NULL GROUP BY task_id UNION ALL SELECT j.task_id, (SELECT min(p.ts) FROM prog p WHERE p.task_id = j.task_id AND p.ts >= j.ts + INTERVAL 1 HOUR) FROM j WHERE (SELECT max(p.ts) FROM prog p WHERE p.task_id = j.task_id) >= j.ts + INTERVAL 1 HOUR)", recursive=True),
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
      k AS (SELECT user_id, k, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS e FROM s GROUP BY 1, 2)
      SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM k WHERE e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
