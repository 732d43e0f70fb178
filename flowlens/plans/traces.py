"""Queries of operators/traces.py and operators/sketches.py, and of column functions, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import columns as C
from flowlens.operators import sketches as K
from flowlens.operators import traces as X
from flowlens.sources import model as S

T, R, E = S.TASKS_SQL, f"{S.TASKS_SQL}, {S.RUNS_SQL}", S.EVENTS_SQL
NOW = lambda: S.as_of(S.TASKS_AS_OF)
N = f"TIMESTAMP '{S.TASKS_AS_OF}'"

_TIMER = "CASE WHEN task_id % 8 = 0 THEN attempt {0} END"
HISTORY_SQL = f"""h AS (SELECT task_id, attempt * 2 AS seq, CASE task_id % 4 WHEN 0 THEN 'SLEEP' WHEN 1 THEN 'WAIT' WHEN 2 THEN 'CONDITION' ELSE 'SIGNAL' END AS kind, CASE WHEN task_id % 4 = 3 THEN 'POINT' ELSE 'START' END AS phase, 'n' || (worker_id % 2) AS name, started_at AS ts, {_TIMER.format("")} AS timer_seq FROM runs
    UNION ALL SELECT task_id, attempt * 2 + 3, CASE task_id % 4 WHEN 0 THEN 'SLEEP' WHEN 1 THEN 'WAIT' ELSE 'CONDITION' END, CASE state WHEN 'FAILED' THEN 'TIMEOUT' ELSE 'END' END, 'n' || (worker_id % 2), finished_at, {_TIMER.format("- task_id // 8 % 3")} FROM runs WHERE finished_at IS NOT NULL AND task_id % 4 <> 3
    UNION ALL SELECT task_id, 1, CASE task_id % 4 WHEN 0 THEN 'SLEEP' ELSE 'CONDITION' END, 'END', 'n0', finished_at, NULL FROM runs WHERE attempt = 1 AND task_id % 4 IN (0, 2) AND task_id % 5 = 0
    UNION ALL SELECT task_id, 0, 'SLEEP', 'START', 'n0', started_at, NULL FROM runs WHERE attempt = 1 AND task_id % 8 = 0 AND task_id % 3 = 0),
s AS (SELECT *, lag(phase) OVER w AS p, lead(phase) OVER w AS e, lead(ts) OVER w AS finished_at FROM (SELECT *, CASE WHEN kind = 'WAIT' THEN name WHEN kind = 'SLEEP' THEN CAST(timer_seq AS VARCHAR) END AS slot FROM h) WHERE slot IS NOT NULL WINDOW w AS (PARTITION BY task_id, kind, slot ORDER BY seq)),
q AS (SELECT task_id, kind, seq, phase, ts FROM h WHERE kind = 'CONDITION' OR kind = 'SLEEP' AND timer_seq IS NULL UNION ALL SELECT task_id, kind, seq, phase, ts FROM s WHERE kind = 'SLEEP' AND phase <> 'START' AND p IS DISTINCT FROM 'START'),
b AS (SELECT *, sum(CASE WHEN phase = 'START' THEN 1 ELSE -1 END) OVER (PARTITION BY task_id, kind ORDER BY seq) AS b FROM q),
o AS (SELECT *, phase = 'START' OR b >= least(0, coalesce(min(b) OVER (PARTITION BY task_id, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ok FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id, kind, phase = 'START' ORDER BY seq) AS k FROM o WHERE ok),
f AS (SELECT task_id, kind, min(seq) FILTER (phase = 'START') AS seq, lower(kind) AS name, min(ts) FILTER (phase = 'START') AS started_at, min(ts) FILTER (phase <> 'START') AS finished_at, min(phase) FILTER (phase <> 'START') AS e FROM k GROUP BY task_id, kind, k)"""


def history(spark, d):
    """Starts and ends of runs; some ends come before all starts, some carry the number of another timer."""
    k, t, attempt = F.col("task_id") % 4, F.col("task_id"), F.col("attempt")
    name = F.concat(F.lit("n"), (F.col("worker_id") % 2).cast("string"))
    kind = F.when(k == 0, "SLEEP").when(k == 1, "WAIT").when(k == 2, "CONDITION").otherwise("SIGNAL")
    timer, none = lambda n: F.when(t % 8 == 0, attempt - n), F.lit(None).cast("long")
    row = lambda seq, phase, name, at, timer: F.struct(seq.alias("seq"), phase.alias("phase"), name.alias("name"), F.col(at).alias("at"), timer.alias("timer_seq"))
    phase, number = F.when(F.col("state") == "FAILED", F.lit("TIMEOUT")).otherwise("END"), lambda n: F.lit(n).cast("long")
    begin = row(attempt * 2, F.when(k == 3, "POINT").otherwise("START"), name, "started_at", timer(F.lit(0)))
    end = F.when(F.col("finished_at").isNotNull() & (k != 3), row(attempt * 2 + 3, phase, name, "finished_at", timer(F.floor(t / 8) % 3)))
    early = F.when((attempt == 1) & k.isin(0, 2) & (t % 5 == 0), row(number(1), F.lit("END"), F.lit("n0"), "finished_at", none))
    plain = F.when((attempt == 1) & (t % 8 == 0) & (t % 3 == 0), row(number(0), F.lit("START"), F.lit("n0"), "started_at", none))
    rows = S.runs(spark, d).select("task_id", kind.alias("kind"), F.explode(F.array(begin, end, early, plain)).alias("_h"))  # the runs are read once
    return rows.where("_h is not null").select("task_id", "kind", "_h.*")


def spans(spark, d):
    t = S.tasks(spark, d)
    return t.select("id", "parent_id", "kind", "state", "name", F.col("created_at").alias("queued_at"), F.when(F.col("id") % 5 != 0, F.timestamp_add("MINUTE", (F.col("id") % 7).cast("int"), F.col("created_at"))).alias("started_at"), F.col("completed_at").alias("finished_at"))


SPANS_SQL = "spans AS (SELECT id, parent_id, kind, state, name, created_at AS queued_at, CASE WHEN id % 5 <> 0 THEN created_at + to_minutes(id % 7) END AS started_at, completed_at AS finished_at FROM tasks)"


def waits(spark, d):
    """A wait per user of an event that has 1 of 100 payloads, or of any."""
    k = F.col("user_id")
    first = S.events(spark, d).groupBy("user_id", "queue").agg((F.min("created_at")).alias("created_at"))
    predicate = F.when(k % 5 == 0, "{}").otherwise(F.concat(F.lit('{"k": '), (k * 7 % 100).cast("string"), F.lit("}")))
    return first.select(k.alias("id"), "queue", F.when(k % 2 == 0, "click").otherwise("view").alias("name"), predicate.alias("predicate"), "created_at", F.when(k % 3 == 0, F.timestamp_add("DAY", F.lit(10), F.col("created_at"))).alias("timeout_at"))


WAITS_SQL = """w AS (SELECT user_id AS id, queue, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END AS name, CASE WHEN user_id % 5 <> 0 THEN user_id * 7 % 100 END AS want, min(created_at) AS created_at,
    CASE WHEN user_id % 3 = 0 THEN min(created_at) + INTERVAL 10 DAY END AS timeout_at FROM ev GROUP BY user_id, queue),
m AS (SELECT w.id AS wait_id, e.id AS event_id, e.created_at AS woken_at FROM w JOIN ev e ON e.queue = w.queue AND e.name = w.name AND e.created_at >= w.created_at AND (want IS NULL OR CAST(json_extract(e.payload, '$.k') AS BIGINT) = want)
    QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY e.created_at, e.id) = 1)"""

_BIN = f"CAST(ceil(ln(value) / {K.math.log(K.GAMMA)!r}) AS INTEGER)"
_DD = f"""b AS (SELECT name, {_BIN} AS bin, count(*) AS n, min(value) AS least, max(value) AS most FROM ev WHERE value > 0 GROUP BY 1, 2)"""


def _labels(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", C.sleep_label(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("label"))


def _uuids(spark, d):
    """A day per event; a UUID holds the lower 48 bits of its milliseconds, the era those above."""
    millis = F.col("event_id") * 86_400_000
    hexed, era = F.lpad(F.lower(F.hex(millis.bitwiseAND((1 << 48) - 1))), 12, "0"), F.shiftright(millis, 48)
    uuid = F.concat(F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.when(F.col("event_id") % 3 == 0, "-4").otherwise("-7"), F.lit("abc-8def-0123456789ab"))
    return S.table(spark, d, "events").select("event_id", C.uuid7_time(uuid, era).cast("timestamp_ntz").alias("at"))


def _durations(spark, d):
    text = F.concat(F.lit("P"), (F.col("l_quantity").cast("int") % 3).cast("string"), F.lit("M"), F.col("l_quantity").cast("int").cast("string"), F.lit("DT"), F.col("l_linenumber").cast("string"), F.lit("H"))
    rows = S.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", C.iso_duration(text).alias("d"))
    return rows.select("l_orderkey", C.add_duration(F.col("l_shipdate"), F.col("d"), -1).alias("before"), C.duration_seconds(F.col("d")).alias("seconds"))


QUERIES = {
    "history_spans": (
        lambda s, d: X.history_spans(history(s, d)),
        f"""WITH {R}, {HISTORY_SQL}, a AS (SELECT task_id, kind, seq, name, started_at, finished_at, e FROM f
            UNION ALL SELECT task_id, kind, seq, CASE WHEN kind = 'WAIT' THEN slot ELSE lower(kind) END, ts, finished_at, e FROM s WHERE phase = 'START' AND (e IS NULL OR e <> 'START')
            UNION ALL SELECT task_id, kind, seq, name, ts, ts, 'END' FROM h WHERE kind = 'SIGNAL')
        SELECT task_id, kind, seq, name, started_at, finished_at, CASE WHEN e IS NULL THEN 'RUNNING' WHEN e = 'TIMEOUT' THEN 'TIMED_OUT' ELSE 'COMPLETED' END AS state FROM a""",
    ),
    "trace_tree": (
        lambda s, d: X.trace_tree(spans(s, d), NOW()),
        f"""WITH RECURSIVE {T}, {SPANS_SQL}, b(root_id, zero, id, depth) AS (SELECT id, queued_at, id, 0 FROM spans WHERE parent_id IS NULL UNION ALL SELECT root_id, zero, s.id, depth + 1 FROM b JOIN spans s ON s.parent_id = b.id)
        SELECT root_id, id, CAST(depth AS INTEGER) AS depth, date_diff('microsecond', zero, queued_at) / 1000.0 AS start_ms, date_diff('microsecond', queued_at, coalesce(finished_at, {N})) / 1000.0 AS duration_ms, date_diff('microsecond', queued_at, coalesce(started_at, {N})) / 1000.0 AS queued_ms FROM b JOIN spans USING (id)""",
    ),
    "trace_filter": (
        lambda s, d: X.with_ancestors(spans(s, d), X.is_error(F.col("kind"), F.col("state")) & (F.col("name") == "2-HIGH")),
        f"""WITH RECURSIVE {T}, hit AS (SELECT id FROM tasks WHERE state IN ('FAILED', 'CRASHED') AND name = '2-HIGH'), up(id) AS (SELECT id FROM hit UNION SELECT t.parent_id FROM up JOIN tasks t ON t.id = up.id WHERE t.parent_id IS NOT NULL)
        SELECT id, id IN (SELECT id FROM hit) AS matched FROM up""",
    ),
    "emit_match": (lambda s, d: X.match_events(S.events(s, d), waits(s, d)), f"WITH {E}, {WAITS_SQL} SELECT wait_id, event_id, woken_at FROM m"),
    "await_event": (
        lambda s, d: X.await_outcome(waits(s, d), S.events(s, d), S.as_of(S.EVENTS_AS_OF)),
        f"""WITH {E}, {WAITS_SQL}, p AS (SELECT w.id, arg_max(e.id, e.created_at) AS prev FROM w JOIN ev e ON e.queue = w.queue AND e.name = w.name AND e.created_at < w.created_at AND (want IS NULL OR CAST(json_extract(e.payload, '$.k') AS BIGINT) = want) GROUP BY 1)
        SELECT w.id, CASE WHEN prev IS NOT NULL OR (woken_at IS NOT NULL AND (timeout_at IS NULL OR woken_at <= timeout_at)) THEN 'EVENT' WHEN timeout_at <= TIMESTAMP '{S.EVENTS_AS_OF}' THEN 'TIMED_OUT' ELSE 'WAITING' END AS state,
            coalesce(prev, CASE WHEN timeout_at IS NULL OR woken_at <= timeout_at THEN event_id END) AS event_id FROM w LEFT JOIN p USING (id) LEFT JOIN m ON wait_id = w.id""",
    ),
    "ddsketch": (lambda s, d: K.sketch(S.events(s, d), ["name"], "value"), f"WITH {E}, {_DD} SELECT * FROM b"),
    "ddsketch_quantiles": (
        lambda s, d: K.quantiles(K.sketch(S.events(s, d), ["name"], "value"), ["name"], (0.0, 0.5, 0.95, 0.99, 1.0)).withColumns({c: F.round(c, 6) for c in ("p0", "p50", "p95", "p99", "p100")}),
        f"""WITH {E}, {_DD}, c AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY name) AS al, min(least) OVER (PARTITION BY name) AS lo, max(most) OVER (PARTITION BY name) AS hi FROM b),
        v AS (SELECT *, least(greatest(pow({K.GAMMA!r}, bin - 0.5), lo), hi) AS x FROM c)
        SELECT name, CAST(sum(n) AS BIGINT) AS n, round(min(lo), 6) AS p0, round(min(x) FILTER (cum >= ceil(0.5 * al)), 6) AS p50, round(min(x) FILTER (cum >= ceil(0.95 * al)), 6) AS p95, round(min(x) FILTER (cum >= ceil(0.99 * al)), 6) AS p99, round(max(hi), 6) AS p100 FROM v GROUP BY name""",
    ),
    "ddsketch_merge": (
        lambda s, d: K.merge(*[K.sketch(S.events(s, d).where(F.col("id") % 3 == i), ["queue"], "value") for i in range(3)], keys=["queue"]),
        f"WITH {E} SELECT queue, {_BIN} AS bin, count(*) AS n, min(value) AS least, max(value) AS most FROM ev WHERE value > 0 GROUP BY 1, 2",
    ),
    "ddsketch_mean": (
        lambda s, d: K.mean(K.sketch(S.events(s, d), ["name"], "value"), ["name"]).withColumn("mean", F.round("mean", 6)),
        f"WITH {E}, {_DD} SELECT name, round(sum(pow({K.GAMMA!r}, bin - 0.5) * n) / sum(n), 6) AS mean FROM b GROUP BY name",
    ),
    "avg_duration": (
        lambda s, d: K.weighted_median(K.quantiles(K.sketch(S.events(s, d), ["name"], "value"), ["name"], (0.5,))).withColumn("avg_ms", F.round("avg_ms", 6)),
        f"""WITH {E}, {_DD}, c AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY name) AS al, min(least) OVER (PARTITION BY name) AS lo, max(most) OVER (PARTITION BY name) AS hi FROM b),
        m AS (SELECT name, sum(n) AS n, min(least(greatest(pow({K.GAMMA!r}, bin - 0.5), lo), hi)) FILTER (cum >= ceil(0.5 * al)) AS p50 FROM c GROUP BY 1) SELECT round(sum(p50 * n) / sum(n), 6) AS avg_ms FROM m""",
    ),
    "rate_ewma": (
        lambda s, d: K.smoothed_rate(S.events(s, d).groupBy("name", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")), "name", "day", "n", 86400.0).withColumn("rate", F.round("rate", 9)),
        f"""WITH RECURSIVE {E}, c AS (SELECT name, CAST(created_at AS DATE) AS day, count(*) / 86400.0 AS raw, row_number() OVER (PARTITION BY name ORDER BY CAST(created_at AS DATE)) AS k FROM ev GROUP BY 1, 2),
        r(name, day, k, rate) AS (SELECT name, day, k, raw FROM c WHERE k = 1 UNION ALL SELECT c.name, c.day, c.k, 0.25 * raw + 0.75 * rate FROM r JOIN c ON c.name = r.name AND c.k = r.k + 1) SELECT name, day, round(rate, 9) AS rate FROM r""",
    ),
    "sleep_label": (
        _labels,
        """WITH m AS (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN ms // 1000 || 's'
        WHEN ms < 3600000 THEN ms // 60000 || 'm' || CASE WHEN ms // 1000 % 60 > 0 THEN ' ' || ms // 1000 % 60 || 's' ELSE '' END
        WHEN ms < 86400000 THEN ms // 3600000 || 'h' || CASE WHEN ms // 60000 % 60 > 0 THEN ' ' || ms // 60000 % 60 || 'm' ELSE '' END
        ELSE ms // 86400000 || 'd' || CASE WHEN ms // 3600000 % 24 > 0 THEN ' ' || ms // 3600000 % 24 || 'h' ELSE '' END END AS label FROM m""",
    ),
    "uuid7_time": (_uuids, "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN TIMESTAMP '1970-01-01' + to_days(CAST(event_id AS INTEGER)) END AS at FROM events"),
    "iso_duration": (
        _durations,
        """SELECT l_orderkey, l_shipdate - to_months(q % 3) - to_days(q) - to_hours(l_linenumber) AS before, CAST(q % 3 * 30 * 86400 + q * 86400 + l_linenumber * 3600 AS BIGINT) AS seconds FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""",
    ),
}
