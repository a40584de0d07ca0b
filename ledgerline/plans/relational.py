"""Queries over the driver's tables, one per relational operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.adapter import LOG_SQL, WINDOW_MS, event_log, table
from ledgerline.operators import correlate, gaps, scope, timeline
from ledgerline.plans.verify import disclosed_overlap
from ledgerline.sinks import counts
from ledgerline.sources import captures, hooks
from ledgerline.streaming.captures import collector_counters
from ledgerline.operators.intervals import argv_overlap, best, interval_join, related_paths

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _log(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).select(F.col("session_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_id").alias("id"), "type", "us", "ms", F.col("ms").alias("mono"), "k", "value")


def _of(log: DataFrame, kind: str) -> DataFrame:
    return log.where(F.col("type") == kind)


def _targets(log: DataFrame, kind: str) -> DataFrame:
    return _of(log, kind).select("session", "seq", "ms", F.concat(F.lit("/w/"), F.col("k") % 4).alias("cwd"), F.array(F.col("k").cast("string"), F.lit("x")).alias("argv"))


def _pres(log: DataFrame) -> DataFrame:
    return _of(log, "intent").select("session", F.col("seq").alias("pre_seq"), F.col("ms").alias("pre_ms"), F.concat(F.lit("/w/"), F.col("k") % 4).alias("pre_cwd"), F.array(F.col("k").cast("string")).alias("pre_argv"))


# --- aggregates --------------------------------------------------------------------------


@query("a1_tool_summary", f"WITH {LOG_SQL} SELECT k AS tool, count(*) FILTER (WHERE type = 'intent') AS n_intent, count(*) FILTER (WHERE type = 'result') AS n_result FROM e GROUP BY k")
def a1_tool_summary(spark: SparkSession, d: str) -> DataFrame:
    return timeline.tool_summary(_log(spark, d).withColumnRenamed("k", "tool"), "tool", "type")


@query("a2_manifest_counts", f"""WITH {LOG_SQL} SELECT count(*) AS events, count(*) FILTER (WHERE type = 'gap') AS gaps, count(*) FILTER (WHERE type = 'effect') AS "artifactsPre", count(*) FILTER (WHERE type = 'effect') AS "artifactsPost",
7::BIGINT AS "destructiveOperations", count(*) FILTER (WHERE type = 'exec' AND k < 10) AS "capturesAttributed", 2::BIGINT AS "capturesExcluded" FROM e""")
def a2_manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    events = log.withColumn("type", F.when(F.col("type") == "effect", "file_diff").otherwise(F.col("type")))
    found = counts(events, 7, log.where("type = 'exec' and k < 10").count(), 2)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


_SCOPED = f"""WITH {LOG_SQL},
b AS (SELECT min(ms) + 86400000 - {scope.MARGIN_MS} AS low, min(ms) + 20 * 86400000 + {scope.MARGIN_MS} AS high FROM e),
r AS (SELECT event_id, ms, CASE WHEN k % 3 > 0 THEN session_id END AS rs, CASE WHEN k % 5 > 0 THEN '8' END AS own, k % 2 = 0 AS opted FROM e),
s AS (SELECT event_id, CASE WHEN rs IS NOT NULL AND own IS NOT NULL THEN CASE WHEN rs = own THEN 'include' ELSE 'other-session' END
        WHEN NOT opted THEN 'unattributed' WHEN rs IS NOT NULL THEN 'include'
        WHEN ms < low OR ms > high THEN 'outside-session-window' ELSE 'include' END AS decision FROM r, b)"""


@query("p3_scope_classify", _SCOPED + " SELECT event_id, decision FROM s")
def p3_scope_classify(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    first = log.agg(F.min("ms").alias("t0"))
    low, high = scope.window_bounds(F.col("t0") + 86_400_000, F.col("t0") + 20 * 86_400_000)
    rows = log.crossJoin(F.broadcast(first))  # one row
    decided = scope.decide(F.when(F.col("k") % 3 > 0, F.col("session_id")), F.when(F.col("k") % 5 > 0, F.lit("8")), F.col("k") % 2 == 0, F.col("ms"), low, high)
    return rows.select("event_id", decided.alias("decision"))


@query("a3_exclusion_histogram", _SCOPED + " SELECT decision AS reason, count(*) AS n FROM s WHERE decision <> 'include' GROUP BY 1")
def a3_exclusion_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scope.histogram(p3_scope_classify(spark, d))


@query("a4_session_bounds", f"WITH {LOG_SQL} SELECT session_id AS session, arg_min(ms, (us, event_id)) AS first, arg_max(ms, (us, event_id)) AS last FROM e GROUP BY 1")
def a4_session_bounds(spark: SparkSession, d: str) -> DataFrame:
    return timeline.bounds(_log(spark, d), ["session"], ["us", "seq"], "ms")


@query("a5_first_seen", f"""WITH {LOG_SQL}, f AS (SELECT session_id AS session, k, min((us, event_id)) AS seen FROM e GROUP BY ALL)
SELECT session, k, row_number() OVER (PARTITION BY session ORDER BY seen) AS place FROM f""")
def a5_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return timeline.first_seen(_log(spark, d), ["session"], "k", ["us", "seq"])


@query("a7_hour_runs", f"""WITH {LOG_SQL}, h AS (SELECT session_id AS session, event_id, us, strftime(make_timestamp(us), '%Y-%m-%dT%H') AS hour FROM e),
n AS (SELECT *, CASE WHEN hour IS DISTINCT FROM lag(hour) OVER w THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY session ORDER BY us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY us, event_id)::BIGINT AS section FROM n)
SELECT session, section, any_value(hour) AS hour, count(*) AS n FROM s GROUP BY 1, 2""")
def a7_hour_runs(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("wall_ts", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss"))
    return timeline.hour_sections(log, ["session"], ["us", "seq"], "wall_ts")


@query("a8_store_stats", "SELECT count(*) AS records, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes, 1700000000 + min(doc_id) AS oldest, 1700000000 + max(doc_id) AS newest, count(*) > 5000 OR sum(octet_length(encode(text))) > 25 * 1024 * 1024 AS warn FROM documents")
def a8_store_stats(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modified"))
    return captures.store_stats(files).withColumns({c: F.unix_seconds(c) for c in ("oldest", "newest")})


@query("a10_collector_counters", f"WITH {LOG_SQL} SELECT count(*) AS seen, count(*) FILTER (WHERE k % 4 > 1) AS recorded, count(*) FILTER (WHERE k % 4 <= 1) AS uncharacterized FROM e WHERE type = 'exec'")
def a10_collector_counters(spark: SparkSession, d: str) -> DataFrame:
    argv = F.when(F.col("k") % 4 > 1, F.array(F.lit("run"), F.col("k").cast("string"))).when(F.col("k") % 4 == 1, F.array().cast("array<string>"))
    return collector_counters(_log(spark, d).select(F.when(F.col("type") == "exec", "execve").otherwise("command").alias("kind"), F.struct(argv.alias("argv")).alias("r")))


# --- windows, order, sets ----------------------------------------------------------------


@query("w1_running_parent", f"""WITH {LOG_SQL} SELECT event_id AS seq, last_value(CASE WHEN type IN ('intent', 'result') THEN event_id END IGNORE NULLS)
OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM e""")
def w1_running_parent(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("type").isin("intent", "result"), F.col("seq"))
    return timeline.running_last(_log(spark, d), ["session"], ["us", "seq"], kept, "parent").select("seq", "parent")


@query("w2_ts_carry", f"""WITH {LOG_SQL} SELECT event_id AS seq, last_value(CASE WHEN k % 3 = 0 THEN ms END IGNORE NULLS)
OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM e""")
def w2_ts_carry(spark: SparkSession, d: str) -> DataFrame:
    return timeline.running_last(_log(spark, d), ["session"], ["us", "seq"], F.when(F.col("k") % 3 == 0, F.col("ms")), "carried", including=True).select("seq", "carried")


@query("w3_marker_lag", f"""WITH {LOG_SQL}, l AS (SELECT event_id AS seq, type, lag(CASE WHEN type = 'exec' THEN ms END) OVER (PARTITION BY session_id ORDER BY us, event_id) AS marker FROM e)
SELECT seq, marker FROM l WHERE type <> 'exec'""")
def w3_marker_lag(spark: SparkSession, d: str) -> DataFrame:
    marked = timeline.previous(_log(spark, d), ["session"], ["us", "seq"], F.when(F.col("type") == "exec", F.col("ms")), "marker")
    return marked.where("type <> 'exec'").select("seq", "marker")


@query("w6_counter", f"WITH {LOG_SQL} SELECT event_id AS seq, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) - 1 AS mono FROM e")
def w6_counter(spark: SparkSession, d: str) -> DataFrame:
    return timeline.counter(_log(spark, d).drop("mono"), ["session"], ["us", "seq"]).select("seq", "mono")


@query("o1_timeline_order", f"""WITH {LOG_SQL}, t AS (SELECT event_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M') AS wall_ts, k AS mono, type = 'gap' AS is_gap FROM e)
SELECT event_id, row_number() OVER (ORDER BY wall_ts, mono, is_gap DESC, event_id) AS place FROM t""")
def o1_timeline_order(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d).select("event_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm").alias("wall_ts"), F.col("k").alias("mono"), (F.col("type") == "gap").alias("is_gap"), F.lit(0).alias("src_ord"), F.col("event_id").alias("seq"))
    return global_places(log, timeline.order_columns(), "wall_ts").select("event_id", "place")


def global_places(rows: DataFrame, order: list, by: str) -> DataFrame:
    """rows with `place`, their position in a total order, without one task for all rows.

    Rows are numbered within each value of the leading order column and moved up by the
    number of rows with smaller values; only those counts are ordered as a whole.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    before = counts.select(F.col(by).alias("_by"), F.coalesce(F.sum("_n").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_at", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return numbered.join(before, F.col(by).eqNullSafe(F.col("_by"))).withColumn("place", (F.col("_at") + F.col("_before")).cast("long")).drop("_at", "_by", "_before")


@query("o3_children_order", f"""WITH {LOG_SQL} SELECT event_id AS seq, row_number() OVER (PARTITION BY session_id, k % 7 ORDER BY strftime(make_timestamp(us), '%Y-%m-%d'), event_id) AS child FROM e""")
def o3_children_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).select("session", (F.col("k") % 7).alias("parent"), "seq", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("wall_ts"))
    return timeline.children_order(rows).select("seq", "child")


@query("u1_union_sources", f"""WITH {LOG_SQL} SELECT 0 AS src_ord, event_id AS id, k FROM e WHERE type = 'intent' UNION ALL SELECT 1, event_id, k FROM e WHERE type = 'exec' UNION ALL SELECT 2, conv_id * 1000 + turn, NULL FROM conversations""")
def u1_union_sources(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    parts = [_of(log, "intent").select("id", "k"), _of(log, "exec").select("id", "k"), turns]
    out = [p.withColumn("src_ord", F.lit(n)) for n, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2], allowMissingColumns=True).select("src_ord", "id", "k")


@query("u2_dedup_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1""")
def u2_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return timeline.dedup_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_suppkey")


@query("u3_partition_check", """WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
d AS (SELECT DISTINCT l_orderkey AS i FROM lineitem WHERE l_orderkey % 3 > 0), w AS (SELECT o_orderkey AS i FROM orders WHERE o_orderkey % 3 <> 1),
r AS (SELECT unnest(range(n)) AS i FROM n)
SELECT count(*) FILTER (WHERE r.i IS NULL) AS outside, count(*) FILTER (WHERE d.i IS NULL AND w.i IS NULL) AS missing, count(*) FILTER (WHERE d.i IS NOT NULL AND w.i IS NOT NULL) AS both
FROM r FULL JOIN d ON d.i = r.i FULL JOIN w ON w.i = coalesce(r.i, d.i)""")
def u3_partition_check(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i")).where("i % 3 > 0").distinct()
    n = (orders.agg(F.max("i")).first()[0] or -1) + 1
    return partition_report(spark.range(n).withColumnRenamed("id", "i"), lines, orders.where("i % 3 <> 1"))


def partition_report(whole: DataFrame, one: DataFrame, other: DataFrame, key: str = "i") -> DataFrame:
    """How many keys lie outside of `whole`, in neither part, and in both."""
    marked = [df.select(key, F.lit(True).alias(f"_{n}")) for n, df in enumerate((whole, one, other))]
    both = marked[0].join(marked[1], key, "full_outer").join(marked[2], key, "full_outer")
    has = [F.col(f"_{n}").isNotNull() for n in range(3)]
    return both.agg(F.count_if(~has[0]).alias("outside"), F.count_if(~has[1] & ~has[2]).alias("missing"), F.count_if(has[1] & has[2]).alias("both"))


@query("u4_path_union", f"""WITH {LOG_SQL}, s AS (SELECT session_id AS session, list_sort(list_distinct(list(k) FILTER (WHERE type = 'intent'))) AS a, list_sort(list_distinct(list(k) FILTER (WHERE type = 'effect'))) AS b FROM e GROUP BY 1)
SELECT session, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS paths FROM s""")
def u4_path_union(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: F.collect_set(F.when(F.col("type") == t, F.col("k")))
    rows = _log(spark, d).groupBy("session").agg(own("intent").alias("a"), own("effect").alias("b"))
    return rows.select("session", F.array_join(F.array_sort(F.array_union("a", "b")).cast("array<string>"), ",").alias("paths"))


# --- joins -------------------------------------------------------------------------------

_J2 = f"""WITH {LOG_SQL},
t AS (SELECT session_id AS session, event_id AS seq, ms, k FROM e WHERE type = '%s'),
p AS (SELECT session_id AS session, event_id AS pre_seq, ms AS pre_ms, k AS pre_k FROM e WHERE type = 'intent'),
c AS (SELECT t.session, seq, pre_seq, pre_ms, (CASE WHEN k %% 4 = pre_k %% 4 THEN 10 ELSE 0 END + CASE WHEN k = pre_k THEN 5 ELSE 0 END + greatest(0, 10 - abs(ms - pre_ms) // 1000))::BIGINT AS score
      FROM t JOIN p ON t.session = p.session AND abs(ms - pre_ms) <= {WINDOW_MS}),
m AS (SELECT session, seq, pre_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY score DESC, pre_ms, pre_seq) AS n FROM c) WHERE n = 1 AND score >= 5)"""


@query("j2_interval_argmax", _J2 % "result" + " SELECT * FROM m")
def j2_interval_argmax(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return correlate.scored_matches(_targets(log, "result"), _pres(log), WINDOW_MS)


_J3 = (_J2 % "result") + _J2.partition(LOG_SQL)[2].replace("t AS", "t2 AS").replace("p AS", "p2 AS").replace("c AS", "c2 AS").replace("m AS", "m2 AS").replace("FROM t JOIN p ON t.session = p.session", "FROM t2 AS t JOIN p2 AS p ON t.session = p.session").replace("FROM c)", "FROM c2)") % "effect" + """,
x AS (SELECT m2.* FROM m2 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.session = m2.session AND m.pre_seq = m2.pre_seq)),
j3 AS (SELECT session, seq, pre_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY session, pre_seq ORDER BY seq) AS n FROM x) WHERE n = 1)"""


@query("j3_exclusive_argmax", _J3 + " SELECT * FROM j3")
def j3_exclusive_argmax(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    taken = correlate.scored_matches(_targets(log, "result"), _pres(log), WINDOW_MS)
    own = correlate.scored_matches(_targets(log, "effect"), _pres(log), WINDOW_MS)
    return correlate.exclusive(own, taken).select("session", "seq", "pre_seq", "score")


@query("j1_lookup_last", f"""WITH {LOG_SQL}, i AS (SELECT session_id AS session, k, arg_max(event_id, event_id) AS intent FROM e WHERE type = 'intent' GROUP BY ALL)
SELECT e.event_id AS seq, i.intent FROM e LEFT JOIN i ON i.session = e.session_id AND i.k = e.k WHERE e.type = 'result'""")
def j1_lookup_last(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    lookup = correlate.last_by_key(_of(log, "intent").select("session", "k", "seq", F.col("seq").alias("intent")), ["session", "k"], "seq", ["intent"])
    return _of(log, "result").select("session", "k", "seq").join(lookup, ["session", "k"], "left").select("seq", "intent")


@query("j4_claim_first", f"""WITH {LOG_SQL}, n AS (SELECT f.session_id AS session, f.event_id AS seq, i.event_id AS intent_seq FROM e f JOIN e i ON f.type = 'effect' AND i.type = 'intent' AND i.session_id = f.session_id AND i.event_id = f.event_id - f.k)
SELECT session, seq, intent_seq, seq = min(seq) OVER (PARTITION BY session, intent_seq) AS claims FROM n""")
def j4_claim_first(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    effects = _of(log, "effect").select("session", "seq", (F.col("seq") - F.col("k")).alias("intent_id"))
    intents = _of(log, "intent").select("session", F.col("seq").alias("intent_id"), F.col("seq").alias("intent_seq"))
    return correlate.claim_recorded(effects, intents).drop("intent_id")


@query("j5_claim_nearest")
def j5_claim_nearest(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    effects = _of(log, "effect").select("session", "seq", "ms", F.when(F.col("k") % 3 == 0, F.col("seq") - F.col("k")).alias("intent_id"), (F.col("k") % 5).cast("string").alias("input_hash"))
    intents = _of(log, "intent").select("session", F.col("seq").alias("intent_seq"), F.col("ms").alias("intent_ms"), F.col("seq").alias("intent_id"), (F.col("k") % 5).cast("string").alias("intent_hash"))
    return correlate.claim_effects(effects, intents, WINDOW_MS)


_J6 = f"""WITH {LOG_SQL}, r AS (SELECT session_id AS session, k % 10 AS path, event_id AS seq, type = 'effect' AS wrote, CASE WHEN value > 10 THEN floor(value)::BIGINT % 3 END AS hash FROM e WHERE type IN ('effect', 'intent')),
l AS (SELECT *, last_value(CASE WHEN wrote THEN {{'h': hash, 's': seq}} END IGNORE NULLS) OVER (PARTITION BY session, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r)"""


@query("j6_last_value_before", _J6 + " SELECT session, path, seq, hash, p.h AS previous_hash, p.s AS previous_seq FROM l WHERE NOT wrote AND p IS NOT NULL AND p.h IS DISTINCT FROM hash")
def j6_last_value_before(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("hash", F.when(F.col("value") > 10, F.floor("value") % 3)).withColumn("path", F.col("k") % 10)
    effects = _of(log, "effect").select("session", "path", "seq", F.col("hash").alias("post_hash"), F.col("seq").alias("event_id"))
    reads = _of(log, "intent").select("session", "path", "seq", F.col("hash").alias("pre_hash"), F.col("seq").alias("event_id"))
    return correlate.file_breaks(effects, reads).select("session", "path", "seq", "hash", "previous_hash", F.col("previous_event_id").alias("previous_seq"))


_J7 = f"""WITH {LOG_SQL}, c AS (SELECT x.session_id AS session, x.event_id AS seq, i.event_id AS intent_seq, row_number() OVER (PARTITION BY x.session_id, x.event_id ORDER BY abs(x.ms - i.ms), i.ms, i.event_id) AS n
FROM e x JOIN e i ON x.type = 'exec' AND i.type = 'intent' AND x.session_id = i.session_id AND x.ms - i.ms BETWEEN -{6 * 3_600_000} AND {WINDOW_MS} AND list_has_any([x.k, x.k % 7], [i.k, i.k % 7])),
m AS (SELECT session, seq, intent_seq FROM c WHERE n = 1)"""


@query("j7_overlap_interval", _J7 + " SELECT * FROM m")
def j7_overlap_interval(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    execs = _of(log, "exec").select("session", "seq", "ms", F.array("k", F.col("k") % 7).alias("pids"))
    intents = _of(log, "intent").select("session", F.col("seq").alias("intent_seq"), F.col("ms").alias("intent_ms"), F.array("k", F.col("k") % 7).alias("intent_pids"))
    return correlate.kernel_matches(execs, intents, WINDOW_MS, 6 * 3_600_000)


@query("j8_parent_earlier", """SELECT c.conv_id, c.turn, p.turn AS attached FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = (c.turn * 7 + c.conv_id) % 5 AND p.turn < c.turn""")
def j8_parent_earlier(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), ((F.col("turn") * 7 + F.col("conv_id")) % 5).alias("parent"), F.col("turn").alias("seq"))
    return correlate.attach_parents(turns).select(F.col("session").alias("conv_id"), F.col("id").alias("turn"), "attached")


@query("j10_full_outer_diff", """WITH a AS (SELECT o_orderkey AS path, o_custkey AS digest FROM orders WHERE o_orderkey % 5 > 0),
b AS (SELECT l_orderkey AS path, min(l_partkey) % 1500 AS digest FROM lineitem WHERE l_orderkey % 7 > 0 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.digest = b.digest THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def j10_full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("digest"))
    found = table(spark, d, "lineitem").where("l_orderkey % 7 > 0").groupBy(F.col("l_orderkey").alias("path")).agg((F.min("l_partkey") % 1500).alias("digest"))
    return file_diff(listed, found)


def file_diff(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) with state same, changed, added (not listed) or deleted (not found)."""
    both = listed.select("path", F.lit(True).alias("_l"), F.col("digest").alias("_a")).join(found.select("path", F.lit(True).alias("_f"), F.col("digest").alias("_b")), "path", "full_outer")
    state = F.when(F.col("_l").isNull(), "added").when(F.col("_f").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return both.select("path", state.alias("state"))


@query("j12_overlap_lines", "SELECT a.l_orderkey AS idx FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.l_returnflag || a.l_linestatus <> b.l_returnflag || b.l_linestatus")
def j12_overlap_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    side = lambda n: lines.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("idx"), F.concat("l_returnflag", "l_linestatus").alias("line"))
    return disclosed_overlap(side(1), side(2))


@query("j13_opening_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j13_opening_semi(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").where("l_linenumber in (1, 3)").select("l_orderkey", "l_linenumber").join(chosen, "l_orderkey", "left_semi")


@query("j16_state_merge", f"""WITH {LOG_SQL}, a AS (SELECT session_id AS session, k AS path, max(floor(value)::BIGINT % 4) AS h FROM e WHERE type = 'intent' GROUP BY ALL), b AS (SELECT session_id AS session, k AS path, max(floor(value)::BIGINT % 4) AS h FROM e WHERE type = 'effect' GROUP BY ALL)
SELECT coalesce(a.session, b.session) AS session, coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'created' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.session = b.session AND a.path = b.path""")
def j16_state_merge(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    side = lambda t, n: _of(log, t).groupBy("session", F.col("k").alias("path")).agg(F.max(F.floor("value") % 4).alias(n))
    return state_changes(side("intent", "pre").join(side("effect", "post"), ["session", "path"], "full_outer"))


def state_changes(both: DataFrame) -> DataFrame:
    pre, post = F.col("pre"), F.col("post")
    change = F.when(pre.isNull(), "created").when(post.isNull(), "deleted").when(pre == post, "unchanged").otherwise("modified")
    return both.select("session", "path", change.alias("change"))


@query("j17_revocation", "SELECT s_suppkey, coalesce(lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_regionkey = 1), false) AS revoked FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j17_revocation(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    revoked = nations.where("n_regionkey = 1").select(F.lower("n_name").alias("key")).distinct().withColumn("revoked", F.lit(True))
    named = table(spark, d, "supplier").join(nations.select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("key")), "s_nationkey", "left")
    return named.join(revoked, "key", "left").select("s_suppkey", F.coalesce("revoked", F.lit(False)).alias("revoked"))


# --- gaps --------------------------------------------------------------------------------


@query("g1_unmatched_left", _J2 % "result" + " SELECT t.session, t.seq AS parent, 'tool_result_without_pre_capture' AS reason, ms, ms + 1 AS mono FROM t LEFT JOIN m ON m.session = t.session AND m.seq = t.seq WHERE m.seq IS NULL")
def g1_unmatched_left(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    matched = correlate.scored_matches(_targets(log, "result"), _pres(log), WINDOW_MS)
    left = gaps.unmatched(_of(log, "result"), matched, ["session", "seq"])
    return gaps.gap_rows(left, "tool_result_without_pre_capture").drop("affected", "detail")


@query("g2_unmatched_right", _J3 + " SELECT p.session, p.pre_seq AS parent, 'pre_capture_without_tool_result' AS reason, pre_ms AS ms, pre_ms + 1 AS mono FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pre_seq = p.pre_seq) AND NOT EXISTS (SELECT 1 FROM j3 WHERE j3.pre_seq = p.pre_seq)")
def g2_unmatched_right(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    taken = correlate.scored_matches(_targets(log, "result"), _pres(log), WINDOW_MS)
    own = correlate.exclusive(correlate.scored_matches(_targets(log, "effect"), _pres(log), WINDOW_MS), taken)
    matched = taken.select("session", F.col("pre_seq").alias("seq")).union(own.select("session", F.col("pre_seq").alias("seq")))
    return gaps.gap_rows(gaps.unmatched(_of(log, "intent"), matched, ["session", "seq"]), "pre_capture_without_tool_result").drop("affected", "detail")


@query("g3_guarded_absence", f"""WITH {LOG_SQL}, c AS (SELECT DISTINCT i.event_id FROM e f JOIN e i ON f.type = 'effect' AND i.type = 'intent' AND i.session_id = f.session_id AND i.event_id = f.event_id - f.k)
SELECT session_id AS session, event_id AS parent, 'intent_without_effect' AS reason, ms, ms + 1 AS mono FROM e WHERE type = 'intent' AND event_id NOT IN (SELECT event_id FROM c) AND session_id IN (SELECT session_id FROM e WHERE type = 'effect' AND k < 20)""")
def g3_guarded_absence(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    claimed = j4_claim_first(spark, d).select("session", F.col("intent_seq").alias("seq"))
    left = gaps.guarded_absence(_of(log, "intent"), claimed, _of(log, "effect").where("k < 20"), ["session", "seq"])
    return gaps.gap_rows(left, "intent_without_effect").drop("affected", "detail")


@query("g4_effect_without_intent", f"""WITH {LOG_SQL} SELECT f.session_id AS session, f.event_id AS parent, 'effect_without_intent' AS reason, f.ms, f.ms + 1 AS mono FROM e f WHERE f.type = 'effect'
AND NOT EXISTS (SELECT 1 FROM e i WHERE i.type = 'intent' AND i.session_id = f.session_id AND i.event_id = f.event_id - f.k)""")
def g4_effect_without_intent(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    left = gaps.unmatched(_of(log, "effect"), j4_claim_first(spark, d), ["session", "seq"])
    return gaps.gap_rows(left, "effect_without_intent").drop("affected", "detail")


@query("g5_unwitnessed_change", _J6 + """ SELECT l.session, seq AS parent, 'unwitnessed_file_change' AS reason, p.s || ',' || seq AS affected, e.ms, e.ms + 2 AS mono FROM l JOIN e ON e.event_id = l.seq WHERE NOT wrote AND p IS NOT NULL AND p.h IS DISTINCT FROM hash""")
def g5_unwitnessed_change(spark: SparkSession, d: str) -> DataFrame:
    broken = j6_last_value_before(spark, d).select("session", "seq", "previous_seq")
    rows = _of(_log(spark, d), "intent").join(broken, ["session", "seq"])
    found = gaps.gap_rows(rows, "unwitnessed_file_change", F.array(F.col("previous_seq"), F.col("seq")))
    return found.withColumn("affected", F.array_join(F.col("affected").cast("array<string>"), ",")).drop("detail")


@query("g6_unhooked_exec", _J7 + " SELECT session_id AS session, event_id AS parent, 'kernel_execve_without_hook' AS reason, ms, ms + 1 AS mono FROM e WHERE type = 'exec' AND event_id NOT IN (SELECT seq FROM m)")
def g6_unhooked_exec(spark: SparkSession, d: str) -> DataFrame:
    left = gaps.unmatched(_of(_log(spark, d), "exec"), j7_overlap_interval(spark, d), ["session", "seq"])
    return gaps.gap_rows(left, "kernel_execve_without_hook").drop("affected", "detail")


@query("j11_gap_coverage", f"""WITH {LOG_SQL}, g AS (SELECT session_id AS session, event_id - k AS id FROM e WHERE type = 'gap')
SELECT session_id AS session, event_id AS id FROM e WHERE type = 'intent' AND NOT EXISTS (SELECT 1 FROM g WHERE g.session = e.session_id AND g.id = e.event_id)""")
def j11_gap_coverage(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    held = _of(log, "gap").select("session", F.lit("intent_without_effect").alias("reason"), F.array(F.col("seq") - F.col("k")).alias("affected"))
    conditions = _of(log, "intent").select("session", F.lit("intent_without_effect").alias("reason"), "id")
    return gaps.uncovered(conditions, held).select("session", "id")


_FLAGSHIP = _J3 + """
SELECT 'linked' AS reason, (SELECT count(*) FROM m) + (SELECT count(*) FROM j3) AS n UNION ALL
SELECT 'tool_result_without_pre_capture', count(*) FROM t LEFT JOIN m ON m.seq = t.seq WHERE m.seq IS NULL UNION ALL
SELECT 'pre_capture_without_tool_result', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pre_seq = p.pre_seq) AND NOT EXISTS (SELECT 1 FROM j3 WHERE j3.pre_seq = p.pre_seq)"""


@query("flagship_gap_report", _FLAGSHIP)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Correlate by interval arg-max, emit both kinds of gap rows and count all by reason."""
    log = _log(spark, d)
    taken = correlate.scored_matches(_targets(log, "result"), _pres(log), WINDOW_MS)
    own = correlate.exclusive(correlate.scored_matches(_targets(log, "effect"), _pres(log), WINDOW_MS), taken)
    linked = taken.select("session", "seq", "pre_seq").union(own.select("session", "seq", "pre_seq"))
    left = gaps.gap_rows(gaps.unmatched(_of(log, "result"), taken, ["session", "seq"]), "tool_result_without_pre_capture")
    right = gaps.gap_rows(gaps.unmatched(_of(log, "intent"), linked.select("session", F.col("pre_seq").alias("seq")), ["session", "seq"]), "pre_capture_without_tool_result")
    return left.unionByName(right).select("reason").union(linked.select(F.lit("linked").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


# --- predicates and scalar functions -----------------------------------------------------


@query("p14_in_tree", f"WITH {LOG_SQL} SELECT event_id, k % 3 = 1 AND k <> 1 AS inside FROM e WHERE type = 'exec'")
def p14_in_tree(spark: SparkSession, d: str) -> DataFrame:
    execs = _of(_log(spark, d), "exec")
    return execs.select(F.col("id").alias("event_id"), scope.in_tree(F.array("k", F.col("k") % 3), F.col("k"), F.lit(1)).alias("inside"))


@query("p15_sanitize", r"""SELECT doc_id, substr(replace(regexp_replace(split_part(text, chr(10), 1), '[\x00-\x1F\x7F]', ' ', 'g'), 'the', '~'), 1, 300) AS message FROM documents""")
def p15_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scope.sanitized(F.col("text"), F.lit("the")).alias("message"))


@query("f8_related_paths", "SELECT p_partkey, starts_with(lower(p_name), lower(p_type)) OR starts_with(lower(p_type), lower(p_name)) OR starts_with(lower(p_name), left(lower(p_name), 3)) AS related FROM part")
def f8_related_paths(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    prefix = F.concat(F.upper(F.substring("p_name", 1, 3)), F.lit("//"))
    return part.select("p_partkey", (related_paths(F.col("p_name"), F.col("p_type")) | related_paths(F.col("p_name"), prefix)).alias("related"))


@query("f9_argv_overlap", """WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS a FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.a AS x, b.a AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, list_sum([CASE WHEN i <= least(len(x), len(y)) AND x[i] = y[i] THEN 1 ELSE 0 END for i in range(1, 6)])::BIGINT AS overlap FROM p""")
def f9_argv_overlap(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", argv_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query("f10_truncate", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '... (' || length(text) || ' chars, full argv in the linked event)' END AS shown FROM documents")
def f10_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", truncated(F.col("text")).alias("shown"))


def truncated(text, most: int = 200):
    cut = F.concat(F.substring(text, 1, most), F.lit("... ("), F.length(text), F.lit(" chars, full argv in the linked event)"))
    return F.when(F.length(text) <= most, text).otherwise(cut)


@query("f11_describe_hash", "SELECT event_id, CASE WHEN value > 40 THEN 'absent' ELSE 'sha256:' || left(sha256(event_id::VARCHAR), 12) END AS state FROM events")
def f11_describe_hash(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", described(F.when(~(F.col("value") > 40), F.sha2(F.col("event_id").cast("string"), 256))).alias("state"))


def described(digest):
    return F.coalesce(F.concat(F.lit("sha256:"), F.substring(digest, 1, 12)), F.lit("absent"))


_COMMAND = "replace(replace(replace(html, '<', ' '), '>', ' '), '=\"', ' ')"


@query("f18_extract_paths", rf"""SELECT page_id, array_to_string(regexp_extract_all({_COMMAND}, '(^|[ \t\n\f\r\x0B])(\.{{0,2}}/[^ \t\n\f\r\x0B;|&<>()''"`$]+)', 2), ' ') AS paths FROM pages""")
def f18_extract_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages taken as command lines: their tags fall apart into words, many of which are paths."""
    return table(spark, d, "pages").select("page_id", F.array_join(hooks.paths(F.expr(_COMMAND)), " ").alias("paths"))


@query("f28_parse_mono", "SELECT event_id, CASE WHEN regexp_matches(s, '^(0|[1-9][0-9]*)$') THEN TRY_CAST(s AS BIGINT) END AS mono FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '0' || event_id WHEN 2 THEN '99999999999' || (10000000000 + event_id) ELSE event_id || 'ns' END AS s FROM events)")
def f28_parse_mono(spark: SparkSession, d: str) -> DataFrame:
    e, r = F.col("event_id"), F.col("event_id") % 4
    text = F.when(r == 0, e.cast("string")).when(r == 1, F.concat(F.lit("0"), e)).when(r == 2, F.concat(F.lit("99999999999"), F.lit(10_000_000_000) + e)).otherwise(F.concat(e, F.lit("ns")))
    return table(spark, d, "events").select("event_id", mono_ns(text).alias("mono"))


def mono_ns(text):
    """A 64-bit count from its decimal text; anything else is null."""
    return F.when(text.rlike("^(0|[1-9][0-9]*)$"), text.try_cast("bigint"))


@query("f31_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def f31_escape_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(escaped(F.col("html")).cast("binary")).alias("digest"))


def escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


@query("d3_root_depth", """WITH RECURSIVE p AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 - (turn * 3 + conv_id) % least(turn, 2) END AS parent FROM conversations),
c AS (SELECT p.conv_id, p.turn, q.turn AS parent FROM p LEFT JOIN p q ON q.conv_id = p.conv_id AND q.turn = p.parent),
r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM c WHERE parent IS NULL UNION ALL SELECT c.conv_id, c.turn, r.root, r.depth + 1 FROM r JOIN c ON c.conv_id = r.conv_id AND c.parent = r.turn)
SELECT conv_id, turn, root, depth::BIGINT AS depth FROM r""")
def d3_root_depth(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    turns = table(spark, d, "conversations").select(c.alias("session"), t.alias("id"), t.alias("seq"), F.when(t > 0, t - 1 - (t * 3 + c) % F.greatest(F.least(t, F.lit(2)), F.lit(1))).alias("parent"))
    held = correlate.attach_parents(turns).select("session", "id", F.col("attached").alias("parent"))
    return timeline.forest(held).select(F.col("session").alias("conv_id"), F.col("id").alias("turn"), "root", "depth")


@query("interval_nearest", f"""WITH {LOG_SQL}, c AS (SELECT x.event_id AS seq, i.event_id AS other, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(x.ms - i.ms), i.ms, i.event_id) AS n FROM e x JOIN e i ON x.type = 'effect' AND i.type = 'intent' AND x.session_id = i.session_id AND i.ms - x.ms BETWEEN -{WINDOW_MS} AND 0)
SELECT seq, other FROM c WHERE n = 1""")
def interval_nearest(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    pairs = interval_join(_of(log, "effect").select("session", "seq", "ms"), _of(log, "intent").select("session", F.col("seq").alias("other"), F.col("ms").alias("other_ms")), ["session"], "ms", "other_ms", WINDOW_MS, 0)
    return best(pairs, ["seq"], [F.abs(F.col("ms") - F.col("other_ms")), F.col("other_ms"), F.col("other")], ["other"])
