"""Queries over the driver's tables for hashing, chains, trees, commitments and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.adapter import LOG_SQL, event_log, table
from ledgerline.functions import jcs, ulid
from ledgerline.functions.shell import words
from ledgerline.operators import integrity, rules

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


_HASHED = f"""{LOG_SQL},
m AS (SELECT session_id AS session, event_id, sha256('{{"k":' || k || '}}') AS ph,
  '{{"agentId":"agent","id":"' || event_id || '","monoNs":"' || us || '","parentEventId":null,"payloadHash":"' || sha256('{{"k":' || k || '}}') || '","sessionId":"' || session_id || '","type":"' || type || '","wallTs":"' || ms || '"}}' AS md FROM e)"""


def hashed_log(spark: SparkSession, d: str) -> DataFrame:
    """The event log with payload hash and metadata of every event."""
    log = event_log(spark, d).withColumn("payload_hash", F.sha2(F.concat(F.lit('{"k":'), F.col("k"), F.lit("}")).cast("binary"), 256))
    fields = {"agentId": F.lit("agent"), "id": F.col("event_id"), "monoNs": F.col("us"), "parentEventId": F.lit(None), "payloadHash": F.col("payload_hash"), "sessionId": F.col("session_id"), "type": F.col("type"), "wallTs": F.col("ms")}
    return log.select(F.col("session_id").alias("session"), "event_id", "payload_hash", integrity.metadata_json(fields).alias("metadata"))


@query("f1_canonical_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def f1_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", jcs.jcs("props").alias("canonical"))


@query("f2_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f2_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_ULID = f"""WITH {LOG_SQL}, h AS (SELECT event_id, ms, sha256('log|' || event_id) AS h FROM e),
n AS (SELECT event_id, ms, ('0x' || substr(h, 1, 10))::BIGINT AS a, ('0x' || substr(h, 11, 10))::BIGINT AS b FROM h),
u AS (SELECT event_id, ms, array_to_string([substr('{ulid.ALPHABET}', ((ms >> (5 * i)) % 32 + 1)::INT, 1) for i in range(9, -1, -1)], '') || array_to_string([substr('{ulid.ALPHABET}', ((a >> (5 * i)) % 32 + 1)::INT, 1) for i in range(7, -1, -1)], '') || array_to_string([substr('{ulid.ALPHABET}', ((b >> (5 * i)) % 32 + 1)::INT, 1) for i in range(7, -1, -1)], '') AS id FROM n)
SELECT event_id, id, true AS valid, ms FROM u"""


@query("f3_ulid", _ULID)
def f3_ulid(spark: SparkSession, d: str) -> DataFrame:
    made = event_log(spark, d).select("event_id", ulid.from_time(F.col("ms"), F.lit("log"), F.col("event_id")).alias("id"))
    return made.select("event_id", "id", ulid.is_valid(F.col("id")).alias("valid"), ulid.to_time(F.col("id")).alias("ms"))


@query("f4_seeded_salt", "SELECT event_id, sha256('salt:seed:' || event_id) AS salt FROM events")
def f4_seeded_salt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", integrity.seeded_salt("seed", F.col("event_id")).alias("salt"))


@query("f6_correlator_words")
def f6_correlator_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(words("text")).cast("long").alias("n_words"))


@query("f14_commitment", "SELECT doc_id, sha256('[\"' || sha256('salt:doc:' || doc_id) || '\",\"/lang\",\"' || lang || '\"]') AS digest FROM documents")
def f14_commitment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    salt = integrity.seeded_salt("doc", F.col("doc_id"))
    return docs.select("doc_id", integrity.commitment(salt, F.lit("/lang"), integrity.json_text(F.col("lang"))).alias("digest"))


@query("f22_uuid8", """WITH h AS (SELECT event_id, sha256('ns:' || event_id) AS h FROM events)
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::BIGINT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def f22_uuid8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", integrity.uuid8("ns", F.col("event_id").cast("string")).alias("id"))


@query("h2_metadata_json", f"WITH {_HASHED} SELECT event_id, md AS metadata FROM m")
def h2_metadata_json(spark: SparkSession, d: str) -> DataFrame:
    return hashed_log(spark, d).select("event_id", "metadata")


@query("h3_chain_root", f"WITH {_HASHED} SELECT session, list_reduce(list(ph || md ORDER BY event_id), lambda a, x: sha256(unhex(a) || encode(x)), repeat('00', 32)) AS root_hash, count(*) AS n FROM m GROUP BY 1")
def h3_chain_root(spark: SparkSession, d: str) -> DataFrame:
    return integrity.chain_root(hashed_log(spark, d), ["session"], "event_id")


_CHAIN = f"""WITH RECURSIVE {_HASHED},
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_id) AS n FROM m),
c AS (SELECT session, n, event_id, sha256(unhex(repeat('00', 32)) || encode(ph || md)) AS h FROM o WHERE n = 1
      UNION ALL SELECT o.session, o.n, o.event_id, sha256(unhex(c.h) || encode(o.ph || o.md)) FROM c JOIN o ON o.session = c.session AND o.n = c.n + 1)"""


@query("h3_chain_hashes", _CHAIN + " SELECT event_id, h AS chain_hash FROM c")
def h3_chain_hashes(spark: SparkSession, d: str) -> DataFrame:
    return integrity.chain(hashed_log(spark, d), ["session"], "event_id").select("event_id", "chain_hash")


@query("h4_chain_verify", _CHAIN + """, s AS (SELECT session, event_id, CASE WHEN event_id % 97 = 0 THEN sha256(h) ELSE h END AS stored FROM c),
l AS (SELECT s.*, ph, md, lag(stored, 1, repeat('00', 32)) OVER (PARTITION BY s.session ORDER BY s.event_id) AS before FROM s JOIN m USING (event_id))
SELECT session, event_id FROM l WHERE stored <> sha256(unhex(before) || encode(ph || md))""")
def h4_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    stored = integrity.chain(hashed_log(spark, d), ["session"], "event_id")
    altered = F.when(F.col("event_id") % 97 == 0, F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash"))
    return integrity.chain_breaks(stored.withColumn("chain_hash", altered), ["session"], "event_id").select("session", "event_id")


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = hashed_log(spark, d)
    place = F.row_number().over(W.partitionBy("session").orderBy("event_id")) - 1
    return rows.select("session", place.alias("idx"), integrity.leaf(F.unhex("payload_hash")).alias("hash"))


@query("h5_merkle_root", f"""WITH RECURSIVE {_HASHED},
t AS (SELECT session, list(sha256(unhex('00') || unhex(ph)) ORDER BY event_id) AS hs FROM m GROUP BY 1
      UNION ALL SELECT session, [CASE WHEN 2 * i + 2 <= len(hs) THEN sha256(unhex('01') || unhex(hs[2 * i + 1]) || unhex(hs[2 * i + 2])) ELSE hs[2 * i + 1] END for i in range((len(hs) + 1) // 2)] FROM t WHERE len(hs) > 1)
SELECT session, hs[1] AS merkle_root FROM t WHERE len(hs) = 1""")
def h5_merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return integrity.merkle_roots(_leaves(spark, d), ["session"])


@query("h7_inclusion", f"""WITH {_HASHED}, n AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY session) AS n FROM m)
SELECT session, idx, list_sum([CASE WHEN xor(idx >> l, 1) < (n + (1 << l) - 1) >> l AND (n + (1 << l) - 1) >> l > 1 THEN 1 ELSE 0 END for l in range(20)])::BIGINT AS steps, true AS proven FROM n""")
def h7_inclusion(spark: SparkSession, d: str) -> DataFrame:
    proofs = integrity.proven_leaves(_leaves(spark, d), ["session"])
    return proofs.select("session", F.col("idx").cast("long").alias("idx"), F.size("path").cast("long").alias("steps"), (integrity.proven_root(F.col("hash"), F.col("path")) == F.col("merkle_root")).alias("proven"))


@query("j9_openings", f"""WITH {LOG_SQL}, p AS (SELECT event_id, 'k' AS path, sha256('[\"' || sha256('salt:s:' || event_id) || '\",\"/k\",' || k || ']') AS digest FROM e WHERE k % 4 > 0),
o AS (SELECT event_id, 'k' AS path, CASE WHEN event_id % 50 = 0 THEN k + 1 ELSE k END AS v FROM e WHERE k % 5 > 0)
SELECT coalesce(p.event_id, o.event_id) AS event_id, 'k' AS path, CASE WHEN o.event_id IS NULL THEN 'unopened' WHEN p.event_id IS NULL THEN 'orphan' WHEN o.event_id % 50 > 0 THEN 'ok' ELSE 'mismatch' END AS state
FROM p FULL JOIN o ON p.event_id = o.event_id""")
def j9_openings(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    digest = lambda v: integrity.commitment(integrity.seeded_salt("s", F.col("event_id")), F.lit("/k"), v.cast("string"))
    placeholders = log.where("k % 4 > 0").select("event_id", F.lit("k").alias("path"), digest(F.col("k")).alias("digest"))
    openings = log.where("k % 5 > 0").select("event_id", F.lit("k").alias("path"), F.when(F.col("event_id") % 50 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("value"))
    return integrity.opening_report(placeholders, openings, digest(F.col("value")))


#: Rules over the words of the synthetic conversations, in the shape of the real ones.
_RULES = (
    ("head", "critical", ["the"], None, None, None),
    ("head-two", "high", ["and", "the"], None, None, None),
    ("contains", "medium", None, ["tion"], None, None),
    ("head-contains", "high", ["de"], ["la"], None, None),
    ("any", "low", None, None, "(?i)^en.*on$", None),
    ("line", "critical", None, None, None, "(?i)\\bla\\s+de\\b"),
    ("never", "low", None, None, None, None),
)


def _rules_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    listed = lambda x: "NULL::VARCHAR[]" if x is None else str(x)
    values = ", ".join(f"({n}, '{r[0]}', '{r[1]}', {listed(r[2])}, {listed(r[3])}, {text(r[4])}, {text(r[5])})" for n, r in enumerate(_RULES))
    return f"""WITH r AS (SELECT * FROM (VALUES {values}) v(rule_ord, rule_id, severity, head, has, rx, line)),
c AS (SELECT conv_id * 1000 + turn AS event_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS idx FROM conversations),
a AS (SELECT event_id, idx, list_filter(string_split(t, ' '), lambda x: x <> '') AS argv FROM c),
h AS (SELECT event_id, idx, rule_ord, rule_id, severity, argv FROM a, r
  WHERE (head IS NOT NULL OR has IS NOT NULL OR rx IS NOT NULL OR line IS NOT NULL)
    AND (head IS NULL OR (len(argv) >= len(head) AND list_transform(argv[1:len(head)], lambda x: lower(x)) = head))
    AND (has IS NULL OR len(list_filter(argv, lambda x: contains(x, has[1]))) > 0)
    AND (rx IS NULL OR len(list_filter(argv, lambda x: regexp_matches(x, rx))) > 0)
    AND (line IS NULL OR regexp_matches(array_to_string(argv, ' '), line)))
SELECT event_id, rule_id, severity, min(idx)::INT AS idx FROM h GROUP BY event_id, rule_id, severity"""


@query("r3_rule_theta", _rules_sql())
def r3_rule_theta(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    argv = F.filter(F.split("line", " "), lambda x: x != "")
    commands = turns.select("event_id", "idx", argv.alias("argv"), argv.alias("bare_argv"))
    return rules.matches(commands, rules.rule_table(spark, _RULES)).select("event_id", "rule_id", "severity", "idx")
