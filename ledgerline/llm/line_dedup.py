"""Line dedup by winnowing over line hashes (DataFrame functions only).

A window is `run` consecutive lines, or fewer where these hold `words` words already, so
a passage counts as long by its lines or by its words. What follows:

1. Winnowing: every window elects its smallest line hash (the first of equals). Only the
   elected positions are posted, each once, however many windows elect it. Equal windows
   elect the same line at the same offset, so no repeat is missed.
2. Positions are joined by their fingerprint: fingerprints that stand at one position only
   go no further, and with them all windows that elected them.
3. A match is extended both ways from the fingerprint: the lines before and after it, as
   far as a window reaches, are compared by their MD5, and the earliest position of each
   (fingerprint, offset, lines) is found. Windows that follow or overlap each other in a
   later text are one run, so a run is as long as the match.
4. The lines of later runs are deleted.

A run of which no window is complete (a line or two of few words) stays, and so does what
follows a long line in a repeat but is neither long itself nor followed by equal lines.

Results in odd cases: a null text is empty and has one empty line; lines are compared as
they stand, but blank lines all count as equal and a window of blank lines only is never
a repeat; "earlier" is by (doc_id, line), null doc_ids last; rows that agree in doc_id
and text are one document and get the same result; an empty table gives an empty result.
Other columns pass through dedup_lines untouched, but for one named line_dedup, which is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.common import fresh, join_small, parted, table, written

RUN = 3
WORDS = 50
_LAST = 9223372036854775807
#: What separates the words that are counted.
_SPACE = r"[\\x20\\x09-\\x0D]+"


def _lines(docs: DataFrame, run: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, l, h, win): lines (blank ones empty), their hashes, and all windows as (start, size, pos).

    pos is the elected line; hashes and counts are taken once a line.
    """
    lines = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.expr(f"transform(split(coalesce(`{text_col}`, ''), '\n', -1), x -> if(trim(x) = '', '', x))").alias("l"),
    )
    lines = lines.withColumn("h", F.expr("transform(l, x -> if(x = '', 0L, xxhash64(x)))"))
    lines = lines.withColumn("c", F.expr(f"transform(l, x -> size(array_remove(split(x, '{_SPACE}'), '')))"))
    held = lambda n: " + ".join(f"c[i + {j}]" for j in range(n))
    size = "case " + " ".join(f"when i + {n} > size(h) then 0 when {held(n)} >= {words} then {n}" for n in range(1, run)) + f" when i + {run} > size(h) then 0 else {run} end"
    lines = lines.withColumn("s", F.expr(f"transform(sequence(0, size(h) - 1), i -> {size})"))
    # the first of the smallest: later lines must be smaller to be elected
    least = "aggregate(sequence(i + 1, i + s[i] - 1), i, (p, j) -> if(h[j] < h[p], j, p))"
    window = f"struct(i as start, s[i] as size, if(s[i] = 1, i, {least}) as pos)"
    told = "exists(slice(l, i + 1, s[i]), x -> x <> '')"
    return lines.select("doc", "th", "l", "h", F.expr(f"transform(filter(sequence(0, size(h) - 1), i -> s[i] > 0 and {told}), i -> {window})").alias("win"))


def repeated_runs(docs: DataFrame, run: int = RUN, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, runs): per document the merged runs of repeated lines, as [first, last] structs."""
    lines = _lines(docs, run, words, id_col, text_col)
    # outer, so that no filter takes the windows a second time
    posted = lines.select(F.explode_outer(F.expr("transform(array_distinct(win.pos), p -> h[p])")).alias("key"))
    shared = written(posted.groupBy("key").count().where("count > 1 and key is not null").select("key"), "fingerprints")

    windows = lines.select("doc", "th", "l", "h", F.explode_outer("win").alias("w"))
    windows = windows.select("doc", "th", "w.start", "w.size", F.expr("get(h, w.pos)").alias("fp"), F.expr("w.pos - w.start").alias("offset"), F.expr("slice(l, w.start + 1, w.size)").alias("l"))
    maybe, _ = parted(windows, F.col("fp"), shared)
    digest = F.unhex(F.md5(F.array_join("l", "\n"))).alias("lines")
    maybe = written(maybe.select("doc", "th", "start", "size", "fp", "offset", digest), "matches")

    named = ["fp", "offset", "size", "lines"]
    at = F.struct(F.coalesce("doc", F.lit(_LAST)).alias("o"), F.col("th"), F.col("start"))
    first = maybe.groupBy(*named).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first = written(first.where("first <> last").drop("last"), "line-firsts")
    later = join_small(maybe, first, named, "inner").where(at > F.col("first")).select("doc", "th", "start", "size").distinct()
    line = W.partitionBy("doc", "th").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(line.rowsBetween(W.unboundedPreceding, -1))
    merged = later.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("g", F.sum("new").over(line))
    merged = merged.groupBy("doc", "th", "g").agg(F.min("start").alias("first"), (F.max(F.col("start") + F.col("size")) - 1).alias("last"))
    return merged.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text reduced to the lines that stay, plus the struct `line_dedup`.

    Only texts that may have runs are exchanged to meet them.
    """
    docs = docs.drop("line_dedup")
    runs = written(repeated_runs(docs, run, words, id_col, text_col), "runs")
    key = lambda doc, th: F.xxhash64(doc, th)
    touched, clear = parted(docs, key(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))), runs.select(key(F.col("doc"), F.col("th")).alias("key")))
    p = fresh(docs)
    own = runs.select(F.col("doc").alias(f"{p}doc"), F.col("th").alias(f"{p}th"), F.col("runs").alias(f"{p}runs"))
    joined = touched.join(own, F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}doc")) & (F.xxhash64(F.col(text_col)) == F.col(f"{p}th")), "left")
    lines = f"split(coalesce(`{text_col}`, ''), '\n', -1)"
    # runs ascend and are few (they are maximal), so each line looks through them
    kept = f"if({p}runs is null, {lines}, filter({lines}, (l, i) -> not exists({p}runs, r -> i between r.first and r.last)))"
    joined = joined.withColumn(f"{p}kept", F.expr(kept))
    text = F.when(F.col(f"{p}runs").isNull(), F.col(text_col)).otherwise(F.array_join(f"{p}kept", "\n"))
    joined = joined.withColumn("line_dedup", _facts(f"size({lines})", f"size({lines}) - size({p}kept)", f"coalesce(size({p}runs), 0)")).withColumn(text_col, text)
    clear = clear.withColumn("line_dedup", _facts(f"size({lines})", "0", "0"))
    return joined.drop(f"{p}doc", f"{p}th", f"{p}runs", f"{p}kept").unionByName(clear)


def _facts(lines: str, removed: str, runs: str) -> Column:
    return F.struct(*[F.expr(x).cast("long").alias(c) for c, x in (("n_lines", lines), ("n_removed", removed), ("n_runs", runs))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.n_runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
n AS (SELECT doc_id, i, line, CASE WHEN trim(line, ' ') = '' THEN '' ELSE line END AS v,
             len(regexp_extract_all(line, '[^\x{{20}}\x{{09}}-\x{{0D}}]+')) AS n FROM l),
w AS (
  SELECT doc_id, i, v AS a, lead(v, 1) OVER d AS b, lead(v, 2) OVER d AS c, n AS na, lead(n, 1) OVER d AS nb
  FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT doc_id, i, CASE WHEN na >= {WORDS} THEN [a] WHEN na + nb >= {WORDS} THEN [a, b] WHEN c IS NOT NULL THEN [a, b, c] END AS k FROM w),
r AS (
  SELECT doc_id, i, len(k) AS size FROM (
    SELECT doc_id, i, k, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth
    FROM k WHERE k IS NOT NULL AND k <> ['', '', ''])
  WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(size)) AS i FROM r),
s AS (
  SELECT doc_id, count(*) AS n_runs FROM (
    SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM gone)
  WHERE step IS NULL OR step > 1 GROUP BY doc_id)
SELECT n.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, any_value(coalesce(s.n_runs, 0)) AS n_runs,
       sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i LEFT JOIN s ON s.doc_id = n.doc_id
GROUP BY n.doc_id
"""
