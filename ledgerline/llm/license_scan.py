"""License scan by diagonal voting (DataFrame functions only).

All rolling word k-gram hashes of every text are joined to the template positions that
carry the same hash, and the words of both are compared. A hit votes for the diagonal (word position minus template
position); votes are counted per text, template and diagonal. A base phrase stands at a
diagonal that has all its k-grams, each once. For a longer template, diagonals that lie
within `drift` of each other are merged (inserted or missing words shift the rest) and
the span is kept if the distinct template positions it covers reach `cover`.

Results in odd cases: a null text is empty; texts with fewer than k words have no hit;
each row is judged by itself, so repeated rows give equal results and a null doc_id is
kept; rows without a find have n_base 0, null first_word and last_word, empty labels and
score 0; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.common import LOWER, UPPER, table, worded

#: The base phrases with their labels, and the method's templates.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
K = 2
DRIFT = 2
COVER = 0.75


def _templates(spark: SparkSession, k: int, base: dict[str, str], more: dict[str, str]) -> DataFrame:
    """(tid, label, is_base, grams, tpos, gram, h): a fixed list, so a few hundred rows at most."""
    if any(len(text.split()) < k for text in (*base, *more)):
        raise ValueError(f"a phrase of fewer than {k} words has no {k}-gram")
    rows = [(n, text.split(), label, text in base) for n, (text, label) in enumerate([*base.items(), *more.items()])]
    grams = [(n, label, own, len(w) - k + 1, p, w[p : p + k]) for n, w, label, own in rows for p in range(len(w) - k + 1)]
    made = spark.createDataFrame(grams, "tid int, label string, is_base boolean, grams int, tpos int, gram array<string>")
    return made.select("tid", "label", "is_base", "grams", "tpos", "gram", F.xxhash64(*[F.col("gram")[i] for i in range(k)]).alias("h"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, drift: int = DRIFT, cover: float = COVER, base: dict[str, str] = BASE, more: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per text: doc_id, counts of base phrases, labels and the best coverage."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), worded(F.col(text_col)).alias("w"))
    # position -1 carries the row itself through the join; outer, so that no filter cuts the words a second time
    places = words.select("row", "doc_id", "w", F.explode_outer(F.expr(f"sequence(-1, greatest(size(w) - {k}, -1))")).alias("pos"))
    gram = ", ".join(f"w[pos + {j}]" for j in range(k))
    grams = places.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w", "pos", F.expr(f"if(pos >= 0, xxhash64({gram}), null)").alias("h"))
    hits = grams.join(F.broadcast(_templates(docs.sparkSession, k, base, more)), "h", "left")
    hits = hits.where(F.expr(f"case when tid is null then pos < 0 else slice(w, pos + 1, {k}) = gram end"))
    keys = ["row", "doc_id", "n_words", "tid", "label", "is_base", "grams"]
    votes = hits.withColumn("diag", F.when(F.col("tid").isNotNull(), F.col("pos") - F.col("tpos")))
    votes = votes.groupBy(*keys, "diag").agg(F.count("*").alias("n"), F.collect_set("tpos").alias("at"))
    near = W.partitionBy("row", "tid").orderBy("diag")
    step = F.when(~F.col("is_base") & (F.col("diag") - F.lag("diag").over(near) <= drift), 0).otherwise(1)
    votes = votes.withColumn("step", step).withColumn("band", F.sum("step").over(near))
    spans = votes.groupBy(*keys, "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("got"), F.min("diag").cast("long").alias("start"))
    share = F.col("got") / F.col("grams")
    spans = spans.withColumn("share", F.when(F.col("is_base"), F.when(F.col("got") == F.col("grams"), F.lit(1.0))).when(share >= cover, share))
    found, own = F.col("share").isNotNull(), F.col("share").isNotNull() & F.col("is_base")
    named = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(own).alias("n_base"),
        F.min(F.when(own, F.col("start"))).alias("first_word"),
        F.max(F.when(own, F.col("start"))).alias("last_word"),
        named(own).alias("base_labels"),
        named(found).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    listed = [*((t, v, True) for t, v in BASE.items()), *((t, v, False) for t, v in TEMPLATES.items())]
    values = ", ".join(f"({n}, '{label}', {str(own).lower()}, '{text}')" for n, (text, label, own) in enumerate(listed))
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') AS w
  FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 1)) AS p, w FROM d WHERE len(w) >= {K}),
b AS (SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b FROM g),
t AS (SELECT * FROM (VALUES {values}) v(tid, label, is_base, text)),
u AS (SELECT tid, label, is_base, string_split(text, ' ') AS w FROM t),
q AS (SELECT tid, label, is_base, len(w) - 1 AS grams, unnest(range(len(w) - 1)) AS tp, w FROM u),
h AS (
  SELECT DISTINCT b.doc_id, q.tid, q.label, q.is_base, q.grams, q.tp, b.p - q.tp AS diag
  FROM b JOIN q ON b.a = q.w[q.tp + 1] AND b.b = q.w[q.tp + 2]),
x AS (SELECT DISTINCT doc_id, tid, is_base, diag FROM h),
s AS (
  SELECT doc_id, tid, diag, CASE WHEN NOT is_base AND diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) <= {DRIFT} THEN 0 ELSE 1 END AS step
  FROM x),
bands AS (SELECT doc_id, tid, diag, sum(step) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS band FROM s),
spans AS (
  SELECT h.doc_id, h.tid, h.label, h.is_base, h.grams, band, count(DISTINCT h.tp) AS got, min(h.diag) AS start
  FROM h JOIN bands USING (doc_id, tid, diag) GROUP BY ALL),
ok AS (
  SELECT *, got / grams AS share FROM spans
  WHERE CASE WHEN is_base THEN got = grams ELSE got / grams >= {COVER} END)
SELECT d.doc_id, any_value(len(d.w))::BIGINT AS n_words, count(*) FILTER (WHERE is_base) AS n_base,
       min(start) FILTER (WHERE is_base) AS first_word, max(start) FILTER (WHERE is_base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(share), 0.0)::DOUBLE AS score
FROM d LEFT JOIN ok ON ok.doc_id = d.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
