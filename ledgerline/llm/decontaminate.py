"""Benchmark decontamination by SimHash windows (DataFrame functions only).

1. Word k-gram hashes of every place of every text are joined to those of the benchmark
   items and counted by text and item. A window that is similar enough shares at least
   `percent` of the item's k-grams, so texts with fewer such places go no further.
2. In the texts left every place is looked up in the item, and an item-sized window stands
   at every start whose places hold as many hits as a similar window has at least.
3. Each window and each item gets a 64-bit SimHash of its weighted shingles (the weight
   is how often a shingle occurs).
4. Fingerprints are cut into radius + 1 blocks; two that differ in at most `radius` bits
   agree in a whole block, so joining on (item size, block, value) misses none of them.
5. Pairs within the radius are verified by the exact weighted Jaccard similarity.

At similarity 0.8 two fingerprints differ in 10 bits on average with a deviation of 3;
a radius of 20 loses about one in ten thousand of those, and no copy.

Results in odd cases: null or empty texts and items have no words and match nothing; a
text or item of fewer than k words is a single shingle; a text that ends within a window
makes the window shorter; rows that agree in doc_id and text are one document, and an
item_id whose text repeats counts once; null ids are reported as null; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_ROWS, join_small, parted, table, worded, written

K = 5
PERCENT = 80
RADIUS = 20


def _gram(words: str, at: str, k: int) -> str:
    """SQL: hash of the k-word shingle at a place, of the whole where there are fewer than k words."""
    return f"if(size({words}) >= {k}, xxhash64({', '.join(f'{words}[{at} + {j}]' for j in range(k))}), xxhash64({words}))"


def _shingles(words: str, k: int) -> str:
    """SQL: hashes of the shingles at all places of an array of words."""
    return f"transform(sequence(0, greatest(size({words}) - {k}, 0)), i -> {_gram(words, 'i', k)})"


def _starts(places: str, size: str, least: str, last: str) -> str:
    """SQL: every start up to `last` whose `size` places hold `least` of the ascending places."""
    low, high = f"greatest(0, {places}[i + {least} - 1] - {size} + 1)", f"least({places}[i], {last})"
    ranges = f"transform(sequence(0, size({places}) - {least}), i -> if({low} <= {high}, sequence({low}, {high}, 1), cast(array() as array<int>)))"
    return f"if(size({places}) >= {least}, array_distinct(flatten({ranges})), cast(array() as array<int>))"


def _simhash(shingles: str) -> str:
    """SQL: bit b is set if more than half of the shingles set it; four bits are counted at once, 16 bits apart."""
    ones = f"aggregate({shingles}, 0L, (s, x) -> s + (shiftrightunsigned(x, b) & {0x0001000100010001}L))"
    bits = " | ".join(f"if(2 * (shiftrightunsigned(y, {16 * q}) & 65535L) > size({shingles}), shiftleft(1L, b + {16 * q}), 0L)" for q in range(4))
    counted = f"aggregate(sequence(0, 15), 0L, (f, b) -> f | element_at(transform(array({ones}), y -> {bits}), 1))"
    vote = f"aggregate({shingles}, 0, (s, x) -> s + if((shiftrightunsigned(x, b) & 1L) = 1L, 1, -1))"
    return f"if(size({shingles}) <= 65535, {counted}, aggregate(sequence(0, 63), 0L, (f, b) -> f | if({vote} > 0, shiftleft(1L, b), 0L)))"


def _blocks(value: str, radius: int) -> str:
    """SQL: the bits of each of radius + 1 blocks that cover the 64 bits; the last takes the rest."""
    width = 64 // (radius + 1)
    rest = (1 << (64 - radius * width)) - 1
    return f"transform(sequence(0, {radius}), b -> shiftrightunsigned({value}, b * {width}) & if(b = {radius}, {rest}L, {(1 << width) - 1}L))"


def leaks(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, th, item_id, similarity, start_word: the best window per document and item."""
    bench = items.select(F.col(item_col).alias("item_id"), worded(F.col(item_text)).alias("w")).where("size(w) > 0").distinct()
    bench = bench.withColumn("m", F.size("w")).withColumn("sh", F.expr(_shingles("w", k)))
    bench = written(bench.withColumn("fp", F.expr(_simhash("sh"))).select("item_id", "m", "sh", "fp"), "items")
    bodies = written(bench.select(F.xxhash64("m", "sh").alias("body"), "m", F.col("sh").alias("ish")).distinct(), "item-bodies")
    need = F.expr(f"({percent} * size(sh) + 99) div 100").alias("need")
    seeds = written(bench.select(F.xxhash64("m", "sh").alias("body"), need, F.explode("sh").alias("h")).distinct(), "item-shingles")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    # outer, so that no filter cuts the words a second time
    at = F.explode_outer(F.expr(f"if(size(w) > 0, sequence(0, greatest(size(w) - {k}, 0)), cast(array() as array<int>))"))
    places = texts.select("doc_id", "th", worded(F.col("text")).alias("w")).select("doc_id", "th", "w", at.alias("p"))
    hits = places.select("doc_id", "th", F.expr(f"if(p is null, null, {_gram('w', 'p', k)})").alias("h"))
    hits = join_small(hits, seeds, ["h"], "inner", 10 * BROADCAST_ROWS)
    near = hits.groupBy("doc_id", "th", "body", "need").agg(F.count("*").alias("met")).where("met >= need")
    near = written(near.groupBy("doc_id", "th").agg(F.collect_set("body").alias("bodies")), "candidates")

    small = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = near.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "bodies")
    if not small:  # only texts that may be candidates move
        texts, _ = parted(texts, F.xxhash64("doc_id", "th"), near.select(F.xxhash64("doc_id", "th").alias("key")))
    found = texts.join(F.broadcast(side) if small else side, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    found = found.select("doc_id", "th", "bodies", worded(F.col("text")).alias("w")).select("doc_id", "th", "bodies", F.expr(_shingles("w", k)).alias("g"))
    found = join_small(found.select("doc_id", "th", "g", F.explode("bodies").alias("body")), bodies, ["body"], "inner")
    found = found.withColumn("long", F.expr("least(size(g), size(ish))")).withColumn("places", F.expr("filter(sequence(0, size(g) - 1), p -> array_contains(ish, g[p]))"))
    # what two sets of shingles share is at least this much of their sizes, or they are not similar
    found = found.withColumn("least", F.expr(f"cast(({percent} * (long + size(ish)) + {99 + percent}) div {100 + percent} as int)"))
    found = found.withColumn("start", F.expr(_starts("places", "long", "least", "(size(g) - long)")))
    found = found.select("doc_id", "th", "m", F.explode(F.expr("transform(start, s -> struct(s as start, slice(g, s + 1, long) as sh))")).alias("x"))
    found = found.select("doc_id", "th", "m", "x.start", "x.sh").withColumn("fp", F.expr(_simhash("sh")))
    keyed = found.select("*", F.posexplode(F.expr(_blocks("fp", radius))).alias("block", "bits"))
    blocks = bench.select("item_id", "m", F.col("sh").alias("ish"), F.col("fp").alias("ifp"), F.posexplode(F.expr(_blocks("fp", radius))).alias("block", "bits"))
    pairs = join_small(keyed, written(blocks, "item-blocks"), ["m", "block", "bits"], "inner")
    # of the blocks in which a pair agrees, the first one speaks for it
    pairs = pairs.where(f"bit_count(fp ^ ifp) <= {radius}").where(f"block = array_position({_blocks('(fp ^ ifp)', radius)}, 0L) - 1")
    n = lambda a: f"cast(size(filter({a}, y -> y = x)) as long)"
    both = f"aggregate(array_distinct(sh), 0L, (s, x) -> s + least({n('sh')}, {n('ish')}))"
    # where either side repeats nothing, what is shared is counted once
    both = f"if(size(array_distinct(sh)) = size(sh) or size(array_distinct(ish)) = size(ish), cast(size(array_intersect(sh, ish)) as long), {both})"
    pairs = pairs.withColumn("both", F.expr(both)).withColumn("all", F.expr("size(sh) + size(ish)") - F.col("both"))
    pairs = pairs.where(f"100 * both >= {percent} * all").withColumn("similarity", F.col("both") / F.col("all"))
    best = pairs.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("similarity", F.negative("start").alias("s"))).alias("best"))
    return best.select("doc_id", "th", "item_id", "best.similarity", F.negative("best.s").cast("long").alias("start_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


#: The definition: every window of an item's size, at every start of every text.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM benchmark),
ds AS (SELECT doc_id, p, greatest(len(w) - {K} + 1, 1) AS n, array_to_string(w[p + 1:p + {K}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {K} + 1, 1))) AS p FROM d WHERE len(w) > 0)),
ig AS (SELECT item_id, greatest(len(w) - {K} + 1, 1) AS m, array_to_string(w[p + 1:p + {K}], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {K} + 1, 1))) AS p FROM i WHERE len(w) > 0)),
ic AS (SELECT item_id, m, g, count(*) AS c FROM ig GROUP BY ALL),
hit AS (SELECT doc_id, item_id, p, g, c, m, n, least(m, n) AS size FROM ds JOIN ic USING (g)),
win AS (SELECT doc_id, item_id, m, size, g, c, unnest(range(greatest(0, p - size + 1), least(p, n - size) + 1)) AS start FROM hit),
met AS (SELECT doc_id, item_id, m, size, start, g, least(count(*), c) AS c FROM win GROUP BY doc_id, item_id, m, size, start, g, win.c),
b AS (SELECT doc_id, item_id, start, sum(c) AS c, m + size AS s FROM met GROUP BY doc_id, item_id, start, m, size),
j AS (SELECT doc_id, item_id, start, (c / (s - c))::DOUBLE AS similarity FROM b WHERE 100 * c >= {PERCENT} * (s - c))
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT AS start_word FROM j GROUP BY doc_id, item_id
"""
