"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each text becomes its set of distinct word shingles; texts with equal sets form a class
   and only the class representative (smallest doc_id) goes on.
2. A class posts itself under every (coordinate, value) pair of its signature. Pairs are
   ordered rarest first and, as two signatures of `coords` values that agree in at least
   `match` of them must meet within the first coords - match + 1, only that prefix is
   posted and pairs held by one class alone are skipped.
3. In each posting list the hub (the class whose pairs are the most shared) meets every
   other class once, on the full sets, and links are kept. So a list of n costs n. Of the
   classes that did not join its component a new hub is elected, ROUNDS times; these meet
   it if their signatures collide in `match` coordinates at least.
4. What two classes of a list share lies within the list's first hub or outside of it. For
   classes that are in different components still, pairs of one list are taken up again
   only if their signatures collide in `match` coordinates and they share a shingle outside
   the hub, or what each shares with the hub is enough for a link, counted in blocks of the
   hub's shingles of which both can share only the lesser number. Shingles that more than
   `hot` classes hold and the hub lacks count as the hub's. Classes that share too little
   of their own set with the whole list are left out. No other pair can be a link, so none
   is lost, and no list is paired in full.
5. The link is confirmed on the full shingle sets.

At similarity 0.8 a pair of 32-value signatures agrees in fewer than 14 values with a
probability of about 1e-5; that is the only loss.

Results in odd cases: null or empty texts and texts without words have no shingles, are
linked with nothing and stay; with fewer than k words the whole sequence is one shingle;
rows with equal sets are linked; a null doc_id has a null component, links nothing and
stays; rows that share a doc_id are one node of the graph; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm import textops as tx
from ledgerline.llm.common import join_small, parted, table, written
from ledgerline.llm.components import components

#: What separates words.
SPACE = " \t\n\x0b\x0c\r"
COORDS = 32
MATCH = 14
#: Classes of a list that hold a shingle which its hub lacks, up to which they are paired by it.
HOT = 64
#: Steps of sizes, for a factor of e, in which the partners of an open class are looked for.
STEPS = 16
#: Blocks, by hash, in which shingles shared with a hub are counted: of each two texts share the lesser number at most.
BLOCKS = 16
#: Elections of a hub among the classes that are left over in a list.
ROUNDS = 3


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sets of this size are sorted sooner than numpy's unique() hashes them."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the sorted distinct shingle hashes of each text of an Arrow column."""
    gap = tx.gaps(SPACE)
    data, off = tx.text_bytes(column)
    for _, _, part, at in tx.pieces(data, off):
        part = tx.lowered(part)
        start, end, first = tx.words(part, at, gap)
        hashes = tx.span(tx.prefix(part), start, end)
        grams = tx.grams(hashes, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield b - a, _distinct(grams[a : b - k + 1]) if b - a >= k else tx.grams(hashes[a:b], b - a) if b > a else hashes[:0]


def _key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _signatures(k: int, coords: int):
    factors = tx.constants(coords, 21)[:, None]
    low = np.uint64(coords - 1)

    def run(batches):
        for batch in batches:
            words, n, keys, tokens = [], [], [], []
            for count, own in shingle_sets(batch.column(1), k):
                words.append(count)
                n.append(len(own))
                keys.append(_key(own))
                if len(own):
                    least = np.full(coords, np.uint64(2**64 - 1))
                    for at in range(0, len(own), 4096):
                        least = np.minimum(least, (own[None, at : at + 4096] * factors).min(axis=1))
                    tokens.append(((tx.mix(least) & ~low) | np.arange(coords, dtype=np.uint64)).view(np.int64))
                else:
                    tokens.append(None)
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], names=["doc", "n", "key", "tokens", "n_words", *batch.schema.names[2:]])

    return run


def _sets(k: int):
    """Full sets of the texts; of those that come with a key, only where the set has it."""

    def run(batches):
        for batch in batches:
            rep = batch.column(0).to_pylist()
            keys = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(rep)
            kept = [(r, s.tobytes()) for r, key, (_, s) in zip(rep, keys, shingle_sets(batch.column(1), k), strict=True) if key is None or _key(s) == key]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], names=["rep", "own"])

    return run


def _compared(percent: int, extras: bool):
    """Full sets oa, ob of a pair: what they share, whether that is a link, what b has beside a, what it shares by block."""
    block = np.uint64(64 - BLOCKS.bit_length() + 1)

    def run(batches):
        for batch in batches:
            shared, linked, more, blocks = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                inside = np.isin(y, x, assume_unique=True)
                both = int(inside.sum())
                shared.append(both)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                more.append(y[~inside].view(np.int64) if extras else None)
                blocks.append(np.bincount((y[inside] >> block).astype(np.int64), minlength=BLOCKS) if extras else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_()), pa.array(more, pa.list_(pa.int64())), pa.array(blocks, pa.list_(pa.int64()))], names=["a", "b", "shared", "linked", "extras", "blocks"])

    return run


def _among(df: DataFrame, c: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose value in c is a key in `keys`, and about 1 in 256 of the others: two bitmaps of unlike hashes."""
    again = keys.select(F.xxhash64("key", F.lit(1)).alias("key"))
    return parted(parted(df, F.col(c), keys)[0], F.xxhash64(F.col(c), F.lit(1)), again)[0]


def _classes(signed: DataFrame) -> DataFrame:
    """(rep, key, n, tokens) of each distinct set: read from the signatures where one row has it, written where several have."""
    rows = signed.where("n > 0 and doc is not null")
    several = written(rows.groupBy("key").count().where("count > 1").select(F.xxhash64("key").alias("key")), "equal-sets")
    maybe, single = parted(rows, F.xxhash64("key"), several)
    equal = written(maybe.groupBy("key").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "classes")
    return single.select(F.col("doc").alias("rep"), "key", "n", "tokens").unionByName(equal)


def _member_sets(docs: DataFrame, reps: DataFrame, classes: DataFrame, signed: DataFrame, k: int) -> DataFrame:
    """(rep, own): the full sets of the classes whose rep is a key in `reps`, and of few others.

    Texts of an id that stands in one row are that class's and are not moved. Of ids that stand in several, texts of
    another class go by the key, and equal sets stand once, as each would meet all of the other's.
    """
    made = lambda rows: rows.mapInArrow(tx.trimmed(_sets(k)), "rep long, own binary")
    repeated = signed.where("doc is not null").groupBy("doc").count().where("count > 1").select(F.col("doc").alias("key"))
    repeated = written(repeated, "repeated")
    if not repeated.limit(1).count():
        return written(made(_among(docs, "doc", reps)), "sets")
    many, single = parted(docs, F.col("doc"), repeated)
    many, single = (_among(rows, "doc", reps) for rows in (many, single))
    members = reps.withColumnRenamed("key", "doc").join(classes.select(F.col("rep").alias("doc"), "key"), "doc")
    many = many.distinct().join(members, "doc").select("doc", "text", "key")
    return written(made(single).unionByName(made(many).distinct()), "sets")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, extras: bool) -> DataFrame:
    """(a, b, shared, linked, extras, blocks) of the pairs (a, b), from their full sets."""
    whole = pairs.join(sets.select(F.col("rep").alias("b"), F.col("own").alias("ob")), "b")
    firsts = _among(sets, "rep", written(pairs.select(F.col("a").alias("key")).distinct(), "firsts"))
    whole = whole.join(firsts.select(F.col("rep").alias("a"), F.col("own").alias("oa")), "a")
    return written(whole.select("a", "b", "oa", "ob").mapInArrow(tx.trimmed(_compared(percent, extras)), "a long, b long, shared long, linked boolean, extras array<long>, blocks array<long>"), "compared")


def _label(df: DataFrame, labels: DataFrame, c: str) -> DataFrame:
    """df with the component of the class in column c as {c}_in; a class without links is its own."""
    named = labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    return df.join(named, c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after the links (a, b) in `found`: they join whole components, whose labels stand for their members."""
    named = _label(_label(found.select("a", "b"), labels, "a"), labels, "b")
    merged = written(components(named.select("a_in", "b_in"), "a_in", "b_in"), "merged")
    own = labels.union(found.select("a", "a")).union(found.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
    own = own.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    return written(own.select("node", F.coalesce("whole", "component").alias("component")), "labels")


def _colliding(pairs: DataFrame, classes: DataFrame, match: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `match` coordinates at least."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("tokens").alias(f"t{side}")), side)
    return written(pairs.where(f"size(array_intersect(ta, tb)) >= {match}").select("a", "b").distinct(), "pairs")


def _elected(left: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, match: int) -> DataFrame:
    """Labels after links to new hubs of the lists `left` (token, b, weight), in rounds."""
    for _ in range(ROUNDS):
        left = written(_label(left.select("token", "b", "weight"), labels, "b"), "left")
        hubs = left.groupBy("token").agg(F.max(F.struct("weight", F.negative("b").alias("r"), F.col("b_in").alias("i"))).alias("hub"), F.count("*").alias("n"))
        hubs = written(hubs.where("n > 1").select("token", F.negative("hub.r").alias("a"), F.col("hub.i").alias("a_in")), "hubs")
        rest = left.join(hubs, "token").where("a_in <> b_in")
        pairs = _colliding(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, match)
        found = _compare(pairs, sets, percent, False).where("linked").select("a", "b")
        if not found.limit(1).count():
            break
        labels, left = _relabelled(labels, found), rest
    return labels


def _open_pairs(facts: DataFrame, lists: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, hot: int, match: int) -> DataFrame:
    """(a, b): pairs of one list that collide and may still be links between two components."""
    sizes = classes.select("rep", "n").distinct()
    hubs = facts.select("a").distinct().join(sizes.select(F.col("rep").alias("a"), "n"), "a")
    rows = facts.select("a", "b", "shared", "blocks").join(sizes.select(F.col("rep").alias("b"), "n"), "b")
    rows = rows.unionByName(hubs.select("a", F.col("a").alias("b"), F.col("n").alias("shared"), F.lit(None).cast("array<long>").alias("blocks"), "n"))
    rows = written(_label(_label(rows, labels, "a"), labels, "b"), "members")
    # only hubs with a member outside their component leave anything open
    opened = written(rows.where("a_in <> b_in").select("a").distinct(), "open-hubs")
    rows = join_small(rows, opened, ["a"], "left_semi")
    beside = _among(facts.select("a", "b", "extras"), "a", opened.select(F.col("a").alias("key"))).select("a", "b", F.explode("extras").alias("s"))
    held = beside.groupBy("a", "s").agg(F.count("*").alias("c")).where("c > 1")
    beside = written(beside.join(held, ["a", "s"]).select("a", "b", "s", (F.col("c") > hot).alias("hot")), "beside")
    most = beside.groupBy("a", "b").agg(F.count_if("hot").alias("more"), F.count_if(~F.col("hot")).alias("rest"))
    rows = rows.join(most, ["a", "b"], "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("core", F.col("shared") + F.col("more")).withColumn("rest", F.coalesce("rest", F.lit(0)))
    # a link is at least percent of either size, so a class that shares less with all others of the list is in none
    rows = rows.where(f"100 * (core + rest) >= {percent} * n")
    rows = written(rows.select("a", "b", "n", "core", "rest", "more", "blocks", "a_in", "b_in"), "bounds")
    x = rows.where("a_in <> b_in").select("a", *[F.col(c).alias(f"{c}_x") for c in ("b", "n", "core", "rest", "more", "blocks", "b_in")])
    y = rows.select("a", *[F.col(c).alias(f"{c}_y") for c in ("b", "n", "core", "rest", "more", "blocks", "b_in")])
    # a link shares percent / (100 + percent) of both sizes together
    enough = lambda both: f"({100 + percent}) * ({both}) >= {percent} * (n_x + n_y) and b_in_x <> b_in_y"
    # the hub itself has no blocks
    each = " + ".join(f"least(blocks_x[{i}], blocks_y[{i}])" for i in range(BLOCKS))
    core = f"coalesce(least(more_x, more_y) + {each}, least(core_x, core_y))"
    low, high = f"cast(ceil({percent} * n_x / 100) as long)", f"least(cast(floor(100 * n_x / {percent}) as long), cast(floor({100 + percent} * core_x / {percent}) as long) - n_x)"
    # a pair that collides often enough meets in lists: the first of them speaks for it, whose hub bounds it as any other
    both = lists.join(x.where(f"{high} >= {low}").select("a").distinct(), "a", "left_semi").join(classes.select(F.col("rep").alias("b"), "tokens"), "b")
    both = both.join(lists.groupBy("b").agg(F.collect_list("token").alias("posted")), "b")  # no more than the coordinates
    both = written(both.select("token", "a", "b", "tokens", "posted"), "open-lists")
    near = lambda df, c: df.join(both.select("token", "a", F.col("b").alias(f"b_{c}"), F.col("tokens").alias(f"t_{c}"), F.col("posted").alias(f"p_{c}")), ["a", f"b_{c}"])
    step = lambda n: f"cast(floor({STEPS} * ln({n})) as int)"
    ranged = near(x.where(f"{high} >= {low}"), "x").withColumn("step", F.explode(F.expr(f"sequence({step(low)}, {step(high)})")))
    agreed = f"array_min(array_intersect(p_x, p_y)) = token and size(array_intersect(t_x, t_y)) >= {match}"
    sized = near(y, "y").drop("a").withColumn("step", F.expr(step("n_y")))
    within = ranged.join(sized, ["token", "step"]).where(f"n_y between {low} and {high} and {enough(core)} and {agreed}").select("b_x", "b_y").distinct()
    # pairs are counted without what is known of their ends, which is looked up once a pair
    shared = beside.where("not hot").withColumn("ab", F.xxhash64("a", "b"))
    shared = {c: _among(shared, "ab", side.select(F.xxhash64("a", f"b_{c}").alias("key"))).select("a", "s", F.col("b").alias(f"b_{c}")) for c, side in (("x", x), ("y", y))}
    met = shared["x"].join(shared["y"], ["a", "s"]).where("b_x <> b_y").groupBy("a", "b_x", "b_y").agg(F.count("*").alias("both"))
    met = met.join(x, ["a", "b_x"]).join(y, ["a", "b_y"]).where(enough(f"{core} + both"))
    ends = [F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")]
    met = _colliding(met.select(*ends).distinct(), classes, match)
    return written(within.select(*ends).union(met).distinct(), "open-pairs")


def sign(docs: DataFrame, k: int = 5, coords: int = COORDS) -> DataFrame:
    """A written table of the rows (doc, text, others): doc, n shingles, key of the set, tokens of the signature, n_words, others."""
    schema = StructType.fromDDL("doc long, n long, key binary, tokens array<long>, n_words long")
    for field in docs.schema.fields[2:]:
        schema = schema.add(field)
    return written(docs.mapInArrow(tx.trimmed(_signatures(k, coords)), schema), "signatures")


def link(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, match: int = MATCH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", signed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    signed: what sign() made of the same ids and texts with the same k and coords, where that is there already.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = sign(docs, k, coords) if signed is None else signed
    classes = _classes(signed)

    tokens = classes.select("rep", F.explode("tokens").alias("token"))
    held = written(tokens.groupBy("token").count().where("count > 1"), "tokens")
    # pairs that one class holds alone come first and weigh nothing: what is left of the prefix is all that they change
    weighed = tokens.join(held.hint("shuffle_hash"), "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("t"))
    weighed = weighed.select("rep", F.expr("aggregate(t, 0D, (s, x) -> s + ln(x.count))").alias("weight"), F.expr(f"slice(t, 1, greatest(size(t) - {match - 1}, 0))").alias("t"))
    posted = written(weighed.select("rep", "weight", F.explode("t.token").alias("token")), "postings")

    # from here on only posted classes are looked up, so others need not be moved
    named, reps = classes.select("key", "rep"), written(posted.select(F.col("rep").alias("key")).distinct(), "reps")
    classes = written(_among(classes, "rep", reps), "posted-classes")
    sets = _member_sets(docs, reps, classes, signed, k)

    hubs = written(posted.groupBy("token").agg(F.max(F.struct("weight", F.negative("rep").alias("r"))).alias("hub")).select("token", F.negative("hub.r").alias("a")), "hubs")
    lists = written(posted.join(hubs, "token").select("token", "a", F.col("rep").alias("b"), "weight"), "lists")
    facts = _compare(written(lists.where("a <> b").select("a", "b").distinct(), "pairs"), sets, percent, True)
    labels = written(components(facts.where("linked").select("a", "b")), "labels")

    apart = _label(_label(facts.select("a", "b"), labels, "a"), labels, "b").where("a_in <> b_in").select("a", "b")
    labels = _elected(lists.join(apart, ["a", "b"]), classes, sets, labels, percent, match)
    again = _open_pairs(facts, lists, classes, labels, percent, hot, match)
    found = _compare(again, sets, percent, False).where("linked").select("a", "b")
    if found.limit(1).count():
        labels = _relabelled(labels, found)

    named = named.join(labels, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("rep"))
    own = signed.select("doc", "n", "key").join(written(named, "named"), "key", "left")
    own = own.withColumn("component_id", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")))
    return own.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (
  WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
