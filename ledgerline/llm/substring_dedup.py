"""Substring dedup: suffixes at cover samples, sorted one bucket at a time.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document
with a smaller id. A suffix array over all positions would have to move every suffix; as
only common prefixes of LENGTH bytes count, suffixes are sorted at cover samples alone.

Cover: of the K-byte strings in every window of LENGTH bytes the one with the least hash
(the first of equals) is a sample. So any two equal windows have a sample at the same
offset, which is what a difference cover gives, at a third of its density: the sample is
chosen by content, not by position modulo a period. All windows that elect one sample
form its segment. Per sample there are its bucket key (the K-byte prefix) and its rank,
the name of the whole segment around it.

Sort: samples are dealt to buckets by key and each bucket is sorted by (key, rank,
document). Equal ranks settle ties of any length without looking at text: all but the
smallest document of a (key, rank) lose the segment. Two segments of one key but different
rank can share a window only if the SIDE bytes before or those after the sample are equal;
where tags of these bytes say so, the segments are compared window by window from their
bytes, key by key or, where a key has many, tag by tag. Very large groups of one tag are
dealt again by window, so that no task gets a whole hot group. Within a key they come by
document: the windows seen, each with its smallest document, are all that is remembered.

Documents equal in text to one with a smaller id are settled first, by digest.

Keys are 64 bits, ranks 48 bits within a key and window names 64 bits within a key.

Results in odd cases: a null text is empty; texts of fewer than LENGTH bytes stay whole;
a null doc_id is neither smaller nor larger than any other, so its text stays and removes
nothing; rows that share a doc_id never remove from each other and are judged each by its
text; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textops as tx
from ledgerline.llm.common import table, written

LENGTH = 50
K = 16
#: A window that holds a sample holds this many bytes before it or as many after it.
SIDE = (LENGTH - K) // 2
#: Bytes of text per bucket and samples that a task holds before it deals them out.
BUCKET_BYTES = 8 << 20
HELD = 1 << 17
#: Bytes of text whose samples are taken at once (a longer document is taken whole).
PIECE = 1 << 18
#: Ranks of one key and tag above which their segments are dealt by window.
MANY = 256
#: Segments of one key that are asked for above which they are dealt by tag.
CROWD = 4096
#: Rows of (doc_id, digest) up to which exact copies are looked up by broadcast.
COPIES = 200_000

_U = np.uint64
_RANK = _U((1 << 48) - 1)
#: What a reply says about a segment: it goes, or its bytes are asked for whole (dealt by
#: key, by key and tag before, by key and tag after) or window by window.
GONE, WHOLE, WINDOWS, BEFORE, AFTER = 0, 1, 2, 4, 8
#: Bits of these in a reply, beside the rank.
KIND_BITS = 4


def samples(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document index, first window, last window, key, rank, tags) of each segment of a piece."""
    n = len(part)
    none = np.empty(0, np.int64)
    nothing = none, none, none, *[none.astype(_U)] * 3
    if n < LENGTH:
        return nothing
    sums = tx.prefix(part)
    _, down = tx.powers(n + 1)
    keys = tx.mix((sums[K:] - sums[:-K]) * down[: n - K + 1])
    least = (keys & _U(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=_U)
    width, wide = 1, LENGTH - K + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    ends = np.repeat(off[1:], np.diff(off))
    window = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= LENGTH)
    if not len(window):
        return nothing
    at = (least[window] & _U(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([start[1:], [len(at)]]) - 1
    first, last, at = window[start], window[last], at[start]
    rank = tx.mix(tx.span(sums, first, last + LENGTH) + (at - first).astype(_U)) & _RANK
    doc = np.searchsorted(off, first, "right") - 1
    before = tx.span(sums, np.maximum(at - SIDE, off[doc]), at) & _U(0xFFFF)
    after = tx.span(sums, at + K, np.minimum(at + K + SIDE, off[doc + 1])) & _U(0xFFFF)
    return doc, first, last, keys[at], rank, before << _U(16) | after


def _planes(x: np.ndarray) -> bytes:
    """Byte planes: the equal high bytes of sorted or small numbers stand together."""
    return x.astype(_U).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U).ravel()


def _dealt(buckets: int):
    """Samples of whole texts by bucket; what a smaller document of the same run settles goes as a reply."""
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary()), ("docs", pa.binary()), ("tags", pa.binary()), ("reply", pa.bool_())])

    def flush(held):
        doc, key, rank, tags = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, rank, key))
        doc, key, rank, tags = doc[order], key[order], rank[order], tags[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])])
        smallest = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        sent = doc == smallest
        sent[1:] &= new[1:] | (doc[1:] != doc[:-1])
        settled = doc != smallest
        rows = []
        for reply, chosen in ((False, sent), (True, settled)):
            k, r, d, t = key[chosen], rank[chosen], doc[chosen], tags[chosen]
            # settled ones spread by document, whatever key they share
            bucket = (tx.mix(d.astype(_U)) if reply else k) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, k, r, d, t = bucket[order], k[order], r[order], d[order], t[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = k[a:b]
                own = np.diff(own, prepend=_U(0)) if not reply else own[:0]
                rows.append({"bucket": int(bucket[a]), "keys": _planes(own), "ranks": _planes(r[a:b]), "docs": _planes(d[a:b].astype(np.int64).view(_U)), "tags": _planes(t[a:b] if not reply else t[:0]), "reply": reply})
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = tx.text_bytes(batch.column(1))
            for a, _, part, at in tx.pieces(data, off, PIECE):
                doc, _, _, key, rank, tags = samples(part, at)
                held.append((ids[a + doc], key, rank, tags))
                n += len(doc)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _replies(key: np.ndarray, rank: np.ndarray, doc: np.ndarray, tags: np.ndarray, many: int, crowd: int) -> tuple[np.ndarray, ...]:
    """Sort one bucket; (doc, rank, kind) for every sample that is settled or asked for."""
    order = np.lexsort((doc, rank, key))
    key, rank, doc, tags = key[order], rank[order], doc[order], tags[order]
    of_rank = np.concatenate([[True], (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])])
    gone = doc > doc[np.maximum.accumulate(np.where(of_rank, np.arange(len(doc)), 0))]
    kind = np.zeros(len(doc), np.int64)
    # of equal ranks the smallest document speaks for all
    own = np.flatnonzero(~gone)
    for tag, side in ((tags >> _U(16), BEFORE), (tags & _U(0xFFFF), AFTER)):
        at = own[np.lexsort((tag[own], key[own]))]
        start = np.flatnonzero(np.concatenate([[True], (key[at][1:] != key[at][:-1]) | (tag[at][1:] != tag[at][:-1])]))
        number = np.diff(np.append(start, len(at)))
        several = np.minimum.reduceat(doc[at], start) != np.maximum.reduceat(doc[at], start)
        kind[at] |= np.repeat(np.where(several, np.where(number > many, WINDOWS, side), 0), number)
    # where a key has few of them, its whole segments meet in one place
    whole = kind & (BEFORE | AFTER) > 0
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    few = np.repeat(np.add.reduceat(whole.astype(np.int64), start) <= crowd, np.diff(np.append(start, len(key))))
    kind = np.where(whole & few, kind & WINDOWS | WHOLE, kind)
    said = gone | (kind > 0)
    return doc[said], rank[said], np.where(gone, GONE, kind)[said]


def _sorted_buckets(many: int, crowd: int):
    """Buckets one after another; a partition holds its buckets in order."""
    names = ["doc", "rank", "kind"]
    shape = lambda doc, rank, kind: pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rank.astype(np.int64), pa.int64()), pa.array(kind.astype(np.int8), pa.int8())], names=names)

    def whole(held):
        return shape(*_replies(*(np.concatenate(x) for x in zip(*held, strict=True)), many, crowd))

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                rank, doc = _from_planes(row["ranks"]), _from_planes(row["docs"]).view(np.int64)
                if row["reply"]:
                    yield shape(doc, rank, np.zeros(len(doc)))
                    continue
                if row["bucket"] != bucket and held:
                    yield whole(held)
                    held = []
                bucket = row["bucket"]
                held.append((np.cumsum(_from_planes(row["keys"]), dtype=_U), rank, doc, _from_planes(row["tags"])))
        if held:
            yield whole(held)

    return run


def _said(batch, column: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Replies of the texts [first, last) of a batch: (text and rank in one number, kind), sorted."""
    said = batch.column(column).slice(first, last - first)
    code = said.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.nan_to_num(pc.list_value_length(said).to_numpy(zero_copy_only=False)).astype(np.int64)
    own = np.repeat(np.arange(last - first, dtype=_U), size) << _U(48) | (code >> KIND_BITS).astype(_U)
    kind = code & ((1 << KIND_BITS) - 1)
    order = np.lexsort((kind, own))
    return own[order], kind[order]


def _kinds(doc: np.ndarray, rank: np.ndarray, own: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """What was said about each segment, -1 where nothing was."""
    if not len(own):
        return np.full(len(doc), -1)
    want = doc.astype(_U) << _U(48) | rank
    at = np.minimum(np.searchsorted(own, want), len(own) - 1)
    return np.where(own[at] == want, kind[at], -1)


def _slices(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of the bytes as a binary array."""
    size = end - start
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(part[at]))])


def _asked(batches):
    """Bytes of the segments that are asked for; those of large groups window by window."""
    names = ["key", "doc", "th", "pos", "bytes"]
    for batch in batches:
        ids, ths = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        data, off = tx.text_bytes(batch.column(2))
        for a, b, part, at in tx.pieces(data, off, PIECE):
            own, kind = _said(batch, 3, a, b)
            if not kind.any():
                continue
            doc, first, last, key, rank, tags = samples(part, at)
            found = np.maximum(_kinds(doc, rank, own, kind), 0)
            hot = np.flatnonzero(found & WINDOWS)
            by = ((WHOLE, key), (BEFORE, key ^ (tags >> _U(16) | _U(1 << 16))), (AFTER, key ^ (tags & _U(0xFFFF) | _U(1 << 17))))
            calm = np.concatenate([np.flatnonzero(found & x) for x, _ in by])
            calm_keys = np.concatenate([k[found & x > 0] for x, k in by])
            size = last[hot] - first[hot] + 1
            pos = np.repeat(first[hot] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            names_of = tx.span(tx.prefix(part), pos, pos + LENGTH) if len(pos) else pos.astype(_U)
            d = np.concatenate([doc[calm], np.repeat(doc[hot], size)])
            start = np.concatenate([first[calm], pos])
            end = np.concatenate([last[calm], pos]) + LENGTH
            keys = np.concatenate([calm_keys, names_of]).view(np.int64)
            for i in range(0, len(d), 20_000):
                z = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[z]), pa.array(ids[a + d[z]]), pa.array(ths[a + d[z]]), pa.array(start[z] - at[d[z]]), _slices(part, start[z], end[z])], names=names)


def _compared(batches):
    """Windows of asked segments, by key and document: those that a smaller document has, as stretches."""
    schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def flush(held, open_key, seen, seen_doc):
        key, doc, th, pos, size, part = (np.concatenate(x) for x in zip(*held, strict=True))
        if key[0] != open_key:
            seen, seen_doc = seen[:0], seen_doc[:0]
        begin = np.cumsum(size) - size
        number = size - LENGTH + 1
        row = np.repeat(np.arange(len(size)), number)
        step = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        at = begin[row] + step
        # the key is mixed as that of a window dealt alone is the window's hash itself
        name = np.concatenate([seen, tx.span(tx.prefix(part), at, at + LENGTH) ^ tx.mix(key.view(_U))[row]])
        d = np.concatenate([seen_doc, doc[row]])
        order = np.lexsort((d, name))
        new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        hit = np.zeros(len(d), bool)
        hit[order] = d[order] > d[order][np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
        # a run may close within a key, whose windows the next one then has to know
        last = order[new]
        last = last[np.concatenate([np.full(len(seen), key[0]), key[row]])[last] == key[-1]]
        hit = np.flatnonzero(hit[len(seen) :])
        # windows that follow each other in one segment are one stretch
        new = np.concatenate([[True], (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])]) if len(hit) else np.zeros(0, bool)
        a = hit[new]
        z = hit[np.concatenate([new[1:], [True]])] if len(hit) else hit
        r = row[a]
        found = pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), pa.array(pos[r] + step[a]), pa.array(pos[r] + step[z] + LENGTH)], schema=schema)
        return found, (key[-1], name[last], d[last])

    held, n, known = [], 0, (None, np.empty(0, _U), np.empty(0, np.int64))
    for batch in batches:
        if not len(batch):
            continue
        part, off = tx.text_bytes(batch.column(4))
        held.append((*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)), np.diff(off), part))
        n += len(batch)
        if n >= HELD // 8:
            found, known = flush(held, *known)
            yield found
            held, n = [], 0
    if n:
        yield flush(held, *known)[0]


def _closed(batches):
    """Take out all that goes and hash what stays."""
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        ids, ths = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        data, off = tx.text_bytes(batch.column(2))
        for a, b, part, at in tx.pieces(data, off, PIECE):
            own, kind = _said(batch, 3, a, b)
            edge = np.zeros(len(part) + 1, np.int32)
            if (kind == GONE).any():
                doc, first, last, _, rank, _ = samples(part, at)
                gone = _kinds(doc, rank, own, kind) == GONE
                np.add.at(edge, first[gone], 1)
                np.add.at(edge, last[gone] + LENGTH, -1)
            more = batch.column(4).slice(a, b - a)
            size = np.nan_to_num(pc.list_value_length(more).to_numpy(zero_copy_only=False)).astype(np.int64)
            if size.any():
                flat = more.flatten()
                th, start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                doc = np.repeat(np.arange(b - a), size)
                mine = th == ths[a + doc]  # another text may share the id
                np.add.at(edge, at[doc[mine]] + start[mine], 1)
                np.add.at(edge, at[doc[mine]] + end[mine], -1)
            out = np.cumsum(edge[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(out)])
            rises = out.copy()
            rises[1:] &= ~out[:-1]
            rises[at[:-1]] = out[at[:-1]]
            spans = np.concatenate([[0], np.cumsum(rises)])
            kept = memoryview(np.ascontiguousarray(part[~out]))
            stay = at - removed[at]
            digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(stay[:-1].tolist(), stay[1:].tolist(), strict=True)]
            total = lambda x: x[at[1:]] - x[at[:-1]]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(np.diff(at)), pa.array(total(removed)), pa.array(total(spans)), pa.array(digests, pa.string())], schema=schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    facts = written(docs.select("doc", "th", F.sha1(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    first = facts.where(f"n_bytes >= {LENGTH}").groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    copies = facts.join(written(first.where("n > 1"), "first-copies"), "digest").where(f"doc > first and n_bytes >= {LENGTH}")
    copies = written(copies.select("doc", "th", "n_bytes"), "copies")
    ids = copies.select("doc", "th").distinct()
    ids = F.broadcast(ids) if copies.count() <= COPIES else ids
    long = docs.where(f"doc is not null and octet_length(text) >= {LENGTH}").join(ids, ["doc", "th"], "left_anti")

    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(64, total // BUCKET_BYTES)
    dealt = long.select("doc", "text").mapInArrow(tx.trimmed(_dealt(buckets)), "bucket long, keys binary, ranks binary, docs binary, tags binary, reply boolean")
    replies = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tx.trimmed(_sorted_buckets(MANY, CROWD)), "doc long, rank long, kind byte")
    # dealt by document before they are gathered: partial lists would cost more than they save
    replies = replies.select("doc", F.expr(f"shiftleft(rank, {KIND_BITS}) + kind").alias("code")).repartition("doc")
    replies = written(replies.groupBy("doc").agg(F.collect_list("code").alias("said")), "replies")

    # one plan for both uses of the texts, so that their exchange is made once
    told = long.join(replies, "doc", "left").select("doc", "th", "text", "said")
    asked = told.mapInArrow(tx.trimmed(_asked), "key long, doc long, th long, pos long, bytes binary")
    found = asked.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(tx.trimmed(_compared), "doc long, th long, start long, end long")
    found = found.groupBy("doc").agg(F.collect_list(F.struct("th", "start", "end")).alias("more"))
    closed = told.join(found, "doc", "left").select("doc", "th", "text", "said", "more").mapInArrow(tx.trimmed(_closed), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    result = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    number = lambda n: F.lit(n).cast("long")
    short = docs.where(f"doc is null or octet_length(text) < {LENGTH}").select("doc", F.octet_length("text").cast("long").alias("n_bytes"), number(0).alias("n_removed"), number(0).alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    same = copies.select("doc", "n_bytes", F.col("n_bytes").alias("n_removed"), number(1).alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    out = closed.select(*result).union(short.select(*result)).union(same.select(*result))
    return out.withColumnRenamed("doc", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: All strings of LENGTH bytes, as hexadecimal digits, which are cut into pieces first as substr() counts from the start.
SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, j, substr(h, 512 * j + 1, {512 + 2 * LENGTH}) AS h FROM (SELECT doc_id, h, unnest(range((length(h) + 511) // 512)) AS j FROM h)),
b AS (SELECT doc_id, 256 * j + i AS i, substr(h, 2 * i + 1, 2) AS byte, substr(h, 2 * i + 1, {2 * LENGTH}) AS w
      FROM (SELECT doc_id, j, h, unnest(range(least(256, length(h) // 2))) AS i FROM p)),
w AS (SELECT doc_id, i, w FROM b WHERE length(w) = {2 * LENGTH}),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w),
hit AS (SELECT doc_id, i FROM w JOIN f USING (w) WHERE doc_id > first),
m AS (SELECT b.doc_id, b.i, byte, hit.i AS own FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.i = b.i),
c AS (SELECT doc_id, i, byte, count(own) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM m),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS rises FROM c),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE rises) AS n_spans,
             coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT h.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN s USING (doc_id)
"""
