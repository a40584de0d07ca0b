"""Near-dedup, decontamination, top-k search and packing against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, near_dedup, packing, topk_search
from ledgerline.llm.components import components
from tests.llm.fixtures import DOCS, empty, frame, odd, odd_rows, words

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LETTERS))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k):
    """Brute force: smallest id that each document reaches."""
    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: top(d) for d in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup_finds_every_component(spark):
    rng = random.Random(11)
    rows = []
    for family in range(5):
        base = words(rng, 160)
        rows += [(1000 * family + i, edited(rng, base, rng.randrange(9)), None, None, None) for i in range(40)]
    chain = words(rng, 200)
    for i in range(30):  # neighbours are alike, the ends are not
        rows.append((9000 + i, chain, None, None, None))
        chain = edited(rng, chain, 3)
    rows += [(20000 + i, words(rng, rng.randrange(1, 40)), None, None, None) for i in range(60)]
    rng.shuffle(rows)
    for hot in (1, 64):
        got = {r.doc_id: r for r in near_dedup.link(frame(spark, rows), k=4, hot=hot).collect()}
        want = groups([(r[0], r[1]) for r in rows], 4)
        assert {d: r.component_id for d, r in got.items()} == want
    for d, text, *_ in rows:
        assert got[d].n_shingles == len(shingles(text, 4)) and got[d].kept == (d == want[d])


def test_near_dedup_odd_rows(spark):
    got = near_dedup.link(odd(spark), k=4).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id is None and r.kept for r in by[None])
    assert {r.component_id for r in by[4]} == {1} and not any(r.kept for r in by[4])
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[5][0].n_shingles == 0 and by[2][0].kept
    assert by[7][0].component_id == 6
    assert near_dedup.link(empty(spark)).count() == 0


def test_rows_that_repeat_an_id_meet_once(spark, monkeypatch):
    rng, met = random.Random(29), []
    base = words(rng, 120)
    rows = [(d, edited(rng, base, 1 + d % 3), None, None, None) for d in range(6)] * 20
    compare = near_dedup._compare
    monkeypatch.setattr(near_dedup, "_compare", lambda *a: met.append(compare(*a)) or met[-1])
    got = near_dedup.link(frame(spark, rows), k=4).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == groups([r[:2] for r in rows], 4)
    assert met[0].count() and all(f.count() == f.select("a", "b").distinct().count() for f in met)


def test_rows_of_one_id_keep_the_links_of_each_text(spark):
    rng = random.Random(31)
    one, two = words(rng, 150, 9000), words(rng, 150, 9000)
    rows = [(1, one, None, None, None), (1, two, None, None, None), (2, edited(rng, one, 2), None, None, None), (3, edited(rng, two, 2), None, None, None)]
    rows += [(10 + i, words(rng, 30, 9000), None, None, None) for i in range(20)]
    got = near_dedup.link(frame(spark, rows), k=4).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == groups([r[:2] for r in rows], 4)


def test_near_dedup_moves_only_texts_that_may_be_alike(spark, monkeypatch):
    rng, made = random.Random(37), {}
    rows = [(i, words(rng, 60, 90000), None, None, None) for i in range(400)]
    rows += [(1000 + i, edited(rng, rows[i][1], 1), None, None, None) for i in range(10)]
    written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, tag: made.setdefault(tag, []).append(written(df, tag)) or made[tag][-1])
    got = near_dedup.link(frame(spark, rows), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == groups([r[:2] for r in rows], 4)
    assert all(20 <= made[tag][0].count() < 60 for tag in ("reps", "sets", "posted-classes"))


def _recorded(monkeypatch):
    made, written = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, tag: made.setdefault(tag, []).append(written(df, tag)) or made[tag][-1])
    return made


def test_near_dedup_writes_signatures_once(spark, monkeypatch):
    rng, made = random.Random(41), _recorded(monkeypatch)
    rows = [(i, words(rng, 40, 90000), None, None, None) for i in range(200)]
    rows += [(1000 + i, rows[i % 7][1], None, None, None) for i in range(21)] + [(None, rows[0][1], None, None, None), (None, rows[50][1], None, None, None)]
    rows += [(2000, edited(rng, rows[3][1], 1), None, None, None), (2001, edited(rng, rows[60][1], 1), None, None, None)]
    got = near_dedup.link(frame(spark, rows), k=4).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == groups([r[:2] for r in rows], 4)
    # of the sets that one row has, the signatures are all that stands of the tokens
    assert {r.rep for r in made["classes"][0].collect()} == set(range(7))


def test_open_pairs_without_what_cannot_be_a_link(spark, monkeypatch):
    rng, made, rows = random.Random(43), _recorded(monkeypatch), []
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    for family in range(3):
        base = words(rng, 160, 9000)
        rows += [(1000 * family + i, base.rsplit(" ", 40)[0] + " " + words(rng, 40, 9000), None, None, None) for i in range(12)]
        for i in range(12):  # neighbours are alike, most of them are not like a hub
            base = edited(rng, base, 4)
            rows.append((1000 * family + 100 + i, base, None, None, None))
    rng.shuffle(rows)
    for hot in (1, 64):
        got = {r.doc_id: r.component_id for r in near_dedup.link(frame(spark, rows), k=4, hot=hot).collect()}
        assert got == groups([r[:2] for r in rows], 4) and made["open-pairs"][-1].count()
        assert "extras" not in made["members"][-1].columns and 0 < made["bounds"][-1].count() < made["members"][-1].count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and 5000 not in got
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def multiset(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)]) if w else Counter()


def leaked(docs, items, k=5):
    """Brute force: (doc, item) pairs with a window of the item's size that is similar enough."""
    out = set()
    for d, text in docs:
        w = plain_words(text)
        for item, body in items:
            i = plain_words(body)
            if not i or not w:
                continue
            b = multiset(i, k)
            for start in range(max(1, len(w) - len(i) + 1)):
                a = multiset(w[start : start + len(i)], k)
                if 100 * sum((a & b).values()) >= 80 * sum((a | b).values()):
                    out.add((d, item))
                    break
    return out


def test_decontamination_finds_items_and_nothing_else(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(3, 60), 300)) for i in range(25)] + [(90, ""), (91, None)]
    docs = []
    for i in range(90):
        text = words(rng, rng.randrange(120), 300)
        if i % 3 == 0:
            body = rng.choice(items[:25])[1].split()
            for _ in range(rng.randrange(3)):
                body[rng.randrange(len(body))] = "changed"
            text = f"{text} {' '.join(body).upper() if i % 2 else ', '.join(body)} {words(rng, 10, 300)}"
        docs.append((i, text, None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaked([(d[0], d[1]) for d in docs], items)
    assert all(0.8 <= r.similarity <= 1 for r in got) and len(got) > 10


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "one"), (None, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd(spark), items).collect()}
    assert got == {(1, 1), (4, 1), (None, 1), (9, 2), (9, None)}
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(odd(spark), items.limit(0)).count() == 0


def own_leaks(spark, rng, pairs):
    """(what leaks finds, brute force) of each text against its own item, between other words."""
    docs = [(i, f"{words(rng, rng.randrange(20, 60), 9000)} {text} {words(rng, rng.randrange(20, 60), 9000)}", None, None, None) for i, (_, text) in enumerate(pairs)]
    bench = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(pairs)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    return got, set().union(*(leaked([d[:2]], [(i, pairs[i][0])]) for i, d in enumerate(docs)))


def test_decontamination_finds_windows_that_start_beside_the_hits(spark):
    rng, pairs = random.Random(21), []
    for _ in range(300):
        body = words(rng, rng.randrange(70, 110), 9000).split()
        text = list(body)
        del text[-rng.randrange(2, 12)]
        for _ in range(rng.randrange(1, 4)):
            text.insert(rng.randrange(1, 12), f"put{rng.randrange(10**6)}")
        pairs.append((" ".join(body), " ".join(text)))
    got, want = own_leaks(spark, rng, pairs)
    assert got == want and len(want) > 100


def test_decontamination_finds_swapped_parts(spark):
    rng, pairs = random.Random(22), []
    for _ in range(60):
        body = words(rng, rng.randrange(40, 90), 9000).split()
        cut = len(body) // 2 + rng.randrange(-8, 9)
        pairs.append((" ".join(body), " ".join(body[cut:] + body[:cut])))
    got, want = own_leaks(spark, rng, pairs)
    assert got == want and len(want) == 60


@pytest.mark.parametrize("scale", [1.0, 2e7])
def test_topk_search_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(0)
    rows = [(i, [int(x) for x in np.floor(rng.normal(0, 20, 8) * scale)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(400, None), (None, [1] * 8), (401, [1, 2, 3]), (402, [4, 5, 6]), (403, []), (404, [0] * 8), (405, [1, None, 3])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = {}
    for r in topk_search.search(df, df.where("vec_id % 25 = 0 or vec_id in (401, 403)"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    for q, v in usable:
        if q % 25 and q not in (401, 403):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
        assert sorted(got.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_maxscore_skips_what_cannot_reach_the_threshold():
    rng = np.random.default_rng(5)
    columns, query, ids = rng.integers(-50, 50, (16, 400)).astype(float), rng.integers(-50, 50, 16).astype(float), np.arange(400)
    scores = query @ columns
    for floor in (None, -1e9, *np.sort(scores)[[-1, -5, -6, -40, 0]], 1e9):
        got = topk_search.maxscore(ids, columns, columns.max(axis=1), columns.min(axis=1), 7, query, 5, floor)
        want = sorted((-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) if i != 7 and (floor is None or s >= floor))[:5]
        assert [(-s, i) for i, s in zip(*(x.tolist() for x in got), strict=True)] == want


def test_topk_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, None), (5, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in df.where(topk_search.usable("embedding")).collect()) == [0, 5]
    none = spark.createDataFrame([], "vec_id long, vec array<long>")
    assert topk_search.search(none, none).count() == 0


def first_fit_bins(items, capacity):
    """Brute force best-fit: the tightest bin with room that holds neither source nor cluster."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(room, n) for n, (room, s, c) in enumerate(bins) if room >= size and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if not fits:
            bins.append([capacity, set(), set()])
            fits = [(capacity, len(bins) - 1)]
        _, n = min(fits)
        bins[n][0] -= size
        bins[n][1] |= {source} - {None}
        bins[n][2] |= {cluster} - {None}
        out.append(n)
    return out


def test_best_fit_is_tightest_and_free_of_conflicts():
    rng = random.Random(6)
    for _ in range(30):
        items = sorted(((rng.randrange(1, 100), rng.choice(["a", "a", "b", "c", None]), rng.choice([1, 2, 3, None])) for _ in range(80)), key=lambda x: -x[0])
        assert packing.best_fit(items, 100) == first_fit_bins(items, 100)


def test_packing_places_every_token(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 90)), "en", rng.choice("abc"), 1) for i in range(150)] + odd_rows()
    got = packing.pack(frame(spark, rows), capacity=32, shard_rows=40).collect()
    tokens = Counter()
    bins = {}
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        if r.bin_id is None:
            assert r.n_tokens == 0 and r.piece is None
        else:
            bins.setdefault(r.bin_id, []).append(r)
    want = Counter()
    for d, t, *_ in rows:
        want[d] += len((t or "").split())
    assert +tokens == +want
    assert all(sum(r.n_tokens for r in b) <= 32 for b in bins.values())
    assert packing.pack(empty(spark)).count() == 0
    schema = spark.createDataFrame([(1, "a b c", None, None, None)], DOCS)
    assert packing.pack(schema, capacity=2).orderBy("piece").select("piece", "start_token", "n_tokens").collect() == [(0, 0, 2), (1, 2, 1)]
    assert packing.pack(frame(spark, rows), source=F.lit("x"), capacity=32).where("bin_id is not null").groupBy("bin_id").count().where("count > 1").count() == 0


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    rng, rows = random.Random(23), []
    for i in range(12):  # pairs of near copies from two sources, with repeated and null ids
        text = words(rng, 60 + i, 9000)
        rows += [(i, text, "en", "a", 1), (None if i % 3 == 0 else i if i % 3 == 1 else 100 + i, text + " more", "en", "b", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(len(r[1].split()) for r in rows)
    size = {(len(r[1].split()), r[0]): i // 2 for i, r in enumerate(rows)}
    held = [(r.bin_id, size[r.n_tokens, r.doc_id]) for r in got]
    assert len(set(held)) == len(held)


def test_packing_counts_tokens_in_the_pass_that_signs(spark, tmp_path, monkeypatch):
    rng = random.Random(41)
    text = words(rng, 3000, 9000)
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows()] + [(50, " \x0b one\x0ctwo\r\nthree\u00a0four\t", "en", "a", 1), (51, text, "en", "a", 1), (52, text, "en", "b", 1), (53, text.upper(), "en", None, 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    monkeypatch.setattr(packing, "tokens", lambda text: pytest.fail("texts are read again to count their tokens"))
    got = packing.query(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in got) == want
    rest = [(r.bin_id, r.n_tokens) for r in got if r.doc_id in (51, 52, 53) and r.piece == 1]
    assert len(rest) == 3 and len({b for b, _ in rest}) == 3
