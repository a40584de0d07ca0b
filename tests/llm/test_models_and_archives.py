"""Language ID, quality and WARC: accuracy, round trips, odd rows; then the pipeline."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import language_id, quality, warc
from ledgerline.llm.common import table
from tests.llm.fixtures import empty, frame, odd, odd_rows


def test_language_of_held_out_declarations(spark, small):
    docs = table(spark, small, "documents")
    # a quarter of the declarations is wrong on purpose
    wrong = docs.withColumn("declared", F.when(F.col("doc_id") % 4 == 0, F.element_at(F.array(*map(F.lit, language_id.LANGUAGES)), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise(F.col("lang")))
    got = language_id.identify(wrong, declared="declared", keep=["doc_id", "lang"])
    assert got.where("lang = language").count() >= 0.95 * docs.count()
    assert got.where("not accepted").count() <= 0.01 * docs.count()


def test_language_odd_rows(spark):
    got = language_id.identify(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    assert all(not r.accepted for r in got if not (r.text or "").strip())
    assert all(r["row"] == "clash" and 0 <= r.posterior <= 1 + 1e-9 for r in got)
    assert language_id.identify(empty(spark)).count() == 0


def test_host_priors_are_smoothed_towards_the_domain(spark):
    rows = [("a.example.de", "de")] * 60 + [("b.example.de", "de")] * 30 + [("c.example.de", None)] + [("x.example.fr", "fr")] * 60 + [("lone", "en")]
    got = {r.host: r.prior for r in language_id.host_priors(spark.createDataFrame(rows, "host string, declared string")).collect()}
    de, fr = language_id.LANGUAGES.index("de"), language_id.LANGUAGES.index("fr")
    assert got["a.example.de"][de] > 0.8 and got["c.example.de"][de] > 0.6 and got["x.example.fr"][fr] > 0.7
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.values())


def by_hand(rows, languages):
    """Brute force: (language, posterior) of each (declared, host, suffix, text) row."""
    fold = lambda t: [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode()]

    def trigrams(text):
        t = fold(text or "")
        for a, b, c in zip(t, t[1:], t[2:], strict=False):
            if (a, b) != (32, 32) and (b, c) != (32, 32):
                yield ((a * 2654435761 & 0xFFFFFFFF ^ b * 2246822519 & 0xFFFFFFFF ^ c * 3266489917 & 0xFFFFFFFF) * 668265263 & 0xFFFFFFFF) >> 18

    two = lambda d: (d or "").strip().lower()[:2]
    counts = {x: Counter(g for d, _, _, t in rows if two(d) == x for g in trigrams(t)) for x in languages}
    levels = lambda h: [(0,), *([(1, h.split(".")[-1])] if "." in h else []), *([(2, ".".join(h.split(".")[-2:]))] if h.count(".") > 1 else []), (3, h)]
    held = Counter((level, two(d)) for d, h, _, _ in rows if h for level in levels(h) if two(d) in languages)
    out = []
    for d, h, suffix, text in rows:
        prior = {x: 1 / len(languages) for x in languages}
        if h:
            for level in levels(h):
                own = {x: held[level, x] + (level == (0,)) - (level[0] == 3 and two(d) == x) for x in languages}
                weight = 0 if level == (0,) else language_id.HOST_WEIGHT
                prior = {x: (own[x] + weight * prior[x]) / (sum(own.values()) + weight) for x in languages}
        grams = list(trigrams(text))
        share = min(language_id.TEXT_WEIGHT, len(grams)) / max(len(grams), 1)
        logs = {}
        for x in languages:
            total = sum(counts[x].values()) + language_id.BUCKETS
            logs[x] = math.log(prior[x]) + share * sum(math.log((counts[x][g] + 1) / total) for g in grams)
            for said, right in ((two(d), language_id.DECLARED_RIGHT), (language_id.SUFFIXES.get((suffix or "").lower()), language_id.SUFFIX_RIGHT)):
                if said in languages:
                    logs[x] += math.log(right if said == x else (1 - right) / (len(languages) - 1))
        odds = {x: math.exp(v - max(logs.values())) for x, v in logs.items()}
        best = max(languages, key=lambda x: odds[x])
        out.append((best, odds[best] / sum(odds.values())))
    return out


def test_language_equals_brute_force(spark):
    rng, rows = random.Random(31), []
    stems = {"de": "der die und nicht straße", "en": "the and of which thing", "es": "el de niño que pero", "fr": "le garçon est dans une"}
    for i in range(60):
        x = rng.choice(list(stems))
        text = " ".join(rng.choice(stems[x].split()) + rng.choice(["", "a", "en"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([x, x.upper(), f"{x}-XX", "zz", None]), rng.choice(["a.b.de", "c.b.de", "x.fr", "lone", None]), rng.choice(["de", "FR", "xyz", None]), rng.choice([text, text.upper(), None]) if i else "漢字 --  !"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, declared string, host string, suffix string, text string").withColumn("_declared", F.lit("clash")).withColumn("_prior", F.lit(1))
    got = {r.n: (r.language, r.posterior) for r in language_id.identify(df, "declared", "host", "suffix").collect()}
    for i, (language, posterior) in enumerate(by_hand(rows, language_id.LANGUAGES)):
        assert abs(got[i][1] - posterior) < 1e-3 and (got[i][0] == language or posterior < 0.51), (i, rows[i], got[i], language, posterior)


def test_pages_are_identified_by_their_markup(spark, small):
    pages = language_id.page_evidence(table(spark, small, "pages")).select("page_id", "declared", "host")
    got = language_id.page_query(spark, small).join(pages, "page_id")
    assert got.count() == pages.count() and got.where("language = declared").count() >= 0.9 * got.where("declared is not null and accepted").count()


def test_page_evidence(spark):
    html = "<!DOCTYPE html><HTML class=x lang='DE-at'><script>var t='</p>';</script><p>Guten <b>Tag</b><!-- no --></p>"
    rows = [(1, "https://u@www.example.DE:80/x?y", html), (2, None, None), (3, "nothing", "")]
    got = {r.page_id: r for r in language_id.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix) == ("de", "www.example.de", "de") and got[1].text.split() == ["Guten", "Tag"]
    assert (got[2].declared, got[2].host, got[2].suffix, got[2].text) == (None, None, None, "")
    assert got[3].host is None


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).join(table(spark, d, "labels").where("quality is not null"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert len(got) > 80 and right >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_learns_from_nothing_that_is_held_out(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 1), (9, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.out for r in docs.select("doc_id", quality.held_out().alias("out")).collect()}
    assert all(out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, out in kept.items())
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty(spark), none).count() == 0


def test_trees_learn_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


def test_warc_round_trip(spark):
    big, other = "<p>" + "payload ä " * 200, "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, None, big), (None, "http://n", big), (4, "http://s p\r\nace", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("keeper", F.lit("clash"))
    folder, index = warc.write(pages.repartition(3))
    got = warc.read(folder, index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
        assert r.payload == (html if r.record_type == "response" else None)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None) and kinds[None] == ("response", None)
    assert kinds[4] == kinds[5] == kinds[9] == kinds[10] == ("response", None)
    heads = [gzip.decompress(open(r.file, "rb").read()[r.offset : r.offset + r.length]).decode() for r in index.collect()]
    assert len({h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads}) == len(rows) and all("\r\nWARC-Date: 2" in h for h in heads)
    some = warc.read(folder, index.where("page_id in (2, 8)")).collect()
    assert sorted(r.page_id for r in some) == [2, 8]


def test_warc_files_are_plain_gzip_members(spark):
    folder, index = warc.write(spark.createDataFrame([(1, "http://a", "body")], "page_id long, url string, html string"))
    with open(index.first().file, "rb") as file:
        text = gzip.decompress(file.read()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and "WARC-Target-URI: http://a\r\n" in text and text.endswith("body\r\n\r\n")


def test_warc_empty(spark):
    folder, index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read(folder, index).count() == 0


def test_pipeline_stages_keep_the_columns_and_pack_what_is_left(spark, small):
    docs = table(spark, small, "documents").select(*corpus_pipeline.COLUMNS)
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small).cache()
        assert after.columns == corpus_pipeline.COLUMNS, name
        assert 0 < after.count() <= docs.count()
        assert after.select("doc_id").distinct().count() == after.count()
        docs = after
    assert docs.count() > 0.7 * total
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_odd_rows(spark, small):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        assert docs.count() > 0, name
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, small)
        assert none.count() == 0
