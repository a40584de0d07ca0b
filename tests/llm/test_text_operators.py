"""License scan, substring dedup, line dedup: against plain Python on small tables."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import license_scan, line_dedup, substring_dedup
from ledgerline.llm.common import parted
from tests.llm.fixtures import empty, frame, odd, odd_rows, words

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
    found = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), found


def test_license_scan_counts_all_base_places(spark):
    rng = random.Random(3)
    vocabulary = ["cc", "CC", "by", "general", "public", "license", "GENERAL", "all", "rights", "reserved", "x", "émile", "by-nc", "K"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(120)]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        n, found = base_places(text)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(found)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_scan_merges_diagonals(spark):
    text = "Licensed under the Apache License, surely Version 2.0. and more"
    (r,) = license_scan.scan(frame(spark, [(1, text, None, None, None)])).collect()
    assert "apache-2.0" in r.labels.split(",") and r.base_labels == ""


def test_license_scan_rejects_grams_longer_than_a_phrase(spark):
    with pytest.raises(ValueError):
        license_scan.scan(odd(spark), k=3)


def test_license_scan_odd_rows(spark):
    got = license_scan.scan(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r.n_words for r in got if r.doc_id == 2 or r.doc_id == 3) == [0, 0]
    assert license_scan.scan(empty(spark)).count() == 0


def cut(rows):
    """Brute force: what is left of each text, per row."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if d is not None and first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many", [1, 256])
def test_substring_dedup_is_exact(spark, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    rng = random.Random(7)
    passages = [words(rng, 14, 30) for _ in range(6)] + ["ab" * 60, "a" * 130]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.6 else words(rng, rng.randrange(25), 50) for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(50), "\n".join(parts), None, None, None))
    rows += odd_rows()[:5] + odd_rows()[5:]
    df = frame(spark, rows).repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(df).collect()), key=repr)
    assert got == cut([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("crowd", [2, 4096])
def test_substring_dedup_of_passages_that_hundreds_share(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    short, line, rare = letters(40), letters(70), letters(90)
    # beside 40 shared bytes nothing goes; of the rare passage each text has another part
    rows = [(i, letters(30) + (short if i % 3 else line) + letters(30), None, None, None) for i in range(900)]
    rows += [(i, letters(20) + rare[rng.randrange(30) : rng.randrange(60, 91)] + letters(20), None, None, None) for i in range(900, 960)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows)).collect()), key=repr)
    assert got == cut([(r[0], r[1]) for r in rows])


def test_substring_dedup_compares_one_key_over_all_batches():
    window, other = b"w" * 50, b"o" * 50

    def batch(key, docs, text):
        return pa.RecordBatch.from_arrays([pa.array([key] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(docs, pa.int64()), pa.array([0] * len(docs), pa.int64()), pa.array([text] * len(docs), pa.binary())], names=["key", "doc", "th", "pos", "bytes"])

    batches = [batch(1, range(9000 * i, 9000 * i + 9000), window) for i in range(4)] + [batch(2, range(5), other)]
    gone = [d for found in substring_dedup._compared(iter(batches)) for d in found.column(0).to_pylist()]
    assert sorted(gone) == sorted([*range(1, 36000), *range(1, 5)])


def test_substring_dedup_empty(spark):
    assert substring_dedup.dedup(empty(spark)).count() == 0


def lines_left(rows, run=3, long=50):
    """Brute force: documents by (id, text), each once; the lines that stay."""
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    texts = sorted({(d if d is not None else 2**63 - 1, t or "", d, t) for d, t in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for _, text, d, t in texts:
        lines = text.split("\n")
        shown = ["" if not x.strip(" ") else x for x in lines]
        gone = set()
        for i in range(len(lines)):
            n = next((n for n in range(1, run) if i + n <= len(lines) and sum(map(count, lines[i : i + n])) >= long), run)
            w = tuple(shown[i : i + n])
            if i + n > len(lines) or not any(w):
                continue
            if w in seen:
                gone |= set(range(i, i + n))
            seen.add(w)
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_line_dedup_is_exact(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  ", "d e"]) + str(rng.randrange(3)) * rng.randrange(2) for _ in range(rng.randrange(14))), None, None, None) for i in range(80)]
    rows += [r for r in odd_rows() if r[0] not in (9,)]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    want = lines_left([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    left = sorted((repr(r.doc_id), r.text or "", r.line_dedup.n_removed) for r in got)
    assert left == sorted((repr(r[0]), *want[r[0], r[1]]) for r in rows)
    assert all(r["row"] == "clash" for r in got)


def test_line_dedup_takes_short_runs_of_many_words(spark):
    rng = random.Random(9)
    pool = [words(rng, n) for n in (3, 20, 26, 30, 49, 50, 51, 70)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, rng.randrange(30)) for _ in range(rng.randrange(1, 9))), None, None, None) for i in range(60)]
    got = line_dedup.dedup_lines(frame(spark, rows).withColumns({"_doc": F.lit(1), "_RUNS": F.lit(2), "line_dedup": F.lit(3)})).collect()
    want = lines_left([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.text, r.line_dedup.n_removed) for r in got} == {r[0]: want[r[0], r[1]] for r in rows}
    assert all((r["_doc"], r["_RUNS"]) == (1, 2) for r in got) and sum(r.line_dedup.n_removed for r in got) > 20


def test_keys_are_parted_without_loss(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.lit(7).alias("_slot"))
    keys = spark.createDataFrame([(7 * i,) for i in range(300)], "key long")
    maybe, no = parted(rows, F.col("k"), keys)
    among = {r.k for r in maybe.collect()}
    assert {7 * i for i in range(300) if 7 * i % 50} <= among and len(among) < 900
    assert maybe.count() + no.count() == 5000 and maybe.columns == no.columns == rows.columns
    assert parted(rows, F.col("k"), keys.limit(0))[0].count() == 0


def test_line_dedup_finds_runs_between_documents(spark):
    shared = "one line\ntwo line\nthree line\nfour line"
    rows = [(1, f"start\n{shared}\nend", None, None, None), (2, f"other\n{shared}\nlast\none line\ntwo line", None, None, None)]
    got = {r.doc_id: (r.text, r.line_dedup.n_runs) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other\nlast\none line\ntwo line", 1)}
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
