"""Each stage of the pipeline against brute force, on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
from ledgerline.llm import packing
from ledgerline.llm.common import table
from tests.llm.test_links_and_search import groups, multiset, plain_words
from tests.llm.test_text_operators import lines_left


def _leaks(docs, items):
    """Documents with an item-sized window that is similar enough; items without a common shingle are passed over."""
    bench = [(len(w), b) for _, body in items if (w := plain_words(body)) for b in [multiset(w)]]
    out = set()
    for d, text in docs:
        w = plain_words(text)
        whole = set(multiset(w))
        for m, b in bench:
            if whole & set(b) and any(100 * sum((a & b).values()) >= 80 * sum((a | b).values()) for s in range(max(1, len(w) - m + 1)) for a in [multiset(w[s : s + m])]):
                out.add(d)
                break
    return out


def test_stages_equal_brute_force(spark, small):
    docs = table(spark, small, "documents")
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, small).cache()
    assert kept.count() >= 0.99 * docs.count()

    before = rows(kept)
    after = stages["line_dedup"](spark, kept, small).cache()
    want = lines_left(list(before.items()))
    assert rows(after) == {d: want[d, t][0] if want[d, t][1] else t for d, t in before.items() if not want[d, t][1] or want[d, t][1] < len((t or "").split("\n"))}

    before = rows(after)
    single = stages["near_dedup"](spark, after, small).cache()
    top = groups(list(before.items()), 5)
    assert rows(single) == {d: t for d, t in before.items() if top[d] == d}

    before = rows(single)
    clean = stages["decontaminate"](spark, single, small).cache()
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    leaked = _leaks(list(before.items()), items)
    assert rows(clean) == {d: t for d, t in before.items() if d not in leaked} and leaked

    packed = stages["best_fit_packing"](spark, clean, small).collect()
    tokens = Counter()
    bins: dict = {}
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert +tokens == +Counter({d: len((t or "").split()) for d, t in rows(clean).items()})
    source = {r.doc_id: r.source for r in clean.select("doc_id", "source").collect()}
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= packing.CAPACITY
        assert len({source[r.doc_id] for r in held}) == len(held)


def test_run_goes_through_all_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start_token", "n_tokens", "bin_id"] and out.count() > 100
