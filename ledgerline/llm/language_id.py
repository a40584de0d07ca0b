"""Language ID by Bayesian fusion of text, declared markup, address suffix and host.

log P(lang | row) is, up to a constant, the sum of
- the text: log likelihoods of hashed byte trigrams over the whole text, as a mean that
  counts as at most `weight` trigrams (neighbouring trigrams are far from independent);
- the declared language and the address suffix, each right with a stated probability;
- the host: counts of declared languages per host without the row's own declaration,
  smoothed towards its registered domain, that towards its suffix and that towards the
  whole (grouped aggregation).
A declaration counts by its first two letters, whatever their case. The trigram counts
come from all texts under their declared language; the model's size is
languages x buckets, whatever the input.

Results in odd cases: a null or letterless text has no text evidence and is rejected,
with the language of the other evidence; unknown or null declarations, suffixes and hosts
add nothing; each row is judged by itself, so repeated rows and null doc_ids just keep
their place; with no declared text at all every language is as likely; an empty table
gives an empty result. Other columns pass through identify() untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import textops as tx
from ledgerline.llm.common import fresh, join_small, table, written

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 14
#: Address suffixes that point to a language.
SUFFIXES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "mx": "es", "uk": "en", "us": "en"}
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
HOST_WEIGHT = 20.0
TEXT_WEIGHT = 60.0
LEAST_POSTERIOR = 0.6

#: Bytes that are no letters count as one space; A-Z as a-z.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def _trigrams(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte (BUCKETS where none counts), and where each text starts."""
    folded = _FOLD[part]
    out = np.full(len(part), BUCKETS, np.int64)
    if len(part) > 2:
        h = (folded[:-2] * np.uint32(2654435761) ^ folded[1:-1] * np.uint32(2246822519) ^ folded[2:] * np.uint32(3266489917)) * np.uint32(668265263)
        out[:-2] = h >> np.uint32(18)
        blank = folded == 32
        out[:-2][blank[:-2] & blank[1:-1]] = BUCKETS
        out[:-2][blank[1:-1] & blank[2:]] = BUCKETS
        for back in (1, 2):
            ends = off[1:] - back
            out[ends[ends >= 0]] = BUCKETS  # a trigram stays within its text
    return out, off


def _counted(languages: tuple[str, ...]):
    def run(batches):
        sums = np.zeros((len(languages), BUCKETS + 1), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            data, off = tx.text_bytes(batch.column(1))
            declared = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for a, b, part, at in tx.pieces(data, off):
                of = np.repeat(declared[a:b], np.diff(at))
                found = _trigrams(part, at)[0]
                seen = of >= 0
                sums += np.bincount(of[seen] * (BUCKETS + 1) + found[seen], minlength=sums.size).reshape(sums.shape)
        for i, x in enumerate(languages):
            there = np.flatnonzero(sums[i, :BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(sums[i, there], pa.int64())], names=["lang", "bucket", "n"])

    return run


def _two(declared: str) -> Column:
    return F.substring(F.lower(F.trim(F.col(declared))), 1, 2)


def text_model(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, declared: str = "lang", text: str = "text") -> np.ndarray:
    """Log probabilities, one row per language; the last column is for bytes without a trigram."""
    counts = docs.select(_two(declared), F.col(text)).mapInArrow(tx.trimmed(_counted(languages)), "lang string, bucket int, n long")
    model = np.ones((len(languages), BUCKETS + 1))
    for row in counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # languages x buckets at most
        model[languages.index(row.lang), row.bucket] += row.n
    model = np.log(model[:, :BUCKETS] / model[:, :BUCKETS].sum(axis=1, keepdims=True))
    return np.hstack([model, np.zeros((len(languages), 1))]).astype(np.float32)


def host_priors(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, weight: float = HOST_WEIGHT) -> DataFrame:
    """(host, held, above, prior): rows has host and declared. Written, one row per host.

    held: declarations by language; above: the prior of the level above; prior: both together.
    """
    counted = [F.count_if(F.col("declared") == x).cast("double").alias(f"c{i}") for i, x in enumerate(languages)]
    names = [f"c{i}" for i in range(len(languages))]
    hosts = written(rows.where("host is not null").groupBy("host").agg(*counted), "hosts")
    label = F.split("host", r"\.")
    hosts = hosts.withColumn("domain", F.when(F.size(label) > 2, F.concat_ws(".", F.slice(label, -2, 2)))).withColumn("suffix", F.when(F.size(label) > 1, F.element_at(label, -1)))
    total = hosts.agg(*[F.sum(c).alias(c) for c in names]).first()
    total = [float(x or 0) + 1 for x in total]
    prior = [F.lit(x / sum(total)) for x in total]
    for level in ("suffix", "domain"):
        own = hosts.where(F.col(level).isNotNull()).groupBy(level).agg(*[F.sum(c).alias(f"{level}_{c}") for c in names])
        hosts = hosts.join(own, level, "left")
        n = reduce(lambda x, y: x + y, [F.col(f"{level}_{c}") for c in names])
        prior = [F.coalesce((F.col(f"{level}_{c}") + weight * p) / (n + weight), p) for c, p in zip(names, prior, strict=True)]
        hosts = hosts.withColumns({f"{level}_p{i}": p for i, p in enumerate(prior)})
        prior = [F.col(f"{level}_p{i}") for i in range(len(names))]
    n = reduce(lambda x, y: x + y, [F.col(c) for c in names])
    whole = F.array(*[(F.col(c) + weight * p) / (n + weight) for c, p in zip(names, prior, strict=True)])
    return written(hosts.select("host", F.array(*names).alias("held"), F.array(*prior).alias("above"), whole.alias("prior")), "priors")


def _log(right: float, n: int) -> np.ndarray:
    """Row i: log P(declared | language) where i is declared."""
    return np.log(np.full((n, n), (1 - right) / max(n - 1, 1)) + np.eye(n) * (right - (1 - right) / max(n - 1, 1)))


def _scored(model: np.ndarray, languages: tuple[str, ...], weight: float, least: float, schema: pa.Schema, p: str):
    sides = np.vstack([_log(DECLARED_RIGHT, len(languages)), np.zeros(len(languages))]), np.vstack([_log(SUFFIX_RIGHT, len(languages)), np.zeros(len(languages))])

    def run(batches):
        place = {x: i for i, x in enumerate(languages)}
        pointed = {s: place[x] for s, x in SUFFIXES.items() if x in place}
        for batch in batches:
            declared, suffix, held, above = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (f"{p}declared", f"{p}suffix", f"{p}held", f"{p}above"))
            own = np.array([place.get(x or "", -1) for x in declared], np.int64)
            data, off = tx.text_bytes(batch.column(batch.schema.get_field_index(f"{p}text")))
            held, above = (np.array([x or [other] * len(languages) for x in y], np.float64).reshape(-1, len(languages)) for y, other in ((held, 0.0), (above, 1.0)))
            known = held.sum(axis=1) > 0
            held[np.flatnonzero((own >= 0) & known), own[(own >= 0) & known]] -= 1  # the row's own declaration is evidence of its own
            logs = np.log((held + HOST_WEIGHT * above) / (held.sum(axis=1, keepdims=True) + HOST_WEIGHT))
            logs += sides[0][own] + sides[1][[pointed.get((x or "").lower(), -1) for x in suffix]]
            number, letters = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for a, b, part, at in tx.pieces(data, off):
                found, _ = _trigrams(part, at)
                sums = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.float64)]))[at[1:]] - c[at[:-1]]  # noqa: B023, E731
                number[a:b], letters[a:b] = sums(found < BUCKETS), sums(_FOLD[part] != 32)
                share = np.minimum(weight, number[a:b]) / np.maximum(number[a:b], 1)
                for i in range(len(languages)):
                    logs[a:b, i] += sums(model[i][found]) * share
            odds = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf)) if len(logs) else logs
            odds = odds / odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1) if len(odds) else np.zeros(0, int)
            top = odds[np.arange(len(odds)), best]
            facts = [pa.array([languages[i] for i in best.tolist()], pa.string()), pa.array(top, pa.float64()), pa.array(number), pa.array((top >= least) & (letters > 0))]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in [f"{p}{x}" for x in ("declared", "suffix", "held", "above", "text")]]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept, schema, strict=False)), *facts], schema=schema)

    return run


def identify(docs: DataFrame, declared: str = "lang", host: str | None = "source", suffix: str | None = None, text: str = "text", keep: list[str] | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The columns `keep` of docs (all by default) with language, posterior, n_trigrams and accepted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = ("language", "posterior", "n_trigrams", "accepted")
    keep = [c for c in docs.columns if c not in made] if keep is None else keep
    model = text_model(docs, languages, declared, text)
    named = lambda c: F.col(c) if c else F.lit(None).cast("string")
    priors = host_priors(docs.select(named(host).alias("host"), _two(declared).alias("declared")), languages)
    p = fresh(docs)
    rows = docs.select(*keep, _two(declared).alias(f"{p}declared"), named(suffix).alias(f"{p}suffix"), named(host).alias(f"{p}host"), F.col(text).alias(f"{p}text"))
    rows = join_small(rows, priors.select(F.col("host").alias(f"{p}host"), F.col("held").alias(f"{p}held"), F.col("above").alias(f"{p}above")), [f"{p}host"]).drop(f"{p}host")
    made = T.StructType([*docs.select(*keep).schema.fields, T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("n_trigrams", T.LongType()), T.StructField("accepted", T.BooleanType())])
    return rows.mapInArrow(tx.trimmed(_scored(model, languages, TEXT_WEIGHT, LEAST_POSTERIOR, to_arrow_schema(made), p)), made)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with declared (the lang attribute), host, suffix and text (markup taken out)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    empty = lambda c: F.when(c != "", c)
    page = F.coalesce(F.col(html), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    return pages.withColumns({"declared": empty(F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2})", 1))), "host": empty(host), "suffix": empty(F.substring_index(host, ".", -1)), "text": text})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), keep=["doc_id"])


def page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages, with the markup's declaration, the address suffix and hosts of several levels."""
    pages = page_evidence(table(spark, sf_dir, "pages"))
    return identify(pages, declared="declared", host="host", suffix="suffix", keep=["page_id"])
