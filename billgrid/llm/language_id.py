"""Language identification: text likelihoods fused with declared language, address suffix and
host priors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrid.llm import common

#: The class of texts in none of the languages; what a text without any evidence is called.
OTHER, UNKNOWN = "other", "und"
#: Distinct labelled texts of each language that the likelihoods are fitted on at most, and
#: their lengths; of a language without such texts, others, as far as the greater length.
FIT_TEXTS, FIT_CHARS = 500, (40, 50_000)
#: A text weighs as at most so many independent trigrams.
WEIGHT = 200.0
#: Prior documents at each level of the host hierarchy; prior chance of OTHER.
KAPPA, OTHER_PRIOR = 5.0, 0.005

_BUCKETS, _STEP = 1 << 18, 1 << 20
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_MARKUP = regex.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>|&#?\w{1,10};")


def _trigrams(raw: bytes) -> np.ndarray:
    d = _LOWER[np.frombuffer(raw, np.uint8)]
    code = d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 18)


def _sample(docs: DataFrame, texts: int) -> tuple[list[str], DataFrame | None]:
    """All languages that label a text with a trigram, and lang, text of ``texts`` distinct texts of each.

    The texts with the least hashes are taken, those of other lengths than FIT_CHARS only where a
    language has none within. Languages are counted over all rows; copies count once. Texts stay on
    executors until they are chosen.
    """
    lang = F.lower("lang")
    labelled = docs.select("text", lang.alias("lang")).filter((F.trim(lang) != "") & (F.octet_length(F.btrim("text", F.lit(" \t\n\v\f\r"))) > 2))
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    keys = common.stored(labelled.groupBy("lang", "h").agg(F.max(F.char_length("text").between(*FIT_CHARS)).alias("usual")), "labelled-texts")
    sizes: dict[str, dict[bool, int]] = {}
    for r in keys.groupBy("lang", "usual").count().collect():  # two rows a language
        sizes.setdefault(r.lang, {})[r.usual] = r["count"]
    if not sizes:
        return [], None
    spark = docs.sparkSession
    steps = [(k, max(v), max(1, v[max(v)] // (8 * texts))) for k, v in sorted(sizes.items())]
    steps = F.broadcast(spark.createDataFrame(steps, "lang string, usual boolean, step long"))  # one row a language
    some: dict[str, list[int]] = {}
    for r in keys.join(steps, ["lang", "usual"]).filter(F.pmod("h", "step") == 0).select("lang", "h").collect():  # about 8 to 16 x texts a language at most
        some.setdefault(r.lang, []).append(r.h)
    chosen = [(k, h) for k, v in some.items() for h in sorted(v)[:texts]]
    chosen = F.broadcast(spark.createDataFrame(chosen, "lang string, h long"))
    found = labelled.join(chosen, ["lang", "h"]).select("lang", "h", F.left("text", F.lit(FIT_CHARS[1])).alias("text")).dropDuplicates(["lang", "h"])
    return sorted(some), found.select("lang", "text")


def fit(docs: DataFrame, texts: int = FIT_TEXTS) -> tuple[list[str], np.ndarray]:
    """(languages, log chances of hashed byte trigrams: one column a language, one for OTHER).

    The languages are those of all labelled rows (text, lang), however rare; blank labels are none. Each
    is fitted on a hash sample of at most ``texts`` of its distinct texts. OTHER has independent bytes
    with the frequencies of all sampled texts.
    """
    languages, sample = _sample(docs, texts)
    table = np.zeros((_BUCKETS, len(languages) + 1), np.float32)
    single = np.ones(256)
    at = {k: n for n, k in enumerate(languages)}
    if sample is not None:
        for r in common.stored(sample, "language-sample").toLocalIterator():  # bounded by languages, texts and FIT_CHARS
            raw = r.text.encode()
            table[:, at[r.lang]] += np.bincount(_trigrams(raw), minlength=_BUCKETS)
            single += np.bincount(_LOWER[np.frombuffer(raw, np.uint8)], minlength=256)
    single /= single.sum()
    other = np.zeros(_BUCKETS)
    for first in range(256):
        codes = np.arange(first << 16, (first + 1) << 16, dtype=np.uint32)
        chance = single[first] * single[(codes >> 8) & 255] * single[codes & 255]
        other += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - 18), chance, _BUCKETS)
    for k in range(len(languages)):
        seen = table[:, k].astype(np.float64)
        unseen = min(0.05 * _BUCKETS, seen.sum())  # a small sample must not come out like OTHER
        table[:, k] = np.log((seen + unseen * other) / (seen.sum() + unseen) + 1e-12)
    table[:, -1] = np.log(other + 1e-12)
    return languages, table


def text_likelihood(raw: bytes, table: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of trigrams and log likelihoods, weighing at most WEIGHT trigrams."""
    total, n = np.zeros(table.shape[1]), max(0, len(raw) - 2)
    for at in range(0, n, _STEP):
        total += table[_trigrams(raw[at : at + _STEP + 2])].sum(0, dtype=np.float64)
    return n, total / max(n, 1) * (n * WEIGHT / (n + WEIGHT))


def visible(markup: str) -> str:
    return _MARKUP.sub(" ", markup)


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """Plain texts; the source stands for the host. Their ``lang`` is a label, not evidence."""
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), common.whole_text().alias("text"), F.lit(None).cast("string").alias("declared"),
                       F.coalesce("source", F.lit("")).alias("host"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Web pages: visible text, the language their markup declares, the host of their address."""
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), html.alias("text"), F.when(declared != "", declared).alias("declared"), host.alias("host"))


def _scored(evidence: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    schema = "kind string, id long, key long, declared string, host string, n long, ll array<double>, post array<double>"
    prior = np.log(np.array([(1 - OTHER_PRIOR) / max(1, len(languages))] * len(languages) + [OTHER_PRIOR]))
    shared = evidence.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ll, post = [], [], []
            for kind, text in zip(batch.column("kind").to_pylist(), common.strings(batch.column("text"))):
                k, x = text_likelihood((visible(text) if kind == "page" else text).strip().encode(), shared.value)
                p = np.exp(x + prior - (x + prior).max())
                n.append(k)
                ll.append(x)
                post.append(p / p.sum())
            as_list = lambda rows: pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))
            yield pa.record_batch({c: batch.column(c) for c in ("kind", "id", "key", "declared", "host")} | {"n": pa.array(n, pa.int64()), "ll": as_list(ll), "post": as_list(post)})

    known = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), OTHER)
    rows = evidence.select("kind", F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text", known.alias("declared"), "host")
    return rows.mapInArrow(score, schema)


def identify(evidence: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """kind, id, key (hash of the text), host, lang, confidence, text_lang, declared, kept of every
    row of ``evidence`` (kind, id, text, declared, host).

    log P(lang | all) = text likelihood + log P(declared | lang) + log P(suffix | lang) + log prior
    of the host, whose counts are smoothed by its domain's, and those by all rows'. The tables behind
    the last three are grouped sums of the texts' own posteriors; a row's own share is taken out of
    its host's. Texts and hosts stay on executors; at most one row per language comes to the driver.

    A text without a trigram (null, empty or nearly) has no language of its own: it is ``und`` and not
    kept. Null declarations are no evidence; null and empty hosts are one host; repeated rows, ties and
    null ids give a row each, a tie going to the language first in order; an empty table gives an
    empty result; other columns are ignored. Whole texts are scored, in steps of fixed size.
    """
    classes = [*languages, OTHER]
    labels = F.split("host", r"\.")
    scored = common.stored(_scored(evidence, languages, table), "language-scores")
    scored = scored.withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("")).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    sums = [F.sum(F.when(F.col("n") > 0, F.col("post")[k]).otherwise(0.0)).alias(f"c{k}") for k in range(len(classes))]
    added = [F.sum(f"c{k}").alias(f"c{k}") for k in range(len(classes))]
    hosts = common.stored(scored.groupBy("kind", "suffix", "domain", "host").agg(*sums), "language-hosts")
    every = np.array([x or 0.0 for x in hosts.agg(*added).first()])
    base = (every + np.array([(1 - OTHER_PRIOR) / max(1, len(languages))] * len(languages) + [OTHER_PRIOR])) / (every.sum() + 1)
    total = lambda prefix: reduce(lambda a, b: a + b, [F.col(f"{prefix}{k}") for k in range(len(classes))])

    declared = scored.filter("declared is not null").groupBy("declared").agg(*sums).collect()  # one row a class at most
    by_class = {r.declared: np.array([r[f"c{k}"] for k in range(len(classes))]) for r in declared}
    given = sum(by_class.values(), np.zeros(len(classes)))
    said: Column = F.array(*[F.lit(0.0)] * len(classes))
    for d, c in sorted(by_class.items()):
        said = F.when(F.col("declared") == d, F.array(*[F.lit(float(x)) for x in np.log((c + 0.5) / (given + 0.5 * len(classes)))])).otherwise(said)

    domains = hosts.groupBy("kind", "suffix", "domain").agg(*added)
    prior = [((F.col(f"c{k}") + KAPPA * float(base[k])) / (total("c") + KAPPA)).alias(f"d{k}") for k in range(len(classes))]
    domains = common.stored(domains.select("kind", "domain", *prior), "language-domains")
    n_suffixes = hosts.select("suffix").distinct().count()
    suffixes = hosts.groupBy("suffix").agg(*added).select("suffix", F.array(*[F.log((F.col(f"c{k}") + 0.5) / (float(every[k]) + 0.5 * n_suffixes)) for k in range(len(classes))]).alias("by_suffix"))
    suffixes = common.stored(suffixes, "language-suffixes")
    hosts = common.stored(hosts.join(domains, ["kind", "domain"]).select("kind", "host", F.array(*[f"c{k}" for k in range(len(classes))]).alias("c"), total("c").alias("c_all"), F.array(*[f"d{k}" for k in range(len(classes))]).alias("d")), "language-priors")

    own = lambda k: F.when(F.col("n") > 0, F.col("post")[k]).otherwise(0.0)
    score = [F.col("ll")[k] + said[k] + F.col("by_suffix")[k] + F.log((F.greatest(F.col("c")[k] - own(k), F.lit(0.0)) + KAPPA * F.col("d")[k]) / (F.greatest(F.col("c_all") - F.when(F.col("n") > 0, 1.0).otherwise(0.0), F.lit(0.0)) + KAPPA)) for k in range(len(classes))]
    out = scored.join(hosts, ["kind", "host"]).join(suffixes, "suffix").select("kind", "id", "key", "host", "declared", "n", "post", F.array(*score).alias("s"))
    names = F.array(*map(F.lit, classes))
    best = F.array_max("s")
    spread = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    lang = F.when(F.col("n") > 0, names[F.array_position("s", best).cast("int") - 1]).otherwise(UNKNOWN)
    return out.select("kind", "id", "key", "host", lang.alias("lang"), F.when(F.col("n") > 0, F.round(1 / spread, 6)).otherwise(0.0).alias("confidence"),
                      F.when(F.col("n") > 0, names[F.array_position("post", F.array_max("post")).cast("int") - 1]).otherwise(UNKNOWN).alias("text_lang"), "declared",
                      ((F.col("n") > 0) & (lang != OTHER)).alias("kept"))
