"""Language of web pages by Bayesian fusion of four kinds of evidence.

* The text: log-likelihoods of its byte trigrams (hashed to ``BUCKETS``) under each language, from counts over at most
  ``TRAIN_ROWS`` documents whose language is known (those with the smallest hash of doc_id). Trigrams of a text aren't
  independent, so the sum is divided by ``DAMPING``.
* The markup: the language that the page declares in ``<html lang>`` or a content-language tag is right with the chance
  ``TRUST_MARKUP``.
* The address: a country suffix with a language of its own, or a path part such as ``/fr/``, with the chance ``TRUST_ADDRESS``.
* The host: sums of the other evidence over its pages, without the page itself, smoothed towards those of its registered
  domain, these towards the address suffix and these towards all pages, each level with the weight of ``SMOOTHING`` pages.

The sums are grouped aggregations with partial sums in the map tasks, so a host with most pages is no task of its own; the
sums of hosts are joined back. The posterior is the normalised product. Null or empty pages have no text evidence; without
any documents to learn from there are no languages, and ``language`` is null. More than ``MAX_LANGUAGES`` languages in the
sample are an error: none is left out in silence. Every row of pages gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import looked_up, saved

TRAIN_ROWS = 5000
BUCKETS = 1 << 14
DAMPING = 8.0
TRUST_MARKUP, TRUST_ADDRESS = 0.9, 0.8
SMOOTHING = 5.0
MAX_LANGUAGES = 500
# Country suffixes whose pages are mostly in one language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "nl": "nl", "pl": "pl", "pt": "pt", "br": "pt", "ru": "ru", "jp": "ja", "cn": "zh"}

#: Each alternative that finds no end takes all that is left, so that the whole takes one walk over the page.
_HIDDEN = re.compile(rb"<(script|style)\b(?:.*?</\1\s*+>|.*+)|<!--(?:.*?-->|.*+)|<[A-Za-z/!?][^>]*+>?", re.S | re.I)
_LETTERS = np.arange(256, dtype=np.uint32)
_LETTERS[65:91] += 32
_LETTERS[[*range(33, 65), *range(91, 97), *range(123, 127), *range(0, 32)]] = 32


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the byte trigrams of a text by bucket; A-Z lower-cased, anything but letters a space."""
    b = _LETTERS[np.frombuffer(text, np.uint8)]
    b = b[~((b == 32) & (np.roll(b, 1) == 32))] if len(b) else b
    codes = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:] if len(b) > 2 else b[:0]
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)


def _trained(documents: DataFrame, rows: int) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities by (language, bucket)."""
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(rows).select("doc_id").distinct()
    sample = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + trigrams((text or "").encode())
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} values of lang in the training sample; at most {MAX_LANGUAGES} can be told apart")
    table = np.full((len(langs), BUCKETS), 0.5)
    place = {lang: i for i, lang in enumerate(langs)}
    table[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _part(url: Column) -> dict[str, Column]:
    given = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(given, r"^[a-zA-Z][a-zA-Z0-9+.-]*+://(?:[^/@]*+@)?([^/:?#]++)", 1))
    return {
        "host": host,
        "domain": F.regexp_extract(host, r"(?:^|\.)([^.]++\.(?:(?:co|com|org|ac|gov)\.)?[^.]++)$", 1),
        "suffix": F.substring_index(host, ".", -1),
        "path_lang": F.lower(F.regexp_extract(given, r"^[a-zA-Z][a-zA-Z0-9+.-]*+://[^/]++/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:/|$)", 1)),
    }


def _declared(html: Column) -> Column:
    """The language of the first html tag, else of the first meta tag on the content's language; each tag is read once, to its end."""
    tag = F.regexp_extract(F.regexp_extract(html, r"(?i)<html\b([^>]*+)", 1), r"(?i)(?:^|[\s\"'])lang\s*+=\s*+[\"']?([a-zA-Z]{2,3})", 1)
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^>]*+)"), F.lit(1)), lambda m: F.lower(m).contains("content-language"))
    meta = F.regexp_extract(F.coalesce(F.get(metas, F.lit(0)), F.lit("")), r"(?i)[\s\"']content\s*+=\s*+[\"']?([a-zA-Z]{2,3})", 1)
    return F.lower(F.when(tag != "", tag).otherwise(F.when(html.isNotNull(), meta)))


def identified(pages: DataFrame, documents: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, url, language, confidence, and what each kind of evidence alone says: text_language, declared, address, host_language."""
    langs, table = _trained(documents, rows)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", "url", none.alias("language"), F.lit(None).cast("double").alias("confidence"), none.alias("text_language"), _declared(F.col("html").cast("string")).alias("declared"), none.alias("address"), none.alias("host_language"))
    shared = pages.sparkSession.sparkContext.broadcast(table)
    n = len(langs)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            for a in range(0, batch.num_rows, 512):
                part = html.slice(a, 512).to_pylist()
                counts = np.array([trigrams(_HIDDEN.sub(b" ", (h or "").encode())) for h in part], np.float32)
                scores = (counts @ shared.value.T.astype(np.float32)).astype(float) / DAMPING
                rows = batch.slice(a, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(list(scores), pa.list_(pa.float64()))], names=["page_id", "url", "declared", "scores"])

    html = F.col("html").cast("string")
    url = F.col("url").cast("string")
    page_type = pages.schema["page_id"].dataType.simpleString()
    read = pages.select("page_id", url.alias("url"), _declared(html).alias("declared"), html.alias("html"))
    read = read.mapInArrow(likelihoods, f"page_id {page_type}, url string, declared string, scores array<double>")
    read = read.select("*", *[c.alias(k) for k, c in _part(F.col("url")).items()])
    suffixes = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    address = F.when(F.col("path_lang").isin(langs), F.col("path_lang")).otherwise(F.coalesce(F.try_element_at(suffixes, F.col("suffix")), F.lit("")))
    read = read.withColumn("address", address)

    def said(column: str, trust: float) -> list[Column]:
        known = F.col(column).isin(langs)
        return [F.when(~known, F.lit(0.0)).when(F.col(column) == x, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log((1 - trust) / max(n - 1, 1))))) for x in langs]

    own = [F.col("scores")[i] + m + a for i, (m, a) in enumerate(zip(said("declared", TRUST_MARKUP), said("address", TRUST_ADDRESS), strict=True))]
    read = read.withColumn("own", F.array(*own))
    read = read.withColumn("most", F.array_max("own")).withColumn("own", F.transform("own", lambda x: F.exp(x - F.col("most"))))
    read = read.withColumn("whole", F.aggregate("own", F.lit(0.0), lambda s, x: s + x)).withColumn("own", F.transform("own", lambda x: x / F.col("whole")))
    read = saved(read.drop("most", "whole", "path_lang"))

    sums = [F.sum(F.col("own")[i]).alias(f"h{i}") for i in range(n)]
    hosts = saved(read.groupBy("host", "domain", "suffix").agg(*sums))
    levels = {k: hosts.groupBy(*keys).agg(*[F.sum(f"h{i}").alias(f"{k[0]}{i}") for i in range(n)]) for k, keys in (("domain", ["domain"]), ("suffix", ["suffix"]), ("all", []))}
    priors = looked_up(hosts, levels["domain"], ["domain"])
    priors = looked_up(priors, levels["suffix"], ["suffix"]).crossJoin(F.broadcast(levels["all"]))
    both = looked_up(read, priors.drop("domain", "suffix"), ["host"])

    def smoothed(level: str, above: list[Column]) -> list[Column]:
        without = [F.greatest(F.col(f"{level}{i}") - F.col("own")[i], F.lit(0.0)) for i in range(n)]
        total = sum(without[1:], without[0])
        return [(without[i] + SMOOTHING * above[i]) / (total + SMOOTHING) for i in range(n)]

    # pages without a host, or hosts without a domain, have nothing in common that would say so
    named = {"a": F.lit(True), "s": F.col("suffix") != "", "d": F.col("domain") != "", "h": F.col("host") != ""}
    prior = [F.lit(1.0 / n)] * n
    for level in "asdh":
        both = both.select("*", F.array(*[F.when(named[level], x).otherwise(p) for x, p in zip(smoothed(level, prior), prior, strict=True)]).alias(f"prior_{level}"))
        prior = [F.col(f"prior_{level}")[i] for i in range(n)]
    posterior = F.array(*[F.col("own")[i] * prior[i] for i in range(n)])
    both = both.withColumn("posterior", posterior)
    names = F.array(*[F.lit(x) for x in langs])
    first = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    total = F.aggregate("posterior", F.lit(0.0), lambda s, x: s + x)
    return both.select(
        "page_id", "url", first(F.col("posterior")).alias("language"), (F.array_max("posterior") / total).alias("confidence"),
        first(F.col("scores")).alias("text_language"), "declared", "address", first(F.col("prior_h")).alias("host_language"),
    )
