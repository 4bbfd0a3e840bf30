"""Language of pages by fusing evidence: text, declared language, address and host.

Trigrams of bytes, counted over all labelled texts, give a likelihood of the text. Pages
are first read by text alone; grouped sums of that over hosts, domains and address
suffixes give a prior for each site, a host shrunk toward its domain, a domain toward its
suffix and a suffix toward all pages, and how often a language is declared for each true
one. A page's own share is taken out of its prior. The logs of all three are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import appended, pieces, utf8
from millrace.llm._scratch import written
from millrace.llm._split import lowered
from millrace.llm._words import let

# Trigrams are hashed to so many numbers, so the model has that many rows.
BUCKETS = 1 << 16
# Trigrams of a text are far from independent: a text counts as this many at most.
MOST_TRIGRAMS = 60.0
# Languages of a smaller share of the labelled texts are not told apart, so there are no more than
# its inverse, and the model has no more than 2**26 numbers.
LEAST_SHARE = 2.0**-10
# How many pages the next wider level is worth in a prior.
WORTH = 5.0
SLICE_BYTES = 4 << 20
LEVELS = ("host", "domain", "suffix")


def _hidden(html: Column, opener: str, whole: str) -> Column:
    """``html`` without parts that match ``whole``, which begins with ``opener``.

    Cut before each opener, every piece is searched once from its start, so a page full of
    openers that nothing closes takes no longer than any other.
    """
    parts = F.split(html, f"(?i)(?={opener})")
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, f"(?is)^{whole}", " ")), "")


def page_text(html: Column) -> Column:
    """What is left of a page without scripts, styles, comments, head, tags and entities."""
    bare = _hidden(F.coalesce(html, F.lit("")), "<!--", "<!--.*?-->")
    bare = _hidden(bare, "<(?:script|style)\\b", "<(script|style)\\b.*?</\\1\\s*>")
    # Only the first head counts, and without its end it stays.
    bare = F.regexp_replace(bare, "(?is)^(?>(.*?)<head\\b)(?>.*?</head\\s*>)", "$1 ")
    return F.regexp_replace(F.regexp_replace(bare, "<[^<>]*+>", " "), "&#?\\w{1,31};", " ")


def declared_language(html: Column) -> Column:
    """The primary tag of the lang attribute of ``<html>``, in lower case; empty without one."""
    tag = "(?i)<html\\b[^<>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,8})"
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), tag, 1))


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    found = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), found, 1))


def _trigrams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of texts that lie on end, and the first of each text (and one more)."""
    data = lowered(data).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    gram = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    inside = np.ones(len(data) - 2, bool)
    edge = rows[1:-1]
    for back in (1, 2):
        at = edge - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    # An edge at the very end or start cuts nothing off.
    code = gram * np.uint32(0x9E3779B1) >> np.uint32(16)
    first = np.concatenate([[0], np.cumsum(inside)])[np.minimum(rows, len(inside))]
    return code[inside].astype(np.int64), first


def train(texts: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log probabilities of trigrams by language, from all rows of ``text`` and ``lang``."""
    place = {language: k for k, language in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            code, first = _trigrams(*utf8(batch.column("text")))
            lang = [place.get(x, -1) for x in batch.column("lang").to_pylist()]
            own = np.repeat(np.array(lang, np.int64), np.diff(first))
            # As many counts as a slice has kinds of trigrams, however many languages there are.
            cells = pa.array((own * BUCKETS + code)[own >= 0]).dictionary_encode()
            n = np.bincount(cells.indices.to_numpy(), minlength=len(cells.dictionary))
            yield pa.RecordBatch.from_arrays([cells.dictionary, pa.array(n)], ["cell", "n"])

    counted = texts.select("text", "lang").mapInArrow(run, "cell long, n long")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(BUCKETS * len(languages), 0.5)
    counts[found["cell"].to_numpy()] += found["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """``pages`` with ``text`` replaced by ``loglik``: the log likelihood by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            code, first = _trigrams(*utf8(batch.column("text")))
            n = np.diff(first)
            sums = np.concatenate(
                [np.zeros((1, len(model))), np.cumsum(model[:, code].T, axis=0, dtype=np.float64)]
            )
            mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)[:, None]
            found = mean * (n * MOST_TRIGRAMS / (n + MOST_TRIGRAMS))[:, None]
            rows = pa.array(list(found), pa.list_(pa.float64()))
            yield appended(batch.drop_columns(["text"]), loglik=rows)

    kept = [f for f in pages.schema.fields if f.name != "text"]
    new = T.StructField("loglik", T.ArrayType(T.DoubleType()))
    return pages.mapInArrow(run, T.StructType([*kept, new]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _posterior(logs: Column) -> Column:
    """Probabilities from log weights."""

    def weights(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top)))

    def scaled(w: Column) -> Column:
        return let(_total(w), lambda all_: F.transform(w, lambda y: y / all_))

    return let(logs, lambda x: let(weights(x), scaled))


def _sums(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The sum of ``p`` (one number a language) for each value of ``keys``."""
    each = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]
    summed = rows.groupBy(*keys).agg(*each)
    return summed.select(*keys, F.array(*(f"s{k}" for k in range(n))).alias("sums"))


def identify(
    pages: DataFrame,
    texts: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``page_id``, ``lang``, ``probability``, ``text_lang`` (by text alone), ``declared`` and ``host``.

    ``texts`` has ``text`` and ``lang``; its languages of at least ``LEAST_SHARE`` of the rows are
    those that can be found, and rows of others or with a null in either teach nothing. A page whose html is null or
    without text has no evidence from it; one without an address or a host has the prior
    of all pages, and one without a declared language is read by the others, where
    absence is a value like any other. Ties go to the first language in alphabetical
    order. A page must fit a task; tags, scripts, styles and comments are taken out in time in
    proportion to its length, closed or not. Repeated rows get a row each; without languages ``lang`` is null; empty tables
    give no rows; other columns are ignored.

    Sums over hosts are aggregated before the shuffle and joined back to numbers, not
    pages, so a host with a third of all pages is split like any skewed join.
    """
    known = texts.where("text is not null and lang is not null")
    rows = known.count()
    often = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows * LEAST_SHARE)
    languages = sorted(r.lang for r in often.collect())
    if not languages:
        return pages.select(
            F.col(page_id).alias("page_id"),
            F.lit(None).cast("string").alias("lang"),
            F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"),
            declared_language(F.col(html)).alias("declared"),
            host_of(F.col(url)).alias("host"),
        )
    n = len(languages)
    names = F.array(*(F.lit(x) for x in languages))
    own = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        declared_language(F.col(html)).alias("declared"),
        page_text(F.col(html)).alias("text"),
    )
    read = _likelihoods(own, train(known, languages))
    labels = F.split("host", "\\.")
    read = read.withColumns(
        {
            "p": _posterior(F.col("loglik")),
            "suffix": F.element_at(labels, -1),
            "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )
    read = written(read, "read-pages")

    sums = {level: _sums(read, [level], n).toDF(level, f"{level}_sums") for level in LEVELS}
    sites = read.where("host <> ''").select(*LEVELS).distinct()
    sites = reduce(lambda left, level: left.join(sums[level], level), LEVELS, sites)
    sites = written(sites.select("host", *(f"{level}_sums" for level in LEVELS)), "sites")
    total = read.agg(*(F.sum(F.col("p")[k]) for k in range(n))).first()
    everywhere = F.array(*(F.lit(float(x or 0.0)) for x in total))

    said = _sums(read, ["declared"], n).select("declared", F.col("sums").alias("said"))
    joined = read.join(sites, "host", "left").join(said, "declared", "left")

    def without_own(name: Column) -> Column:
        none = F.array(*(F.lit(0.0) for _ in languages))
        left = F.zip_with(name, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.coalesce(left, none)

    def shrunk(counts: Column, wider: Column) -> Column:
        def of(c: Column) -> Column:
            size = _total(c)
            mix = lambda all_: F.zip_with(c, wider, lambda x, w: (x + WORTH * w) / (all_ + WORTH))
            return let(size, mix)

        return let(counts, of)

    even = F.array(*(F.lit(1.0 / n) for _ in languages))
    prior = shrunk(without_own(everywhere), even)
    for level in reversed(LEVELS):
        prior = shrunk(without_own(F.col(f"{level}_sums")), prior)
    # Of the pages of each language, the share that declares what this page does.
    told = F.zip_with(
        without_own(F.col("said")),
        without_own(everywhere),
        lambda c, others: F.log((c + 0.5) / (others + 1.0)),
    )
    evidence = F.zip_with("loglik", told, lambda a, b: a + b)
    logs = F.zip_with(evidence, prior, lambda a, b: a + F.log(b))
    step = joined.withColumn("q", _posterior(logs))

    def likeliest(p: str) -> Column:
        return F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    return step.select(
        "page_id",
        likeliest("q").alias("lang"),
        F.array_max("q").alias("probability"),
        likeliest("p").alias("text_lang"),
        "declared",
        "host",
    )
