"""Bad documents by hierarchical empirical Bayes over text, host and path.

A classifier gives the evidence of a text: boosted rules "this word or trait occurs",
fitted on a bounded sample of labelled rows. Labels of all documents then give the
share of bad ones at each host and each path of a host. A host is shrunk toward the
global share and a path toward its host, the more so the fewer labels it has; how
strongly is estimated from how much hosts (paths) differ beyond chance. Evidence and
prior meet as log odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import appended, pieces
from millrace.llm._scratch import written

# Bound of the fit: labelled texts in the sample. All their words and traits that occur
# ``LEAST_ROWS`` times may have a rule, so what comes to the driver is bounded by the sample.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 3
# Up to so many sites with labels are sent to every executor.
BROADCAST_SITES = 100_000
SYMBOLS = b"#*$%&|<>"
# Bytes of a word's beginning.
PREFIXES = (4, 5, 6)
_LIMIT = 8.0
# Of the loss in a round; a trait that gains 1 can lessen it by more.
_LEAST_DROP = 0.01


def traits(text: bytes | None) -> set[bytes]:
    """The words of a text, A-Z in lower case, and traits, which begin with a blank: how at
    least every two-hundredth word begins, since inflected forms share that, and what the
    text is like as a whole."""
    text = text or b""
    words = text.lower().split()
    found = set(words)
    begins = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
    often = {b" often " + p for p, c in begins.items() if 200 * c >= len(words)}
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    distinct, n = len(found), len(words)
    for share in (5, 10, 20, 50):
        if 100 * symbols > share * n:
            found.add(b" symbols over %d in 100 words" % share)
        if 100 * distinct < share * n:
            found.add(b" distinct words under %d in 100" % share)
    for few in (5, 10, 20):
        if n < few:
            found.add(b" under %d words" % few)
    return found | often


def _trait_counts(sample: DataFrame) -> DataFrame:
    """``trait``, ``bad`` and ``good``: how many rows of each kind have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, bad in zip(texts, batch.column("bad").to_pylist(), strict=True):
                counts[bad].update(traits(text))
            names = [*{**counts[0], **counts[1]}]
            columns = [[c[t] for t in names] for c in (counts[1], counts[0])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)],
                ["trait", "bad", "good"],
            )

    counted = sample.mapInArrow(run, "trait binary, bad long, good long")
    return counted.groupBy("trait").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def boost(
    row: np.ndarray, trait: np.ndarray, n_traits: int, bad: np.ndarray
) -> tuple[float, np.ndarray]:
    """Intercept and weight of each trait as log odds of ``bad``, given which ``row`` has which ``trait``,
    rows in ascending order.

    Each round takes the trait that parts the rows best as they are weighted now, and
    adds its weighted log odds; rows without it are left alone. Later rounds see little
    weight in what earlier ones explain, so words that only go along with others stay out.
    Rounds end when no trait gains 1; a step that would not lessen the loss is halved, so
    every round lessens it and they do end.
    """
    has = np.searchsorted(row, np.arange(len(bad) + 1, dtype=row.dtype))
    rows = row[np.argsort(trait, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(trait, minlength=n_traits)))
    sign = np.where(bad, 1.0, -1.0)
    smooth = 1.0
    n_bad, n_good = float(bad.sum()), float((~bad).sum())
    start = float(np.log((n_bad + smooth) / (n_good + smooth)))
    score = np.full(len(bad), start)
    weights = np.zeros(n_traits)
    w = 1.0 / (1.0 + np.exp(sign * score))  # how wrong each row still is
    for_ = np.bincount(trait, (w * bad)[row], n_traits)
    against = np.bincount(trait, (w * ~bad)[row], n_traits)
    while n_traits:
        # Rounded, so that the order of rows, which sums depend on, decides no tie.
        up, down = np.maximum(for_, 0), np.maximum(against, 0)
        gain = np.round(np.abs(np.sqrt(up) - np.sqrt(down)), 9)
        best = int(gain.argmax())
        if gain[best] < 1.0:
            break
        step = float(np.log((up[best] + smooth) / (down[best] + smooth)))
        own = rows[first[best] : first[best + 1]]
        loss = np.logaddexp(0, -sign[own] * score[own]).sum()
        while np.logaddexp(0, -sign[own] * (score[own] + step)).sum() > loss - _LEAST_DROP:
            step /= 2
        weights[best] += step
        score[own] += step
        # Only these rows, and so the sums of their traits, have changed.
        change = 1.0 / (1.0 + np.exp(sign[own] * score[own])) - w[own]
        w[own] += change
        size = has[own + 1] - has[own]
        at = np.repeat(has[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for_ += np.bincount(trait[at], np.repeat(change * bad[own], size), n_traits)
        against += np.bincount(trait[at], np.repeat(change * ~bad[own], size), n_traits)
    return start, weights


def fit(sample: DataFrame) -> tuple[float, dict[bytes, float]]:
    """Intercept, and the weight of each word or trait with a rule, from ``text`` and ``bad`` (0 or 1)."""
    counts = written(_trait_counts(sample), "trait-counts")
    common = counts.where(F.col("bad") + F.col("good") >= LEAST_ROWS).orderBy("trait")
    names = common.select("trait").toArrow()["trait"].to_pylist()
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            own = [sorted(place[t] for t in traits(text) if t in place) for text in texts]
            columns = [batch.column("bad"), pa.array(own, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["bad", "own"])

    rows = sample.mapInArrow(run, "bad int, own array<int>").toArrow()
    own = rows["own"].combine_chunks()
    row = np.repeat(np.arange(rows.num_rows, dtype=np.int32), own.value_lengths())
    bad = rows["bad"].to_numpy().astype(bool)
    own = own.flatten().to_numpy()
    del rows
    start, weights = boost(row, own, len(names), bad)
    return start, {name: w for name, w in zip(names, weights.tolist(), strict=True) if w}


def strength(sites: DataFrame, share: Column) -> float:
    """How many labels a site's prior is worth, by the method of moments.

    ``sites`` has ``n`` and ``bad``; ``share`` is what each is shrunk toward. The less
    sites differ beyond what chance gives, the more; at most a million.
    """
    expected = F.sum(F.col("n") * share * (1 - share))
    squares = F.sum(F.pow(F.col("bad") - F.col("n") * share, 2))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * share * (1 - share))
    within, total, between = (float(x or 0) for x in sites.agg(expected, squares, pairs).first())
    if total <= within or between <= 0:
        return 1e6
    alike = min((total - within) / between, 1.0)
    return min(max(1 / alike - 1, 1.0), 1e6)


def site_priors(labelled: DataFrame, levels: Sequence[str]) -> list[DataFrame]:
    """For each depth of ``levels`` (host first, then paths within it), a table of their values
    and ``prior``: log odds of bad rows less the global ones."""
    p = labelled.agg((F.sum("bad") + 0.5) / (F.count("bad") + 1.0)).first()[0]
    share = float(p if p is not None else 0.5)
    base = float(np.log(share / (1 - share)))
    tables: list[DataFrame] = []
    for depth in range(1, len(levels) + 1):
        keys = list(levels[:depth])
        sites = labelled.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.count("bad").alias("n"))
        if tables:
            sites, up = _joined(sites, tables[-1], keys[:-1]), F.col("prior") + base
            sites = sites.withColumn("up", 1 / (1 + F.exp(-up))).drop("prior")
        else:
            sites = sites.withColumn("up", F.lit(share))
        sites = written(sites, "sites")
        worth = strength(sites, F.col("up"))
        shrunk = (F.col("bad") + worth * F.col("up")) / (F.col("n") + worth)
        prior = F.log(shrunk / (1 - shrunk)) - F.lit(base)
        tables.append(written(sites.select(*keys, prior.alias("prior")), "site-priors"))
    return tables


def _joined(rows: DataFrame, sites: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """``rows`` with the ``prior`` of their site, null where it has none; null is a key like any other."""
    sites = sites.select(*(F.col(k).alias(f"_{k}") for k in keys), "prior")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(F.broadcast(sites) if small else sites, same, "left").drop(
        *(f"_{k}" for k in keys)
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    levels: Sequence[str] = ("source", "lang"),
    threshold: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``evidence`` (log odds of the text), ``p_bad`` and ``keep`` (``p_bad`` <= ``threshold``).

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; a document is bad if its quality
    is 0 or it is toxic. A row of labels counts if both are there and its id is found;
    several rows for an id all count for its sites. ``levels`` are columns of ``docs``, the host and then
    paths within it; null is a value like any other, and one without labels has its
    host's prior (a host without, the global one). A null text has no words. Without
    labels all evidence is 0 and ``p_bad`` one half, which is kept at the default.
    Repeated rows, ties and empty tables are fine; an existing column of one of the
    three names is an error.

    The classifier is fitted on about ``SAMPLE_ROWS`` labelled texts (no more than 5 % more), chosen
    by a hash of id, text and label; rows equal in these count once there, however often
    they occur. Site counts use all labels. Texts are not shuffled unless more than
    ``BROADCAST_SITES`` sites have labels.
    """
    clash = {"evidence", "p_bad", "keep"} & {*docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.where("quality is not null and toxic is not null and doc_id is not null")
    known = known.select(F.col("doc_id").alias("_id"), bad.alias("bad"))
    keys = [f"key{k}" for k in range(len(levels))]
    named = [F.col(c).alias(k) for c, k in zip(levels, keys, strict=True)]
    content = F.coalesce(text, F.lit(""))
    # Two differently seeded hashes of the text, 128 bits together.
    own = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(content).alias("one"), F.xxhash64(F.lit(1), content).alias("two"), *named
    )
    marked = written(own.join(known, own["id"] == known["_id"]).drop("_id"), "labelled")
    labelled = marked.select("id", "one", "two", "bad").distinct()
    part = min(1.0, SAMPLE_ROWS / max(labelled.count(), 1))
    row = F.pmod(F.xxhash64("id", "one", "two", "bad"), F.lit(1 << 30))
    chosen = labelled.where(row < F.lit(int(part * (1 << 30))))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(content).alias("one"), content.alias("text"))
    texts = texts.withColumn("two", F.xxhash64(F.lit(1), "text"))
    sample = texts.join(F.broadcast(chosen), ["id", "one", "two"]).groupBy("id", "one", "two", "bad")
    sample = written(sample.agg(F.first("text").alias("text")).select("text", "bad"), "labelled-sample")
    start, weights = fit(sample)
    tables = site_priors(marked, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            scores = [
                fsum([start, *(weights[t] for t in traits(x) & weights.keys())]) for x in texts
            ]
            found = np.clip(np.array(scores, np.float64), -_LIMIT, _LIMIT)
            yield appended(batch, evidence=pa.array(found))

    schema = T.StructType([*docs.schema.fields, T.StructField("evidence", T.DoubleType())])
    # Rows carry their own columns in one, so that no name can clash.
    scored = docs.mapInArrow(run, schema).select(F.struct(*docs.columns).alias("row"), "evidence", *named)
    odds: Column = F.lit(0.0)
    for depth, sites in enumerate(tables, 1):
        small = sites.count() <= BROADCAST_SITES
        scored = _joined(scored, sites.toDF(*keys[:depth], "prior"), keys[:depth], small)
        scored = scored.withColumnRenamed("prior", f"prior{depth}")
        odds = F.coalesce(f"prior{depth}", odds)
    p_bad = 1 / (1 + F.exp(-(F.col("evidence") + odds)))
    return scored.select("row.*", "evidence", p_bad.alias("p_bad"), (p_bad <= threshold).alias("keep"))
