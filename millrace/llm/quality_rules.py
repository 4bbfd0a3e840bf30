"""Quality rules as a cascade that stops at the first rule a document fails.

A rule is an expression over a document's text, its measure included, and is worked out
only for rows that no earlier rule has rejected. The verdict does not depend on the order,
only the work does. Each rule is tried on a sample: how many rows it rejects, and what it
costs, which is timed over as many repetitions as it takes to stand out from a job's own
time. Rules then run in order of rejections per cost.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import dropped, written
from millrace.llm._words import BLANKS, let, words

# Rows of a sample, whatever the size of the table.
SAMPLE_ROWS = 1_000
# A rule is repeated until its own seconds are so many, or so often.
_ENOUGH_SECONDS, _MOST_TIMES = 0.15, 4096


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for rows to reject; null counts as false."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Measured:
    """``cost`` in seconds for each row of the sample."""

    rule: Rule
    rejected: float
    cost: float

    @property
    def rank(self) -> tuple[float, float]:
        """Most rejections per cost first, and of rules that reject nothing the cheapest. Costs count
        in powers of two, so that no order hangs on what two runs of a rule differ by."""
        cost = round(log2(self.cost))
        return (-log2(self.rejected) + cost, 0.0) if self.rejected else (float("inf"), cost)


def draw(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``docs``, by chance; ``docs`` are counted first."""
    share = min(1.0, rows / max(docs.count(), 1))
    return docs.sample(share, seed).limit(2 * rows)


def measure(sample: DataFrame, rules: Sequence[Rule]) -> list[Measured]:
    """Share of rows rejected and cost of each rule on a sample, which must fit one task."""
    sample = written(sample.coalesce(1), "rule-sample")
    n = max(sample.count(), 1)

    def seconds(column: Column, times: int) -> tuple[float, float]:
        repeated = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        # Adding the number of the repetition keeps the rule from being worked out once for all.
        share = repeated.agg(F.avg(F.when(column, 1.0).otherwise(0.0) + 0 * F.col("_time"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    # What else the machine does only adds to a time, so the least of a few counts.
    @cache
    def idle(times: int) -> float:
        return min(seconds(F.col("_time") < 0, times)[1] for _ in range(3))

    def settled(column: Column) -> tuple[float, float]:
        times = 1
        while True:
            share, took = seconds(column, times)
            took -= idle(times)
            if took >= _ENOUGH_SECONDS or times >= _MOST_TIMES:
                break
            # Powers of two, so that rules share what a job takes without them.
            grow = 2 * _ENOUGH_SECONDS / took if took > 0.05 else 16
            times = min(_MOST_TIMES, times << ceil(log2(min(max(grow, 2), 16))))
        again = [seconds(column, times)[1] - idle(times) for _ in range(2)]
        return share, max(min(took, *again), 1e-6) / times / n

    seconds(F.lit(False), 1)
    found = [Measured(rule, *settled(rule.fails)) for rule in rules]
    dropped(sample)
    return found


def cascade(docs: DataFrame, rules: Sequence[Rule], sample: DataFrame) -> DataFrame:
    """``docs`` with ``kept``: whether no rule fails.

    The rules are estimated on ``sample`` (rows with the columns of ``docs``, such as ``draw``
    gives) and then tried for each row in order of rejections per cost, up to the first
    that fails; what the others would have to work out is not worked out. The sample decides
    the order alone, so the result is the same for any, an empty one included. Nulls
    fail no rule unless the rule says so; repeated rows and empty tables are fine;
    an existing column ``kept`` is an error.
    """
    return tried(docs, [m.rule for m in sorted(measure(sample, rules), key=lambda m: m.rank)])


def tried(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``docs`` with ``kept``, the rules tried in this order."""
    if "kept" in docs.columns:
        raise ValueError("column kept exists already")
    failed = F.lit(False)
    for rule in reversed(rules):
        failed = F.when(F.coalesce(rule.fails, F.lit(False)), True).otherwise(failed)
    return docs.withColumn("kept", ~failed)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of every text: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``,
    ``n_dup_lines`` and ``n_repeat_words`` (an existing column of such a name is an error).

    A null text has zero of each; other columns pass through, repeated rows too. ``n_lines``
    are lines with a word, ``n_dup_lines`` those equal to an earlier one, ``n_repeat_words`` the words in windows of three
    that occur more than once in the text. Windows are compared by a 64-bit hash
    of their words within one text. All of it is column work on single rows: the
    windows of a text are sorted, never paired.
    """
    clash = {*_COUNTS} & {*docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    return docs.select("*", *(c.alias(name) for name, c in text_measures(text).items()))


def text_measures(text: str = "text") -> dict[str, Column]:
    """What ``measures`` counts, as expressions over the text, for rules that need only some of it."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    chars = F.length(t) - F.regexp_count(t, F.lit("[\\x20\\x09-\\x0D]"))
    counts = [
        F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")),
        chars,
        F.regexp_count(t, F.lit("[#*$%&|<>]")),
        F.size(lines),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        let(words(t), lambda w: let(_triples(w), _covered)),
    ]
    return {name: c.cast("long") for name, c in zip(_COUNTS, counts, strict=True)}


def _triples(w: Column) -> Column:
    """A hash of each three words in a row."""
    n = F.size(w)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(3))))


def _covered(h: Column) -> Column:
    """How many words lie in triples whose hash occurs more than once."""
    placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

        return F.sort_array(F.filter(s, twin)["i"])

    def total(p: Column) -> Column:
        gap = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

    # Most texts repeat no triple, and those are not sorted.
    some = F.size(F.array_distinct(h)) < F.size(h)
    sorted_ = let(F.sort_array(placed), lambda s: let(repeated(s), total))
    return F.when(some, sorted_).otherwise(F.lit(0))
