"""Shared lines, conversation prefixes and ranked search against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lexical_search, line_dedup, prefix_trie

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def without_shared_lines(rows, min_docs, min_chars, keep_first):
    """Rows in order of id (null last) with what stays of their lines; equal rows lose the same."""
    holders = defaultdict(list)
    for k, (_, text) in enumerate(rows):
        seen = defaultdict(list)
        for at, line in enumerate((text or "").split("\n")):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= min_chars:
                seen[key].append(at)
        for key, places in seen.items():
            holders[key].append((k, places))
    gone = defaultdict(set)
    for found in holders.values():
        if len(found) >= min_docs:
            for n, (k, places) in enumerate(found):
                gone[rows[k]].update(places[1:] if keep_first and n == 0 else places)
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = [x for at, x in enumerate(lines) if at not in gone[row]]
        out.append((row[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def lined():
    rng = random.Random(7)
    common = [" Menu", "menu\t", "MENU", "é", "Ünser", "-", "", "  ", "a b"]
    rows = []
    for i in range(300):
        own = [rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(400)}" for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(own)))
    return rows + [(400, None), (401, ""), (402, "\n\n"), (403, "x\r\n\x0bX \nx")]


@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 3, False), (3, 1, True), (1, 2, True)])
def test_lines_equal_a_plain_version(spark, min_docs, min_chars, keep_first):
    rows = lined()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS one", "2 AS keep", "3 AS row")
    got = line_dedup.drop_shared_lines(docs.repartition(5), min_docs, min_chars=min_chars, keep_first=keep_first)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    found = Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()))
    assert found == without_shared_lines(rows, min_docs, min_chars, keep_first)


def test_lines_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "a\nb")] * 3 + [(None, "a\nc")] * 2 + [(1, "b\nd"), (2, "a\na"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_shared_lines(docs, 4).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert Counter(map(tuple, got.collect())) == without_shared_lines(rows, 4, 1, False)
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.drop_shared_lines(docs.selectExpr("*", "1 AS n_lines"))


@pytest.mark.parametrize("seed", range(20))
def test_ranges_cut_anywhere_give_the_same_rows(seed):
    """A key's rows over many ranges and batches, against all of them in one place."""
    rng = random.Random(seed)
    keys = sorted(rng.choices(range(12), weights=[60] + [3] * 11, k=rng.randint(1, 150)))
    least = rng.choice([1, 2, 5, 40])
    rows = pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(keys, pa.int64()), pa.array(range(len(keys)), pa.int64())],
        ["key1", "key2", "id"],
    )
    cuts = sorted(rng.choices(range(len(keys) + 1), k=rng.randint(0, 5)))
    out = []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
        inner = sorted(rng.choices(range(a, b + 1), k=rng.randint(0, 4)))
        batches = [rows.slice(x, y - x) for x, y in zip([a, *inner], [*inner, b])]
        for batch in line_dedup._Stream(least, part).run(iter(batches)):
            out += batch.to_pylist()
    counts, first = Counter(), {}
    for r in out:
        if r["n"] is not None:
            counts[r["key1"]] += r["n"]
            first[r["key1"]] = min(first.get(r["key1"], 99), r["part"])
    kept = [r for r in out if r["n"] is None and (not r["open"] or counts[r["key1"]] >= least)]
    often = Counter(keys)
    assert sorted(r["id"] for r in kept) == [i for i, k in enumerate(keys) if often[k] >= least]
    heads = {r["key1"]: r["id"] for r in kept if r["head"] and (not r["open"] or r["part"] == first[r["key1"]])}
    assert heads == {k: keys.index(k) for k in set(keys) if often[k] >= least}


def test_bitmaps_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        keep = rng.random(n) < 0.9
        assert (line_dedup.unpack_bitmap(line_dedup.pack_bitmap(keep), n) == keep).all()


def plain_trie(paths):
    """Of each conversation id its turns, as a tuple."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, own in members.items():
        d = len(node)
        below = [x for x in members if x[:d] == node]
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == d)
        out.append(
            (
                min(own),
                d,
                min(members[node[:-1]]) if d else None,
                len(own),
                sum(len(x) == d + 1 for x in below),
                sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return Counter(out)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(-3, 60):
        n = rng.choice([1, 2, 3, 5, 8, 9, 17, 30])
        said = [(rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "né", ""])) for _ in range(n)]
        if c % 4 == 0:
            said = [("user", "same")] * 26 + said
        rows += [(c, t, role, text) for t, (role, text) in enumerate(said)]
    rows += [(100, None, "user", "hi"), (100, 0, None, None), (101, 5, "user", "hi"), (101, 9, "", "")]
    return rows


@pytest.mark.parametrize("blocks, chunk", [(1024, 1 << 20), (2, 32)])
def test_trie_equals_a_plain_one(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(prefix_trie, "SUPER", blocks)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", chunk)
    rows = conversations()
    paths = defaultdict(tuple)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        paths[c] += ((role or "", text or ""),)
    turns = spark.createDataFrame([*rows, (None, 1, "user", "lost")], "conv_id long, turn long, role string, text string")
    turns = turns.selectExpr("*", "1 AS one", "2 AS position", "3 AS block")
    more = spark.createDataFrame([(700,), (701,), (None,), (5,)], "conv_id long")
    got = prefix_trie.prefixes(prefix_trie.numbered(turns.repartition(3)), more).collect()
    assert Counter(map(tuple, got)) == plain_trie(paths | {700: (), 701: ()})


def test_trie_of_ties_and_nothing(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.depth, r.n_convs, r.n_leaves) for r in prefix_trie.prefixes(prefix_trie.numbered(turns)).collect()}
    assert got == {(d, 2, 1) for d in range(4)}
    assert prefix_trie.prefixes(prefix_trie.numbered(turns.limit(0))).count() == 0
    silent = spark.createDataFrame([(4,), (3,)], "conv_id long")
    (root,) = prefix_trie.prefixes(prefix_trie.numbered(turns.limit(0)), silent).collect()
    ends = hashlib.sha256(b"3,4").hexdigest()
    assert tuple(root) == (3, 0, None, 2, 0, 1, 0, ends)


def test_prefixes_are_rolled_up(spark):
    blocks = prefix_trie._blocks(prefix_trie.numbered(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")), spark.createDataFrame([(1,)], "conv_id long"))
    plan = prefix_trie._rolled(blocks, "count(1) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan and "spark_grouping_id" in plan


def plain_search(docs, items, k):
    found = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+").findall
    terms = lambda text: found((text or "").translate(LOWER))
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in own if c)
    all_ = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // max(all_, 1)
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) & c.keys()
            )
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block, terms, share", [(7, 500_000, 0.25), (1 << 15, 9, 0.0), (40, 500_000, 10.0)])
def test_search_equals_a_plain_one(spark, monkeypatch, block, terms, share):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "MOST_TERMS", terms)
    monkeypatch.setattr(lexical_search, "SHORT_SHARE", share)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Größe", "漢字", "x-y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(200)]
    docs += docs[:15] + [(None, docs[3][1]), (None, docs[3][1]), (900, None), (901, "!?"), (902, "W0 " * 300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "w1 w2"), (3, "w5 w5 W5"), items[0]]
    docs_ = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS term", "3 AS score")
    items_ = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS rank")
    got = lexical_search.best_documents(docs_.repartition(4), items_, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, 5)
    if block == 7:
        assert lexical_search.best_documents(docs_.limit(0), items_).count() == 0
        assert lexical_search.best_documents(docs_, items_.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_skipping_loses_no_document(seed):
    rng = np.random.default_rng(seed)
    best, every, skipped = lexical_search.Best(4), Counter(), 0
    for block in range(5):
        ids = np.arange(block * 400, block * 400 + 400)
        lists = []
        for n in rng.integers(0, 400, rng.integers(1, 9)):
            docs = np.sort(rng.choice(400, n, replace=False))
            scores = rng.integers(-3, 4, n) if n > 200 else rng.integers(1, 200, n)
            lists.append(lexical_search.List(docs, scores, max(int(scores.max(initial=0)), 0)))
            every.update(dict(zip((ids[docs]).tolist(), scores.tolist())))
        skipped += lexical_search.search(lists, ids, best)
    expected = sorted(((-s, i) for i, s in every.items() if s > 0))[:4]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == expected


def test_long_lists_are_skipped_once_the_threshold_is_above_them():
    ids = np.arange(1000)
    rare = lexical_search.List(np.arange(50), np.full(50, 1000), 1000)
    long = lexical_search.List(ids, np.ones(1000, np.int64), 1)
    best = lexical_search.Best(10)
    assert lexical_search.search([rare, long], ids, best) == 1000
    assert best.ids.tolist() == list(range(10)) and set(best.scores.tolist()) == {1001}
