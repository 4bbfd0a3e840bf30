"""SimHash, components, near copies and repeated passages against plain versions."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash

import corpus_pipeline
import plain
from millrace.llm import queries, simhash, similar, substring_dedup
from millrace.llm.components import components


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in plain.shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def within(values, distance):
    pairs = combinations(values, 2)
    return [(a, b) for a, b in pairs if (values[a] ^ values[b]).bit_count() <= distance]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(300 + i, 301 + i) for i in range(60)] + [(999, i) for i in range(400, 480)] + [(5, 5)]
    got = components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    ends = {n for a, b in edges if a != b for n in (a, b)}
    assert dict(map(tuple, got)) == plain.linked(ends, edges) and len(got) == len(ends)


def test_op3_on_documents(spark, texts):
    got = queries.op3_simhash(spark, "/root/testdata/sf0.001").collect()
    own = {d: fingerprint(t) for d, t in texts.items()}
    labels = plain.linked(own, within(own, 2))
    assert {tuple(r) for r in got} == {(d, f"{own[d]:016x}", labels[d]) for d in own}


def test_crowded_values_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 5)
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(40)}
    for base in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(120):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    own = {signed(v): v for v in values}
    nodes = spark.createDataFrame([(v,) for v in own], "fp long")
    links = simhash.links(nodes, 2)
    got = {r.node: r.component for r in components(links).collect()}
    assert {v: got.get(v, v) for v in own} == plain.linked(own, within(own, 2))
    assert links.count() < 65 * len(own)


def test_thresholds_add_up_at_the_least_cost():
    cost = [[0, 5, 9, 50], [0, 1, 2, 90], [0, 7, 8, 9]]
    price, chosen = simhash.allocate(cost, 0)
    options = [
        (cost[0][a + 1] + cost[1][b + 1] + cost[2][c + 1])
        for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0
    ]
    assert price == min(options) and sum(chosen) == 0


def test_simhash_of_nulls_ties_and_nothing(spark):
    rows = [(5, None), (4, ""), (None, " \n"), (7, "one two"), (7, "one two"), (6, "ONE\ttwo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS least")
    got = Counter(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()))
    fp = signed(fingerprint("one two"))
    assert got == Counter([(5, 0, 4), (4, 0, 4), (None, 0, 4), (7, fp, 6), (7, fp, 6), (6, fp, 6)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nobody = docs.where("doc_id is null")
    assert [tuple(r) for r in simhash.near_duplicates(nobody).collect()] == [(None, 0, None)]


def near_copies():
    """Groups of copies with few words changed, and texts of their own."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(rng.choice([1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += rows[:4] + ["too short", "Too short", "", " "]
    return [(i, t) for i, t in enumerate(rows)] + [(900, None)]


def test_near_copies_keep_one_of_each_group(spark):
    rows = near_copies()
    sets = {i: set(plain.shingles(t, 5)) for i, t in rows}
    alike = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    blank = [i for i, t in rows if not t]
    labels = plain.linked(sets, alike + list(zip(blank, blank[1:], strict=False)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS owner", "1 AS least")
    kept = similar.keep_one(docs.repartition(3))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(labels.values()))
    assert similar.keep_one(docs.limit(0)).count() == 0
    twice = docs.limit(3).union(docs.limit(3)).union(docs.limit(3).selectExpr("null", "text", "owner", "least"))
    assert similar.keep_one(twice).count() == similar.keep_one(docs.limit(3)).count()


def test_crowded_near_copies_link_to_their_middle(spark, monkeypatch):
    monkeypatch.setattr(similar, "CROWDED", 8)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        own[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(own)))
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]


def kept_by_brute_force(rows):
    sets = {i: set(plain.shingles(t, 5)) for i, t in rows}
    alike = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(plain.linked(sets, alike).values()))


@pytest.mark.parametrize("changes", [(1, 4), (2, 3), (3, 4)])
def test_families_without_their_original_are_linked_like_by_brute_force(spark, changes):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(200), rng.randint(*changes)):
            own[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)


def test_few_candidates_of_a_family_that_is_hardly_linked(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(200), rng.randint(3, 4)):
            own[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    made, written = Counter(), similar.written

    def counted(frame, name):
        table = written(frame, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(similar, "written", counted)
    similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert made["candidates"] == 299 and made["more-candidates"] < 0.2 * 300 * 299 / 2


def test_one_of_several_texts_with_one_id_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text + " more"), (1, text + " more"), (2, text + " yet"), (3, "x"), (None, text + " none")]
    kept = [tuple(r) for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 2 and (3, "x") in kept and [d for d, _ in kept].count(1) == 1
    nobody = spark.createDataFrame([(None, text), (None, text + " more"), (None, text)], "doc_id long, text string")
    assert similar.keep_one(nobody).count() == 1


def test_cut_and_extended_copies_are_found(spark):
    rng = random.Random(12)
    rows = []
    for i in range(80):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        more = [f"v{rng.randrange(10**6)}" for _ in range(70)]
        rows += [(i, " ".join(base)), (1000 + i, " ".join(base[:243])), (2000 + i, " ".join(base + more))]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows) == list(range(80))


def test_pipeline_links_near_copies_by_fingerprint_and_by_similarity(spark):
    """Texts that mostly repeat one passage have its fingerprint and few 5-word shingles in common."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(1000 + i, t) for i, t in near_copies() if t] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "\t")]
    for i in range(10):
        passage, own = fresh(3), fresh(60)
        changed = [*own[:30], "changed", *own[31:]]
        rows += [
            (10 * i, " ".join(passage * 100 + fresh(60))),
            (10 * i + 1, " ".join(passage * 100 + own)),
            # The same set of shingles as the one before, but another fingerprint.
            (10 * i + 2, " ".join(passage * 3 + own)),
            (10 * i + 3, " ".join(passage * 3 + changed)),
            (10 * i + 4, " ".join(fresh(60))),
        ]
    own = {d: fingerprint(t) for d, t in rows}
    sets = {d: set(plain.shingles(t, 5)) for d, t in rows}
    close = within(own, 2)
    alike = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    expected = set(plain.linked(own, close + alike).values())
    assert expected < set(plain.linked(own, close).values()) and expected < set(plain.linked(own, alike).values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(expected)
    blank = {d for d in sets if not sets[d]}
    assert len(blank) > 4 and len(blank & expected) == 1 and {d for d in expected if d < 100} == {10 * i + k for i in range(10) for k in (0, 4)}


def repeats():
    rng = random.Random(5)
    base = [[rng.choice("ab") for _ in range(400)] for _ in range(3)]
    base += [["x"] * 200, ["p", "q"] * 150, ["a", "b", "c"] * 60, list("abcde") * 20]
    passages = [[rng.choice("abcdefgh") for _ in range(n)] for n in (34, 35, 36, 40, 60, 90)]
    rows = []
    for i in range(250):
        own = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.3:
                b = rng.choice(base)
                at = rng.randrange(len(b))
                own += b[at : at + rng.randint(1, 80)]
            elif kind < 0.6:
                own += rng.choice(passages)
            else:
                own += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 50))]
        rows.append((i, " ".join(own)))
    odd = [None, "", "  \n", "é " * 50, "y " * 35, "z " * 34, "K " * 34 + "k"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + rows[:3]


@pytest.mark.parametrize("length", [12, 35, 63])
def test_repeats_go_wherever_they_start_twice(spark, length):
    rows = repeats()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS owner", "'s' AS plain")
    got = substring_dedup.remove_repeats(docs.repartition(3), length)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_text", "kept_sha256"]
    expected = Counter(
        (d, n, n - len(kept), b" ".join(kept).decode(), hashlib.sha256(b" ".join(kept)).hexdigest())
        for (d, _), (n, kept) in zip(rows, plain.without_repeats([t for _, t in rows], length), strict=True)
    )
    names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]
    assert Counter(map(tuple, got.select(*names).collect())) == expected


def test_a_text_of_one_word_gives_one_row_for_each_key(spark):
    """Anchors inside a run of one word all have the same key, and its windows are all equal."""
    texts = spark.createDataFrame([(1, "z " * 500), (2, "a b " * 300)], "number long, text string")
    found = substring_dedup._anchors(texts, 35)
    assert found.count() == found.select("number", "key").distinct().count()
    spans = texts.selectExpr("*", "array(0L << 12 | 63L, 64L << 12 | 63L) AS spans")
    windows = substring_dedup._windows(spans, 35).collect()
    assert len(windows) == 1 + 2 and sum(1 + len(w.more) for w in windows) == 2 * 128


def test_repeats_of_nothing_and_clashes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError, match="n_words"):
        substring_dedup.remove_repeats(none.selectExpr("*", "1 AS n_words"))
    with pytest.raises(ValueError, match="windows"):
        substring_dedup.remove_repeats(none, 64)


def test_op8_on_documents(spark, texts):
    got = Counter(map(tuple, queries.op8_substring_dedup(spark, "/root/testdata/sf0.001").collect()))
    plain_ = zip(texts, plain.without_repeats(texts.values(), 35), strict=True)
    assert got == Counter(
        (d, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, (n, kept) in plain_
    )
