"""Leaks, rules, language, language-model scores, classifier and pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter
from math import ceil, log10
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain
from millrace.llm import decontaminate, language_id, ppm, quality_classifier, quality_rules, queries

SMALL = "/root/testdata/sf0.001"


def oracle(name, folder=SMALL):
    with duckdb.connect() as con:
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        found = con.execute(queries.ORACLE_SQL[name])
        return [c[0] for c in found.description], Counter(found.fetchall())


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    columns, expected = oracle(name)
    assert got.columns == columns and Counter(map(tuple, got.collect())) == expected


def leaks():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(40)]
    docs = []
    for i in range(120):
        own = rng.choices(words, k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "other"
            at = rng.randint(0, len(own))
            own[at:at] = part
        docs.append((i, " ".join(own).title()))
    docs += [(500, None), (501, ""), (502, items[0][1]), (None, items[1][1]), (502, "no more")] + docs[:2]
    return docs, items + [(900, None), (901, " "), (None, "a b c d e f g"), (902, "same id"), (902, "two texts of one id")]


@pytest.mark.parametrize("rows", [0, 500_000])
def test_leaks_equal_a_plain_search(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", rows)
    docs, items = leaks()
    expected = set()
    for d, text in set(docs):
        own = {s for k in range(1, 6) for s in plain.shingles(text, k)}
        for i, item in items:
            asked = set(plain.shingles(item, 5))
            if asked and len(own & asked) >= ceil(round(0.8 * len(asked), 9)):
                expected.add((d, i, len(own & asked), len(asked)))
    docs_ = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS need")
    items_ = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc", "2 AS n_shared")
    got = list(map(tuple, decontaminate.find_items(docs_, items_).drop("doc").collect()))
    assert set(got) == expected and len(got) == len(expected)
    left = decontaminate.without_items(docs_, items_)
    clean = [(d, t, 1, 2) for d, t in docs if not any(e[0] == d for e in expected) or (d, t) == (502, "no more")]
    assert left.columns == docs_.columns and Counter(map(tuple, left.collect())) == Counter(clean)
    assert decontaminate.find_items(docs_.limit(0), items_).count() == 0
    assert decontaminate.find_items(docs_, items_.limit(0)).count() == 0


def test_short_items_are_found_inside_long_texts(spark):
    rng = random.Random(9)
    own = [f"w{i}" for i in range(900)]
    rng.shuffle(own)
    docs = spark.createDataFrame([(1, " ".join(own)), (2, "w1"), (3, None)], "doc_id long, text string")
    items = [(k, " ".join(own[300 : 300 + k]).upper()) for k in range(1, 7)] + [(9, "w1"), (10, "w1 w1")]
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.item_id) for r in found.collect())
    assert got == [(1, k) for k in range(1, 7)] + [(1, 9), (2, 9)]


def test_no_words_travel_with_shingles(spark, monkeypatch):
    """Beyond what may be broadcast, a shuffled row is a hash and its document, not the text's words."""
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    own = docs.select(decontaminate._key("doc_id", "text").alias("doc"), F.split("text", " ").alias("w"))
    sketch = spark.createDataFrame([(1, 2, 1)], "hash long, item long, need long")
    plan = decontaminate._candidates(own, sketch, 5)._jdf.queryExecution().sparkPlan().toString()
    lines = [x for x in plan.splitlines() if re.search("Join|HashAggregate", x)]
    assert lines and not any(re.search(r"\bw#", x) for x in lines)


def test_rules_run_by_worth_and_give_one_verdict(spark):
    rows = spark.range(1000).selectExpr("id", "id % 10 AS a", "IF(id % 7 = 0, NULL, id % 2) AS b")
    rules = [quality_rules.Rule("a", F.col("a") == 3), quality_rules.Rule("b", F.col("b") == 1)]
    expected = {i for i in range(1000) if i % 10 != 3 and (i % 7 == 0 or i % 2 != 1)}
    for sample in (rows, rows.limit(0)):
        for order in (rules, rules[::-1]):
            judged = quality_rules.cascade(rows, order, sample)
            assert {r.id for r in judged.where("kept").collect()} == expected
    assert quality_rules.cascade(rows, [], rows).where("kept").count() == 1000
    fast, slow = quality_rules.Measured(rules[0], 0.1, 1e-6), quality_rules.Measured(rules[1], 0.5, 1e-4)
    idle = quality_rules.Measured(rules[1], 0.0, 1e-9)
    assert fast.rank < slow.rank < idle.rank
    with pytest.raises(ValueError, match="kept"):
        quality_rules.cascade(rows.withColumn("kept", F.lit(1)), rules, rows)


def test_rules_are_worked_out_for_rows_that_reach_them_alone(spark):
    rows = spark.range(1000).selectExpr("id", "IF(id % 10 = 0, 'bad', 'good') AS text")
    bad = quality_rules.Rule("bad", F.col("text") == "bad")
    never = F.when(F.col("text") == "bad", F.raise_error(F.lit("reached"))).otherwise(F.lit(False))
    judged = quality_rules.tried(rows, [bad, quality_rules.Rule("dear", never.cast("boolean"))])
    assert judged.where("kept").count() == 900
    with pytest.raises(Exception, match="reached"):
        quality_rules.tried(rows, [quality_rules.Rule("dear", never.cast("boolean")), bad]).collect()


def test_costs_are_positive_and_decide_the_order(spark, small):
    sample = quality_rules.draw(small["documents"].select("doc_id", "text"))
    found = {m.rule.name: m for m in quality_rules.measure(sample, queries.document_rules())}
    assert all(m.cost > 1e-8 for m in found.values())
    # The dearest rule by far comes after a cheap one that rejects about as many.
    assert found["repeats itself"].cost > 2 * found["few words"].cost
    assert found["few words"].rank < found["repeats itself"].rank


def test_measures_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "la " * 500, "x y z x y z", "é#\n\né#\n b", "漢字 & 漢字\r\n漢字"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS t")
    for r in quality_rules.measures(docs).collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit)), text
        assert (r.n_lines, r.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
    assert quality_rules.measures(docs.limit(0)).count() == 0


def test_op7_keeps_clean_documents(spark, small):
    judged = queries.op7_quality_rules(spark, SMALL).join(small["labels"], "doc_id")
    assert judged.where("NOT base_failed AND NOT kept AND quality = 1").count() == 0
    assert judged.where("kept AND quality = 0").count() == 0


def test_native_queries_run_no_python(spark):
    for name in ("op1_decontamination", "op7_quality_rules"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_languages_of_pages(spark, small):
    got = queries.op2_language_id(spark, SMALL).join(small["pages"], "page_id").collect()
    assert len(got) == small["pages"].count()
    right = [r.lang == re.search(r"://[^/]+/(\w\w)/", r.url)[1] for r in got]
    assert np.mean(right) >= 0.98


def test_other_evidence_decides_where_text_is_missing(spark, small):
    docs = small["documents"].select("text", "lang")
    page = {r.lang: r.text[:3000] for r in docs.where("length(text) > 3000").collect()}
    rows = [(i, f"https://a.example.de/{i}", f"<html><p>{page['de']}</p>") for i in range(20)]
    rows += [(50 + i, f"https://b.example.fr/{i}", f'<html lang="fr"><p>{page["fr"]}</p>') for i in range(30)]
    rows += [(100, "https://A.example.de:80/x", "<html>"), (101, None, '<HTML lang=fr-CA>'), (102, None, None)]
    rows += [(103, "https://new.example.fr/", ""), (104, "no address", "<p>zzz"), (100, "https://a.example.de/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS p")
    found = language_id.identify(pages, docs).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert got[100].lang == "de" and got[100].host == "a.example.de" and got[103].lang == "fr"
    assert got[101].lang == "fr" and got[101].declared == "fr" and 0 < got[102].probability <= 1
    assert language_id.identify(pages.limit(0), docs).count() == 0
    untaught = language_id.identify(pages, docs.limit(0)).collect()
    assert len(untaught) == len(rows) and {r.lang for r in untaught} == {None}


@pytest.fixture
def corpus(texts):
    rows = [(i, t[:1500]) for i, t in list(texts.items())[:40]]
    return rows + [(9001, None), (9002, ""), (9003, "é漢 ZZ zz"), (9004, "  "), (None, "no id"), (9003, "é漢 ZZ zz")]


@pytest.mark.parametrize("share", [2.0**-21, 2.0**-6, 2.0])
def test_scores_equal_plain_models(spark, monkeypatch, corpus, share):
    monkeypatch.setattr(ppm, "FREQUENT_GRAMS", share)
    monkeypatch.setattr(ppm, "FREQUENT_SHARE", share)
    monkeypatch.setattr(ppm, "TRIE_ROWS", 3000)
    training = {i: i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in corpus}
    learnt = [t for i, t in corpus if training[i]]
    counts = Counter(w for t in learnt for w in [*plain.WORD.findall(plain.lowered(t)), b""])
    n, v = sum(counts.values()), len(counts)
    model = plain.Ppm(learnt)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS n")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = ppm.score_texts(docs.repartition(3), F.coalesce(~held, F.lit(True))).collect()
    assert len(rows) == len(corpus)
    own = dict(corpus)
    for r in rows:
        tokens = [*plain.WORD.findall(plain.lowered(own[r.doc_id])), b""]
        assert r.held_out != training[r.doc_id] and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
        assert r.base_score == pytest.approx(sum(log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score == pytest.approx(model.score(own[r.doc_id]), rel=1e-4)


def test_probabilities_add_up():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc d", k=rng.randint(0, 60))) for _ in range(30)]
    grams = Counter()
    for text in texts:
        x = b"\xff" * 4 + text.encode() + b"\xff"
        grams.update(x[i : i + 5] for i in range(len(x) - 4))
    pairs = np.zeros((256, 256))
    for g, n in grams.items():
        pairs[g[3], g[4]] += n
    asked = {g[:4] for g in grams} | {b"aazq", b"zzzz", b"zbca", b"qqqa"}
    every = sorted({c + bytes([s]) for c in asked for s in range(256)} | {*grams})
    own = np.array([int.from_bytes(g, "big") for g in every], np.uint64)
    logp = ppm.log_probabilities(own, np.array([grams[g] for g in every]), pairs)
    sums = Counter()
    for g, p in zip(every, logp, strict=True):
        sums[g[:4]] += 10**p
    assert all(sums[c] == pytest.approx(1) for c in asked)


def test_the_model_grows_with_the_texts(spark, small):
    docs = small["documents"].withColumn("held_out", F.lit(False))
    part = ppm.gram_counts(docs.where("doc_id % 4 = 0")).count()
    assert part < ppm.gram_counts(docs).count() == ppm.trie(ppm.gram_counts(docs)).count()


def test_scores_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ppm.score_texts(docs, F.lit(False)).collect()}
    assert rows[1].score == pytest.approx(-3 * log10(256), rel=1e-4) and rows[1].train_tokens == 0
    assert (rows[2].n_tokens, rows[2].n_known) == (1, 0) and rows[2].base_score == pytest.approx(0)
    assert ppm.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_classifier_finds_bad_documents_and_keeps_clean_ones(spark):
    """Fitted on half of the labels of sf0.1, held against the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0"))
    rows = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.keep for r in rows if r.quality == 0]
    toxic = [r.keep for r in rows if r.quality == 1 and r.toxic == 1]
    assert np.mean(clean) >= 0.98 and np.mean(bad) <= 0.05 and np.mean(toxic) <= 0.2


def test_boosting_goes_on_while_a_trait_gains():
    """A hundred traits, each of which alone tells 40 rows."""
    row = np.arange(4000)
    bad = row // 40 % 2 == 0
    _, weights = quality_classifier.boost(row, row // 40, 100, bad)
    assert (np.sign(weights) == np.where(np.arange(100) % 2 == 0, 1, -1)).all()


def test_sites_are_shrunk_toward_wider_ones(spark):
    rows = [("good", "x", 0)] * 200 + [("bad", "x", 1)] * 150 + [("bad", "y", 1)] * 2 + [(None, None, 0)] * 50
    rows += [("tiny", "x", 1)]
    labelled = spark.createDataFrame(rows, "host string, path string, bad int")
    hosts, paths = quality_classifier.site_priors(labelled, ["host", "path"])
    prior = {r.host: r.prior for r in hosts.collect()}
    deep = {(r.host, r.path): r.prior for r in paths.collect()}
    assert prior["good"] < prior[None] < 0 < prior["tiny"] < prior["bad"]
    assert deep[("bad", "y")] > 0 and deep[("tiny", "x")] <= deep[("bad", "x")] and (None, None) in deep
    alike = spark.createDataFrame([(f"h{i % 30}", i // 30 % 2) for i in range(1200)], "host string, bad int")
    (same,) = quality_classifier.site_priors(alike, ["host"])
    assert max(abs(r.prior) for r in same.collect()) < 1e-3


def test_classifier_of_nulls_ties_and_nothing(spark):
    rows = [(1, None, None, None), (None, "fine words", "s", "en"), (2, "x " * 300, "s", "en"), (2, "x " * 300, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs = docs.selectExpr("*", "1 AS prior", "2 AS bad", "3 AS quality")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 0, 0), (2, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    judged = quality_classifier.classify(docs, labels)
    assert judged.columns == [*docs.columns, "evidence", "p_bad", "keep"] and judged.count() == 4
    assert judged.where("p_bad IS NULL OR keep IS NULL").count() == 0
    blind = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert [(r.evidence, r.p_bad, r.keep) for r in blind] == [(0.0, 0.5, True)] * 4
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError, match="keep"):
        quality_classifier.classify(docs.withColumn("keep", F.lit(1)), labels)


def test_pipeline_stage_by_stage(spark, small, texts):
    """Each stage on what the one before kept, against a plain version or its labels."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near copies", "repeated passages", "benchmark leaks", "byte-level BPE"]
    docs = small["documents"]
    kept = stages[0](spark, docs, SMALL).cache()
    labels = {r.doc_id: r for r in small["labels"].collect()}
    left = {r.doc_id: r.text for r in kept.collect()}
    known = [d for d in texts if d in labels]
    assert all(d in left for d in known if labels[d].quality == 1 and not labels[d].toxic)
    assert all(left[d] == texts[d] for d in left)

    once = stages[1](spark, kept, SMALL).cache()
    sets = {d: set(plain.shingles(t, 5)) for d, t in left.items()}
    ids = sorted(sets)
    alike = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in once.collect()} == set(plain.linked(ids, alike).values())

    cut = stages[2](spark, once, SMALL).cache()
    rows = once.collect()
    for r, (n, words) in zip(rows, plain.without_repeats([r.text for r in rows], 35), strict=True):
        got = cut.where(F.col("doc_id") == r.doc_id).first() if len(words) < n else None
        assert got is None or (got.text, got.n_chars) == (b" ".join(words).decode(), len(b" ".join(words).decode()))
    assert cut.count() == once.count()

    clean = stages[3](spark, cut, SMALL).cache()
    items = [set(plain.shingles(r.text, 5)) for r in small["benchmark"].collect()]
    own = {r.doc_id: set(plain.shingles(r.text, 5)) for r in cut.collect()}
    leak = {d for d, s in own.items() if any(i and 5 * len(i & s) >= 4 * len(i) for i in items)}
    assert {r.doc_id for r in clean.collect()} == own.keys() - leak

    for frame in (kept, once, cut, clean):
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    coded = stages[4](spark, clean, SMALL)
    assert coded.where("exact").count() == clean.count() == coded.count()
    whole = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in clean.collect()}


def test_pipeline_of_nulls_and_nothing(spark, small):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, "s", None)]
    docs = small["documents"].limit(30).union(spark.createDataFrame(odd, small["documents"].schema))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SMALL)
        frame.collect()


def test_pipeline_keeps_documents_without_labels(spark, small, tmp_path):
    unknown = small["labels"].limit(5).withColumn("doc_id", F.col("doc_id") + 10**12)
    for name, labels in (("none", small["labels"].limit(0)), ("unknown", unknown)):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = corpus_pipeline.drop_bad(spark, small["documents"], f"{tmp_path}/{name}")
        assert kept.count() == small["documents"].count()
