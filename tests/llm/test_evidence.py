"""Language of pages and quality of documents, against plain versions of the whole formula."""

import re
from collections import Counter, defaultdict
from math import exp, log, log1p, sqrt

import pytest

from millrace.llm import language_id, quality_classifier, queries

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_traits(text):
    words = words_of(text)
    n, distinct = len(words), len(set(words))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    often = Counter(w[:k] for w in words for k in (4, 5, 6) if len(w) > k)
    found = set(words) | {b" often " + p for p, c in often.items() if 200 * c >= n}
    found |= {b" symbols over %d in 100 words" % s for s in (5, 10, 20, 50) if 100 * symbols > s * n}
    found |= {b" distinct words under %d in 100" % s for s in (5, 10, 20, 50) if 100 * distinct < s * n}
    return found | {b" under %d words" % few for few in (5, 10, 20) if n < few}


def plain_boost(rows):
    """Intercept and weights from (traits, bad) rows, by adding the trait that gains most again and again."""
    bad = [b for _, b in rows]
    start = log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    score = [start] * len(rows)
    having = defaultdict(list)
    for k, (found, _) in enumerate(rows):
        for t in found:
            having[t].append(k)
    having = {t: having[t] for t in sorted(having) if len(having[t]) >= 3}
    weights = Counter()
    loss = lambda own, step: sum(log1p(exp(-(score[k] + step) if bad[k] else score[k] + step)) for k in own)
    while having:
        w = [1 / (1 + exp(s if b else -s)) for s, b in zip(score, bad)]
        sums = {t: (sum(w[k] for k in own if bad[k]), sum(w[k] for k in own if not bad[k])) for t, own in having.items()}
        best = max(sums, key=lambda t: round(abs(sqrt(sums[t][0]) - sqrt(sums[t][1])), 9))
        up, down = sums[best]
        if round(abs(sqrt(up) - sqrt(down)), 9) < 1:
            break
        step, before = log((up + 1) / (down + 1)), loss(having[best], 0)
        while loss(having[best], step) > before - 0.01:
            step /= 2
        weights[best] += step
        for k in having[best]:
            score[k] += step
    return start, weights


def shrinking(sites):
    """How many labels what ``sites`` (n, bad, wider share) are shrunk toward is worth."""
    within = sum(n * u * (1 - u) for n, _, u in sites)
    squares = sum((b - n * u) ** 2 for n, b, u in sites)
    pairs = sum(n * (n - 1) * u * (1 - u) for n, _, u in sites)
    if squares <= within or pairs <= 0:
        return 1e6
    return min(max(1 / min((squares - within) / pairs, 1) - 1, 1), 1e6)


def plain_posteriors(docs, labels):
    known = [(x.doc_id, int(x.quality == 0 or x.toxic == 1)) for x in labels]
    marked = [(d, b) for d in docs for i, b in known if d.doc_id == i]
    start, weights = plain_boost([(plain_traits(t), b) for _, t, b in {(d.doc_id, d.text, b) for d, b in marked}])
    share = (sum(b for _, b in marked) + 0.5) / (len(marked) + 1)
    base = log(share / (1 - share))
    priors = [{(): 0.0}]
    for depth in (1, 2):
        counts = defaultdict(lambda: [0, 0])
        for d, b in marked:
            site = (d.source, d.lang)[:depth]
            counts[site][0] += 1
            counts[site][1] += b
        up = {s: 1 / (1 + exp(-(priors[-1][s[:-1]] + base))) for s in counts}
        worth = shrinking([(n, b, up[s]) for s, (n, b) in counts.items()])
        shares = {s: (b + worth * up[s]) / (n + worth) for s, (n, b) in counts.items()}
        priors.append({s: log(p / (1 - p)) - base for s, p in shares.items()})
    out = {}
    for d in docs:
        evidence = start + sum(weights[t] for t in plain_traits(d.text) if t in weights)
        site = (d.source, d.lang)
        prior = priors[2].get(site, priors[1].get(site[:1], 0.0))
        out[d.doc_id] = 1 / (1 + exp(-(max(min(evidence, 8), -8) + prior)))
    return out


def test_classifier_equals_a_plain_fit(spark, small):
    docs, labels = small["documents"].collect(), small["labels"].collect()
    expected = plain_posteriors(docs, labels)
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, SMALL).collect()}
    assert got.keys() == expected.keys()
    for d, p in expected.items():
        assert got[d].p_bad == pytest.approx(p, abs=1e-9) and got[d].keep == (got[d].p_bad <= 0.5)


def test_the_sample_is_bounded_under_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE_ROWS", 200)
    sizes = []
    fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda s: sizes.append(s.count()) or fit(s))
    docs = spark.range(3000).selectExpr("IF(id < 1000, 7, id) AS doc_id", "concat('text ', IF(id < 500, 0, id)) AS text", "'s' AS source", "'en' AS lang")
    labels = spark.range(6000).selectExpr("IF(id < 3000, 7, id % 3000) AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    judged = quality_classifier.classify(docs, labels)
    assert judged.count() == 3000 and sizes[0] < 300


def test_priors_by_shuffle_are_those_by_broadcast(spark, small, monkeypatch):
    judged = lambda: {r.doc_id: r.p_bad for r in quality_classifier.classify(small["documents"], small["labels"]).collect()}
    sent = judged()
    monkeypatch.setattr(quality_classifier, "BROADCAST_SITES", 0)
    assert judged() == pytest.approx(sent)


def plain_page_text(html):
    html = re.sub(r"(?s)<!--.*?-->", " ", html or "")
    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", html)
    html = re.sub(r"(?is)<head\b.*?</head\s*>", " ", html, count=1)
    return re.sub(r"&#?\w{1,31};", " ", re.sub(r"<[^<>]*>", " ", html))


def trigrams(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 0x9E3779B1 % 2**32) >> 16 for k in range(len(data) - 2)]


def softmax(logs):
    top = max(logs)
    weights = [exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def plain_languages(pages, texts):
    languages = sorted({t.lang for t in texts})
    n = range(len(languages))
    counts = {x: Counter() for x in languages}
    for t in texts:
        counts[t.lang].update(trigrams(t.text))
    totals = {x: sum(counts[x].values()) + 0.5 * 65536 for x in languages}
    read = []
    for page in pages:
        grams = trigrams(plain_page_text(page.html))
        mean = [sum(log((counts[x][g] + 0.5) / totals[x]) for g in grams) / max(len(grams), 1) for x in languages]
        loglik = [m * len(grams) * 60 / (len(grams) + 60) for m in mean]
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", page.url or "")
        host = host[1].lower() if host else ""
        said = re.search(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", page.html or "")
        levels = [host, ".".join(host.split(".")[-2:]), host.split(".")[-1]]
        read.append((page.page_id, loglik, softmax(loglik), levels, said[1].lower() if said else ""))
    add = lambda rows: [sum(p[k] for p in rows) for k in n]
    sums = [defaultdict(lambda: [0.0] * len(languages)) for _ in range(4)]
    for level in range(3):
        for name in {r[3][level] for r in read if r[3][0]}:
            sums[level][name] = add([r[2] for r in read if r[3][level] == name])
    for name in {r[4] for r in read}:
        sums[3][name] = add([r[2] for r in read if r[4] == name])
    everywhere = add([r[2] for r in read])
    out = {}
    for page, loglik, p, levels, said in read:
        others = lambda c: [max(x - y, 0.0) for x, y in zip(c, p)]  # noqa: B023, E731
        prior = [1 / len(languages)] * len(languages)
        for c in [everywhere] + [sums[k][levels[k]] if levels[0] else [0.0] * len(languages) for k in (2, 1, 0)]:
            c = others(c) if any(c) else c
            prior = [(x + 5 * w) / (sum(c) + 5) for x, w in zip(c, prior)]
        told = [log((x + 0.5) / (y + 1)) for x, y in zip(others(sums[3][said]), others(everywhere))]
        q = softmax([a + b + log(c) for a, b, c in zip(loglik, told, prior)])
        out[page] = (languages[q.index(max(q))], max(q), languages[p.index(max(p))])
    return out


def test_languages_equal_the_plain_formula(spark, small):
    pages, texts = small["pages"].collect(), small["documents"].collect()
    rows = [r.asDict() for r in pages]
    rows += [dict(page_id=9000 + k, url=u, html=h) for k, (u, h) in enumerate([(None, None), ("x://a.de/", "<html lang=DE>"), ("no", "<p>Hallo Welt")])]
    odd = spark.createDataFrame(rows, small["pages"].schema)
    expected = plain_languages(odd.collect(), texts)
    got = {r.page_id: r for r in language_id.identify(odd, small["documents"]).collect()}
    assert got.keys() == expected.keys()
    for page, (lang, probability, by_text) in expected.items():
        assert (got[page].lang, got[page].text_lang) == (lang, by_text)
        assert got[page].probability == pytest.approx(probability, abs=1e-3)


def test_tags_go_in_linear_time_and_as_a_browser_hides_them(spark):
    page = '<html lang="fr"><head><title>no</title><script>a<b</script></head><body><style>z{}</style>Yes &amp; <!-- gone --> so<p class="x">end'
    rows = [(0, page)] + [(k, x * 100_000) for k, x in enumerate(["<", "<a ", "<!--", "<script>", "<head>"], 1)]
    docs = spark.createDataFrame(rows, "i int, html string")
    found = {r.i: r.text for r in docs.selectExpr("i", "html").select("i", language_id.page_text(docs.html).alias("text")).collect()}
    assert found[0].split() == ["Yes", "so", "end"] and len(found) == 6


def test_rare_languages_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEAST_SHARE", 0.1)
    texts = spark.createDataFrame([("the and of", "en")] * 15 + [("le la les", "fr")] * 15 + [("xx yy", "zz")], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.zz/", "<p>xx yy xx yy")], "page_id long, url string, html string")
    assert language_id.identify(pages, texts).first().lang in ("en", "fr")
