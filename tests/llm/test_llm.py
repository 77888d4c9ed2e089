"""The corpus operators against plain Python, on small tables with awkward rows."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayledger.llm import bpe, common, components, hostrules, langid, mixing, neighbours, quality, simhash, suffixdedup, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, "The cat sat on the mat. " * 3, "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0), (4, " \t\n", "de", "a", 3), (5, "The cat sat on the mat. " * 3, "en", "a", 1),
    (5, "The cat sat on the mat. " * 3, "en", "a", 1), (None, "Ünïcode \U0001f600 täxt\x00\x1c end", "de", "c", 5), (7, "word " * 30_000, "en", "b", 9), (8, "one", "fr", "", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(AWKWARD, DOCS)
    for c in ("score", "ids", "fp", "key", "domain", "size", "h", "spans", "bucket", "_doc"):  # names that operators use inside
        d = d.withColumn(c, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, n, words="the of and river stone light under never again small house over blue".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


# ------------------------------------------------------------------------------------------------ 1, 2: classifiers


def labelled(spark, rng, n, bad, name):
    rows, labels = [], []
    for i in range(n):
        flawed = i % 4 == 0
        rows.append((i, bad(prose(rng, 60)) if flawed else prose(rng, 60) + ".", "en", "a", 1))
        labels.append((i, int(flawed) if name == "toxic" else int(not flawed)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, f"doc_id long, {name} int")


def test_quality_is_learnt_and_total(spark, docs, none):
    d, labels = labelled(spark, random.Random(1), 240, lambda t: "!! ".join(t.upper().split()), "quality")
    model = quality.fit(d, labels.where(common.fold("doc_id", 4) != 2))
    got = d.join(labels, "doc_id").withColumn("s", quality.score_udf(model)("text")).collect()
    assert all((r.s >= 0.7) == (r.quality == 1) for r in got)
    scores = docs.select(quality.score_udf(model)("text").alias("s")).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r.s <= 1 for r in scores)
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.accepted(none, quality.fit(none, labels)).count() == 0


def test_bradley_terry_matches_gradient_descent():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.5, 1, (30, 3)), rng.normal(0, 1, (30, 3))
    w = quality.bradley_terry(good, bad, pairs_per_item=1, l2=0.01)
    d = good - bad
    p = 1 / (1 + np.exp(d @ w))
    assert np.allclose(-(d * p[:, None]).mean(0) + 0.02 * w, 0, atol=1e-6)
    assert quality.cut_at_quantile(np.array([0.0, 1, 2, 3]), 0.25) == 0.5


@pytest.mark.parametrize("good, bad", [(9100, 4300), (11, 9050), (9000, 1)])
def test_quality_is_fitted_on_every_labelled_row(spark, good, bad):
    """Weights and cut are those of all rows, by plain NumPy, in classes of any size."""
    rng = random.Random(31)
    words = [w + rng.choice([" ", "! ", ", ", ". ", " 7 ", " A"]) for w in "the of and river stone light under never again small".split() * 3]
    rows = [(i, "".join(rng.sample(words, rng.randint(3, 9))) + ("!!" if i < bad and rng.random() < 0.6 else "")) for i in range(good + bad)]
    d = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    model = quality.fit(d, spark.createDataFrame([(i, int(i >= bad)) for i, _ in rows], "doc_id long, quality int"))
    x = np.array([quality.features(t) for _, t in rows])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-7) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6), rtol=1e-7)
    assert np.isclose(model.cut, quality.cut_at_quantile(model.raw(x), bad / (good + bad)), rtol=0, atol=1e-12)
    z = (x - model.mean) / model.scale
    w = quality.bradley_terry(z[bad:], z[:bad], pairs_per_item=min(bad, good, 40))
    assert np.linalg.norm(model.weights - w) < 0.15 * np.linalg.norm(w)


@pytest.mark.parametrize("good, bad", [(100, 40), (3, 100), (100, 100), (1, 1), (50, 9)])
def test_blocks_of_pairs_hold_every_row(spark, good, bad):
    rows = spark.createDataFrame([(y, i, [float(i)]) for y, n in ((1, good), (0, bad)) for i in range(n)], "tree int, pos long, x array<double>")
    blocks = quality.pair_blocks(rows, good, bad, per_block=7, least=4).collect()
    larger, smaller = ("good", "bad") if good >= bad else ("bad", "good")
    assert sorted(v for b in blocks for v in b[larger]) == list(range(max(good, bad)))
    assert {v for b in blocks for v in b[smaller]} == set(range(min(good, bad)))
    assert all(len(b[larger]) <= 7 and len(set(b[smaller])) == len(b[smaller]) >= min(4, good, bad) for b in blocks)
    w, x = np.array([0.1]), {s: [np.array(b[s])[:, None] / 2 for b in blocks] for s in ("good", "bad")}
    want = [sum(part) for part in zip(*(quality.pair_sums(g, b, w, 8) for g, b in zip(x["good"], x["bad"])))]
    assert all(np.allclose(a, b) for a, b in zip(quality.block_sums(quality.pair_blocks(rows, good, bad, 7, 4), np.array([2.0]))(w), want))


def test_toxicity_is_learnt_and_located(spark, docs, none):
    rng = random.Random(2)
    mark = lambda t: t[:100] + ". You " + rng.choice(["dolt", "oaf"]) + " there. " + t[100:]
    d, labels = labelled(spark, rng, 240, mark, "toxic")
    model = toxicity.fit(d, labels.where(common.fold("doc_id", 5) != 0))
    got = toxicity.judge(d, model, keep=("text",)).join(labels, "doc_id").collect()
    assert all((r.score >= 0.5) == (r.toxic == 1) for r in got)
    for r in got:
        assert all(re.search("dolt|oaf", r.text[o.start : o.end]) for o in r.offending) and bool(r.offending) == (r.toxic == 1)
    assert all(r.score < 0.5 and r.offending == [] for r in toxicity.judge(docs, model).collect())
    assert all(r.score == 0 for r in toxicity.judge(docs.where("text is null or text = ''"), model).collect())
    assert toxicity.judge(none, toxicity.fit(none, labels)).count() == 0
    p = [0.2, 0.5]
    assert toxicity.Model().score([(0, 1, x) for x in p]) == pytest.approx(1 - 0.8 * 0.5)
    # sentences without a known word count by the bias alone
    assert toxicity.Model(bias=0.0).score([(0, 1, 0.2)], 2) == pytest.approx(1 - 0.8 * 0.25)


# ------------------------------------------------------------------------------------------------ 3, 4: native filters


def test_urls_parse_rules_and_models(spark):
    rng = random.Random(3)
    rows = [(i, f"https://{'spam' if i % 2 else 'good'}{rng.randint(0, 99)}.x{'.net/' if i % 2 else '.org/fr/'}{rng.randint(0, 999)}") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "http://EXAMPLE.net/en/x?y"), (1004, "http://a.example.net/en"), (1005, "http://a.net"), (1006, "x://h?q://z/net/"),
             (1007, "https://spam7.x.nets/1"), (1008, "https://good7.x.orgs/fr/1"), (1008, "https://good7.x.orgs/fr/1"), (None, "ftp://ünï.net/#a")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumn("u", F.lit(1)).withColumn("g", F.lit(2))
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")]
    got = urls.judged(d, rules).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1000].host, by[1000].path, by[1000].rule, by[1002].host) == ("", "", None, "")
    assert (by[1003].host, by[1003].path, by[1003].rule, by[1003].verdict) == ("example.net", "/en/x", "example.net/en/", "allow")
    assert by[1004].rule == "net/" and by[1005].rule is None and by[1005].path == "" and (by[1006].host, by[1006].path) == ("h", "")
    assert by[1007].verdict == "block" and by[1008].verdict == "allow" and by[None].rule == "net/"
    empty = urls.judged(spark.createDataFrame([], "page_id long, url string"), rules)
    assert empty.count() == 0


def test_url_model_is_a_ratio_of_probabilities(spark):
    """With everything kept, the values of a URL's substrings add up to the difference of two recursively smoothed models."""
    good, bad, prior, order = ["abca", "abcb", "aabb"] * 3, ["bbca", "cccb", "cabc"] * 3, 8.0, 3
    d = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "u string, accepted boolean")
    values = {r.g: r.value for r in urls.model(d, order).collect()}

    def probability(texts, c, context):
        n = Counter(f"\x02{u}\x03"[i:j] for u in texts for i in range(len(u) + 2) for j in range(i + 1, len(u) + 3))
        p = (n[c] + prior / 256) / (sum(v for g, v in n.items() if len(g) == 1 and g != "\x02") + prior)
        for k in range(1, len(context) + 1):
            x = context[-k:]
            p = (n[x + c] + prior * p) / (n[x] + prior)
        return p

    text = "\x02abcb\x03"
    want = sum(np.log(probability(good, text[i], text[max(0, i - order + 1) : i]) / probability(bad, text[i], text[max(0, i - order + 1) : i])) for i in range(1, len(text)))
    got = sum(values.get(text[i:j], 0) for i in range(len(text)) for j in range(i + 1, min(i + order, len(text)) + 1))
    assert got / urls.MICRO == pytest.approx(want, abs=1e-4)


def test_url_model_keeps_what_is_rare_in_much_text(spark):
    rng = random.Random(31)
    made = ["http://a.net/" + "".join(rng.choice("abcdefgh") for _ in range(27)) for _ in range(6000)] + [f"http://b.org/{k}qzx" for k in range(3)]
    d = spark.createDataFrame([(u, i % 2 == 0) for i, u in enumerate(made)], "u string, accepted boolean")
    model = common.written(urls.model(d), "model")
    values = {r.g: r.value for r in model.collect()}
    marked = [urls.START + u + urls.END for u in made]
    seen = Counter(m[i : i + n] for m in marked for n in range(1, 5) for i in range(len(m) - n + 1))
    assert {"qz", "qzx", "qzx" + urls.END} <= set(values) == {g for g, n in seen.items() if n > 1}
    assert 0 < model.where("not hot").count()
    for r in urls.scored(d, model).collect():
        m = urls.START + r.u + urls.END
        want = sum(values.get(m[i : i + n], 0) for n in range(1, 5) for i in range(len(m) - n + 1))
        assert r.score == pytest.approx(want / urls.MICRO / (len(r.u) + 1), abs=1e-12)


def brute_measures(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + j for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_host_rules_measure_exactly(spark, docs, none):
    rng = random.Random(4)
    texts = [r[1] for r in AWKWARD] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["x # y\nx # y\n\n \n$|<" + prose(rng, 50)]
    d = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in hostrules.judged(d).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert hostrules.judged(docs).count() == len(AWKWARD) and hostrules.judged(none).count() == 0


def test_host_verdicts_shrink(spark):
    good = prose(random.Random(5), 40, [f"w{i}" for i in range(300)])
    rows = [(i, good if i % 20 else "short", "clean") for i in range(200)] + [(500 + i, "short" if i < 38 else good, "dirty") for i in range(40)] + [(900, good, "tiny")]
    got = {r.doc_id: r for r in hostrules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].kept and not got[0].kept and not got[539].kept and got[900].kept
    assert got[539].host_rate < 38 / 40 and got[900].host_rate > 0


# ------------------------------------------------------------------------------------------------ 5, 6


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_neighbours(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8))
    v[: n // 3] = 1.0  # a third of all vectors are one
    rows = [(i, [float(x) for x in v[i]]) for i in range(n)]
    odd = [(10_000, None), (10_100, [0.0] * 8), (10_200, [float("nan")] + [1.0] * 7), (10_300, [None] + [1.0] * 7), (10_400, [float("inf")] * 8), (None, [1.0] * 8), (10_500, [1.0])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cell", F.lit(0)).withColumn("v", F.lit(0))
    got = {}
    for r in neighbours.search(d, F.col("vec_id") % 100 == 0, entries_per_cell=16, least_codebook=4, entries_per_group=64, queries_per_group=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([[np.float32(y) for y in r[1]] for r in rows], dtype=np.float64).reshape(n, 8)
    hits = total = 0
    for q in range(0, n, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(n), dist)) if i != q][:10]
        mine = got.get(q, [])
        assert len(mine) == len(want) and [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert all(s == dist[i] for _, i, s in mine) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits, total = hits + len({i for _, i, _ in mine} & set(want)), total + len(want)
    assert hits >= 0.9 * total and set(got) <= set(range(0, n, 100))


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    x = [[float(y) for y in v] for v in rng.normal(size=(60, 4))]
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[0]), (7, x[7]), (0, x[9])]  # a query thrice, once with another vector; an entry twice
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, recall=1.0).collect()
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), j, n) for n, (j, u) in enumerate(rows) if n != q)[:10]
            want += [(i, rank, j, s) for rank, (s, j, _) in enumerate(near, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted((a, b, c, round(s, 9)) for a, b, c, s in want)


def water(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        unit = (total - sum(full.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * unit > most * sizes[s]]
        if not over:
            return {s: full.get(s, w[s] * unit) for s in names}
        full |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(spark, docs, none):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 30)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 200 + [None] * 10 + ["d"] * 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(d, rows_per_bin=50).collect()
    size = Counter()
    for r in got:
        size[r.source] += r["size"]
    want, taken = water(size, (5, 2, 1), 3), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source] and r.taken <= 3 * r["size"] and r.taken % r["size"] == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and sum(taken.values()) <= sum(size.values())
    again = mixing.mixed(d.repartition(7), rows_per_bin=50)
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    assert mixing.mixed(docs).count() == len(AWKWARD) and mixing.mixed(none).count() == 0
    out = mixing.repeated(d)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in got)
    assert mixing.repeated(docs).columns == docs.columns


# ------------------------------------------------------------------------------------------------ 7


def test_language(spark, docs, none):
    rng = random.Random(7)
    words = {"xx": ["karu", "tolem", "vash", "idri"], "yy": ["sonnet", "marble", "quill", "ferry"]}
    rows = [(i, prose(rng, rng.randint(3, 80), words[k]), k, "a", 1) for i in range(200) for k in ["xx" if i % 2 else "yy"]]
    d = spark.createDataFrame(rows, DOCS)
    model = langid.fit(d.where(common.fold("doc_id", 5) != 0))
    got = langid.predict(d, model, keep=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = langid.predict(docs, model).collect()
    assert len(odd) == len(AWKWARD)
    for r, row in zip(odd, AWKWARD):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in row[1] or ""))
    assert langid.predict(docs, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


# ------------------------------------------------------------------------------------------------ 8


def brute_removed(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b, m = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                m[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = b"".join(bytes([x]) for x, y in zip(b, m) if not y), sum(m)
    return out


def test_suffix_dedup_is_exact(spark, docs, none, monkeypatch):
    rng = random.Random(8)
    base, line = prose(rng, 60), "this very line stands in many of the documents, again and again, and is long enough to count as a repeat of its own"
    texts = [base, base, base.replace(" ", "  ", 3), "x" + base[30:250] + "y", "ab" * 150, "ab" * 100 + "c", "a" * 99, "a" * 101, "a" * 101, None, "", "é" * 120, "zé" + "é" * 70]
    texts += [prose(rng, 20) + line[: rng.randint(60, 114)] + prose(rng, 20) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    want = brute_removed([(i, t) for i, t in rows], 100)
    for few in (False, True):  # then with every shared k-gram dealt out window by window
        if few:
            monkeypatch.setattr(suffixdedup, "heavy_grams", lambda keyed, length, n: np.sort(suffixdedup.segments([(t or "").encode() for t in texts], length, np.zeros(0, np.uint64))["key"][::2]))
        got = suffixdedup.deduplicated(d).collect()
        assert len(got) == len(rows)
        for r in got:
            kept, n = want[r.doc_id]
            assert bytes(r.kept) == kept and sum(s.end - s.start for s in r.spans) == n, r.doc_id
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    odd = suffixdedup.deduplicated(docs, keep=("source", "key")).collect()
    assert len(odd) == len(AWKWARD)
    assert suffixdedup.deduplicated(none).count() == 0


def test_suffix_array_orders_suffixes():
    rng = random.Random(9)
    for alphabet in (b"a", b"ab", b"abcd\xff "):
        for n in (1, 2, 7, 300):
            t = bytes(rng.choice(alphabet) for _ in range(n))
            order = suffixdedup.suffix_array(np.frombuffer(t, "u1"), 40).tolist()
            assert [t[i : i + 40] for i in order] == sorted(t[i : i + 40] for i in range(n)) and sorted(order) == list(range(n))
            shared = suffixdedup.common_prefixes(np.frombuffer(t, "u1"), np.array(order), 40)
            for a, b, got in zip(order, order[1:], shared[1:]):
                assert got == next((k for k in range(40) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or not t[a + k : a + k + 1]), 40)


# ------------------------------------------------------------------------------------------------ 9


def brute_components(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("cap", [64, 2, 0])
def test_simhash_links_miss_nothing(spark, cap):
    rng = random.Random(10)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    nodes = {simhash.signed(s ^ sum(1 << b for b in rng.sample(range(64), k))) for s in seeds for k in (0, 1, 2, 2, 3, 4)}
    for _ in range(60):  # a crowd around one value
        nodes.add(simhash.signed(seeds[0] ^ sum(1 << b for b in rng.sample(range(64), 2))))
    nodes = sorted(nodes)
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    want = brute_components(nodes, near)
    d = spark.createDataFrame([(x,) for x in nodes], "fp long")
    found = simhash.links(d, 2, cap)
    root = {r.node: r.root for r in components.roots(found).collect()}
    assert len({(want[x], root.get(x, x)) for x in nodes}) == len(set(want.values())) == len({root.get(x, x) for x in nodes})


def test_plan_covers_the_reach():
    rng = np.random.default_rng(3)
    for n in (100, 10**6, 10**10):
        chosen = simhash.plan(rng.integers(0, 2**63, 500).astype(np.uint64), n, 2)
        assert sum(t + 1 for _, t in chosen) == 3 and len({b for bits, _ in chosen for b in bits}) == sum(len(b) for b, _ in chosen)
    assert simhash.allot([[1.0, 5.0], [1.0, 5.0], [9.0, 9.5]], 2) == (6.0, [0, 1, -1])


def test_simhash_classes(spark, docs, none):
    import xxhash

    got = simhash.classes(docs).collect()
    assert len(got) == len(AWKWARD)
    for r, row in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(AWKWARD, key=lambda r: (r[0] is None, r[0]))):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or ""))
        parts = ([" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]) if ws else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert r.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r.doc_id: r.component_id for r in got}[5] == 1 and {r.doc_id: r.component_id for r in got}[4] == 2
    assert simhash.classes(none).count() == 0
    kept = simhash.representatives(docs, simhash.classes(docs))
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 1").count() == 1
    twice = docs.where("doc_id = 5")
    assert simhash.representatives(twice, simhash.classes(twice)).count() == 1


def test_near_classes(spark, docs, none):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [prose(rng, 200, vocabulary) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        ws = t.split()
        ws[rng.randint(0, 199)] = "changed"
        rows.append((100 + i, " ".join(ws)))
    for k in range(150):  # a crowd of near copies, more than a bucket's cap
        ws = base[0].split()
        ws[rng.randint(0, 199)] = f"changed{k}"
        rows.append((1000 + k, " ".join(ws)))
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == i for i in range(30)) and all(got[1000 + k] == 0 for k in range(150)) and len(set(got.values())) == 30
    assert simhash.near_classes(docs).count() == len(AWKWARD) and simhash.near_classes(none).count() == 0


def shingle_sets(rows, words=5):
    ws = {i: t.encode().lower().split() for i, t in rows}
    return {i: {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)} for i, w in ws.items()}


def classes_by_brute_force(rows, similar=0.8):
    sets, root = shingle_sets(rows), {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        share = both / (len(sets[i]) + len(sets[j]) - both)
        pairs.append(share)
        if share >= similar:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in root}, pairs


def test_near_classes_at_the_threshold(spark):
    """Pairs from 0.7 to 0.9, each pair alone: linked if and only if brute force says 0.8 or more."""
    rng = random.Random(21)
    vocabulary, rows = [f"w{i}" for i in range(5000)], []
    for i in range(120):
        ws = prose(rng, 150 + i, vocabulary).split()
        rows.append((2 * i, " ".join(ws)))
        for at in rng.sample(range(len(ws)), rng.randint(2, 1 + len(ws) // 28)):
            ws[at] = f"new{at}"
        rows.append((2 * i + 1, " ".join(ws)))
    want, shares = classes_by_brute_force(rows)
    assert sum(0.75 <= s < 0.8 for s in shares) > 5 < sum(0.8 <= s < 0.85 for s in shares)
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_classes_of_a_crowd(spark):
    """One template, 200 variants around the threshold: the classes are those of all pairs."""
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(5000)]
    base, rows = prose(rng, 160, vocabulary).split(), []
    for i in range(200):
        ws = list(base)
        for at in rng.sample(range(len(ws)), rng.randint(2, 9)):
            ws[at] = f"v{rng.randint(0, 3)}x{at}"
        rows.append((i, " ".join(ws)))
    want, shares = classes_by_brute_force(rows)
    assert 1 < len(set(want.values())) < 180 and sum(s >= 0.8 for s in shares) < len(shares) / 2
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_links_do_not_depend_on_the_input_size(spark):
    """A pair at 0.8 is linked however many texts there are and whatever shingles are taken for common."""
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(5000)]
    ws = prose(rng, 204, vocabulary).split()
    pair = [" ".join(ws), " ".join([*ws[:182], *(f"z{i}" for i in range(22))])]
    rows = list(enumerate(pair))
    want, shares = classes_by_brute_force(rows)
    assert 0.8 <= shares[0] < 0.82 and want[1] == 0
    for extra in (0, 3000):
        d = spark.createDataFrame(rows + [(10 + i, prose(rng, 40, vocabulary)) for i in range(extra)], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.near_classes(d).collect()}
        assert got[0] == got[1] == 0 and len(set(got.values())) == 1 + extra


def test_bands_meet_at_the_similarity():
    """Pairs of sets at 0.8 share a band as often as the formula says, with few bands as with all."""
    rng, bands = np.random.default_rng(24), simhash.bands_for(0.8, 5, 1e-6)
    assert bands == 35
    alone = {1: 0, 3: 0, bands: 0}
    for _ in range(2000):
        h = rng.integers(-(2**63), 2**63, 108, np.int64)  # 96 of 120 in both
        x, y = (simhash.band_hashes(np.sort(s), bands, 5) for s in (h, np.append(h[:96], rng.integers(-(2**63), 2**63, 12, np.int64))))
        for n in alone:
            alone[n] += not (x[:n] == y[:n]).any()
    assert abs(alone[1] / 2000 - 0.672) < 0.04 and abs(alone[3] / 2000 - 0.304) < 0.04 and alone[bands] == 0


def test_roots_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[1000 + k] for k in range(40)}) == 1 and len(set(got.values())) == 3


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(len(ws) - 2, min(len(ws), 1)))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stage_of_near_copies_links_by_fingerprints_and_by_shingles(spark):
    """One row of each class of either link, whatever the ids, as brute force has it."""
    import corpus_pipeline

    rng = random.Random(32)
    vocabulary = [f"w{i}" for i in range(4000)]
    fresh = lambda n: prose(rng, n, vocabulary)
    phrase = [fresh(3) + " " for _ in range(4)]
    texts = [phrase[i % 4] * 100 + fresh(12 + i) for i in range(12)]  # one fingerprint for each phrase, shingles mostly of their own
    chain = [phrase[0] * 100 + fresh(200)]
    chain.append(chain[0] + " changed")  # similar to the one before; linked to the first phrase's others by fingerprints
    edited = 0
    while edited < 6:  # one or two bits apart and less than 0.8 similar
        base = fresh(24)
        other = base.rsplit(" ", 3)[0] + " " + fresh(3)
        if 1 <= (plain_fingerprint(base) ^ plain_fingerprint(other)).bit_count() <= 2:
            texts, edited = [*texts, base, other], edited + 1
    for _ in range(8):  # near copies whose fingerprints are far apart
        ws = fresh(150).split()
        texts += [" ".join(ws), " ".join([*ws[:140], *fresh(8).split()])]
    texts += [*chain, *(fresh(40) for _ in range(12)), "", None, " "]
    rng.shuffle(texts)
    rows = [(rng.choice([None, 3, 5, i + 10, i + 10, i + 10]), t) for i, t in enumerate(texts)]
    rows += [(None, rows[0][1]), rows[1], rows[1]]
    apart, named = {t: plain_fingerprint(t) for _, t in rows}, list({t: None for _, t in rows})
    sets = shingle_sets([(i, t or "") for i, t in enumerate(named)])
    root = list(range(len(named)))
    by = {"fingerprints": 0, "shingles": 0}
    for i, j in itertools.combinations(range(len(named)), 2):
        bits, shared = (apart[named[i]] ^ apart[named[j]]).bit_count() <= 2, len(sets[i] & sets[j])
        similar = shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)
        by["fingerprints"] += bits and not similar
        by["shingles"] += similar and not bits
        if bits or similar:
            root = [root[i] if r == root[j] else r for r in root]
    assert by["fingerprints"] > 10 and by["shingles"] >= 4
    want = {}
    for k, t in rows:
        own = (k is None, k or 0, hashlib.sha256(t.encode()).hexdigest() if t is not None else "", k, t)
        of = root[named.index(t)]
        want[of] = min(want.get(of, own), own, key=lambda x: x[:3])
    kept = corpus_pipeline.one_of_each_class(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((w[3:] for w in want.values()), key=str)


# ------------------------------------------------------------------------------------------------ 10


def test_bpe_matches_the_rank_library(spark, docs, none):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] for r in AWKWARD] + ["<unk> <s> ▁a  b\t\n\n x", "\U0001f600" * 100, " " * 200, "it's I'LL", "日本語　全角", "\x1c a \x1f\x85 b\u2028"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.with_digests(bpe.round_trip(d, path, public.PATTERN)).collect():
        ids = want.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    alone = bpe.decode(bpe.encode(docs, path, public.PATTERN), path).collect()
    assert sorted(bytes(r.decoded) for r in alone) == sorted((r[1] or "").encode() for r in AWKWARD)
    assert bpe.round_trip(none, path, public.PATTERN).count() == 0


# ------------------------------------------------------------------------------------------------ the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(i, (prose(rng, 80, vocabulary) + "." if i % 5 else "!! ".join(prose(rng, 80, vocabulary).upper().split())), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200 + i, rows[1 + 5 * i][1], "en", "s0", 1) for i in range(10)] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    d = spark.createDataFrame(rows, DOCS)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        d = common.written(stage(spark, d, str(tmp_path)), name)
        kept[name] = d
        if name != "bpe":
            assert d.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = {n: {r.doc_id for r in k.select("doc_id").collect()} for n, k in kept.items()}
    assert not {i for i in range(0, 120, 5)} & ids["quality"] and {i for i in range(120) if i % 5} <= ids["quality"]
    assert not {200 + i for i in range(10)} & ids["simhash"] and {1 + 5 * i for i in range(10)} <= ids["simhash"]
    assert ids["suffix"] == ids["simhash"] and ids["mix"] <= ids["suffix"] and ids["bpe"] == ids["mix"]
    assert kept["bpe"].count() == kept["mix"].count()
