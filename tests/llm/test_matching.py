"""Jaccard join, components, decontamination, classifier and language models."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tidegraph.llm import components, decontaminate, jaccard, lm_score, rule_ensemble
from tidegraph.llm.common import materialise


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_jaccard_against_brute_force(spark, width, percent, seed):
    r = random.Random(seed)
    texts = [None, "", "One", "one", "one two", "One  TWO", "ONE two three", "é É"]
    for _ in range(30):
        base = [f"w{r.randint(0, 40)}" for _ in range(r.choice([3, 9, 12, 20, 60, 200]))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 14))):
                copy[r.randrange(len(copy))] = f"n{r.randint(0, 9999)}"
            texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[i : i + 120]) for i in range(0, 60, 3)]  # links only between neighbours
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_shingles int").repartition(5)
    got = sorted(tuple(x) for x in jaccard.jaccard_components(df, width=width, percent=percent).collect())
    assert got == brute_components(texts, width, percent)


def test_signatures_never_miss():
    """Sets that link share a signature, small sizes included; sketches never exceed the distance."""
    r = np.random.default_rng(0)
    for percent in (80, 90):
        scheme = jaccard.Scheme(percent)
        for _ in range(1500):
            n = int(r.integers(1, 120))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            drop = int(r.integers(0, 1 + len(a) // 6))
            extra = r.integers(0, 2**63, int(r.integers(0, 1 + len(a) // 6))).astype(np.uint64)
            b = np.unique(np.concatenate([a[drop:], extra]))
            if not len(b):
                continue
            if scheme.links(a, b) and (len(a) != len(b) or (a != b).any()):
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))
            cells = jaccard.sketch_cells(scheme.distance(len(a) + len(b)))
            differ = int(np.bitwise_count(jaccard.sketch(a, cells) ^ jaccard.sketch(b, cells)).sum())
            assert differ <= len(np.setxor1d(a, b))
            folded = np.bitwise_xor.reduce(jaccard.sketch(a, 2 * cells).reshape(2, -1), axis=0)
            assert (folded == jaccard.sketch(a, cells)).all()


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "A b C d"), (8, None)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id bigint, text string, component_id string")
    got = {(x.doc_id, x.component_id) for x in jaccard.jaccard_components(df).collect()}
    assert {(7, 7), (9, 7), (8, 8)} <= got
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [7, 8]  # one row of a group, and rows without words
    clash = spark.createDataFrame([(1, "one text here"), (1, "another text there"), (2, "another text there"), (None, "one text here"), (3, None)], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.text) for x in jaccard.keep_one(clash).collect() if x.text) == [(1, "another text there"), (1, "one text here")]
    assert jaccard.keep_one(clash.limit(0)).count() == 0


def test_jaccard_with_crowded_signatures(spark, monkeypatch):
    """Near documents of one signature, most of them unlinked, cut into many blocks and keys, with one proposal at a time."""
    for name, value in (("BLOCK_DOCS", 40), ("HOT_ROWS", 20), ("NEAREST", 1), ("NEAREST_GROWTH", 3)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(600):
        copy = base[:60] + [w if r.random() < 0.5 else f"x{r.randint(0, 1)}{w}" for w in base[60:]]
        texts.append(" ".join(copy))
        if i % 7 == 0:
            copy[r.randrange(120)] = "other"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    wanted = brute_components(texts, 1, 80)
    assert 80 < len({c for _, _, c in wanted}) < len(texts)
    assert sorted(tuple(x) for x in jaccard.jaccard_components(df, width=1, percent=80).collect()) == wanted


def test_jaccard_hands_on_no_pairs_of_a_crowd(spark, monkeypatch):
    """A crowd just beyond the threshold, which sketches cannot tell apart: no table grows beyond the rows of its buckets."""
    written = []

    def counted(df, name, *more):
        made = materialise(df, name, *more)
        written.append((name, made.count()))
        return made

    monkeypatch.setattr(jaccard, "materialise", counted)
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(250):
        out = set(r.sample(range(200), 13))
        texts.append(" ".join(f"n{i}.{k}" if k in out else w for k, w in enumerate(base)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = sorted(tuple(x) for x in jaccard.jaccard_components(df, width=1, percent=80).collect())
    wanted = brute_components(texts, 1, 80)
    assert got == wanted and len({c for _, _, c in wanted}) > 50
    names = [name for name, _ in written]
    members = dict(written)["members"]
    assert names.count("links") > 2 and members > 1000  # the last step was reached
    assert max(rows for _, rows in written[names.index("members") :]) <= members


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(30)] + [(500, i) for i in range(600, 680)] + [(3, 3)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert found == {n: root(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != c))
    return min(row)


def test_decontamination_against_brute_force():
    r = random.Random(9)
    items = ["".join(r.choice("abcde ") for _ in range(r.randint(30, 90))).strip() for _ in range(8)]
    items = [decontaminate.normalize(i) for i in items]
    matcher = decontaminate.Matcher(list(enumerate(items)), 0.1)
    for _ in range(150):
        item = list(r.choice(items))
        for _ in range(r.randint(0, len(item) // 6)):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice([[], ["x"], [item[at], "y"]])
        text = "".join(r.choice("abcde ") for _ in range(r.randint(0, 80))) + "".join(item) + "".join(r.choice("abcde ") for _ in range(r.randint(0, 80)))
        plain = decontaminate.normalize(text)
        found = {n: d for n, d, _, _ in matcher.search(text)}
        for n, pattern in enumerate(matcher.patterns):
            least = edit_distance(pattern.text, plain)
            assert (n in found) == (least <= pattern.budget)
            assert n not in found or found[n] >= least


def test_decontamination_rows(spark):
    item = "The quick brown fox jumps over the lazy dog near the old stone bridge"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "tiny"), (4, "")], "item_id bigint, text string")
    texts = [f"xx {item.upper()} yy", item.replace("lazy", "lazi"), item[:40], None, "", "clean words " * 3000, f"{item} {item}"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id bigint, text string, item_id int")
    got = decontaminate.find_leaks(df, bench).collect()
    assert sorted((x.doc_id, x.item_id, x.distance) for x in got) == [(0, 1, 0)] * 4 + [(1, 1, 1)] * 2 + [(6, 1, 0)] * 2  # "tiny" is in none
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    big = [(i, f"{item} number {i}") for i in range(6)]
    many = spark.createDataFrame(big, "item_id bigint, text string")
    before, decontaminate.BLOCK_CHARS = decontaminate.BLOCK_CHARS, 300
    try:
        found = decontaminate.find_leaks(spark.createDataFrame(big, "doc_id bigint, text string"), many, 0.0).collect()
    finally:
        decontaminate.BLOCK_CHARS = before
    assert sorted((x.doc_id, x.item_id) for x in found) == [(i, i) for i in range(6)]


def test_rule_ensemble_learns_a_conjunction():
    r = np.random.default_rng(3)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.4)).astype(float)
    model = rule_ensemble.fit(x, y, list("abcd"))
    assert 0 < len(model.rules) < 120
    assert {c.feature for rule, w in model.rules for c in rule if abs(w) > 1} <= {"a", "b"}
    flat = rule_ensemble.fit(np.zeros((0, 1)), np.zeros(0), ["a"])
    assert flat.bias == 0.0 and not flat.rules


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, "", "", 0), (-2, "", "", "", 0)], documents.schema)
    scored, model = rule_ensemble.classify(documents.union(odd), labels)
    rows = scored.collect()
    assert len(rows) == documents.count() + 2 and all(0 <= x.score <= 1 for x in rows) and model.rules
    truth = {x.doc_id: x.quality for x in labels.collect()}
    held = [x for x in rows if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)


def brute_scores(rows, targets):
    """(id, tokens, target loss, background loss) of each row by plain counting, each row left out of what scores it."""
    import math
    from collections import Counter

    docs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", t or ""), None]) if re.search(r"[^\x20\x09-\x0D]", t or "") else (i, []) for i, t in rows]
    vocabulary = len({w for _, ws in docs for w in ws})

    def count(chosen):
        one, pair = Counter(), Counter()
        for ws in chosen:
            one.update(ws)
            pair.update(zip([None, *ws], ws, strict=False))
        return one, pair

    is_good = [i in targets for i, _ in docs]
    every, good = count(ws for _, ws in docs), count(ws for (_, ws), g in zip(docs, is_good, strict=True) if g)
    scale = sum(good[0].values()) / max(1, sum(every[0].values()))
    out = []
    for (i, ws), g in zip(docs, is_good, strict=True):
        own, means = count([ws]), []
        for (one, pair), mine, weight in ((good, g, 1.0), (every, True, scale)):
            one, pair = (a - b if mine else a for a, b in zip((one, pair), own, strict=True))
            total, loss = sum(one.values()), 0.0
            for before, w in zip([None, *ws], ws, strict=False):
                alone = (weight * one[w] + 8.0 / vocabulary) / (weight * total + 8.0)
                loss -= math.log((weight * pair[before, w] + 8.0 * alone) / (weight * one[before] + 8.0))
            means.append(loss / len(ws) if ws else 0.0)
        out.append((i, len(ws), *means))
    return out


def same_scores(got, rows, targets):
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    found = sorted(((x.doc_id, x.n_tokens, x.target_loss, x.background_loss) for x in got), key=key)
    wanted = sorted(brute_scores(rows, targets), key=key)
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert np.allclose([x[2:] for x in found], [x[2:] for x in wanted], rtol=1e-9, atol=1e-12)
    assert all(abs(x.score - (x.target_loss - x.background_loss)) < 1e-12 for x in got)


@pytest.mark.parametrize(("batch", "part"), [(1 << 23, 1 << 24), (3000, 500)])
def test_language_models_against_brute_force(spark, monkeypatch, batch, part):
    monkeypatch.setattr(lm_score, "BATCH_BYTES", batch)
    monkeypatch.setattr(lm_score, "PART_BYTES", part)
    r = random.Random(5)
    words = ["".join(r.choice("ab\u00e9") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join(r.choice(words[:120] if i % 2 else words[80:]) for _ in range(r.randint(1, 60)))) for i in range(150)]
    rows += [(None, "a  b\n\n"), (7, ""), (8, None), (9, " \t"), (3, rows[3][1]), (3, rows[3][1]), (200, "\x0bx " * 3000), (201, rows[11][1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, score string").repartition(5)
    good = set(range(1, 100, 2))
    target = spark.createDataFrame([(i,) for i in [*good, 1, 1, 999]], "doc_id bigint")
    got = lm_score.score(df, target).collect()
    same_scores(got, rows, good)
    unlabelled = [x for x in got if x.doc_id is not None and 100 <= x.doc_id < 150]
    assert max(x.score for x in unlabelled if x.doc_id % 2) < min(x.score for x in unlabelled if x.doc_id % 2 == 0)
    # a text that occurs twice is better known to the background than one that occurs once
    twice = next(x for x in got if x.doc_id == 201)
    assert twice.background_loss < min(x.background_loss for x in unlabelled)
    same_scores(lm_score.score(df, target.limit(0)).collect(), rows, set())
    named = df.where("doc_id IS NOT NULL")
    assert {x.score for x in lm_score.score(named, named.select("doc_id")).collect()} == {0.0}
    assert lm_score.score(df.limit(0), target).count() == 0


def test_pipeline(spark):
    """Every stage against a plain version of its decision, each on its own input."""
    import re

    import corpus_pipeline

    from .test_filters import brute_pii

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [decontaminate.normalize(x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, tables = docs.columns, [{x.doc_id: x for x in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "stage")
        if name != "packing":
            assert docs.columns == columns
            tables.append({x.doc_id: x for x in docs.collect()})
    raw, good, single, clean, private = tables
    for i in raw.keys() - good.keys():
        words = raw[i].text.split()
        junk = len(re.findall(r"[#*$%&|<>!]", raw[i].text)) > 0.1 * len(words) or raw[i].text.isupper()
        stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) > 0.3 * len(words)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        assert junk or stutter or len(words) < 20 or len(set(windows)) < len(windows)
    ids = sorted(good)
    wanted = {ids[n] for n, _, c in brute_components([good[i].text for i in ids], 5, 80) if c == n}
    assert single.keys() == wanted
    leaks = {i for i, x in single.items() if any(t in decontaminate.normalize(x.text) for t in items)}
    matcher = decontaminate.Matcher(list(enumerate(items)), decontaminate.RATE)
    assert leaks <= single.keys() - clean.keys()
    for i in single.keys() - clean.keys() - leaks:
        assert any(matcher.patterns[n].distance(decontaminate.normalize(single[i].text))[0] == d for n, d, _, _ in matcher.search(single[i].text))
    assert private.keys() == clean.keys() and len(leaks) > 0
    for i, x in private.items():
        assert x.n_chars == (clean[i].n_chars if x.text == clean[i].text else len(x.text))
        assert (x.text == clean[i].text) == (not brute_pii(clean[i].text))
    assert {x.doc_id for x in docs.collect()} == private.keys()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_short_items_and_rows_without_ids(spark):
    bench = spark.createDataFrame([(1, "short benchmark item"), (2, "The quick brown fox jumps over the lazy dog today")], "item_id bigint, text string")
    leak = "so the quick brown fox jumped over the lazy dog today"
    rows = [
        (0, "Short  benchmark\nitem", 1), (1, "short benchmark items", 1), (2, "a short benchmark item, said", 1), (3, "ashort benchmark item", 1),
        (None, leak, 1), (None, "clean", 2), (5, leak, 3), (5, "clean", 3), (5, "clean", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    assert sorted(x.doc_id for x in decontaminate.find_leaks(df, bench).where("item_id = 1").collect()) == [0, 2]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, (df.where("text in ('short benchmark items', 'ashort benchmark item', 'clean')")).collect()))
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(df.limit(0), bench).count() == 0
    before, decontaminate.BLOCK_CHARS = decontaminate.BLOCK_CHARS, 30
    try:
        again = decontaminate.drop_contaminated(df, bench).collect()
    finally:
        decontaminate.BLOCK_CHARS = before
    assert sorted(map(str, again)) == sorted(map(str, kept.collect()))


def test_compiled_rules_equal_the_model(spark):
    """The column expression against the same model in numpy, and a score of exactly one half."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(400, 3)), 2)
    names = ["a", "b", "c"]
    model = rule_ensemble.fit(x, ((x[:, 0] > 0) & (x[:, 1] < 0.5) | (r.random(400) < 0.1)).astype(float), names)
    total = np.full(len(x), model.bias)
    for rule, weight in model.rules:
        total += weight * rule_ensemble._holds(rule, x, names)
    for name, low, high, weight in model.linear:
        total += weight * np.clip(x[:, names.index(name)], low, high)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i int, a double, b double, c double")
    features = {n: F.col(n) for n in names}
    got = [s for _, s in sorted(map(tuple, df.select("i", model.column(features).alias("s")).collect()))]
    assert model.rules and np.allclose(got, 1 / (1 + np.exp(-np.clip(total, -30, 30))), rtol=1e-12)
    half = df.select(rule_ensemble.Model(0.0).column(features).alias("s")).first().s
    assert half == 0.5
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = spark.createDataFrame([(1, "one two", 1.0), (1, "one two", 1.0), (None, None, 0.0)], "doc_id bigint, text string, score double")
    scored, _ = rule_ensemble.classify(rows, labels)  # nothing to learn from: every score is one half, which counts as good
    assert [(x.score, x.predicted) for x in scored.collect()] == [(0.5, 1)] * 3
    assert rule_ensemble.classify(rows.limit(0), labels)[0].count() == 0
