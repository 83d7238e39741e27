import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licences, toxic

from .fixtures import documents, frame, lower

TEXTS = [
    "Released under the MIT License.", "MIT license MIT license", "mit\nLICENSE", "the Apache-License, version 2.0; Licensed under the Apache License, Version 2.0.", "General Public License",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0", "commit license", "mit licenses", "All rights reserved.", "license mit", "é mit license é",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", None, "", "...", "x " * 3000 + "mit license",
]


def brute(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    found = [(i, label) for p, label in licences.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels = {x for _, x in found}
    more = set()
    for label, t, phrases in licences.TEMPLATES:
        words = t.split()
        places = licences._places(words, phrases)
        for o in range(-len(words), len(w)):
            if all(o + p >= 0 and w[o + p : o + p + len(q)] == q for p, q in places):
                more.add(label)
    starts = [i for i, _ in found]
    return (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)))


def test_licences_match_brute_force(spark):
    rows = [(k, t, "x", 7) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 7), (0, TEXTS[0], "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int").repartition(3)
    got = licences.scan(df).collect()
    want = [(i, *brute(t)) for i, t, _, _ in rows]
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got])) == sorted(map(str, want))
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.matches) for r in got)
    assert licences.scan(df.where("false")).count() == 0


def brute_segments(v):
    """Maximal scoring segments by definition: recursion on the best segment, the shortest of equally good ones."""
    out = []

    def go(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(v[i:j])
                if s > 0 and (best is None or s > best[0] or s == best[0] and j - i < best[2] - best[1]):
                    best = (s, i, j)
        if best:
            out.append((best[1], best[2], best[0]))
            go(a, best[1])
            go(best[2], b)

    go(0, len(v))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-4, -3, -2, -1, 1, 2, 3, 5]), max_size=14))
def test_segments_have_the_brute_force_maximum(v):
    got, want = toxic.segments(v), brute_segments(v)
    assert max([s for *_, s in got], default=0) == max([s for *_, s in want], default=0)
    assert sum(s for *_, s in got) == sum(s for *_, s in want)
    assert all(abs(sum(v[a:b]) - s) < 1e-9 for a, b, s in got)


def test_toxicity_learns_markers_and_handles_odd_rows(spark):
    rng = np.random.default_rng(3)
    vocab = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(vocab, 40))
        bad = i % 6 == 0
        if bad:
            w.insert(int(rng.integers(40)), "vilewor" + rng.choice(["t", "x", "zz", "ab"]) if i % 12 else "nasty")
        rows.append((i, " ".join(w), 1.0))
        labels.append((i, int(bad)))
    rows += [(5000, None, 1.0), (5001, "", 1.0), (None, "nasty", 1.0), (0, rows[0][1], 1.0), (5002, "clean " * 20000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxic.classify(df, lab).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    test = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in test)
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 and not r.passages for r in got if r.doc_id in (5000, 5001, 5002))
    none = toxic.classify(df, lab.where("false")).collect()
    assert len({r.score for r in none}) == 1 and math.isfinite(none[0].score)
    assert toxic.classify(df.where("false"), lab).count() == 0


def test_toxicity_of_fixture_runs(spark):
    df = frame(spark)
    lab = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(documents()) if r[0] is not None], "doc_id long, toxic int")
    assert toxic.classify(df, lab).count() == df.count()


def test_toxicity_sums_significant_passages(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1200):
        w = [f"w{x}" for x in rng.integers(0, 300, 300)]
        bad = i % 3 == 0
        for k in range(3 if bad else int(i % 5 == 1)):  # one passage in some clean texts, three in toxic ones
            w[20 + 100 * k] = f"{'abcdefghijklmnopqrstuvwxyzABCD'[rng.integers(30)] * 3}zz"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxic.classify(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    one = [r.predicted for r in got if r.doc_id % 3 and r.doc_id % 5 == 1]
    three = [r.predicted for r in got if r.doc_id % 3 == 0]
    assert np.mean(one) < 0.1 and np.mean(three) > 0.9


def brute_toxic(rows, labels):
    """Scores of the whole fit with dictionaries and plain loops."""
    cost, prior, caution, least, floor = toxic.COST, toxic.PRIOR, toxic.CAUTION, toxic.MIN_DOCS, toxic.FLOOR
    split = lambda t: [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if w]
    features = lambda w: [(0, w)] + [(n, w[:n]) for n in toxic.PREFIXES]
    best = {}
    for i, y in labels:
        best[i] = max(y, best.get(i, 0))
    train = {}
    for i, t in rows:
        if i in best and zlib.crc32(str(i).encode()) % 5 and t is not None:
            train[t] = max(best[i], train.get(t, 0))
    docs, n = [0, 0], [Counter(), Counter()]
    for t, y in train.items():
        docs[y] += 1
        n[y].update({f for w in split(t) for f in features(w)})
    weight = {}
    for f, n1 in n[1].items():
        n0, all_ = n[0][f], sum(docs)
        a0, a1 = (prior * (n0 + n1) / all_ * docs[y] / all_ + 0.1 for y in (0, 1))
        odds = math.log((n1 + a1) / (docs[1] - n1 + a1 + 1)) - math.log((n0 + a0) / (docs[0] - n0 + a0 + 1)) - caution * math.sqrt(1 / (n1 + a1 + 0.4) + 1 / (n0 + a0 + 0.4))
        if n1 >= least and odds > floor:
            weight[f] = float(np.float32(odds))
    values = {t: [max([weight[f] for f in features(w) if f in weight], default=-float(np.float32(cost))) for w in split(t)] for t in {x[1] for x in rows}}
    found = {t: [s for *_, s in brute_segments(v)] for t, v in values.items()}
    tops = [max(found[t], default=0.0) for t, y in train.items() if not y]
    sizes = [max(1, len(values[t])) for t, y in train.items() if not y]
    lam = math.pi / math.sqrt(6) / max(0.25, float(np.std(tops)))
    mu = sum(b - math.log(m) / lam for b, m in zip(tops, sizes)) / len(tops) - 0.5772156649 / lam

    def evidence(t):
        free = mu + math.log(max(1, len(values[t]))) / lam
        kept = [s for s in found[t] if s > free]
        return min(40.0, max(-20.0, sum(s - free for s in kept) * lam if kept else (max(found[t], default=0.0) - free) * lam))

    x, y = np.array([evidence(t) for t in train]), np.array([float(v) for v in train.values()])
    a, b = math.log((docs[1] + 0.5) / (docs[0] + 0.5)), 0.1
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g, q = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b]), p * (1 - p)
        step = np.linalg.solve([[q.sum() + 1e-3, (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 1e-3]], g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return [(i, 1 / (1 + math.exp(-max(-30.0, min(30.0, a + max(b, 1e-6) * evidence(t)))))) for i, t in rows]


def test_toxicity_matches_brute_force(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 2
        words = ["".join(rng.choice(["ta", "re", "mo", "li"]) for _ in range(3)) for _ in range(rng.randint(1, 25))]
        for _ in range(rng.randint(1, 4) if bad else int(rng.random() < 0.1)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Vileword", "vilewordly", "schädlich", "vile-word"]))
        rows.append((i, " ".join(words) if i % 50 else (None if i % 100 else "")))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(1000, rows[1][1]), (1000, rows[1][1])]
    want = brute_toxic(rows, labels)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = toxic.classify(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    have = sorted((r.doc_id, r.score) for r in got)
    assert len(have) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(have, sorted(want)))
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(s >= 0.5 for _, s in want) > 40


def test_one_clean_text_of_repeated_marked_words_hides_no_toxic_text(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 200, int(rng.integers(10, 200)))]
        if i % 4 == 0:
            for k in rng.integers(0, len(w), 2):
                w[k] = f"vile{k}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    at = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5)
    rows.append((at, "vile0 " * 3000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = toxic.classify(df, spark.createDataFrame([*labels, (at, 0)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    assert np.mean([r.predicted for r in got if r.doc_id < 600 and r.doc_id % 4 == 0]) > 0.95
    assert np.mean([r.predicted for r in got if r.doc_id < 600 and r.doc_id % 4]) < 0.05


def test_extreme_law_leaves_out_only_what_it_cannot_expect():
    rng = np.random.default_rng(2)
    best, n = rng.gumbel(0, 2, 5000) + 10, np.ones(5000)
    mu, lam = toxic.extreme_law(best, n)
    assert lam == math.pi / math.sqrt(6) / best.std() and abs(mu - (best.mean() - 0.5772156649 / lam)) < 1e-12
    far = toxic.extreme_law(np.append(best, [1e5, 1e4, 500.0]), np.ones(5003))
    assert far == (mu, lam)
    assert all(map(math.isfinite, toxic.extreme_law([3.0], [0])))
