import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import hamming, pieces, suffix_tree

from .fixtures import documents, frame, lower

END = "\x00end"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(t)) + [END]


class Brute:
    """The suffix tree with dictionaries."""

    def __init__(self, texts, m=4, d=4.0, mu=4.0, disc=0.6):
        self.m, self.d, self.mu, self.disc = m, d, mu, disc
        self.c1, self.c2, self.c3 = Counter(), Counter(), Counter()
        for t in texts:
            w = [END, *tokens(t)]
            self.c1.update(w[1:])
            self.c2.update(zip(w, w[1:]))
            self.c3.update(zip(w, w[1:], w[2:]))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        g1, g2 = defaultdict(float), defaultdict(float)
        for (a, x), c in self.c2.items():
            g1[a] += c * self.gain(c, self.c1[a], self.root(x))
        self.kept1 = {a for a, g in g1.items() if g >= d and self.c1[a] >= m}
        for (a, b, x), c in self.c3.items():
            if self.c2[a, b] >= m:
                g2[a, b] += c * self.gain(c, self.c2[a, b], self.one(b, x))
        self.kept2 = {k for k, g in g2.items() if g >= d}

    def gain(self, c, n, p):
        return math.log((c - 1 + self.mu * p) / (n - 1 + self.mu)) - math.log(p)

    def root(self, x):
        c = self.c1[x]
        return (c - self.disc) / self.n if c else self.disc * self.v / self.n

    def one(self, a, x):
        return (self.c2[a, x] + self.mu * self.root(x)) / (self.c1[a] + self.mu) if a in self.kept1 else self.root(x)

    def score(self, t):
        w = [END, *tokens(t)]
        s = 0.0
        for k in range(1, len(w)):
            p = self.one(w[k - 1], w[k])
            if k > 1 and (w[k - 2], w[k - 1]) in self.kept2:
                p = (self.c3[w[k - 2], w[k - 1], w[k]] + self.mu * p) / (self.c2[w[k - 2], w[k - 1]] + self.mu)
            s += math.log10(p)
        return s


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_suffix_tree_matches_brute_force(spark, monkeypatch):
    rows = documents(n=150)
    model = Brute([r[1] for r in rows if not is_held(r[0])])
    assert model.kept1 and model.kept2
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 500)
    got = suffix_tree.score_texts(frame(spark, rows), held_out=suffix_tree.held_out(), min_context=4, depth=2).collect()
    want = []
    for i, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((model.c1[x] + 1) / (model.n + model.v + 1)) for x in w)
        want.append((str(i), is_held(i), len(w), sum(model.c1[x] > 0 for x in w), model.n, round(base, 6), round(model.score(t), 4)))
    have = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in got]
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-2
    assert suffix_tree.score_texts(frame(spark, [])).count() == 0


def test_suffix_tree_totals_beyond_32_bits(spark, monkeypatch):
    rows = documents(n=150)
    scores = lambda: sorted((str(r.doc_id), r.depth1, r.depth2, round(r.score, 6)) for r in suffix_tree.score_texts(frame(spark, rows)).collect())
    monkeypatch.setattr(suffix_tree, "GAIN", 1 << 20)  # no rounding across the threshold
    want = scores()
    assert any(r[1] for r in want) and any(r[2] for r in want)
    monkeypatch.setattr(suffix_tree, "GAIN", 1 << 28)  # 8 nats are 2 ** 31
    assert scores() == want


def deep_brute(rows, depth=None, d=4.0, mu=4.0):
    """Scores and numbers of words by length of context, for contexts of up to ``depth`` words (any length) and any count."""
    root = Brute([t for i, t in rows if not is_held(i)])
    texts = [[END, *tokens(t)] for _, t in rows]
    train = [not is_held(i) for i, _ in rows]
    p = {(x, k): root.root(w[k]) for x, w in enumerate(texts) for k in range(1, len(w))}
    used = dict.fromkeys(p, 0)

    def grow(places, size):
        split = defaultdict(list)
        for x, k in places:
            if k - size >= 0:
                split[texts[x][k - size]].append((x, k))
        for own in split.values():
            c = Counter(texts[x][k] for x, k in own if train[x])
            n = sum(c.values())
            if n < 2:  # the gain is 0
                continue
            if sum(math.log((c[texts[x][k]] - 1 + mu * p[x, k]) / (n - 1 + mu)) - math.log(p[x, k]) for x, k in own if train[x]) >= d:
                for x, k in own:
                    p[x, k], used[x, k] = (c[texts[x][k]] + mu * p[x, k]) / (n + mu), size
            if size != depth:
                grow(own, size + 1)

    grow(list(p), 1)
    return [(str(rows[x][0]), sum(math.log10(p[x, k]) for k in range(1, len(w))), [sum(f(used[x, k]) for k in range(1, len(w))) for f in (lambda u: u == 1, lambda u: u == 2, lambda u: u > 2)]) for x, w in enumerate(texts)]


def test_deep_suffix_tree_matches_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in documents(n=100) if len(t or "") < 500]
    rows += [(1000 + k, f"{w} {'left' if k % 2 else 'right'} a b c d e f g h {'one' if k % 2 else 'two'} {w}") for k in range(40) for w in [f"w{k % 7}"]]
    df = frame(spark, [(i, t, None, None, 0, 1, 0.5, True) for i, t in rows])
    monkeypatch.setattr(suffix_tree, "GAIN", 1 << 20)  # no rounding across the threshold
    deepest = []
    for depth in (1, 2, 3, 4, 9, None):
        want = sorted(deep_brute(rows, depth))
        got = sorted((str(r.doc_id), r.score, [r.depth1, r.depth2, r.deeper]) for r in suffix_tree.score_texts(df, held_out=suffix_tree.held_out(), depth=depth).collect())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-2 and a[2] == b[2]
        deepest.append(sum(x[1] for x in want))
    assert sum(x[2][2] for x in want) > 20 and len({round(x, 3) for x in deepest}) > 3


def test_suffix_tree_distributions_sum_to_one():
    model = Brute([r[1] for r in documents(n=150)])
    seen = [*model.c1, "never seen"]
    for a in list(model.kept1)[:5]:
        assert abs(sum(model.one(a, x) for x in seen) - 1) < 1e-9


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[500:600] = x[500]  # a hot vector
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(5000, None, 1.0), (5100, [0.0] * 24, 1.0), (5200, [float("nan")] * 24, 1.0), (5300, [1.0] * 3, 1.0), (5400, [float("inf")] + [0.0] * 23, 1.0), (5500, [None] + [1.0] * 23, 1.0), (None, [1.0] * 24, 1.0), (5600, [], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(3)
    got = defaultdict(list)
    for r in hamming.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(f[2] == d[f[1]] for f in found) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        d[q] = np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits >= 0.9 * 300
    few = hamming.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]
    assert hamming.nearest(df.where("false")).count() == 0


def test_nearest_counts_candidates_not_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(2)]
    rows += [(7, (x[0] + 1e-3 * (j + 1)).tolist()) for j in range(30)]  # one candidate in many rows near a query
    got = hamming.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in (0, 100, 200):
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and len({r[1] for r in own}) == 10
    near = {r.vec_id: r.score for r in got if r.query_id == 0}
    assert abs(near[7] - 4e-3) < 1e-9


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 2**32, 400, dtype=np.uint64)
    index = hamming.Index(code, 32)
    for q in code[:20]:
        for radius in (0, 3, 9, 12):
            want = np.flatnonzero(np.bitwise_count(code ^ q) <= radius)
            assert index.within(int(q), radius).tolist() == want.tolist()


def segmentations(v, text):
    out = []

    def go(i, ids, lp):
        if i == len(text):
            out.append((tuple(ids), lp))
            return
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            k = v.ids.get(text[i:j])
            if k is not None:
                go(j, ids + [k], lp + v.logp[k])
        if text[i] not in v.ids:
            spelt = [v.byte_ids[b] for b in text[i].encode()]
            go(i + 1, ids + spelt, lp + sum(v.logp[b] for b in spelt))

    go(0, [], 0.0)
    return out


def test_samples_follow_the_lattice():
    v, trie = pieces._worker(pieces.default_model())
    text = "the in\nabé 日x"
    all_ = segmentations(v, pieces.SPACE + text.replace(" ", pieces.SPACE))
    z = math.log(sum(math.exp(lp) for _, lp in all_))
    p = {s: math.exp(lp - z) for s, lp in all_}
    n = 3000
    lat, kinds, found, kappa, total = pieces.sample_batch(v, trie, [text] * n, [(i * 7919 + 13) * 0x9E3779B97F4A7C15 for i in range(n)], 4)
    assert abs(total[0] - z) < 1e-9
    first, mass = Counter(), 0.0
    for d in range(n):
        ids = [tuple(pieces.ids_of(lat, pieces.path_arcs(lat, kinds[d], x)).tolist()) for x in found[d]]
        assert len(set(ids)) == 4
        score = [x.score for x in found[d]]
        assert score == sorted(score, reverse=True) and score[-1] >= kappa[d]
        for s, x in zip(ids, found[d]):
            assert abs(x.logp - math.log(p[s])) < 1e-9 and pieces.decode_ids(s, v.raw) == text
        first[ids[0]] += 1
        mass += sum(p[s] / -math.expm1(-math.exp(math.log(p[s]) - kappa[d])) for s in ids)
    for s, c in first.items():
        assert abs(c / n - p[s]) < 4 * (p[s] * (1 - p[s]) / n) ** 0.5 + 2e-3
    assert abs(mass / n - 1) < 0.02


def test_few_segmentations_are_all_found():
    v, trie = pieces._worker(pieces.default_model())
    all_ = {s for s, _ in segmentations(v, pieces.SPACE + "is")}
    lat, kinds, found, kappa, _ = pieces.sample_batch(v, trie, ["is"], [5], 50)
    got = {tuple(pieces.ids_of(lat, pieces.path_arcs(lat, kinds[0], x)).tolist()) for x in found[0]}
    assert got == all_ and kappa[0] == -math.inf


def test_segmentations_decode_and_do_not_depend_on_partitions(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.default_model())
    df = frame(spark)
    out = pieces.sample_segmentations(df, keep=["doc_id", "text", "score"], k=3)
    back = pieces.decode(out, to="again").collect()
    assert all(r.again == (r.text or "") for r in back)
    assert all(sp.decode(r.ids) == (r.text or "") for r in back if r["rank"] == 1 and r.text and r.text.strip())
    assert all(r.n_pieces == len(r.ids) for r in back) and all(r.decodes for r in back if r["rank"] == 1)
    assert {r["rank"] for r in back if not r.text} == {1}
    one = sorted(map(str, [(r.doc_id, r["rank"], r.digest, r.perturbed) for r in pieces.sample_segmentations(df.repartition(1)).collect()]))
    many = sorted(map(str, [(r.doc_id, r["rank"], r.digest, r.perturbed) for r in pieces.sample_segmentations(df.repartition(9)).collect()]))
    assert one == many
    assert pieces.sample_segmentations(df.where("false")).count() == 0


def test_every_rank_is_built_decoded_and_digested_from_its_ids(spark):
    key = lambda r: (str(r.doc_id), r["rank"], r.n_pieces, r.digest, r.perturbed)
    whole = pieces.sample_segmentations(frame(spark), k=3).collect()
    bare = pieces.sample_segmentations(frame(spark), k=3, with_ids=False).collect()
    assert sorted(map(key, bare)) == sorted(map(key, whole))
    assert {r["rank"] for r in bare if r.decodes} == {1, 2, 3} and all(r.decodes for r in bare + whole)
    v, _ = pieces._worker(pieces.default_model())
    codes = pieces.mix64(np.arange(1, len(v.raw) + 1))
    assert all(r.digest == pieces.digest_of(np.array(r.ids, np.int64), codes) and r.n_pieces == len(r.ids) for r in whole)
    assert not pieces.decodes([], v.raw, b"x")


def test_runs_of_a_batch_are_about_equal_and_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "BATCH_CHARS", 2000)
    texts = ["x" * 100] * 32 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["__text"])
    runs = list(pieces._runs(batch))
    assert [t for _, own in runs for t in own] == texts and all(b.num_rows == len(own) for b, own in runs)
    assert [sum(len(t or "") for t in own) for _, own in runs] == [1600, 1600]  # not 2000 and 1200: the fullest run sets the memory


def test_arrays_tell_whether_pieces_decode():
    v, trie = pieces._worker(pieces.default_model())
    words = [pieces.SPACE + w for w in ("the", "é日", "\U0001f600x", "")] + ["\n", "ab"]
    lat = pieces.Lattices(v, trie, words)
    assert lat.good.tolist() == [True] * len(words)
    got = [bytes(lat.plain[a : a + n]) for a, n in zip(lat.plain_at[lat.rank], lat.plain_len[lat.rank])]
    assert got == [w.replace(pieces.SPACE, " ").encode() for w in words]
    wrong = lat.rank[[0, 5, 2]]  # the second word's pieces are those of another
    arcs, bounds = lat.expand(lat.start[lat.rank[[0, 4, 2]]])
    assert lat.decoded(arcs, bounds, wrong).tolist() == [True, False, True]


def test_largest_of_ranges():
    rng = np.random.default_rng(3)
    g, cuts = np.round(rng.normal(size=200), 1), np.array([0, 0, 1, 40, 42, 42, 200])
    for want in (1, 2, 3, 50):
        for (a, b), got in zip(zip(cuts, cuts[1:]), pieces._largest(g, cuts, want)):
            assert len(set(got)) == min(want, b - a) and sorted(g[got]) == sorted(g[a:b])[::-1][:want][::-1]


def test_packed_numbers_come_back_and_leave_out_empty_bytes():
    rng = np.random.default_rng(5)
    pairs = rng.integers(-(2**40), 2**40, (50, 2))
    pairs[:3] = [[0, -1], [2**62, -(2**62)], [-1, 1]]
    back = suffix_tree._unplanes(suffix_tree._planes(pairs), suffix_tree.PAIR)
    assert (back.view(np.int64).reshape(-1, 2) == pairs).all()
    for kind, top in ((np.uint8, 3), (np.uint32, 2**32 - 1), (np.uint64, 2**64 - 1), (np.uint64, 300), (np.uint64, 0)):
        x = rng.integers(0, top, 70, dtype=kind, endpoint=True)
        assert (suffix_tree._unplanes(suffix_tree._planes(x), kind) == x).all()
    x = rng.normal(size=9).astype(np.float32)
    assert (suffix_tree._unplanes(suffix_tree._planes(x), np.float32) == x).all()
    assert suffix_tree._planes(x[:0]) == b"" and len(suffix_tree._unplanes(b"", suffix_tree.COUNT)) == 0
    assert suffix_tree._planes(np.arange(200, dtype=np.uint64))[0] == 1  # one byte of eight is packed


def test_a_worker_gives_back_the_memory_of_its_batches():
    import subprocess
    import sys

    # in a process of its own: what this one holds is not only the operator's
    code = """
import random, re
import pyarrow as pa
from tidemark.llm import pieces
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(0).split()[1]) / 1024
run = pieces._encode(pieces.default_model(), 3, True)
pieces._worker(pieces.default_model())
rng = random.Random(1)
def batch():
    texts = [" ".join("".join(rng.choice(["th", "an", "re", "on", "ed", "ly", "is"]) for _ in range(rng.randint(1, 6))) for _ in range(300)) for _ in range(600)]
    return pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts), pa.array(range(600))], ["doc_id", "__text", "__key"])
before = held()
assert sum(b.num_rows for b in run(batch() for _ in range(2))) == 3600
print(held() - before)
"""
    left = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert left < 80, left  # MB
