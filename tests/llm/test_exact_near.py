import re
from collections import defaultdict

from tidemark.llm import exact, minhash

from .fixtures import documents, frame, lower

BLANK = re.compile(r"[\x20\x09-\x0d]")


def test_exact_groups_match_brute_force(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[BLANK.sub("", r[1] or "")].append(r)
    got = exact.exact_groups(frame(spark)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for plain, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            want[r[0]].append((best[0], len(g)))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.keep_id, r.group_size))
    key = lambda x: (x[0] is None, x)
    assert {k: sorted(v, key=key) for k, v in have.items()} == {k: sorted(v, key=key) for k, v in want.items()}
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    df = frame(spark)
    out = exact.exact_dedup(df)
    assert out.columns == df.columns
    plain = [BLANK.sub("", r.text or "") for r in out.collect()]
    assert len(plain) == len(set(plain)) == len({BLANK.sub("", r[1] or "") for r in documents()})


def test_exact_dedup_of_repeats_and_clashes(spark):
    rows = [(None, "same text")] * 5 + [(1, "same  text"), (1, "same  text"), (2, " sametext "), (3, None), (3, ""), (4, " "), (5, "Other")]
    df = frame(spark, [(i, t, None, None, 0, 1, 0.5, True) for i, t in rows])
    left = exact.exact_dedup(df).select("doc_id", "text").collect()
    assert sorted([(r.doc_id, r.text) for r in left], key=str) == sorted([(1, "same  text"), (4, " "), (5, "Other")], key=str)
    got = exact.exact_groups(df).collect()
    assert sum(r.kept for r in got) == 3 and sorted(r.group_size for r in got) == [1, 3, 3, 3] + [8] * 8


def test_exact_empty(spark):
    assert exact.exact_groups(frame(spark, [])).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return sets, [least.get(find(i)) for i in range(len(rows))]


def test_near_groups_match_brute_force(spark):
    rows = documents()
    sets, roots = brute_components(rows)
    want = sorted([(r[0] is None, r[0] or 0, len(s), c) for r, s, c in zip(rows, sets, roots)], key=str)
    got = minhash.near_groups(frame(spark)).collect()
    have = sorted([(r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got], key=str)
    assert have == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_chain_is_one_component(spark):
    rows = [r for r in documents() if r[0] is not None and 100 <= r[0] < 112]
    sets, roots = brute_components(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(frame(spark, rows)).collect()}
    assert got == dict(zip([r[0] for r in rows], roots))


def test_near_dedup_and_empty(spark):
    df = frame(spark)
    out = minhash.near_dedup(df)
    assert out.columns == df.columns and 0 < out.count() < df.count()
    assert minhash.near_groups(frame(spark, [])).count() == 0
    # by row, not by identifier: a document that shares the identifier of the one that stays doesn't stay with it
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, b + " more"), (7, None), (8, ""), (9, b), (9, b)]
    rows += [(None, f"{x} c d e f g") for x in ("one", "one", "two")]
    left = minhash.near_dedup(frame(spark, [(i, t, None, None, 0, 1, 0.5, True) for i, t in rows])).select("doc_id", "text").collect()
    have = sorted([(r.doc_id, r.text) for r in left], key=str)
    assert have == sorted([(1, a), (2, b), (7, None), (8, ""), (None, "one c d e f g"), (None, "two c d e f g")], key=str)
