from collections import Counter
from fractions import Fraction

from tidemark.llm import chat, mixing, urls

from .fixtures import documents, frame


def test_period_is_pfair():
    parts = mixing.quantise({"a": 0.5, "b": 0.3, "c": 0.123, None: 0.077})
    slots, size = mixing.period(parts), sum(parts.values())
    assert Counter(slots) == parts
    seen = Counter()
    for t, s in enumerate(slots):
        j = seen[s]
        assert j * size // parts[s] <= t < -(-(j + 1) * size // parts[s])
        seen[s] += 1
        for x in parts:
            assert abs(seen[x] - (t + 1) * parts[x] / size) < 1


def simulate(blocks, weights, resolution=None):
    """Slot by slot: earliest deadline first among released blocks, by the exact weights (or rounded ones); a new phase when a source is out."""
    left, done, out, start = dict(blocks), Counter(), [], 0
    while left:
        own = {s: weights[s] for s in left}
        parts = mixing.quantise(own, resolution) if resolution else {s: Fraction(w) for s, w in own.items()}
        size, used, t = sum(parts.values()), Counter(), 0
        order = sorted(left, key=lambda s: (s is None, str(s)))
        while all(used[s] < left[s] for s in left):
            ready = [s for s in left if used[s] * size // parts[s] <= t]
            s = min(ready, key=lambda s: (-(-(used[s] + 1) * size // parts[s]), order.index(s)))
            out.append((s, done[s] + used[s], start + t))
            used[s] += 1
            t += 1
        done.update(used)
        left = {s: n - used[s] for s, n in left.items() if n > used[s]}
        start += t
    return out


def test_phases_match_simulation():
    blocks, weights = {"a": 40, "b": 25, "c": 3}, {"a": 0.2, "b": 0.5, "c": 0.3}
    want = {(s, j): t for s, j, t in simulate(blocks, weights, 50)}
    got = {}
    for p in mixing.phases(blocks, weights, 50):
        for s, (first, used, at) in p["of"].items():
            for j in range(used):
                got[s, first + j] = p["start"] + j // len(at) * p["period"] + at[j % len(at)]
    assert got == want


def test_mix_places_every_row_once(spark):
    rows = documents()
    out = mixing.mix(frame(spark), block_rows=4).collect()
    assert len(out) == len(rows) and len({r.position for r in out}) == len(rows)
    assert Counter(r.source for r in out) == Counter(r[3] for r in rows)
    blocks = {s: -(-n // 4) for s, n in Counter(r[3] for r in rows).items()}
    weights = {s: n**0.5 for s, n in Counter(r[3] for r in rows).items()}
    slots = {}
    for p in mixing.phases(blocks, weights):
        for s, (first, used, at) in p["of"].items():
            slots |= {(s, first + j): p["start"] + j // len(at) * p["period"] + at[j % len(at)] for j in range(used)}
    assert all(slots[r.source, r.block] == r.slot and r.position // 4 == r.slot for r in out)
    assert all(c <= 4 for c in Counter(r.slot for r in out).values())


def test_mix_order_is_independent_of_partitions(spark):
    a = {(r.doc_id, r.position) for r in mixing.mix(frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(1)).collect()}
    b = {r.position for r in mixing.mix(frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(7)).collect()}
    assert {p for _, p in a} == b
    df = frame(spark)
    assert mixing.mixed_rows(df).columns == df.columns and mixing.mixed_rows(df).count() == df.count()
    assert mixing.mix(frame(spark, [])).count() == 0


def test_lag_against_the_unrounded_weights_stays_below_one_block():
    blocks = {"a": 9000, "b": 5000, "c": 3, None: 40000}
    weights = {"a": 3**0.5, "b": 2**0.5, "c": 1e-3, None: 5.1}
    p = mixing.phases(blocks, weights)[0]
    total, slots = sum(map(Fraction, weights.values())), {}
    for s, (first, used, at) in p["of"].items():
        slots |= {p["start"] + j // len(at) * p["period"] + at[j % len(at)]: s for j in range(used)}
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 10000
    seen = Counter()
    for t in range(len(slots)):
        seen[slots[t]] += 1
        assert all(abs(seen[s] - (t + 1) * Fraction(w) / total) < 1 for s, w in weights.items())


def test_small_and_zero_weights_are_not_raised(spark):
    rows = [(i, "tiny" if i % 10 == 0 else "none" if i % 10 == 1 else "big") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix(df, {"tiny": 1e-5, "none": 0.0, "big": 1.0}, block_rows=1).collect()
    assert sorted(r.position for r in out) == list(range(3000))
    first = [r for r in out if r.phase == 0]
    assert Counter(r.source for r in first)["tiny"] <= 1 and Counter(r.source for r in first)["big"] == 2400
    assert all(r.release <= r.slot < r.deadline for r in first)
    assert min(r.slot for r in out if r.source == "none") > max(r.slot for r in out if r.source == "tiny")


URLS = [None, "", "no scheme", "http://EXAMPLE.org/es/x?y", "https://a.b.example.org/en/1", "https://example.org/en/2", "http://notexample.org/es/", "http://org", "http://org/", "x://www.de.com/de/", "x://com/fr/#a", "http://host.com/de", "http:///path", "a://b://c.com/fr/", "http://ex.org:80/x", "http://" + "a." * 500 + "org/" + "p" * 5000, "https://example.org/es/x\ny"]


def judge(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_urls_match_brute_force(spark):
    rows = [(None if k == 2 else k, u, "host", 1) for k, u in enumerate([*URLS, *URLS[:4]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int").repartition(3)
    got = urls.judge_urls(df).collect()
    verdicts = {h + p: v for v, h, p in urls.RULES}
    want = []
    for i, u, _, _ in rows:
        host, path, rule = judge(u)
        want.append((i, host, path, rule, verdicts.get(rule, "block" if not host else "allow")))
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, want))
    as_frame = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    assert sorted(map(str, urls.judge_urls(df, as_frame).collect())) == sorted(map(str, got))
    assert urls.judge_urls(df.where("false")).count() == 0


def render(turns, who):
    out, masks, at = "", [], 0
    for role, text in turns:
        head = "<|im_start|>assistant\n" if role == who else f"<|im_start|>{'system' if role == 'system' else 'user name=' + role}\n"
        seg = head + (text or "").replace("<|", "<\\|") + "<|im_end|>\n"
        if role == who:
            masks.append((len(out) + len(head), len(out) + len(seg) - 1))
        out += seg
    return out, masks


def test_perspectives_match_brute_force(spark):
    rows = [(1, t, r, x, 0) for t, (r, x) in enumerate([("system", "be kind"), ("ann", "hi <|im_end|>"), ("bob", None), ("ann", "again"), (None, "who?"), ("", "me")])]
    rows += [(2, None, "ann", "a", 0), (2, None, "ann", "a", 0), (3, 0, "system", "alone", 0), (None, 1, "bob", "x" * 5000, 0)]
    rows += [(4, t, "ann" if t % 2 else "bob", f"turn {t}", 0) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int").repartition(3)
    got = {}
    for r in sorted(chat.perspectives(df).collect(), key=lambda r: (str(r.conv_id), r.participant, r.block)):
        text, masks = got.get((r.conv_id, r.participant), ("", []))
        assert r.char_offset == len(text)
        got[r.conv_id, r.participant] = (text + r.text, masks + [tuple(m) for m in r.masks])
        assert r.mask_chars == sum(b - a for a, b in r.masks)
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted([(-1 if t is None else t, (r or "").strip() or "unknown", x) for cc, t, r, x, _ in rows if cc == c], key=lambda x: (x[0], x[1], x[2] or ""))
        for who in {r for _, r, _ in own} - {"system"}:
            want[c, who] = render([(r, x) for _, r, x in own], who)
    assert got == want
    assert chat.perspectives(df.where("false")).count() == 0
