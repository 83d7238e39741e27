"""A probabilistic suffix tree over words, learned and applied without gathering it anywhere.

States are contexts of up to ``depth`` words. A context is kept if its next-word
distribution diverges from that of its longest kept proper suffix: the leave-one-out
log-likelihood ratio of its own occurrences, which is its count times an estimate of
the Kullback-Leibler divergence, must reach ``divergence``. Distributions are
smoothed towards the longest kept suffix, P(x|s) = (c(sx) + mu P(x|s')) / (N(s) + mu), down
to the root, an absolute-discounting unigram model with one symbol for all unseen words.
A text is scored with the longest kept state at each word.

Contexts grow by one word a round. A context that is not kept
rules out all its extensions if even their best case falls short: they have some of its
occurrences, so their ratio is at most the sum over its occurrences of
log((c - 1 + mu p) / ((c - 1 + mu) p)), where c is the word's count and p its
probability so far. This bound drops no context that the divergence test would keep, and
neither does a minimum of two occurrences: the leave-one-out ratio of a single one is 0.

Counts and divergences of contexts are sums over occurrences, so they are formed in
rounds of the same kind: each input partition (chunk) sends its distinct keys with
partial sums to owners chosen by the key, already summed within the chunk; the owners
add up and return the totals (of divergences, what follows from them) to the chunks that
asked. The answers are checkpointed, and the messages of a round are forgotten then.
Nothing is collected or broadcast but the two totals N and V. The texts are read once and
kept as word numbers in a checkpointed table, which the rounds read in place; from the
third round on, a chunk's state holds only the occurrences whose contexts may still grow.
"""

from __future__ import annotations

import numpy as np
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir, forget, ship, shuffles_of
from .tokens import mix64, word_hashes

END = 0x1D872B41F1A3C5E7  # the end's hash; equal to a word's only by a collision of 64 bits
MIN_CONTEXT = 2
DIVERGENCE = 4.0
MU = 4.0
DISCOUNT = 0.6
DEPTH = 8
BATCH_ROWS = 256
CHUNK_TOKENS = 800_000
GAIN = 1024
#: What an owner answers about a context.
KEPT, LIVE = 1, 2


def pair(a, b):
    """The key of symbol b after context a, and of the context of both."""
    return mix64((a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b)


# --- arrays ----------------------------------------------------------------------------


def _order(keys: np.ndarray) -> np.ndarray:
    """An order in which 64-bit keys come sorted by their high bits and equal keys stand together."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    x = keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)  # sorting plain numbers is fast
    x.sort()
    order = (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    high, got = x >> bits, keys[order]
    if ((high[1:] == high[:-1]) & (got[1:] != got[:-1])).any():
        order = np.argsort(keys, kind="stable")
    return order


def _distinct(keys: np.ndarray):
    """(places of the distinct keys in their order, which of them each key is)."""
    order = _order(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], inverse


def _pairs(a: np.ndarray, b: np.ndarray, width: int):
    """``_distinct`` of pairs of small numbers, b below ``width``."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    both = a.astype(np.uint64) * np.uint64(width) + b.astype(np.uint64)
    bits = max(1, (len(a) - 1).bit_length())
    if ((int(a.max()) + 1) * width).bit_length() + bits > 64:
        return _distinct(both)
    x = both << np.uint64(bits) | np.arange(len(a), dtype=np.uint64)
    x.sort()
    order = (x & np.uint64((1 << bits) - 1)).astype(np.int64)
    both = x >> np.uint64(bits)
    new = np.ones(len(a), bool)
    new[1:] = both[1:] != both[:-1]
    inverse = np.empty(len(a), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], inverse


_ZSTD: dict = {}


def _zstd():
    """This process's compressor and decompressor; making them costs more than a small array."""
    if not _ZSTD:
        import zstandard

        _ZSTD["both"] = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _ZSTD["both"]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array, first bytes first, so that equal high bytes lie together; compressed lightly.

    High bytes that are all 0 are left out, and pairs go one after the other as whole numbers without sign. The number of
    bytes of each number comes first.
    """
    if not len(x):
        return b""
    if x.dtype == np.int64:
        x = ((x << 1) ^ (x >> 63)).view(np.uint64).reshape(-1, 2).T.ravel()
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(len(x), -1)
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if x.dtype.kind == "u" else raw.shape[1]
    out = np.empty((size, len(x)), np.uint8)
    for k in range(size):
        out[k] = raw[:, k]
    return bytes([size]) + _zstd()[0].compress(out)


def _unplanes(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not b:
        return np.zeros(0, kind)
    got = np.frombuffer(_zstd()[1].decompress(memoryview(b)[1:]), np.uint8).reshape(b[0], -1)
    x = np.zeros(got.shape[1], np.uint64 if kind == PAIR else kind)
    raw = x.view(np.uint8).reshape(len(x), -1)
    for k, plane in enumerate(got):
        raw[:, k] = plane
    if kind == PAIR:
        x = (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)
        return np.ascontiguousarray(x.reshape(2, -1).T).view(PAIR).ravel()
    return x


def _deltas(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys."""
    out = keys.copy()
    out[1:] = keys[1:] - keys[:-1]
    return out


# --- one partition's texts as arrays -------------------------------------------------


def _load(batches):
    """Rows of up to about CHUNK_TOKENS words each: identifiers, folds, word counts, the distinct words and the words as numbers of them."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, no = TaskContext.get().partitionId(), 0
    got: list = []
    size = 0

    def flush():
        ids, held, counts, words = (np.concatenate([g[k] for g in got]) for k in range(4))
        null = np.concatenate([g[4] for g in got])
        first, word = _distinct(words)
        cols = {"part": [part], "no": [no], "ids": [ids.tobytes()], "nulls": [null.tobytes()], "held": [held.tobytes()], "counts": [counts.tobytes()], "uni": [_planes(_deltas(words[first]))], "word": [_planes(word.astype(np.uint32))]}
        return pa.RecordBatch.from_pydict(cols)

    for whole in batches:
        for k in range(0, whole.num_rows, BATCH_ROWS):
            b = whole.slice(k, BATCH_ROWS)
            h, at = word_hashes(b.column("text").to_pylist())
            words = np.insert(h, at[1:], np.uint64(END))
            flag = lambda c: np.array(c.to_numpy(zero_copy_only=False), bool)
            ids = np.array(b.column("id").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            got.append((ids, flag(b.column("held")), np.diff(at) + 1, words, flag(b.column("id").is_null())))
            size += len(words)
            if size >= CHUNK_TOKENS:
                yield flush()
                got, size, no = [], 0, no + 1
    if got:
        yield flush()


class Chunk:
    """The arrays of one chunk.

    The context at a text's beginning is the end symbol, which never is a context elsewhere,
    and occurs as often as there are texts.
    """

    def __init__(self, row):
        self.at = row[0], row[1]
        self.ids, self.nulls, self.held = np.frombuffer(row[2], np.int64), np.frombuffer(row[3], bool), np.frombuffer(row[4], bool)
        self.counts, self.uni = np.frombuffer(row[5], np.int64), np.cumsum(_unplanes(row[6], np.uint64), dtype=np.uint64)
        self.word = _unplanes(row[7], np.uint32).astype(np.int32)
        self.ends = np.cumsum(self.counts)
        self.first = np.concatenate(([0], self.ends[:-1]))  # of each text, its first word
        self.end = int(self.word[-1])  # the last word of a text is the end

    def train(self):
        return np.repeat(~self.held, self.counts)

    def state(self):
        """The word before each word."""
        out = np.empty(len(self.word), np.int32)
        out[1:] = self.word[:-1]
        out[self.first] = self.end
        return out

    def contexts(self, at, size: int):
        """Keys of the contexts of ``size`` words before the places ``at``, which must have so many."""
        word = lambda k: self.uni[self.word[at - k]]
        text = np.searchsorted(self.ends, at, side="right")
        key = np.where(at - size < self.first[text], np.uint64(END), self.uni[self.word[np.maximum(at - size, 0)]])
        for k in range(size - 1, 0, -1):
            key = pair(key, word(k))
        return key

    def by_text(self, values):
        return np.add.reduceat(values, self.first)


# --- an exchange: sums of sorted keys go to owners, totals come back --------------------


def _fixed(gain: np.ndarray, reach: np.ndarray, scale: int) -> np.ndarray:
    """Pairs of sums as whole multiples of 1 / scale, which pack better; the second, a bound, is rounded up."""
    return np.stack([np.rint(gain * scale), np.ceil(reach * scale)], axis=1).astype(np.int64)


#: What a table's sums are: a count, or a pair of whole numbers.
COUNT, PAIR = np.dtype(np.uint32), np.dtype("V16")


def _send(at: tuple[int, int], tables, owners: int):
    """(owner, (chunk, blobs)) for every owner; a chunk is a partition and a number in it. ``tables``: (keys in the order of ``_order``, sums) pairs."""
    cuts = []
    for keys, _ in tables:
        own = ((keys >> np.uint64(40)) * np.uint64(owners)) >> np.uint64(24)
        cuts.append(np.searchsorted(own, np.arange(owners + 1)))
    for o in range(owners):
        blobs = [(_planes(_deltas(keys[c[o] : c[o + 1]])), _planes(sums[c[o] : c[o + 1]])) for (keys, sums), c in zip(tables, cuts)]
        if o == sum(at) % owners or any(b[0] for b in blobs):  # every chunk gets an answer
            yield o, (at, blobs)


def _totals(messages, t: int, kind):
    """An owner's distinct keys of table ``t`` by number: their totals, and for each message which ones it has."""
    parts = [(np.cumsum(_unplanes(b[t][0], np.uint64), dtype=np.uint64), _unplanes(b[t][1], kind)) for _, b in messages]
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    first, inverse = _distinct(keys)
    sums = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, kind)
    add = lambda x: np.bincount(inverse, x.astype(float), len(first)).astype(np.int64)  # noqa: E731  exact below 2 ** 53
    if kind == PAIR:
        sums = sums.view(np.int64).reshape(-1, 2)
        total = np.stack([add(sums[:, 0]), add(sums[:, 1])], axis=1)
    else:
        total = add(sums)
    at = np.cumsum([0] + [len(p[0]) for p in parts])
    return total, [inverse[a:b] for a, b in zip(at, at[1:])]


def _number(k):
    return k


def _single(rdd):
    """The same items, pickled one by one: such RDDs are zipped without another pass through Python."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _zip(base, *more):
    """((item, answer), answer) ... of the chunks; answers may have more, empty partitions."""
    n = max([r.getNumPartitions() for r in more], default=0)
    if (gap := n - base.getNumPartitions()) > 0:
        base = _single(base.context.union([base, base.context.parallelize([], gap)]))
    for r in more:
        base = base.zip(r)
    return base


def _open(item, k: int):
    """A chunk's row and its k answers, in the order of the rounds."""
    got = []
    for _ in range(k):
        item, a = item
        got.append(a)
    return item, got[::-1]


def _exchange(asked, owners: int, chunks: int, kinds, judge):
    """Answers for every chunk, in the order of its keys, as a checkpointed RDD with the partitions and items of the chunks.

    ``kinds``: for each table COUNT or PAIR; counts come back as totals, pairs of sums as what
    ``judge`` says of their totals.
    """

    def own(owner, items):
        messages = sorted((m for _, m in items), key=lambda m: m[0])
        answers: list = [[] for _ in messages]
        for t, kind in enumerate(kinds):
            total, where = _totals(messages, t, kind)
            total = judge(total) if kind == PAIR else total.astype(np.uint64)
            for k, w in enumerate(where):
                answers[k].append(_planes(total[w]))
        for (at, _), a in zip(messages, answers):
            yield at[0], (at[1], owner, a)

    def join(items):
        got: dict = {}
        for _, (no, owner, blobs) in items:
            got.setdefault(no, []).append((owner, blobs))
        for no in sorted(got):
            parts = sorted(got.pop(no))
            yield [[v[1][t] for v in parts] for t in range(len(kinds))]

    owned = asked.partitionBy(owners, _number)
    back = owned.mapPartitionsWithIndex(own).partitionBy(chunks, _number)
    return owned, back, _single(back.mapPartitions(join))


def _answers(blobs, kinds):
    """A chunk's answers as arrays."""
    return [np.concatenate([_unplanes(x, np.uint8 if kind == PAIR else np.uint64) for x in b]) for b, kind in zip(blobs, kinds)]


def _keep(rdd):
    """The RDD, written to the shared checkpoint folder in one job."""
    rdd.checkpoint()
    rdd._jrdd.rdd().doCheckpoint()
    return rdd


# --- the model -------------------------------------------------------------------------


def _root(c, n, v, discount):
    """The root's probabilities for counts c: absolute discounting, one symbol for all unseen words."""
    if not v:
        return np.ones(len(c))
    return np.where(c > 0, (c - discount) / n, discount * v / n)


def _gain(c, n, parent, mu):
    """Leave-one-out log-likelihood ratio of an occurrence against the parent's probability."""
    return np.log((c - 1 + mu * parent) / (n - 1 + mu)) - np.log(parent)


def _reach(c, parent, mu):
    """The most that an occurrence can add to the ratio of a longer context."""
    return np.log((c - 1 + mu * parent) / ((c - 1 + mu) * parent))


class Model:
    """Parameters and the two totals; everything else stays distributed."""

    def __init__(self, min_context, divergence, mu, discount, depth):
        self.m, self.d, self.mu, self.discount, self.depth = max(2, min_context), divergence, mu, discount, depth
        self.scale = GAIN  # of the gains' sums; totals over all chunks have 64 bits
        self.n = self.v = 0

    def judge(self, sums):
        """KEPT and LIVE (a longer context might be kept) of contexts, by their totals."""
        enough = sums >= self.d * self.scale
        return (enough[:, 0] * KEPT + enough.any(axis=1) * LIVE).astype(np.uint8)

    def sums(self, group, groups, c, n, p, times):
        """Pairs of sums (gain, reach) for each of ``groups``, of items with counts c and n, probabilities p and ``times`` training occurrences."""
        at = np.flatnonzero(times)
        group, c, n, p, times = group[at], np.maximum(c[at], 1).astype(float), n[at].astype(float), p[at], times[at]
        return _fixed(np.bincount(group, times * _gain(c, n, p, self.mu), groups), np.bincount(group, times * _reach(c, p, self.mu), groups), self.scale)

    def smooth(self, c, n, p):
        return (c + self.mu * p) / (n + self.mu)

    def hopeless(self, n, p):
        """Training occurrences of contexts that occur twice and can't be kept, nor their extensions: both words must be the same, and that is too likely already."""
        return (n == 2) & (2 * _reach(2.0, p, self.mu) < self.d)


class Early:
    """The first rounds of a chunk, worked out from its words and the answers so far.

    ``p`` and ``used`` are each occurrence's probability and the length of its context.
    """

    def __init__(self, ch: Chunk, model: Model, answers):
        self.ch, self.m, m = ch, model, model
        self.state, self.train = ch.state(), ch.train()
        width = len(ch.uni)
        first, self.edge = _pairs(self.state, ch.word, width)
        self.first1, self.width = first, width
        self.key1 = pair(ch.uni[self.state[first]], ch.uni[ch.word[first]])
        self.order1 = _order(self.key1)
        if not answers:
            return
        # counts of words and of edges
        self.c1 = answers[0][0].astype(np.int64)
        self.c2 = np.empty(len(first), np.int64)
        self.c2[self.order1] = answers[0][1].astype(np.int64)
        self.root = _root(self.c1.astype(float), m.n, m.v, m.discount)
        self.use1 = np.flatnonzero(self.c1 >= m.m)
        # contexts of two words are the edges that end one word before
        before = np.arange(len(ch.word)) - 1
        before[ch.first] = -1
        if m.depth >= 2:
            at = np.flatnonzero(before >= 0)
            at = at[self.c2[self.edge[at - 1]] >= m.m]
            self.at2, self.own2 = at, self.edge[at - 1]
            self.first2, self.edge2 = _pairs(self.own2, ch.word[at], width)
            self.key2 = pair(self.key1[self.own2[self.first2]], ch.uni[ch.word[at[self.first2]]])
            self.order2 = _order(self.key2)
        if len(answers) < 2:
            return
        # contexts of one word are judged
        flags = np.zeros(width, np.uint8)
        flags[self.use1] = answers[1][0]
        now = flags[self.state]
        self.live1 = (now & LIVE) > 0
        kept = np.flatnonzero(now & KEPT)
        self.p = self.root[ch.word]
        self.used = np.zeros(len(ch.word), np.uint8)
        self.p[kept] = m.smooth(self.c2[self.edge[kept]], self.c1[self.state[kept]], self.p[kept])
        self.used[kept] = 1
        if m.depth < 2:
            return
        self.c3 = np.empty(len(self.first2), np.int64)
        self.c3[self.order2] = answers[1][1].astype(np.int64)
        if m.depth >= 3:
            # of contexts of three words the place of the edge that ends one word before
            spot = np.full(len(ch.word) + 1, -1, np.int32)
            spot[self.at2 + 1] = self.edge2
            spot[ch.first] = -1
            at = np.flatnonzero((spot[:-1] >= 0) & self.live1)
            own = spot[at]
            n = self.c3[own]
            # the probability after the next answer is the one so far or this
            p2 = self.p.copy()
            p2[self.at2] = m.smooth(self.c3[self.edge2], self.c2[self.own2], self.p[self.at2])
            ok = (n >= m.m) & ~(self.train[at] & m.hopeless(n, np.minimum(self.p[at], p2[at])))
            self.at3, self.own3 = at[ok], own[ok]
            self.first3, self.edge3 = _pairs(self.own3, ch.word[self.at3], width)
            self.key3 = pair(self.key2[self.own3[self.first3]], ch.uni[ch.word[self.at3[self.first3]]])
            self.order3 = _order(self.key3)
        # contexts of two words that may be kept: with a live suffix
        self.used2 = np.zeros(len(self.first1), bool)
        self.used2[self.own2[self.live1[self.at2]]] = True
        self.use2 = np.flatnonzero(self.used2)
        self.use2 = self.use2[_order(self.key1[self.use2])]
        if len(answers) < 3:
            return
        flags = np.zeros(len(self.first1), np.uint8)
        flags[self.use2] = answers[2][0]
        now = flags[self.own2]
        kept = np.flatnonzero(now & KEPT)
        at = self.at2[kept]
        self.p[at] = m.smooth(self.c3[self.edge2[kept]], self.c2[self.own2[kept]], self.p[at])
        self.used[at] = 2
        if m.depth < 3:
            return
        self.c4 = np.empty(len(self.first3), np.int64)
        self.c4[self.order3] = answers[2][1].astype(np.int64)
        live = np.zeros(len(ch.word), bool)
        live[self.at2] = (now & LIVE) > 0
        self.on3 = live[self.at3]

    def ask_counts(self):
        words = np.bincount(self.ch.word[self.train], minlength=self.width)
        edges = np.bincount(self.edge[self.train], minlength=len(self.first1))
        return [(self.ch.uni, words.astype(np.uint32)), (self.key1[self.order1], edges[self.order1].astype(np.uint32))]

    def ask_second(self):
        """Sums of contexts of one word; counts of the words after contexts of two."""
        ch, m = self.ch, self.m
        own = self.state[self.first1]
        times = np.bincount(self.edge[self.train], minlength=len(self.first1))
        sums = m.sums(own, self.width, self.c2, self.c1[own], self.root[ch.word[self.first1]], np.where(self.c1[own] >= m.m, times, 0))
        out = [(ch.uni[self.use1], sums[self.use1])]
        if m.depth >= 2:
            edges = np.bincount(self.edge2[self.train[self.at2]], minlength=len(self.first2))
            out.append((self.key2[self.order2], edges[self.order2].astype(np.uint32)))
        return out

    def ask_third(self):
        """Sums of contexts of two words; counts of the words after contexts of three."""
        m, at = self.m, self.at2[self.first2]
        own = self.own2[self.first2]
        times = np.bincount(self.edge2[self.train[self.at2] & self.live1[self.at2]], minlength=len(self.first2))
        sums = m.sums(own, len(self.first1), self.c3, self.c2[own], self.p[at], times)
        out = [(self.key1[self.use2], sums[self.use2])]
        if m.depth >= 3:
            edges = np.bincount(self.edge3[self.train[self.at3]], minlength=len(self.first3))
            out.append((self.key3[self.order3], edges[self.order3].astype(np.uint32)))
        return out

    def finish(self):
        """The chunk's state: sums of its texts without the occurrences whose contexts may grow, and those occurrences."""
        ch = self.ch
        c1 = self.c1[ch.word]
        low = np.log10((c1 + 1.0) / (self.m.n + (self.m.v + 1.0)))
        log = np.log10(self.p)
        used = self.used
        at = np.zeros(0, np.int64)
        n = c = at
        if self.m.depth >= 3:
            at = self.at3[self.on3]
            n, c = self.c3[self.own3[self.on3]], self.c4[self.edge3[self.on3]]
            log[at] = 0.0
            used = used.copy()
            used[at] = 0
        some = lambda x: ch.by_text(x.astype(np.int64))
        texts = [ch.ids, ch.nulls, ch.held, ch.counts, some(c1 > 0), ch.by_text(low), ch.by_text(log), some(used == 1), some(used == 2), np.zeros(len(ch.ids), np.int64)]
        return _pack(ch.at, texts, at, self.p[at], self.used[at], n, c)


def _pack(no, texts, at, p, used, n, c):
    """A chunk's state as bytes: its number, the texts' columns, and the open occurrences' place, probability, length of context, and counts of the context to be judged and of the word after it."""
    return (no, [x.tobytes() for x in texts], _planes(_deltas(at.astype(np.uint64))), _planes(p.astype(np.float32)), _planes(used.astype(np.uint8)), _planes(n.astype(np.uint64)), _planes(c.astype(np.uint64)))


TEXTS = (np.int64, bool, bool, np.int64, np.int64, float, float, np.int64, np.int64, np.int64)


class Late:
    """A chunk's open occurrences, whose contexts of ``size`` words are to be judged next."""

    def __init__(self, ch: Chunk, state, model: Model, size: int):
        self.ch, self.m, self.size = ch, model, size
        self.texts = [np.frombuffer(b, t) for b, t in zip(state[1], TEXTS)]
        self.at = np.cumsum(_unplanes(state[2], np.uint64)).astype(np.int64)
        self.p, self.used = _unplanes(state[3], np.float32).astype(float), _unplanes(state[4], np.uint8)
        self.n, self.c = _unplanes(state[5], np.uint64).astype(np.int64), _unplanes(state[6], np.uint64).astype(np.int64)
        keys = ch.contexts(self.at, size)
        first, self.own = _distinct(keys)
        self.keys = keys[first]
        text = np.searchsorted(ch.ends, self.at, side="right")
        self.train, self.text = ~ch.held[text], text
        # contexts of one word more
        if size < model.depth:
            # where the word before is open too, it knows how often the longer context occurs
            back = np.searchsorted(self.at, self.at - 1)
            back[back == len(self.at)] = 0
            known = self.at[back] == self.at - 1 if len(self.at) else np.zeros(0, bool)
            n = np.where(known, self.c[back], model.m + 1) if len(self.at) else self.c
            least = np.minimum(self.p, model.smooth(self.c, self.n, self.p))
            more = (self.at - size - 1 >= ch.first[text] - 1) & (n >= model.m) & ~(self.train & model.hopeless(n, least))
            self.on = np.flatnonzero(more)
            at = self.at[self.on]
            keys = ch.contexts(at, size + 1)
            first, self.own2 = _distinct(keys)
            self.keys2 = keys[first]
            keys = pair(keys, ch.uni[ch.word[at]])
            first, self.edge2 = _distinct(keys)
            self.edges2 = keys[first]

    def ask(self):
        """Sums of the contexts, and counts of the contexts of one word more and of the words after them."""
        out = [(self.keys, self.m.sums(self.own, len(self.keys), self.c, self.n, self.p, self.train.astype(np.int64)))]
        if self.size < self.m.depth:
            learn = self.train[self.on]
            out.append((self.keys2, np.bincount(self.own2[learn], minlength=len(self.keys2)).astype(np.uint32)))
            out.append((self.edges2, np.bincount(self.edge2[learn], minlength=len(self.edges2)).astype(np.uint32)))
        return out

    def apply(self, got):
        """The state after the answers."""
        now = got[0][self.own]
        kept = np.flatnonzero(now & KEPT)
        self.p[kept] = self.m.smooth(self.c[kept], self.n[kept], self.p[kept])
        used = self.used.copy()
        used[kept] = np.minimum(255, self.size)
        open_ = np.zeros(len(self.at), bool)
        n = c = np.zeros(0, np.int64)
        if self.size < self.m.depth:
            total = got[1].astype(np.int64)[self.own2]
            ok = (total >= self.m.m) & ((now[self.on] & LIVE) > 0)
            ok &= ~(self.train[self.on] & self.m.hopeless(total, self.p[self.on]))
            open_[self.on[ok]] = True
            n, c = total[ok], got[2].astype(np.int64)[self.edge2[ok]]
        done = np.flatnonzero(~open_)
        texts = [x.copy() for x in self.texts]
        text = self.text[done]
        texts[6] += np.bincount(text, np.log10(self.p[done]), len(texts[6]))
        for k, own in ((7, used[done] == 1), (8, used[done] == 2), (9, used[done] > 2)):
            texts[k] += np.bincount(text[own], minlength=len(texts[k]))
        return _pack(self.ch.at, texts, self.at[open_], self.p[open_], used[open_], n, c)


def score_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out=None,
    min_context: int = MIN_CONTEXT,
    divergence: float = DIVERGENCE,
    mu: float = MU,
    discount: float = DISCOUNT,
    depth: int | None = DEPTH,
) -> DataFrame:
    """Scores every text with a suffix tree learned from the rows outside ``held_out``.

    Returns the identifier, held_out, n_tokens (words and the end), n_known, train_tokens,
    base_score (add-one unigrams), score (log10 probability), and the numbers of words scored
    with a context of one (depth1), two (depth2) and more words (deeper). ``depth``: the most
    words of a context, one round each; with None rounds go on until no context can grow. ``min_context``:
    the fewest occurrences of a context; two at least. Words are runs without white
    space, A-Z lower-cased; a null text is empty and has only the end. ``held_out``: a
    boolean column; null counts as no, and by default nothing is held out. Null and
    repeated identifiers are scored row by row. Without any training row every
    probability at the root is one symbol's, i.e. 1. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    checkpoint_dir(spark)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    schema = f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, depth1 long, depth2 long, deeper long"
    if df.isEmpty():
        return spark.createDataFrame([], schema)
    # words as numbers, about half the size of the texts; all rounds read this table as it was pickled
    words = rows.mapInArrow(_load, "part long, no long, ids binary, nulls binary, held binary, counts binary, uni binary, word binary")
    chunked = _single(words.rdd.map(tuple))
    chunks = chunked.getNumPartitions()
    chunked = _keep(chunked)
    owners = max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = Model(min_context, divergence, mu, discount, (1 << 62) if depth is None else max(1, depth))
    replies, kinds = [], []

    def early(what, answered):
        def run(item):
            row, got = _open(item, answered)
            e = Early(Chunk(row), model, [_answers(g, k) for g, k in zip(got, kinds)])
            return _send(e.ch.at, what(e), owners)

        return run

    def sizes(items):
        total, _ = _totals([m for _, m in items], 0, COUNT)
        yield int(total.sum()), int((total > 0).sum())

    for what in (Early.ask_counts, Early.ask_second, Early.ask_third)[: 1 + min(2, model.depth)]:
        k = len(replies)
        asked = _zip(chunked, *replies).flatMap(early(what, k)) if k else chunked.flatMap(early(what, 0))
        own = ([COUNT, COUNT], [PAIR, COUNT][: model.depth], [PAIR, COUNT][: max(1, model.depth - 1)])[k]
        owned, back, reply = _exchange(asked, owners, chunks, own, model.judge)
        _keep(reply)
        if not k:  # two numbers for each owner
            got = owned.mapPartitions(sizes).collect()
            model.n, model.v = sum(x[0] for x in got), sum(x[1] for x in got)
        forget(spark, shuffles_of(owned) + shuffles_of(back))
        replies, kinds = [*replies, reply], [*kinds, own]

    def first_state(item):
        row, got = _open(item, len(kinds))
        return Early(Chunk(row), model, [_answers(g, k) for g, k in zip(got, kinds)]).finish()

    states = _single(_zip(chunked, *replies).map(first_state))
    size = 3
    if size <= model.depth:
        _keep(states)
    while size <= model.depth and (depth is not None or states.filter(lambda s: s[2]).take(1)):
        last = size == model.depth
        own = [PAIR, COUNT, COUNT][: 1 if last else 3]
        both = _zip(chunked, states)
        owned, back, reply = _exchange(both.flatMap(_late_ask(model, size, owners)), owners, chunks, own, model.judge)
        states = _keep(_single(_zip(both, reply).map(_late_apply(model, size, own))))
        forget(spark, shuffles_of(owned) + shuffles_of(back))
        size += 1

    def result(state):
        cols = [np.frombuffer(b, t).tolist() for b, t in zip(state[1], TEXTS)]
        for i, null, held_, count, known, low, log, d1, d2, d3 in zip(*cols):
            yield (None if null else i, held_, count, known, model.n, low, log, d1, d2, d3)

    return spark.createDataFrame(states.flatMap(result), schema)


def _late_ask(model: Model, size: int, owners: int):
    def run(item):
        row, state = item
        ch = Chunk(row)
        return _send(ch.at, Late(ch, state, model, size).ask(), owners)

    return run


def _late_apply(model: Model, size: int, kinds):
    def run(item):
        (row, state), got = item
        return Late(Chunk(row), state, model, size).apply(_answers(got, kinds))

    return run


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether crc32 of the identifier as text falls into the held-out fold (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
