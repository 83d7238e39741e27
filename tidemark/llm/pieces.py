"""SentencePiece encoding by sampled segmentations, and decoding.

A text's segmentations form a lattice; a piece's weight is exp(score) and comes from its
merge rank by Zipf's law (log p = -log(rank + 2), normalised over the vocabulary), as the
model file of a BPE vocabulary has ranks instead of probabilities. A character that
is no piece is spelt in byte pieces.

Gumbel top-k without replacement: every segmentation's log-probability is perturbed by an
independent Gumbel variable, and the k largest are wanted. A search node is the set of
segmentations that share a prefix but not its next piece; its bound is the Gumbel
maximum of the set, drawn top-down (the maximum of a set of total weight w has location
log w, and a part's maximum is drawn below the known maximum of the whole). The
best-first (A*) search takes the node of the largest bound: its best member is found by
following exact conditional draws to the end, and the sets that branch off from that path
become new nodes. So segmentations come out in the order of their perturbed scores, all
distinct, and each costs one pass over the rest of the text. The inclusion score is
1 - exp(-exp(log p - kappa)), with kappa the (k+1)-th largest perturbed score.

All draws are hashes of the row's key and the place of the draw: results do not
depend on batches, partitions or retries. Texts of a batch are worked off together in
numpy, and the lattice of each of a batch's distinct words is built once. The sets are
split along default paths: at each place a segmentation either follows the likeliest
pieces to the end of the word or leaves that path at some step by some piece.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import frugal, ship
from .tokens import mix64

TOKENIZER = "piece_bpe_32k.model"
K = 3
BATCH_CHARS = 1 << 21
PART_WORDS = 1 << 16
SPACE = "▁"
_STATE: dict = {}


def default_model() -> bytes:
    """The bytes of the installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces and log-probabilities of a model, without control and unknown pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.surface = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        normal, self.raw = [], [b""] * n
        for i, p in enumerate(self.surface):
            if sp.is_byte(i):
                b = int(p[1:-1], 16)
                self.byte_ids[b] = i
                self.raw[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
                self.raw[i] = p.replace(SPACE, " ").encode()
        # merge rank: the order of the scores; pieces of one score in the order of their ids
        ranked = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        mass = math.log(sum(1 / (r + 2) for r in range(len(ranked) + 256)))
        self.logp = {i: -math.log(r + 2) - mass for r, i in enumerate(ranked)}
        for b, i in enumerate(self.byte_ids):
            self.logp[i] = -math.log(len(ranked) + b + 2) - mass
        self.ids = {self.surface[i]: i for i in normal}
        self.longest = max(map(len, self.ids))
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.split = re.compile(r"(?s).+")
        else:  # no piece crosses the start of a run of spaces, nor a character that is only ever a piece of its own
            alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in joined)
            self.split = re.compile(f"(?s){SPACE}+[^{SPACE}{alone}]*|[{alone}]|[^{SPACE}{alone}]+" if alone else f"(?s){SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Trie:
    """The vocabulary's prefixes as a two-table hash of (state, character class) -> state, probed for whole arrays at once."""

    def __init__(self, vocab: Vocabulary):
        chars = sorted({c for p in vocab.ids for c in p})
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.lone = np.zeros(0x110000, bool)  # characters that are pieces
        self.lone[[ord(p) for p in vocab.ids if len(p) == 1]] = True
        next_: dict = {}
        piece = [0]
        for p, i in sorted(vocab.ids.items()):
            at = 0
            for c in p:
                k = (at, int(self.char[ord(c)]))
                if k not in next_:
                    next_[k] = len(piece)
                    piece.append(0)
                at = next_[k]
            piece[at] = i
        self.piece = np.array(piece, np.int32)  # 0: no piece ends here
        keys = np.array([a * self.width + c for a, c in next_], np.int64)
        values = np.array(list(next_.values()), np.int64)
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        table: list = [{}, {}]
        for k, v, s1, s2 in zip(keys.tolist(), values.tolist(), self._slot(keys, 0).tolist(), self._slot(keys, 1).tolist()):
            item, side, slot = (k, v, s1, s2), 0, s1
            for _ in range(10_000):  # cuckoo placement
                item, table[side][slot] = table[side].get(slot), item
                if item is None:
                    break
                side = 1 - side
                slot = item[2 + side]
            else:
                raise RuntimeError("the prefix table could not be built")
        self.keys = [np.full(1 << self.bits, -1, np.int64) for _ in table]
        self.values = [np.full(1 << self.bits, -1, np.int32) for _ in table]
        for side in (0, 1):
            for slot, (k, v, _, _) in table[side].items():
                self.keys[side][slot], self.values[side][slot] = k, v
        self.first = np.full(self.width, -1, np.int32)  # the first step, by character class
        for (a, c), v in next_.items():
            if not a:
                self.first[c] = v

    def _slot(self, keys, side: int):
        odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[side]
        return ((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state, chars):
        """Next states, -1 where there is none."""
        keys = state.astype(np.int64) * self.width + chars
        s = self._slot(keys, 0)
        out = np.where(self.keys[0].take(s) == keys, self.values[0].take(s), -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            k = keys.take(miss)
            s = self._slot(k, 1)
            out[miss] = np.where(self.keys[1].take(s) == k, self.values[1].take(s), -1)
        out[chars == 0] = -1
        return out


class Lattices:
    """The lattices of a batch's distinct words, built for all of them at once.

    A node is a place in a word. Words are ranked by falling length and nodes are numbered by
    the characters that remain, then by rank, so that the backward pass takes one array
    operation for each number of remaining characters; nodes 0 .. words-1 are the ends. Each node has
    its arcs (pieces) with conditional log-probabilities, and a default path to the end that
    follows the likeliest arcs.
    """

    def __init__(self, vocab: Vocabulary, trie: Trie, words: list[str]):
        self.vocab = vocab
        self.spelt: list[list[int]] = []
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-n, kind="stable")
        self.words = words = [words[k] for k in order.tolist()]
        n = n[order]
        self.rank = np.empty(len(words), np.int32)
        self.rank[order] = np.arange(len(words), dtype=np.int32)
        most = int(n[0]) if len(n) else 0
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(n)
        count = np.searchsorted(-n, -np.arange(most + 1), side="right") if most else np.array([0])  # words of at least t characters
        count[0] = len(words)
        off = np.concatenate(([0], np.cumsum(count)))
        total = int(off[-1])
        code = np.zeros(total, np.int32)
        left = np.zeros(total, np.int32)
        off = off.astype(np.int32)
        for t in range(1, most + 1):
            code[off[t] : off[t + 1]] = text[ends[: count[t]] - t]
            left[off[t] : off[t + 1]] = t
        self.start = off[n] + np.arange(len(words), dtype=np.int32)  # of each word, its first node
        nodes = np.arange(len(words), total, dtype=np.int32)
        chars = trie.char[code]
        logp = np.full(len(vocab.surface) + 1, -np.inf)
        logp[list(vocab.logp)] = list(vocab.logp.values())
        src, dst, pid, val = [], [], [], []
        lone = ~trie.lone[code[nodes]]
        if lone.any():  # characters spelt in bytes
            at = nodes[lone]
            kinds, inverse = np.unique(code[at], return_inverse=True)
            cost, named = np.zeros(len(kinds)), np.zeros(len(kinds), np.int64)
            for k, c in enumerate(kinds.tolist()):
                spelt = [vocab.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]
                if len(spelt) > 1:
                    self.spelt.append(spelt)
                named[k] = spelt[0] if len(spelt) == 1 else -len(self.spelt)
                cost[k] = sum(vocab.logp[b] for b in spelt)
            src.append(at)
            dst.append(off[left[at] - 1] + at - off[left[at]])
            pid.append(named[inverse])
            val.append(cost[inverse])
        state, at, row, remain = np.zeros(len(nodes), np.int32), nodes, nodes - off[left[nodes]], left[nodes]
        for size in range(1, vocab.longest + 1):
            if size > 1:
                ok = np.flatnonzero(remain >= size)
                state, at, row, remain = state.take(ok), at.take(ok), row.take(ok), remain.take(ok)
            if not len(at):
                break
            state = trie.first.take(chars[nodes]) if size == 1 else trie.step(state, chars.take(off.take(remain - size + 1) + row))
            ok = np.flatnonzero(state >= 0)
            state, at, row, remain = state.take(ok), at.take(ok), row.take(ok), remain.take(ok)
            ends_here = trie.piece.take(state)
            hit = np.flatnonzero(ends_here)
            ends_here = ends_here.take(hit)
            src.append(at.take(hit))
            dst.append(off.take(remain.take(hit) - size) + row.take(hit))
            pid.append(ends_here)
            val.append(logp.take(ends_here))
        # arcs by node, each node's in the order found: a node is at most once in each of the lists
        spot = np.zeros(total, np.int32)
        for x in src:
            spot[x] += 1
        self.arc = np.concatenate(([0], np.cumsum(spot))).astype(np.int32)
        n_arcs = int(self.arc[-1])
        self.to, self.seq, weight = np.empty(n_arcs, np.int32), np.empty(n_arcs, np.int32), np.empty(n_arcs)
        spot = self.arc[:-1].copy()
        for x, d, i, w in zip(src, dst, pid, val):
            y = spot.take(x)
            self.to[y], self.seq[y], weight[y] = d, i, w
            spot[x] = y + 1
        del src, dst, pid, val
        beta = np.zeros(total)
        self.logq = np.zeros(n_arcs)
        self.best = np.zeros(total, np.int32)
        self.logd = np.zeros(total)  # log-probability of the default path
        for t in range(1, most + 1):
            lo, hi = off[t], off[t + 1]
            a0, a1 = self.arc[lo], self.arc[hi]
            first = self.arc[lo:hi] - a0
            sizes = np.diff(np.append(first, a1 - a0))
            v = weight[a0:a1] + beta[self.to[a0:a1]]
            top = np.maximum.reduceat(v, first)
            beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, sizes)), first))
            self.logq[a0:a1] = v - np.repeat(beta[lo:hi], sizes)
            at = np.flatnonzero(v == np.repeat(top, sizes))
            at = at[np.searchsorted(at, first)]  # the first of equally likely arcs
            self.best[lo:hi] = at + a0
            self.logd[lo:hi] = np.minimum(0.0, top - beta[lo:hi] + self.logd[self.to[at + a0]])
        self.total = beta[self.start]
        with np.errstate(divide="ignore"):
            self.logr = np.log(-np.expm1(self.logd))  # log-probability of leaving the default path
        single = np.diff(self.arc) <= 1
        single[: len(words)] = True
        for t in range(1, most + 1):  # nodes without any choice
            lo, hi = off[t], off[t + 1]
            single[lo:hi] &= single[self.to[self.best[lo:hi]]]
        self.logr[single] = -np.inf
        self.logd[single] = 0.0
        self.prob = np.exp(self.logd)
        self.ends = len(words)
        # arcs of every word's default path
        self.path, bounds = self.expand(self.start)
        self.path_at, self.path_len = bounds[:-1].astype(np.int32), np.diff(bounds).astype(np.int32)
        # bytes of the words, of the pieces and, by negative numbers, of the characters spelt in pieces
        self.plain = np.frombuffer("".join(words).replace(SPACE, " ").encode("utf-8", "surrogatepass"), np.uint8)
        size = (1 + (text >= 0x80) + (text >= 0x800) + (text >= 0x10000) - 2 * (text == ord(SPACE))).astype(np.int32)
        self.plain_len = np.add.reduceat(size, ends - n) if len(words) else np.zeros(0, np.int32)
        self.plain_at = np.cumsum(self.plain_len) - self.plain_len
        raw = vocab.raw + [b"".join(map(vocab.raw.__getitem__, x)) for x in self.spelt[::-1]]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.fromiter(map(len, raw), np.int32, len(raw))
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.good = self.decoded(self.path, bounds)  # whether that path decodes to the word
        self.all_good = bool(self.good.all())

    def decoded(self, arcs, bounds, ranks=None) -> np.ndarray:
        """Whether the pieces of arcs, cut by ``bounds``, decode to the words of the given ranks (by default all, in their order)."""
        seq = self.seq[arcs]
        size = self.raw_len[seq]
        got = self.raw[_spans(self.raw_at[seq], size)]
        ends = np.zeros(len(seq) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        ends = ends[bounds]
        if ranks is None:
            own, sizes = self.plain, self.plain_len
        else:
            sizes = self.plain_len[ranks]
            own = self.plain[_spans(self.plain_at[ranks], sizes)]
        good = ends[1:] - ends[:-1] == sizes
        if not good.all() or not np.array_equal(got, own):
            own_ends = np.cumsum(sizes)
            for k in range(len(good)):
                good[k] = np.array_equal(got[ends[k] : ends[k + 1]], own[own_ends[k] - sizes[k] : own_ends[k]])
        return good

    def expand(self, nodes, steps=None, more=None):
        """Arcs of the default paths from nodes, one after the other, with bounds.

        ``steps``: for each node the number of arcs (negative: to the end); ``more``: an arc to be put after them (negative: none).
        """
        at, node, got, step = np.arange(len(nodes)), nodes.copy(), [], 0
        while True:
            on = node >= self.ends
            if steps is not None:
                on &= steps[at] != step
            at, node = at[on], node[on]
            if not len(at):
                break
            arc = self.best[node]
            got.append((at, arc))
            node = self.to[arc]
            step += 1
        if more is not None:
            own = np.flatnonzero(more >= 0)
            got.append((own, more[own]))
        if not got:
            return np.zeros(0, np.int64), np.zeros(len(nodes) + 1, np.int64)
        at, arc = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(at, kind="stable")
        return arc[order], np.searchsorted(at[order], np.arange(len(nodes) + 1))


def _spans(first, sizes) -> np.ndarray:
    """The places of spans, one after the other, given by their first places and their sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _salted(key, salt: int) -> np.ndarray:
    """Row keys for one kind of draw."""
    return mix64(key + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _uniform(salted, at) -> np.ndarray:
    """Numbers in (0, 1) from salted row keys and the place of the draw."""
    x = mix64(salted + at.astype(np.uint64))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _below(location, bound, u):
    """A Gumbel variable of a location, given that it lies below a bound."""
    # exp(-exp(loc - g)) = u * exp(-exp(loc - bound))
    with np.errstate(divide="ignore", over="ignore"):
        return location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(u))


def _mix(x: int) -> int:
    """``mix64`` of one number."""
    x &= _M
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _M
    return x ^ x >> 33


def _uniform1(key: int, salt: int, at: int) -> float:
    """``_uniform`` of one draw."""
    return ((_mix(_mix(key + salt * 0x9E3779B97F4A7C15) + at) >> 11) + 0.5) * 2.0**-53


_M = (1 << 64) - 1
#: A draw's place: the word's number, then the run of choices within the word (both below 2 ** 31).
_RUNS = 1 << 31


def _leave(lat: Lattices, nodes, keys, place):
    """Where choices leave the default paths of nodes, given that they do: (steps kept, arc taken, log-probability of that choice)."""
    at, node = np.arange(len(nodes)), nodes.copy()
    kept, taken, logp = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.zeros(len(nodes))
    keys, draw = mix64(keys + place.astype(np.uint64)), np.zeros(1, np.int64)  # a stream of its own for each place
    while len(at):
        best = lat.best[node]
        gone = -np.expm1(np.minimum(lat.logq[best], 0.0))  # probability of another arc here
        stay = np.exp(lat.logq[best]) * -np.expm1(lat.logd[lat.to[best]])
        u = _uniform(keys[at], draw) * (gone + stay)
        now = u < gone
        k = np.flatnonzero(now)
        if len(k):  # the first arc, without the default one, at which the mass exceeds the draw
            lo, hi, mass, want = lat.arc[node[k]].copy(), lat.arc[node[k] + 1], np.zeros(len(k)), u[k]
            last = lo.copy()
            open_ = np.arange(len(k))
            while len(open_):
                a = lo[open_]
                other = a != best[k[open_]]
                mass[open_] += np.where(other, np.exp(lat.logq[a]), 0.0)
                last[open_] = np.where(other, a, last[open_])
                lo[open_] += 1
                open_ = open_[(~other | (mass[open_] <= want[open_])) & (lo[open_] < hi[open_])]
            taken[at[k]] = last
            logp[at[k]] += lat.logq[last]
        k = np.flatnonzero(~now)
        kept[at[k]] += 1
        logp[at[k]] += lat.logq[best[k]]
        at, node = at[k], lat.to[best[k]]
        draw += 1
    return kept, taken, logp


class Found:
    """A segmentation: which words leave their default path, and by which arcs."""

    __slots__ = ("words", "at", "arcs", "logp", "score")

    def __init__(self, words, at, arcs, logp, score):
        self.words, self.at, self.arcs, self.logp, self.score = words, at, arcs, logp, score


def sample_batch(vocab: Vocabulary, trie: Trie, texts, keys, k: int):
    """The lattices of a batch and, for each text, its words, up to ``k`` segmentations in descending order, kappa and log weight.

    All texts advance together: emission e of every text is one vectorised pass.
    """
    split = vocab.split.findall
    chunks = [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__  # a word's number is the number of words before it
    number = seen.__getitem__
    kinds = [np.fromiter(map(number, c), np.int32, len(c)) for c in chunks]
    lat = Lattices(vocab, trie, list(seen))
    kinds = [lat.rank[x] for x in kinds]
    key = np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64)
    found, kappa = [], []
    for at, end in _parts(kinds):
        f, c = _emit(lat, kinds[at:end], key[at:end], k)
        found += f
        kappa += c
    return lat, kinds, found, kappa, [float(lat.total[x].sum()) for x in kinds]


def _parts(kinds):
    """Ranges of texts that fit the cache."""
    at = 0
    while at < len(kinds):
        end, size = at, 0
        while end < len(kinds) and (end == at or size + len(kinds[end]) <= PART_WORDS):
            size += len(kinds[end])
            end += 1
        yield at, end
        at = end


def _emit(lat: Lattices, kinds, key, k: int):
    """Up to ``k`` segmentations of each text, given by the numbers of its words, and kappa."""
    n = len(kinds)
    none = np.zeros(0, np.int64)
    found: list = [[] for _ in range(n)]
    heaps: list = [[] for _ in range(n)]
    for d, g in enumerate((-np.log(-np.log(_uniform(_salted(key, 0), np.zeros(1, np.int64))))).tolist()):
        if len(kinds[d]):
            heaps[d].append((-g, 0, None))  # the root: all segmentations, log weight 0
        else:
            found[d].append(Found(none, np.zeros(1, np.int64), none, 0.0, g))
    for e in range(k):
        jobs = [(d, *heapq.heappop(heaps[d])) for d in range(n) if heaps[d]]
        if not jobs:
            break
        # what each text has before its fresh words: the path it branches off from, and the branching word's arcs so far
        heads, nodes, place, gaps = [], [], [], []
        for d, neg, _, node in jobs:
            if node is None:
                head, first, at = (None, 0, none, 0.0), 0, None
            else:
                head, first, at = _branch(lat, kinds[d], node, -neg, int(key[d]), e, heaps[d])
            rest = lat.start[kinds[d][first:]]
            places = np.arange(first, first + len(rest))
            if at is not None and at >= lat.ends:
                rest, places = np.concatenate(([at], rest)), np.concatenate(([first - 1], places))
            heads.append((*head, first, at))
            nodes.append(rest)
            place.append(places)
            gaps.append(len(rest))
        gaps = np.array(gaps)
        text = np.repeat(np.arange(len(jobs), dtype=np.int32), gaps)
        node, place = np.concatenate(nodes), np.concatenate(place)
        of = key[np.array([j[0] for j in jobs], np.int64)]
        of1, of2, of3 = (_salted(of, 4 * e + k) for k in (1, 2, 3))
        # rows: (item, run, node, log-probability of the outcome, steps kept, arc) with arc -1 for the default path
        item = np.arange(len(node), dtype=np.int32)
        rows, run = [], 0
        while len(item):
            spot = place[item] * _RUNS + run
            u = _uniform(of1[text[item]], spot)
            own = node if run == 0 else node_now
            off = np.flatnonzero(u >= lat.prob[own])
            kept, arc, logp = np.zeros(len(item), np.int32), np.full(len(item), -1, np.int32), lat.logd[own]
            if len(off):
                kept[off], arc[off], logp[off] = _leave(lat, own[off], of2[text[item[off]]], spot[off])
            rows.append((item, np.full(len(item), run, np.int32), own, logp, kept, arc))
            to = lat.to[arc[off]]
            on = to >= lat.ends
            item, node_now = item[off[on]], to[on]
            run += 1
        r_item, r_run, r_node, r_logp, r_kept, r_arc = (np.concatenate([r[c] for r in rows]) for c in range(6)) if rows else (none, none, none, np.zeros(0), none, none)
        if run > 1:
            order = np.argsort(r_item, kind="stable")  # runs of one item stay in their order
            r_item, r_run, r_node, r_logp, r_kept, r_arc = (x[order] for x in (r_item, r_run, r_node, r_logp, r_kept, r_arc))
        r_text = text[r_item]
        cuts = np.searchsorted(r_text, np.arange(len(jobs) + 1))
        before, total = np.empty(len(r_logp)), np.zeros(len(jobs))  # by text, so that rounding does not depend on its neighbours
        for j in range(len(jobs)):
            lo, hi = cuts[j], cuts[j + 1]
            if hi > lo:
                upto = np.cumsum(r_logp[lo:hi])
                total[j] = upto[-1]
                before[lo] = heads[j][3]
                before[lo + 1 : hi] = heads[j][3] + upto[:-1]
        bound = np.array([-j[1] for j in jobs])
        # sets that branch off: all outcomes of a row but the one taken
        other = lat.logr[r_node]
        left = np.flatnonzero(r_arc >= 0)
        with np.errstate(divide="ignore"):
            other[left] = np.log(-np.expm1(np.minimum(r_logp[left], 0.0)))
        at = np.flatnonzero(other > -np.inf)
        g = _below(before[at] + other[at], bound[r_text[at]], _uniform(of3[r_text[at]], place[r_item[at]] * _RUNS + r_run[at]))
        at_cuts = np.searchsorted(r_text[at], np.arange(len(jobs) + 1))
        picks = _largest(g, at_cuts, k - e)  # no more branches than that can still come out, kappa included
        # words that left their default path, with all their arcs
        odd = np.flatnonzero((r_arc >= 0) | (r_run > 0))
        o_arcs, o_at = lat.expand(r_node[odd], np.where(r_arc[odd] < 0, -1, r_kept[odd]), r_arc[odd])
        o_place = place[r_item[odd]]
        o_first = np.ones(len(odd), bool)
        o_first[1:] = r_item[odd][1:] != r_item[odd][:-1]
        o_cuts = np.searchsorted(odd, cuts)
        for j, (d, neg, _, _) in enumerate(jobs):
            lo, hi = cuts[j], cuts[j + 1]
            x, y = o_cuts[j], o_cuts[j + 1]
            starts = np.flatnonzero(o_first[x:y]) + x
            fresh_words, fresh_at, fresh_arcs = o_place[starts], np.append(o_at[starts], o_at[y]) - o_at[x], o_arcs[o_at[x] : o_at[y]]
            words, bounds, arcs = _join(lat, heads[j], fresh_words, fresh_at, fresh_arcs)
            path = Found(words, bounds, arcs, float(total[j]) + heads[j][3], -neg)
            found[d].append(path)
            for x in picks[j]:
                r = at[x]
                taken = (-1,) if r_arc[r] < 0 else (int(r_kept[r]), int(r_arc[r]))
                heapq.heappush(heaps[d], (-float(g[x]), (e << 40) + int(r) + 1, (path, int(place[r_item[r]]), int(r_node[r]), (taken,), float(before[r]))))
    return found, [-heaps[d][0][0] if heaps[d] else -math.inf for d in range(n)]


def _largest(g, cuts, want: int) -> list[list[int]]:
    """The places of the ``want`` largest numbers (all, if fewer) of each range between ``cuts``."""
    out: list = [[] for _ in range(len(cuts) - 1)]
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    if want > 16:  # sorting takes less
        for j in some.tolist():
            out[j] = (cuts[j] + np.argsort(-g[cuts[j] : cuts[j + 1]], kind="stable")[:want]).tolist()
        return out
    g, left = g.copy(), cuts[1:] - cuts[:-1]
    sizes = left[some]
    for step in range(want if len(some) else 0):
        top = np.maximum.reduceat(g, cuts[some])
        at = np.flatnonzero(g == np.repeat(top, sizes))
        at = at[np.searchsorted(at, cuts[some])]  # the first of equals
        for j, x in zip(some.tolist(), at.tolist()):
            if left[j] > step:
                out[j].append(x)
        g[at] = -np.inf
    return out


def _default(lat: Lattices, node: int, steps: int) -> list[int]:
    """The first arcs of a node's default path (all of them if ``steps`` is negative)."""
    out = []
    while node >= lat.ends and steps != 0:
        a = int(lat.best[node])
        out.append(a)
        node = int(lat.to[a])
        steps -= 1
    return out


def _branch(lat: Lattices, kinds, node, bound: float, key: int, e: int, heap):
    """Takes the best outcome of a set and puts what is left of the set back on the heap.

    A set is (path, word, lattice node, outcomes taken, log weight of the node's set). Returns
    (path, word, arcs of that word before the next choice, log weight) with the number of the next whole word
    and the lattice node to go on from in the branching word.
    """
    path, word, at, banned, loc = node
    outcomes = [((-1,), float(lat.logd[at]))]
    now, kept, logp = at, 0, 0.0
    while now >= lat.ends:
        best, first = int(lat.best[now]), int(lat.arc[now])
        own = lat.logq[first : int(lat.arc[now + 1])].tolist()
        if len(own) > 1:
            outcomes.extend([((kept, first + i), logp + x) for i, x in enumerate(own) if first + i != best])
        logp += own[best - first]
        now, kept = int(lat.to[best]), kept + 1
    outcomes = [o for o in outcomes if o[0] not in banned]
    q = [math.exp(o[1]) for o in outcomes]
    mass, spot = sum(q), word * _RUNS + len(banned)
    want, pick = _uniform1(key, 4 * e, spot) * mass, 0
    while pick < len(q) - 1 and want >= q[pick]:
        want -= q[pick]
        pick += 1
    outcome, lp = outcomes[pick]
    rest = mass - q[pick]
    if len(q) > 1 and rest > 0:
        at_ = loc + math.log(rest)
        g = at_ - math.log(math.exp(min(at_ - bound, 700.0)) - math.log(_uniform1(key, 4 * e, spot + (1 << 63))))
        heapq.heappush(heap, (-g, (e << 40), (path, word, at, (*banned, outcome), loc)))
    # arcs of the branching word before this node
    k = int(np.searchsorted(path.words, word))
    if k < len(path.words) and path.words[k] == word:
        so_far, now = [], int(lat.start[kinds[word]])
        for a in path.arcs[path.at[k] : path.at[k + 1]].tolist():
            if now == at:
                break
            so_far.append(a)
            now = int(lat.to[a])
    else:
        so_far = []
    if outcome == (-1,):
        so_far = so_far + _default(lat, at, -1)
        to = -1
    else:
        so_far = so_far + _default(lat, at, outcome[0]) + [outcome[1]]
        to = int(lat.to[outcome[1]])
    return (path, word, np.array(so_far, np.int64), loc + lp), word + 1, to


def _join(lat, head, words, at, arcs):
    """The words off their default path: those of the path branched off from, the branching word, then the fresh ones."""
    path, word, so_far, _, _, to = head
    if path is None:
        return words, at, arcs
    k = int(np.searchsorted(path.words, word))
    if len(words) and words[0] == word:  # goes on with choices of its own
        at = np.concatenate(([0], at[1:] + len(so_far)))
        own = so_far
    else:
        own = np.concatenate((so_far, np.array(_default(lat, to, -1), np.int64)))
        words, at = np.concatenate(([word], words)), np.concatenate(([0], at + len(own)))
    before = path.at[k]
    return np.concatenate((path.words[:k], words)), np.concatenate((path.at[:k], at + before)), np.concatenate((path.arcs[:before], own, arcs))


def path_arcs(lat: Lattices, kinds, path: Found) -> np.ndarray:
    """All arcs of a segmentation of a text with the words ``kinds``."""
    return batch_arcs(lat, [kinds], [path])[0]


def batch_arcs(lat: Lattices, kinds, paths):
    """All arcs of one segmentation of each text, one text after the other, their bounds, and whether each decodes.

    A segmentation decodes if its words do; those on their default path are decoded once for all.
    """
    counts = np.fromiter(map(len, kinds), np.int64, len(kinds))
    base = np.cumsum(counts) - counts
    words = np.concatenate(kinds)
    n = lat.path_len[words].astype(np.int64)
    odd_counts = np.fromiter((len(p.words) for p in paths), np.int64, len(paths))
    odd = np.concatenate([p.words for p in paths]) + np.repeat(base, odd_counts)
    arcs = np.concatenate([p.arcs for p in paths])
    size = np.concatenate([p.at[1:] - p.at[:-1] for p in paths])
    n[odd] = size
    ends = np.cumsum(n)
    shift = lat.path_at[words] - (ends - n)
    at = np.cumsum(size)
    shift[odd] = len(lat.path) + (at - size) - (ends - n)[odd]
    total = int(ends[-1]) if len(ends) else 0
    out = np.concatenate((lat.path, arcs))[np.repeat(shift, n) + np.arange(total)]
    bounds = np.concatenate(([0], ends))[np.concatenate((base, [len(words)]))]
    good = np.ones(len(words), bool) if lat.all_good else lat.good[words]
    good[odd] = lat.decoded(arcs, np.concatenate(([0], at)), words[odd])
    bad = np.concatenate(([0], np.cumsum(~good)))[np.concatenate((base, [len(words)]))]
    return out, bounds, bad[1:] == bad[:-1]


def ids_of(lat: Lattices, arcs, bounds=None):
    """Piece ids of a path, or of paths one after the other with their ``bounds`` (then with the bounds of the ids)."""
    seq = lat.seq[arcs]
    if not len(seq) or seq.min() >= 0:
        return seq if bounds is None else (seq, bounds)
    size = np.array([1] + [len(x) for x in lat.spelt], np.int64)
    flat = np.array([i for x in lat.spelt for i in x], np.int64)
    first = np.concatenate(([0, 0], np.cumsum(size[1:])))[:-1]
    kind = np.maximum(-seq, 0)
    n = size[kind]
    ends = np.cumsum(n)
    step = np.arange(ends[-1]) - np.repeat(ends - n, n)
    spelt = np.repeat(kind, n)
    ids = np.where(spelt > 0, flat[np.minimum(first[spelt] + step, len(flat) - 1)], np.repeat(seq, n))
    return ids if bounds is None else (ids, np.concatenate(([0], ends))[bounds])


def decode_ids(ids, raw: list[bytes]) -> str:
    """The text of piece ids: bytes of the pieces, without the space put before the text."""
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
    return text[1:] if text[:1] == " " else text


def decodes(ids, raw: list[bytes], text: bytes) -> bool:
    """Whether piece ids decode to a text given as bytes (see ``decode_ids``)."""
    got = b"".join(map(raw.__getitem__, ids))
    return got[1:] == text if got[:1] == b" " else got == text


def digest_of(ids: np.ndarray, codes: np.ndarray) -> int:
    """A 64-bit digest of piece ids and their places; ``codes`` has a number for every piece."""
    return int(digests_of(ids, np.array([0, len(ids)]), codes)[0])


def digests_of(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The digests of id sequences one after the other."""
    n = bounds[1:] - bounds[:-1]
    place = 2 * (np.arange(len(ids)) - np.repeat(bounds[:-1], n)) + 1
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(codes[ids] * place.astype(np.uint64), bounds[some])
    return out.view(np.int64)


def _worker(model: bytes) -> tuple[Vocabulary, Trie]:
    """The vocabulary in this worker process; it outlives a task."""
    mark = hash(model)
    if _STATE.get("mark") != mark:
        vocab = Vocabulary(model)
        _STATE["mark"], _STATE["vocab"] = mark, (vocab, Trie(vocab))
    return _STATE["vocab"]


def _runs(batch):
    """Slices of a batch of bounded text."""
    texts = batch.column("__text").to_pylist()
    at, size = 0, 0
    whole = sum(len(t or "") for t in texts)
    most = -(-whole // max(1, -(-whole // BATCH_CHARS)))  # runs of about the same size
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > most:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def _encode(model: bytes, k: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        vocab, trie = _worker(model)
        codes = mix64(np.arange(1, len(vocab.raw) + 1))
        names = ["rank", "n_pieces", "log_prob", "log_total", "perturbed", "inclusion", "decodes", "digest"] + ["ids"] * with_ids
        for whole in batches:
            for b, texts in _runs(whole):
                lat, kinds, found, kappa, z = sample_batch(vocab, trie, [t or "" for t in texts], b.column("__key").to_pylist(), k)
                parts = []
                for at, end in _parts(kinds):
                    for r in range(max(map(len, found[at:end]))):
                        rows = [d for d in range(at, end) if r < len(found[d])]
                        paths = [found[d][r] for d in rows]
                        arcs, bounds, same = batch_arcs(lat, [kinds[d] for d in rows], paths)
                        ids, bounds = ids_of(lat, arcs, bounds)
                        for j, d in enumerate(rows):
                            if SPACE in (texts[d] or ""):  # decoded as a space, so words don't tell
                                same[j] = decodes(ids[bounds[j] : bounds[j + 1]].tolist(), vocab.raw, texts[d].encode("utf-8", "surrogatepass"))
                        logp, kap = np.array([p.logp for p in paths]), np.array([kappa[d] for d in rows])
                        with np.errstate(invalid="ignore"):
                            incl = np.where(kap == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(700.0, logp - kap))))
                        cols = [np.full(len(rows), r + 1, np.int32), bounds[1:] - bounds[:-1], logp, np.array([z[d] for d in rows]), np.array([p.score for p in paths]), incl, same, digests_of(ids, bounds, codes)]
                        cols = [pa.array(c) for c in cols]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        own = b.drop_columns(["__text", "__key"]).take(pa.array(rows, pa.int64()))
                        parts.append(pa.RecordBatch.from_arrays([*own.columns, *cols], [*own.schema.names, *names]))
                del lat, kinds, found, kappa, z  # before the next lattices are built
                while parts:
                    yield parts.pop(0)

    return frugal(run)


def sample_segmentations(
    df: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    seed: int = 0,
    keep: list[str] | None = None,
    with_ids: bool = True,
    model: bytes | None = None,
) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text, sampled without replacement.

    For each row of ``df`` and each rank (from 1, by falling perturbed score): ``keep``
    columns, rank, n_pieces, log_prob (of the segmentation given the text), log_total (log
    weight of all segmentations), perturbed, inclusion (1 if there are no more than ``k``), decodes (whether
    the pieces decode to the text), digest (of the ids) and, if wanted, ids. Draws are seeded
    by ``seed`` and the row's key; rows of equal key and text get the same draws, null keys
    count as one key. A null or empty text has one segmentation without pieces. Texts are
    used whole. An empty table gives an empty result.
    """
    from pyspark.sql import types as T

    ship(df.sparkSession)
    names = [key_col] if keep is None else keep
    rows = df.select(*names, F.col(text_col).alias("__text"), F.xxhash64(F.lit(seed), F.col(key_col)).alias("__key"))
    schema = T.StructType(rows.schema.fields[:-2])
    for c, t in (("rank", "int"), ("n_pieces", "long"), ("log_prob", "double"), ("log_total", "double"), ("perturbed", "double"), ("inclusion", "double"), ("decodes", "boolean"), ("digest", "long")):
        schema = schema.add(c, T.DataType.fromDDL(t))
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_encode(default_model() if model is None else model, k, with_ids), schema)


def decode(df: DataFrame, ids_col: str = "ids", to: str = "text", model: bytes | None = None) -> DataFrame:
    """Adds the text of a column of piece ids (null for null)."""
    from pyspark.sql import types as T

    ship(df.sparkSession)
    model = default_model() if model is None else model

    def run(batches):
        import pyarrow as pa

        raw = _worker(model)[0].raw
        for b in batches:
            texts = [None if i is None else decode_ids(i, raw) for i in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields]).add(to, T.StringType()))
