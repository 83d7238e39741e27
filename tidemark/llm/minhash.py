"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

Two permutations of the shingle universe [0, 2**32) make the whole signature: shingles go
through the first, and coordinate k is the smallest value of the second after a circular
shift by k strides. Documents with equal shingle sets are one node. Nodes that share a band
are linked to the band's smallest node; these links are checked on full shingle sets, and
connected components are formed. Members of a band that are still apart are then
compared among themselves by signature (blocks of rows, in numpy), and pairs that can
reach the threshold are checked exactly unless a chain of links joins them already, so a
failed star loses no link. Groups of any size give rows in proportion to their members and
not to their pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, frugal, ship
from .tokens import mix64, word_hashes

WIDTH = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 36, 4
BATCH_ROWS = 256
#: Band members compared in one task, and members checked against one leader in one task.
BLOCK = 2048
CHECKED = 64
#: Standard errors below the threshold at which a signature is given up.
SLACK = 5.0


def _shingles(texts, width: int):
    """The distinct shingle hashes of each text, one text after the other and sorted within each, with bounds.

    A text with fewer words than ``width`` has its whole sequence as one shingle; without
    words it has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    mult = np.uint64(0x9E3779B97F4A7C15)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(words) >= width:
        h = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            h = (h ^ (h >> np.uint64(29))) * mult + words[k : len(words) - width + 1 + k]
        doc = np.repeat(np.arange(len(n)), n)[: len(h)]
        ok = np.arange(len(h)) + width <= at[doc + 1]
        h, doc = mix64(h[ok]), doc[ok]
    else:
        h, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(few):
        short = []
        for d in few:
            x = np.uint64(n[d])
            with np.errstate(over="ignore"):
                for w in words[at[d] : at[d + 1]]:
                    x = (x ^ (x >> np.uint64(29))) * mult + w
            short.append(x)
        h, doc = np.concatenate((h, mix64(np.array(short, np.uint64)))), np.concatenate((doc, few))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of [0, 2**32), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x


def signatures(h: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash signatures (texts x size); rows of texts without shingles are all ones."""
    n = np.diff(bounds)
    out = np.full((len(n), size), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    first = (h >> np.uint64(32)).astype(np.uint32)  # the first permutation: the mixer's high half
    stride = 0x9E3779B1  # odd, so that all shifts differ
    at = 0
    while at < len(has):  # slices of texts that fit the cache
        end = at + 1
        while end < len(has) and bounds[has[end] + 1] - bounds[has[at]] < 1 << 15:
            end += 1
        lo, hi = bounds[has[at]], bounds[has[end - 1] + 1]
        part, starts = first[lo:hi], bounds[has[at:end]] - lo
        for k in range(size):
            out[has[at:end], k] = np.minimum.reduceat(_second(part + np.uint32(k * stride & 0xFFFFFFFF)), starts)
        at = end
    return out


def _digest(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set, as 16 bytes; equal for equal sets."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    has = np.flatnonzero(np.diff(bounds))
    if len(has):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[has, k] = np.add.reduceat(mix64(h ^ np.uint64(salt)), bounds[has])
    return out


def _names(h: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The node of each set: its digest (empty for an empty set)."""
    return [r.tobytes() if n else b"" for r, n in zip(_digest(h, bounds), np.diff(bounds))]


def _sketch(width: int, size: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(k, BATCH_ROWS)
                h, bounds = _shingles(b.column("text").to_pylist(), width)
                n = np.diff(bounds)
                sig = signatures(h, bounds, size)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("key"), pa.array(n, pa.int64()), pa.array(_names(h, bounds), pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "key", "n", "node", "sig"]
                )

    return run


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The key of each band of each signature (signatures x bands)."""
    out = np.empty((len(sig), bands), np.int64)
    for k in range(bands):
        x = np.full(len(sig), k + 1, np.uint64)
        for r in range(rows):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * rows + r])
        out[:, k] = x.view(np.int64)
    return out


def _bands(bands: int, rows: int):
    """(band key, node) rows of the signatures."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                keys = _band_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1), bands, rows)
                for k in range(bands):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), b.column("node")], ["band", "node"])

    return run


def _verify(width: int, threshold: int):
    """Checks each member's text against its leader's; rows come sorted by leader, part and role (leader first)."""

    def run(batches):
        import pyarrow as pa

        leader, own = None, None
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(k, BATCH_ROWS)
                h, bounds = _shingles(b.column("text").to_pylist(), width)
                names = _names(h, bounds)
                leaders, members = b.column("leader").to_pylist(), b.column("member").to_pylist()
                out = []
                for j, (a, m) in enumerate(zip(leaders, members)):
                    if names[j] != m:  # another text of the same key
                        continue
                    s = h[bounds[j] : bounds[j + 1]]
                    if a == m:
                        leader, own = a, s
                    elif a == leader:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= threshold * (len(own) + len(s) - both) and both:
                            out.append((a, m))
                    else:
                        raise RuntimeError("a link's first text is missing")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["leader", "member"])

    return run


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (leader, member) of nodes whose shingle sets reach the threshold.

    A leader's members are dealt over parts of ``CHECKED``, each with the leader's text.
    """
    pairs = pairs.withColumn("n", F.xxhash64("member"))
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("c")).withColumn("parts", F.ceil(F.col("c") / CHECKED).cast("int"))
    members = pairs.join(sizes, "leader").select("leader", "member", F.pmod("n", F.col("parts")).cast("int").alias("part"))
    leads = members.select("leader", F.col("leader").alias("member"), "part").distinct()
    asked = members.unionByName(leads)
    # a node's text is that of its representative row
    asked = asked.join(nodes.select(F.col("node").alias("member"), "rep"), "member")
    with_text = asked.join(texts.select(F.col("key").alias("rep"), "text"), "rep")
    lined = with_text.select("leader", "part", "member", "text").repartition(_parts(pairs), "leader", "part")
    lined = lined.sortWithinPartitions("leader", "part", (F.col("member") != F.col("leader")))
    return lined.select("leader", "member", "text").mapInArrow(frugal(_verify(width, threshold)), "leader binary, member binary")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in a link (columns a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps; the links are checkpointed in every round
    and the number of rounds grows with the logarithm of the links.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = cut(small.where("a <> b").distinct())
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        was = edges.agg(F.count(F.lit(1)), mark).first()
        now = new.agg(F.count(F.lit(1)), mark).first()
        edges = new
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _candidates(table, sig, threshold: int, bands: int, rows: int):
    """Pairs (i, j, matches) of a group that lie in different components, may reach the threshold by signature, and share no earlier band."""
    n = table.num_rows
    code = {r: k for k, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
    comp = np.array([code[r] for r in table.column("root").to_pylist()])
    part, crossed = table.column("part").to_numpy(), table.column("crossed")[0].as_py()
    band = bytes(table.column("band")[0].as_py().to_bytes(8, "little", signed=True))
    j = threshold / 100
    least = max(1.0, sig.shape[1] * (j - SLACK * (j * (1 - j) / sig.shape[1]) ** 0.5))
    keys = _band_keys(sig, bands, rows)
    own = int(np.flatnonzero((keys == np.frombuffer(band, np.int64)[0]).any(axis=0))[0])
    at = np.arange(n)
    for i in range(n):
        others = at[(comp != comp[i]) & (at > i)]
        if crossed:
            others = others[part[others] != part[i]]
        if not len(others):
            continue
        same = (sig[others] == sig[i]).sum(axis=1)
        ok = same >= least
        others, same = others[ok], same[ok]
        if own and len(others):
            new = ~(keys[others, :own] == keys[i, :own]).any(axis=1)
            others, same = others[new], same[new]
        if len(others):
            yield i, others, same


def _open(threshold: int, bands: int, rows: int):
    """The members of a group that have a candidate pair in it."""

    def run(key, table):
        import pyarrow as pa

        use = np.zeros(table.num_rows, bool)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(table.num_rows, -1)
        for i, others, _ in _candidates(table, sig, threshold, bands, rows):
            use[i] = True
            use[others] = True
        return table.select(["band", "x", "y", "node", "root", "part", "crossed"]).filter(pa.array(use))

    return run


def _connect(width: int, threshold: int, bands: int, rows: int):
    """Links that connect a group: its candidate pairs, likeliest first, are checked on full sets unless already connected."""

    def run(key, table):
        import pyarrow as pa

        names = table.column("node").to_pylist()
        h, bounds = _shingles(table.column("text").to_pylist(), width)
        right = [a == b for a, b in zip(_names(h, bounds), names)]  # not another text of the same key
        found = [(np.full(len(o), i, np.int32), o.astype(np.int32), same.astype(np.int32)) for i, o, same in _candidates(table, signatures(h, bounds, bands * rows), threshold, bands, rows)]
        left, right_, same = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int32) for k in range(3))
        order = np.lexsort((right_, left, -same))
        root = list(range(len(names)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first: dict = {}
        for k, r in enumerate(table.column("root").to_pylist()):  # what is connected already
            root[k] = first.setdefault(r, k)
        a, b = [], []
        sizes = np.diff(bounds)
        close = 100 * np.minimum(sizes[left], sizes[right_]) >= threshold * np.maximum(sizes[left], sizes[right_])
        for k in order[close[order]]:
            i, o = int(left[k]), int(right_[k])
            x, y = find(i), find(o)
            if x == y or not (right[i] and right[o]):
                continue
            s, t = h[bounds[i] : bounds[i + 1]], h[bounds[o] : bounds[o + 1]]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and 100 * both >= threshold * (len(s) + len(t) - both):
                root[x] = y
                a.append(names[i])
                b.append(names[o])
        return pa.table({"leader": pa.array(a, pa.binary()), "member": pa.array(b, pa.binary())})

    return run


def _left_apart(members: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, width: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """Checked links among what the stars left apart, from bands with more than one component.

    ``members``: (band, node) of shared bands. A band of more than BLOCK members is split
    into parts; each pair of parts is one group, so all pairs are met. A pair is looked at in
    the first band it shares. A group gives fewer links than it has members.
    """
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    spread = spread.select("band", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    open_ = named.join(spread, "band").join(nodes.select("node", "sig"), "node")
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    grouped = other.select("band", lo.alias("x"), hi.alias("y"), "node", "root", "sig", "part", (F.col("part") != F.col("other")).alias("crossed"))
    schema = "band long, x int, y int, node binary, root binary, part int, crossed boolean"
    asked = grouped.groupBy("band", "x", "y").applyInArrow(_open(threshold, bands, rows), schema)
    asked = asked.join(nodes.select("node", "rep"), "node").join(texts.select(F.col("key").alias("rep"), "text"), "rep")
    # rows of one node and text may repeat (rows equal in identifier and text); once is enough
    asked = asked.select("band", "x", "y", "node", "root", "part", "crossed", "text")
    return asked.groupBy("band", "x", "y").applyInArrow(_connect(width, threshold, bands, rows), "leader binary, member binary")


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each row of ``df``: the identifier, n_shingles, component_id (the smallest identifier that can be reached) and kept.

    Words are runs without white space, A-Z lower-cased. Null and empty texts have no
    shingles: they are linked with nothing, and their component is their own identifier.
    Rows with equal texts, also under one identifier, are one node; a null identifier
    takes part in links but never names a component unless all its members are null.
    Texts are used whole. An empty table gives an empty result; other columns are not read.
    """
    out = _groups(df, id_col, text_col, width, threshold, bands, rows)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _key(id_col: str, text_col: str) -> Column:
    """Finds a row's text, or the row, again."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _groups(df: DataFrame, id_col: str, text_col: str, width: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """``near_groups`` with the columns id, key, n, node, root (null without shingles), component_id and kept."""
    ship(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _key(id_col, text_col).alias("key"))
    sketched = cut(texts.mapInArrow(frugal(_sketch(width, bands * rows)), "id long, key long, n long, node binary, sig binary"))
    filled = sketched.where("n > 0")
    # copies of a set: the smallest identifier stands for all
    nodes = cut(filled.groupBy("node").agg(F.min("id").alias("id"), F.min("key").alias("rep"), F.max("sig").alias("sig")))
    links = near_links(nodes, texts, width, threshold, bands, rows)
    roots = components(links.select(F.col("leader").alias("a"), F.col("member").alias("b")))
    # linked nodes get the smallest identifier of their component, all others keep their own
    linked = cut(nodes.select("node", "id").join(roots, "node"))
    lowest = cut(linked.groupBy("root").agg(F.min("id").alias("lowest")))
    named = cut(linked.join(lowest, "root").select("node", "root", "lowest"))
    named = nodes.select("node", F.col("id").alias("own")).join(named, "node", "left")
    named = named.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("lowest", "own").alias("component_id"))
    out = sketched.select("id", "key", "n", "node").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("id")))


def near_links(nodes: DataFrame, texts: DataFrame, width: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """Checked links (leader, member) that connect all nodes whose sets reach the threshold."""
    banded = nodes.select("node", "sig").mapInArrow(frugal(_bands(bands, rows)), "band long, node binary")
    heads = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "leader")
    members = cut(banded.join(heads, "band"))
    stars = members.where("leader <> node").select("leader", F.col("node").alias("member")).distinct()
    reps = nodes.select("node", "rep")
    sure = cut(verified(stars, reps, texts, width, threshold))
    roots = cut(components(sure.select(F.col("leader").alias("a"), F.col("member").alias("b"))))
    return sure.unionByName(_left_apart(members.select("band", "node"), nodes, roots, texts, width, threshold, bands, rows))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``df`` that stay, with its own columns: of each group one row of the smallest identifier.

    Null and empty texts are in no group, so all these rows stay. Null identifiers come last. If several
    rows of a group carry its smallest identifier, the smallest hash of identifier and text
    decides, and of rows repeated in both any one stays.
    """
    marked = cut(_groups(df, id_col, text_col, width, threshold, bands, rows).select("id", "key", "n", "root"))
    best = marked.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("best"))
    often = marked.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.lit(True).alias("__often"))
    kept = best.select(F.col("best.key").alias("key")).distinct().join(often, "key", "left").unionByName(marked.where("n = 0").select("key", F.lit(False).alias("__often")).distinct())
    kept = cut(kept.select(F.col("key").alias("__key"), F.coalesce("__often", F.lit(False)).alias("__often")))
    out = df.join(kept, _key(id_col, text_col) == F.col("__key"))
    once = out.where("not __often").select(*df.columns)
    again = out.where("__often").groupBy("__key").agg(F.first(F.struct(*df.columns)).alias("__row")).select("__row.*")
    return once.unionByName(again)


__all__ = ["Column", "components", "near_dedup", "near_groups", "near_links", "signatures"]
