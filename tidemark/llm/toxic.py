"""Toxic passages by maximum-scoring segments of token log-odds.

Learning: each word and its prefixes are features; a feature's log-odds between toxic
and clean documents come from document counts with an informative Dirichlet prior (the
pooled rates of all documents), lowered by ``caution`` standard errors. Scoring: a word
carries the largest significant log-odds of its features, any other word a small cost.
All maximal scoring segments of a text are found in one pass (linear in the words). The
maximum of random segment scores follows an extreme-value law whose location grows
with log(words); scores are put on that scale, fitted to the clean training documents,
and the evidence of all significant segments is combined into one number that a
one-dimensional logistic fit turns into the probability of the label.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, frugal, ship
from .tokens import word_hashes

#: Bounds of what is fitted: labelled rows, and hashed features.
MAX_TRAIN_ROWS = 20_000
FEATURE_BITS = 20
PREFIXES = (4, 5, 6)
COST = 0.05
PRIOR = 20.0
CAUTION = 1.0
MIN_DOCS = 4
BATCH_ROWS = 512
FLOOR = 1.5
STRAY = 0.01


def train_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled identifiers, by smallest hash; an identifier with several labels has the largest."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    return one.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)


def _features(texts):
    """Feature numbers of each word (words x kinds) and the bounds of the texts."""
    out = word_hashes(texts, "alnum", PREFIXES)
    shift = np.uint64(64 - FEATURE_BITS)
    return np.stack([h >> shift for h in (out[0], *out[2:])], axis=1).astype(np.int64) if len(out[0]) else np.zeros((0, 1 + len(PREFIXES)), np.int64), out[1]


def _batches(batch, rows: int = BATCH_ROWS):
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _count(batches):
    import pyarrow as pa

    total = np.zeros((2, 1 << FEATURE_BITS), np.int32)
    docs = np.zeros(2, np.int64)
    for whole in batches:
        for b in _batches(whole):
            f, bounds = _features(b.column("text").to_pylist())
            for k, y in enumerate(b.column("__y").to_pylist()):
                total[y][np.unique(f[bounds[k] : bounds[k + 1]])] += 1
                docs[y] += 1
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_pydict({"f": np.concatenate(([-1], some)), "n0": np.concatenate((docs[:1], total[0][some].astype(np.int64))), "n1": np.concatenate((docs[1:], total[1][some].astype(np.int64)))})


def log_odds(n0, n1, docs0: int, docs1: int):
    """Cautious Dirichlet log-odds of features with n0 clean and n1 toxic documents."""
    n0, n1 = np.asarray(n0, float), np.asarray(n1, float)
    rate = (n0 + n1) / max(1, docs0 + docs1)
    share = docs1 / max(1, docs0 + docs1)
    a0, a1 = PRIOR * rate * (1 - share) + 0.1, PRIOR * rate * share + 0.1
    odds = np.log((n1 + a1) / (docs1 - n1 + a1 + 1)) - np.log((n0 + a0) / (docs0 - n0 + a0 + 1))
    return odds - CAUTION * np.sqrt(1 / (n1 + a1 + 0.4) + 1 / (n0 + a0 + 0.4))


def segments(values) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa)."""
    values = np.asarray(values, float)
    up = np.flatnonzero(values > 0)
    if not len(up):
        return []
    sums = np.concatenate(([0.0], np.cumsum(values)))
    stack: list[list] = []  # start, end, left sum, right sum, place of the nearest segment below with a smaller left sum
    for p in up:
        s = [int(p), int(p) + 1, sums[p], sums[p + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= s[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= s[3]:
                s[4] = j
                stack.append(s)
                break
            s = [stack[j][0], s[1], stack[j][2], s[3], -1]
            del stack[j:]
    return [(a, b, float(r - left)) for a, b, left, r, _ in stack]


def _evidence(values, model):
    """Segments and the evidence of a text: the summed excess of its segments over what a clean text of that length has."""
    found = segments(values)
    free = model["mu"] + math.log(max(1, len(values))) / model["lam"]
    kept = [(a, b, s) for a, b, s in found if s > free]
    total = sum((s - free) * model["lam"] for _, _, s in kept)
    best = max([s for _, _, s in found], default=0.0)
    return kept, (total if kept else (best - free) * model["lam"]), best


def extreme_law(best, n) -> tuple[float, float]:
    """Location and scale of the extreme-value law of texts of n words with these best segments, by moments.

    The variance of a few texts that repeat a marked word hundreds of times would hide all others. So best segments
    of which the law expects fewer than ``STRAY`` among all these texts are left out and the moments taken again,
    until none is. The texts count as before in all that follows.
    """
    best, size = np.asarray(best, float), np.log(np.maximum(1, np.asarray(n)))
    far = math.log(len(best) / STRAY)
    while True:
        lam = math.pi / math.sqrt(6) / max(0.25, float(best.std()))
        mu = float(np.mean(best - size / lam)) - 0.5772156649 / lam
        own = (best - mu) * lam - size <= far
        if own.all():
            return mu, lam
        best, size = best[own], size[own]


def _weights(model):
    w = np.full(1 << FEATURE_BITS, -COST, np.float32)
    w[model["f"]] = model["w"]
    return w


def _values(f, w):
    return w[f].max(axis=1) if len(f) else np.zeros(0, np.float32)


def _measure(model):
    """Number of words, best segment and evidence of each training document."""

    def run(batches):
        import pyarrow as pa

        w = _weights(model)
        for whole in batches:
            for b in _batches(whole):
                f, bounds = _features(b.column("text").to_pylist())
                v = _values(f, w)
                got = [_evidence(v[bounds[k] : bounds[k + 1]], model)[1:] for k in range(b.num_rows)]
                yield pa.RecordBatch.from_pydict({"n": np.diff(bounds), "best": [float(x[1]) for x in got], "total": [float(x[0]) for x in got], "y": b.column("__y")})

    return run


def fit(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: a dictionary of plain numbers and arrays, bounded by FEATURE_BITS.

    ``train`` (from ``train_rows``) is bounded by its row limit, so it is sent to all tasks.
    A training document is used with its whole text; texts that repeat count once. Without
    a toxic or without a clean training document every text gets the share of toxic ones.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null")
    rows = cut(rows.join(F.broadcast(train), "__id").select("text", "__y").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("__y").alias("__y")).select("text", "__y"))
    counted = rows.mapInArrow(frugal(_count), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # features of enough toxic documents, or the totals
    table = counted.where(f"f = -1 or n1 >= {MIN_DOCS}").toPandas()  # at most 2 ** FEATURE_BITS rows
    head = table[table.f == -1]
    docs0, docs1 = (int(head.n0.sum()), int(head.n1.sum()))
    prior = (docs1 + 0.5) / (docs0 + docs1 + 1)
    model = {"f": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "mu": 0.0, "lam": 1.0, "a": math.log(prior / (1 - prior)), "b": 0.0}
    if not docs0 or not docs1:
        return model
    table = table[table.f >= 0].sort_values("f")
    odds = log_odds(table.n0, table.n1, docs0, docs1)
    good = odds > FLOOR
    model |= {"f": table.f.to_numpy()[good], "w": odds[good].astype(np.float32)}

    def measured():  # four numbers for each training row
        seen = rows.mapInArrow(frugal(_measure(model)), "n long, best double, total double, y int").toPandas()
        return seen.sort_values(["n", "best", "total", "y"])

    seen = measured()
    clean = seen[seen.y == 0]
    mu, lam = extreme_law(clean.best, clean.n)
    model |= {"lam": lam, "mu": mu}
    seen = measured()  # on that scale
    x = np.clip(seen.total, -20, 40).to_numpy()
    y = seen.y.to_numpy().astype(float)
    a, b = model["a"], 0.1
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        q = p * (1 - p)
        h = np.array([[q.sum() + 1e-3, (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return model | {"a": a, "b": max(b, 1e-6)}


def _score(model, text: str, names):
    def run(batches):
        import pyarrow as pa

        w = _weights(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for b in _batches(whole):
                f, bounds = _features(b.column(text).to_pylist())
                v = _values(f, w)
                spans, scores = [], []
                for k in range(b.num_rows):
                    own = v[bounds[k] : bounds[k + 1]]
                    kept, total, _ = _evidence(own, model)
                    x = min(40.0, max(-20.0, total))
                    spans.append([{"start": s, "end": e, "score": z} for s, e, z in kept])
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model["a"] + model["b"] * x)))))
                rest = b.drop_columns(["__text"]) if text == "__text" else b
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*rest.schema.names, *names])

    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """``keep`` columns (all by default) with the score and the passages (start and end in words, log-odds), under ``names``.

    Null and empty texts have no words: they get the score of a text without evidence and
    no passage. Rows are judged one by one, so repeats and other columns change nothing.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    extra = [] if text_col in kept else [F.col(text_col).alias("__text")]
    rows = docs.select(*kept, *extra)
    schema = T.StructType(rows.schema.fields[: len(kept)]).add(names[0], "double").add(names[1], T.DataType.fromDDL("array<struct<start:bigint,end:bigint,score:double>>"))
    return rows.mapInArrow(frugal(_score(model, "__text" if extra else text_col, names)), schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row's identifier falls into the fold that is never learned from (null: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fits on the labels outside the held-out fold and scores every row; adds ``score``, ``passages``, ``held_out`` and ``predicted``."""
    model = fit(docs, train_rows(labels.where(~held_out(id_col)), id_col), id_col, text_col)
    out = score(docs, model, text_col, keep or [id_col])
    return out.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted as toxic, with their own columns; learns as ``classify`` does."""
    model = fit(docs, train_rows(labels.where(~held_out(id_col)), id_col), id_col, text_col)
    out = score(docs, model, text_col, names=("__score", "__passages"))
    return out.where("__score < 0.5").select(*docs.columns)
