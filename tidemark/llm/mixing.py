"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` rows. Block j (from 0) of a source
of weight w is released at slot floor(j / w) and due at slot ceil((j + 1) / w); one
block runs in each slot, and the released block of the earliest deadline goes first.
The weights are exact fractions and sum to one, so each source is less than one block
away from its target at every slot. Whole numbers of 1/L repeat after L slots; other
weights are scheduled slot by slot, on the driver, up to the end of the phase.
When a source has run out, the weights of the rest are scaled up and a new phase
begins; every row is placed exactly once, none is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
RESOLUTION = 1000
BUCKET_ROWS = 4096
SPAN = 1024


def quantise(weights: dict, resolution: int = RESOLUTION) -> dict:
    """Whole parts of the period, at least one each, by largest remainders (ties to the smaller name)."""
    total = sum(Fraction(w).limit_denominator(10**9) for w in weights.values())
    period = max(resolution, 2 * len(weights))
    order = sorted(weights, key=lambda s: (s is None, str(s)))
    exact = {s: Fraction(weights[s]).limit_denominator(10**9) / total * period for s in order}
    parts = {s: max(1, int(exact[s])) for s in order}
    spare = period - sum(parts.values())
    by_rest = sorted(order, key=lambda s: (parts[s] - exact[s], order.index(s)))
    for k in range(max(0, spare)):
        parts[by_rest[k % len(by_rest)]] += 1
    while spare < 0:
        most = max(order, key=lambda s: (parts[s] - exact[s] if parts[s] > 1 else -period, -order.index(s)))
        parts[most] -= 1
        spare += 1
    return parts


def unrounded(weights: dict) -> dict:
    """Whole parts of the shortest period in the exact proportions of the weights. Sources without a weight wait for the others, then share equally."""
    some = {s: Fraction(w) for s, w in weights.items() if w > 0} or dict.fromkeys(weights, Fraction(1))
    scale = math.lcm(*(w.denominator for w in some.values()))
    parts = {s: int(w * scale) for s, w in some.items()}
    shared = math.gcd(*parts.values())
    return {s: n // shared for s, n in parts.items()}


def period(parts: dict, blocks: dict | None = None) -> list:
    """The source of each slot of one period, by earliest deadline first, or up to the slot that takes the last of a source's ``blocks``."""
    size = sum(parts.values())
    order = {s: k for k, s in enumerate(sorted(parts, key=lambda s: (s is None, str(s))))}
    waiting = [(0, order[s], 0, s) for s in parts]  # release, rank, block, source
    heapq.heapify(waiting)
    ready: list = []
    slots, t = [], -1
    while (t := t + 1) < size:
        while waiting and waiting[0][0] <= t:
            _, k, j, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * size // parts[s]), k, j, s))
        due, k, j, s = heapq.heappop(ready)
        slots.append(s)
        if blocks and j + 1 == blocks[s]:
            break
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * size // parts[s], k, j + 1, s))
    return slots


def phases(blocks: dict, weights: dict, resolution: int | None = None) -> list[dict]:
    """For each phase: its first slot, its period, its weights, and for each source its first block, its number of blocks and its slots in a period (in the phase, if that ends sooner).

    The weights are exact, or rounded to parts of a period of ``resolution`` slots. The work
    is bounded by the number of blocks; no row is touched.
    """
    left, start, out = {s: n for s, n in blocks.items() if n}, 0, []
    done = dict.fromkeys(left, 0)
    while left:
        own = {s: weights[s] for s in left}
        parts = quantise(own, resolution) if resolution else unrounded(own)
        size = sum(parts.values())
        at: dict = {s: array("q") for s in parts}
        slots = period(parts, left)
        for t, s in enumerate(slots):
            at[s].append(t)
        if len(slots) < size:  # a source has run out before the schedule repeats
            end = repeat = len(slots)
            used = {s: len(at[s]) for s in parts}
        else:
            repeat = size
            end = min((left[s] - 1) // parts[s] * size + at[s][(left[s] - 1) % parts[s]] for s in parts) + 1
            used = {s: end // size * parts[s] + sum(t < end % size for t in at[s]) for s in parts}
        out.append({"start": start, "period": repeat, "parts": parts, "of": {s: (done[s], used[s], at[s]) for s in parts}})
        done |= {s: done[s] + used[s] for s in parts}
        left = {s: n - used.get(s, 0) for s, n in left.items() if n > used.get(s, 0)}
        start += end
    return out


def _running(sizes: DataFrame) -> DataFrame:
    """The rows of a source before each bucket: sums within spans of SPAN buckets and over the spans, so that no task has all buckets of a source."""
    source, upto = ["__s", "__n"], Window.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda keys, by: F.coalesce(F.sum("__rows").over(upto.partitionBy(*keys).orderBy(by)), F.lit(0))
    spans = sizes.groupBy(*source, "__span").agg(F.sum("__rows").alias("__rows"))
    spans = spans.select(*source, "__span", so_far(source, "__span").alias("__outside"))
    sizes = sizes.withColumn("__here", so_far([*source, "__span"], "__bucket")).join(spans, [*source, "__span"])
    return sizes.select(*source, "__bucket", (F.col("__outside") + F.col("__here")).alias("__before"))


def mix(
    df: DataFrame,
    weights: dict | None = None,
    temperature: float = 0.5,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    resolution: int | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Places every row of ``df`` in the mix.

    Returns the identifier, the source, ``carry`` columns, ``block`` (number within the
    source), ``phase``, ``slot`` (of the block), ``release`` and ``deadline`` (slots, counted
    from the phase's start) and ``position`` (of the row, unique). ``weights`` are target
    weights by source, taken exactly unless ``resolution`` rounds them to parts of a period
    of so many slots; a source that is not listed gets its share of rows raised to
    ``temperature`` and scaled, as do all sources if ``weights`` is None. Null sources are a
    source of their own. Within a source the order is by buckets and a hash of the identifier (the first 60 bits of md5 of its text), then the
    identifier; rows with equal or null identifiers are adjacent. Sources are expected to
    be few (one row each reaches the driver); the driver schedules blocks, three numbers
    for each unless the weights repeat sooner; rows may be any number and one source may hold
    most of them. An empty table gives an empty result.
    """
    spark = df.sparkSession
    names = [id_col, source_col] + [c for c in (carry or []) if c not in (id_col, source_col)]
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = df.select(*names).withColumn("__hash", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    counts = {r[0]: r[1] for r in df.groupBy(source_col).agg(F.count(F.lit(1))).collect()}
    total = sum(counts.values())
    target = {s: float(n) ** temperature for s, n in counts.items()}
    if weights:
        scale = sum(target.values())
        target = {s: float(weights.get(s, target[s] / scale)) for s in target}
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, target, resolution) if total else []
    buckets = max(1, -(-total // BUCKET_ROWS))
    base = base.withColumn("__bucket", F.pmod(F.shiftright("__hash", 8), F.lit(buckets)))
    by_source = [F.coalesce(F.col(source_col), F.lit("")).alias("__s"), F.col(source_col).isNull().alias("__n")]
    base = base.select("*", *by_source)
    # Number within the source: rows of smaller buckets first, then the place within the bucket.
    sizes = base.groupBy("__s", "__n", "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    sizes = _running(sizes.withColumn("__span", F.floor(F.col("__bucket") / SPAN)))
    inside = F.row_number().over(Window.partitionBy("__s", "__n", "__bucket").orderBy("__hash", F.col(id_col).asc_nulls_last()))
    placed = base.withColumn("__inside", inside).join(sizes, ["__s", "__n", "__bucket"])
    number = F.col("__before") + F.col("__inside") - 1
    placed = placed.withColumn("__number", number).withColumn("block", F.floor(number / block_rows).cast("long"))
    table, spans = [], []  # blocks of a period with their slots, and sources
    for k, p in enumerate(plan):
        for s, (first, used, at) in p["of"].items():
            n, w, size = min(len(at), used), p["parts"][s], sum(p["parts"].values())
            if n:
                spans.append((s or "", s is None, k, first, first + used, p["start"], p["period"], len(at)))
                due = array("q", (min(-(-(r + 1) * size // w), 2**63 - 1) for r in range(n)))
                free = array("q", (r * size // w for r in range(n)))
                table.append(pa.table({"__s": pa.repeat(s or "", n), "__n": pa.repeat(s is None, n), "phase": pa.repeat(pa.scalar(k, pa.int32()), n), "__r": np.arange(n), "__t": np.array(at[:n]), "__free": np.array(free), "__due": np.array(due)}))
    spans_df = spark.createDataFrame(spans, "__s string, __n boolean, phase int, __first long, __end long, __start long, __period long, __parts long")
    kind = "__s string, __n boolean, phase int, __r long, __t long, __free long, __due long"
    table_df = spark.createDataFrame(pa.concat_tables(table), kind) if table else spark.createDataFrame([], kind)
    # One table is bounded by sources x phases, the other by the blocks; blocks find theirs by equality on the source.
    blocks = placed.select("__s", "__n", "block").distinct()
    blocks = (
        blocks.join(spans_df, ["__s", "__n"])
        .where("block >= __first and block < __end")
        .withColumn("__j", F.col("block") - F.col("__first"))
        .withColumn("__r", F.col("__j") % F.col("__parts"))
        .join(table_df, ["__s", "__n", "phase", "__r"])
        .select(
            "__s",
            "__n",
            "block",
            "phase",
            (F.col("__start") + F.floor(F.col("__j") / F.col("__parts")) * F.col("__period") + F.col("__t")).cast("long").alias("slot"),
            F.expr("__j div __parts * __period + __free").alias("release"),
            F.expr("__j div __parts * __period + __due").alias("deadline"),
        )
    )
    out = placed.join(blocks, ["__s", "__n", "block"])
    position = F.col("slot") * block_rows + F.col("__number") % block_rows
    return out.select(*names, "block", "phase", "slot", "release", "deadline", position.cast("long").alias("position"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df``, every one once and with its own columns, in the order of the mix.

    Partitions follow one another and rows are in order within each, so a writer's files, by name, and their rows hold
    the order; ``written_order`` reads it back.
    """
    rows = df.select(options.get("id_col", "doc_id"), options.get("source_col", "source"), F.struct(*df.columns).alias("__row"))
    out = mix(rows, carry=["__row"], **options)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "position").sortWithinPartitions("position").select("__row.*")


def written_order(df: DataFrame) -> DataFrame:
    """Adds the place of each row in written files: ``mix_file`` (the number of the part) and ``mix_row`` (from 0); nulls if ``df`` does not come from files."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    try:
        return df.select("*", part.cast("int").alias("mix_file"), F.col("_metadata.row_index").cast("long").alias("mix_row"))
    except AnalysisException:
        return df.select("*", F.lit(None).cast("int").alias("mix_file"), F.lit(None).cast("long").alias("mix_row"))
