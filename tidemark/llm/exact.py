"""Exact duplicate removal by a tree merge of sorted digest runs.

Every row belongs to one of P = RADIX ** rounds virtual partitions, chosen by a
hash of its identifier, so that a group of copies of any size is spread over all
of them. Rows are dealt by that number alone and sorted by digest within it: a
partition holds its digests as one sorted run, with one entry for each (the
partial aggregate). Then the runs travel through a binomial
(radix-RADIX butterfly) network: in round r, the partitions whose numbers differ
only in digit r exchange slices of their runs, chosen by the same digit of the
digest, and each merges the RADIX slices that it receives into one run. An entry keeps
the best row seen so far and
the number of rows; equality is verified at every level by a second fingerprint
and the normalised length beside SHA-256. After the last round each digest has one
entry; it goes back down to the virtual partitions and from there to the rows, so
that no task ever holds more than one partition's share of a group. The texts are read
once, into a checkpointed table of digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

SPACES = " \t\n\x0b\x0c\r"
RADIX = 8


def normalised(text: Column) -> Column:
    """The text without its white space ([\\x20\\x09-\\x0D]); null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _rounds(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 2
    while RADIX**rounds < parts:
        rounds += 1
    return rounds


def _swap(at: Column, digest: Column, r: int) -> Column:
    """``at`` with its digit ``r`` replaced by the same digit of ``digest``."""
    unit = RADIX**r
    own = F.floor(at / unit) % RADIX
    return (at + (F.floor(digest / unit) % RADIX - own) * unit).cast("long")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the digest columns to ``df``."""
    return (
        df.withColumn("__plain", normalised(F.col(text_col)))
        .withColumn("__sha", F.sha2("__plain", 256))
        .withColumn("__fp", F.xxhash64("__plain"))
        .withColumn("__len", F.length("__plain"))
        .withColumn("__points", F.length(F.coalesce(F.col(text_col), F.lit(""))))
        .drop("__plain")
    )


KEYS = ["__sha", "__fp", "__len"]


def _runs(df: DataFrame, parts: int) -> DataFrame:
    """Entries dealt by the virtual partition alone and sorted by digest within it."""
    return df.repartition(parts, "__at").sortWithinPartitions("__at", *KEYS)


def _merged(df: DataFrame) -> DataFrame:
    """One entry for each digest of each run; uses the runs' own order."""
    return df.groupBy("__at", *KEYS).agg(F.min("__best").alias("__best"), F.sum("__rows").alias("__rows"))


def _marked(rows: DataFrame, id_col: str) -> DataFrame:
    """Checkpointed digest rows with ``__row``, joined with their group: ``__best`` (of the group), ``__rows``, and whether they stay (``__kept``)."""
    rounds = _rounds(rows)
    space, parts = RADIX**rounds, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digit = F.pmod(F.col("__fp"), F.lit(space))
    # of equal rows the smallest stays: most code points, then the smallest identifier, nulls last, then any one
    best = F.struct((-F.col("__points")).alias("p"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__row").alias("r"))
    entries = rows.select("__at", *KEYS, best.alias("__best"), F.lit(1).cast("long").alias("__rows"))
    run = _merged(_runs(entries, parts))
    level = run
    for r in range(rounds):
        level = _merged(_runs(level.withColumn("__at", _swap(F.col("__at"), digit, r)), parts))
    root = level.select(*KEYS, F.col("__best").alias("__top"), F.col("__rows").alias("__size"))
    down = run.select("__at", *KEYS).join(root, KEYS)
    joined = rows.join(down, ["__at", *KEYS])
    return joined.withColumn("__kept", F.col("__top.r") == F.col("__row"))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The digest rows of ``df``, numbered and checkpointed (so that the numbers stay what they are)."""
    rows = digests(df.select(id_col, text_col), id_col, text_col).drop(text_col).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows)
    # copies under one identifier, or without one, are spread as well
    return rows.withColumn("__at", F.pmod(F.xxhash64("__row", F.lit(7)), F.lit(RADIX ** _rounds(df))))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if they are identical once white space is deleted; of equal texts
    the row with the most code points stays, then the smallest identifier (null
    identifiers last). Null texts count as empty and are equal to blank ones. Of rows that
    agree in identifier and text one is marked as kept. An empty table gives an empty result. Other columns are not read;
    names must not begin with two underscores.
    """
    out = _marked(_rows(df, id_col, text_col), id_col)
    return out.select(id_col, F.col("__top.i").alias("keep_id"), F.col("__size").cast("long").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its own columns.

    As ``exact_groups``; of rows repeated in identifier and text any one stays. The rows to keep are found
    by identifier, digest and code points, so texts move once; only rows repeated in all of these are grouped.
    """
    same = [id_col, "__sha", "__points"]
    all_rows = _rows(df, id_col, text_col)
    kept = _marked(all_rows, id_col).where("__kept").select(*(F.col(c).alias(f"__k{n}") for n, c in enumerate(same)))
    often = all_rows.groupBy(*same).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select(*(F.col(c).alias(f"__o{n}") for n, c in enumerate(same)))
    on = lambda p: [F.col(c).eqNullSafe(F.col(f"{p}{n}")) for n, c in enumerate(same)]
    kept = cut(kept.join(often, [F.col(f"__k{n}").eqNullSafe(F.col(f"__o{n}")) for n in range(len(same))], "left").select("__k0", "__k1", "__k2", F.col("__o1").isNotNull().alias("__often")))
    rows = digests(df, id_col, text_col).join(kept, on("__k"))
    once = rows.where("not __often").select(*df.columns)
    again = rows.where("__often").groupBy(*same).agg(F.first(F.struct(*df.columns)).alias("__row")).select("__row.*")
    return once.unionByName(again)
