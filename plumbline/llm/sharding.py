"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``shards * nodes`` arcs of fixed number. A key belongs to the shard of its arc; when
that shard is full, its arc's last keys continue clockwise to the next shard with room. Only the
number of keys of each arc decides this, so the driver handles a fixed number of counts, and each
row finds its shard from its rank within its arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

ARCS, CELLS = 4096, 64


def ring(shards: int, nodes: int | None = None) -> list[int]:
    """The owner of each of the ring's ARCS equal arcs: that of the first virtual node at or after it."""
    nodes = nodes or max(1, 1024 // shards)
    point = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % ARCS
    taken: dict[int, int] = {}
    for v in range(nodes):
        for s in range(shards):
            taken.setdefault(point(s, v), s)
    at = sorted(taken)
    out, k = [], 0
    for a in range(ARCS):
        while k < len(at) and at[k] < a:
            k += 1
        out.append(taken[at[k % len(at)]])
    return out


def assign(loads: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, (shard, number of keys) in the order of the keys' rank.

    In turn t every arc offers what is left to the t-th distinct shard clockwise, in ring order."""
    room, left, out = list(capacity), list(loads), [[] for _ in loads]
    walks = []
    for a in range(len(loads)):
        seen: dict[int, None] = {}
        for b in range(len(owners)):
            seen[owners[(a + b) % len(owners)]] = None
            if len(seen) == len(capacity):
                break
        walks.append([*seen, *(s for s in range(len(capacity)) if s not in seen)])
    for t in range(len(capacity)):
        for a, walk in enumerate(walks):
            take = min(left[a], room[walk[t]])
            if take:
                out[a].append((walk[t], take))
                left[a] -= take
                room[walk[t]] -= take
    assert not any(left), "the shards' capacities are less than the number of keys"
    return out


def shard(rows: DataFrame, key: Column, tie: Column, shards: int = 16, epsilon: float = 0.0) -> DataFrame:
    """Adds ``shard`` and ``slot`` (from 0 without gaps in each shard) to ``rows``.

    With ``epsilon`` 0 the shards' row counts differ by one at most; a larger one lets a shard hold
    that share above the mean and moves fewer keys. Rows are ranked within an arc by cells of
    a second hash, which a row number feeds too, so equal keys, be they a third of all rows and equal in ``tie``
    as well, are dealt to CELLS tasks or more."""
    spark = rows.sparkSession
    cols = rows.columns
    arc = F.pmod(F.xxhash64(key), F.lit(ARCS)).cast("int")
    cell = F.pmod(F.xxhash64(tie, F.monotonically_increasing_id()), F.lit(CELLS)).cast("int")
    placed = durable(rows.withColumns({"_arc": arc, "_cell": cell, "_tie": F.xxhash64(tie)}), "ring")
    cells = placed.groupBy("_arc", "_cell").count()  # ARCS * CELLS rows at most
    loads = [0] * ARCS
    for r in cells.groupBy("_arc").agg(F.sum("count").alias("n")).collect():  # ARCS rows at most
        loads[r["_arc"]] = r["n"]
    n = sum(loads)
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    if epsilon:
        capacity = [max(c, int(-(-n * (1 + epsilon) // shards))) for c in capacity]
    spans, schema = [], "_arc int, _shard int, _from long, _to long"
    for a, parts in enumerate(assign(loads, ring(shards), capacity)):
        lo = 0
        for s, k in parts:
            spans.append((a, s, lo, lo + k))
            lo += k
    spans = spark.createDataFrame(spans, schema)  # ARCS * shards rows at most
    # A cell's ranks within its arc are a range; what a range shares with a span goes to its shard.
    before = F.sum("count").over(W.partitionBy("_arc").orderBy("_cell")) - F.col("count")
    cut = (
        cells.withColumn("_before", before)
        .join(F.broadcast(spans), "_arc")
        .withColumns({"_lo": F.greatest("_from", "_before"), "_hi": F.least("_to", F.col("_before") + F.col("count"))})
        .where("_lo < _hi")
    )
    first = F.sum(F.col("_hi") - F.col("_lo")).over(W.partitionBy("_shard").orderBy("_arc", "_cell", "_lo")) - (F.col("_hi") - F.col("_lo"))
    cut = cut.select("_arc", "_cell", "_shard", (F.col("_lo") - F.col("_before")).alias("_lo"), (F.col("_hi") - F.col("_before")).alias("_hi"), first.alias("_first"))
    cut = cut.groupBy("_arc", "_cell").agg(F.collect_list(F.struct("_lo", "_hi", "_shard", "_first")).alias("_cuts"))  # at most `shards` each
    rank = F.row_number().over(W.partitionBy("_arc", "_cell").orderBy("_tie", *cols)) - 1
    # The rows already lie by arc and cell for their ranks; the other side comes to them.
    out = placed.withColumn("_rank", rank).join(cut.hint("merge"), ["_arc", "_cell"])
    out = out.withColumn("_cut", F.filter("_cuts", lambda c: (c["_lo"] <= F.col("_rank")) & (F.col("_rank") < c["_hi"]))[0])
    return out.select(*cols, F.col("_cut._shard").alias("shard"), (F.col("_cut._first") + F.col("_rank") - F.col("_cut._lo")).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts at most one apart. Equal texts share a key, hence a shard, until it is
    full. Null text has no bytes (size 1, crc32 0); repeated rows are rows of their own."""
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_key"),
    )
    out = shard(slim, F.col("_key"), F.coalesce(F.col("doc_id"), F.lit(-1)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
