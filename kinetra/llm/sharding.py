"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws
-ln(u) / weight from a hash of the key and the child's own path, and the
smallest draw wins, so a child is taken with probability weight / total. A
draw depends on nothing but the key, the path and that child's weight:
changing the weights below one subtree moves keys only into it (growth) or
out of it (shrinkage), and leaves choices inside every other subtree as they
were. A shard added as a region of its own takes keys only into itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: 13 hexadecimal digits of the digest make a draw of 52 bits.
DRAW_DIGITS = 13


def topology(n_shards: int, per_rack: int = 2, per_region: int = 4, base: int = 8) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) rows. The first `base` shards fill racks and regions; each later one opens a region, so that growth by one moves rows only into the new shard."""
    rows = []
    for s in range(n_shards):
        if s < base:
            rows.append((s // per_region, s % per_region // per_rack, s, 1.0))
        else:
            rows.append((base // per_region + s - base, 0, s, 1.0))
    return rows


def _draw(key: Column, path: str) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{path}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -F.log(u)


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct((_draw(key, path) / weight).alias("d"), F.lit(i).alias("i")) for i, (path, weight, _) in enumerate(children)]
    winner = F.least(*draws)["i"]
    return reduce(lambda rest, x: F.when(winner == x[0], x[1][2]).otherwise(rest), list(enumerate(children))[:-1][::-1], children[-1][2])


def shard_of(key: Column, tree: list[tuple[int, int, int, float]]) -> Column:
    """The shard of a text key; shards of weight 0 or less get nothing."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    live = [r for r in tree if r[3] > 0]
    regions = []
    for region in sorted({r[0] for r in live}):
        racks = []
        for rack in sorted({r[1] for r in live if r[0] == region}):
            shards = [(f"{region}.{rack}.{s}", w, F.lit(s)) for g, k, s, w in live if (g, k) == (region, rack)]
            racks.append((f"{region}.{rack}", sum(x[1] for x in shards), _choose(key, shards)))
        regions.append((f"{region}", sum(x[1] for x in racks), _choose(key, racks)))
    return _choose(key, regions)


def assign_shards(docs: DataFrame, tree, grown=None, key: str = "doc_id", text: str = "text", rows_per_group: int = 50_000) -> DataFrame:
    """Shard, gapless slot within the shard and, with a grown tree, the shard after growth.

    One row per input row: key, size (UTF-8 bytes + 1; a null text has none),
    text_crc32 (0 for a null text), law, shard, slot, grown_shard. A null key
    is the key ''. Repeated rows each get a slot of their own. An empty table
    gives an empty table; other columns of the input are not read. Slots follow
    (group, key, checksum): groups of about rows_per_group rows are ranked
    apart and shifted by the rows of the groups before, so that no shard is
    ranked in one task.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = materialize(
        docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .withColumns({"shard": shard_of(F.col("doc_id"), tree), "grown_shard": shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")}),
        "shards",
    )
    groups = max(16, -(-slim.count() // (len(tree) * rows_per_group)))
    slim = slim.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(groups)))
    counts = slim.groupBy("shard", "grp").agg(F.count("*").alias("n"))
    before = counts.select("shard", "grp", (F.sum("n").over(W.partitionBy("shard").orderBy("grp")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "grp").orderBy("doc_id", "text_crc32", "size"))
    return slim.join(before, ["shard", "grp"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + rank - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def op1_sharding(spark, sf_dir):
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), topology(8), topology(9))
