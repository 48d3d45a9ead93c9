"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: sigma, of the 64-bit integers, is
applied to a document's shingles once, and its upper 32 bits are kept; pi, of
the 32-bit integers, circularly shifted by k times an odd constant, gives
coordinate k as min over shingles of pi(sigma(x) + k * constant). Bands of coordinates
deal documents into buckets. Documents with equal shingle sets are one class
and stand in the buckets once.

A class of which more than 1 - threshold of the shingles stand in no other
candidate class can be linked to none, and leaves before any comparison.
Within a bucket, the remaining candidates are compared with a central member (the one that
shares most buckets with others), not with each other: what is linked to it
is settled, and the rest elects a centre of its own, for a few rounds. What
remains is compared pair by pair, and so is what missed the centre with what
is settled, where counts already known leave a link possible and the two are
not in the same component yet. All links are confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, materialize
from .words import mix, text_buffer, windows, word_hashes

BANDS, ROWS = 26, 6
ROUNDS = 2
#: Bits of the table by which texts outside all buckets are left out before the shuffle.
MAYBE_BITS = 1 << 23
#: Shingles hashed at a time, so that a signature is made in cache.
STRIP = 512
#: Texts hashed together.
TEXTS = 500


def _sets(raw, ends, size):
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    h, places = word_hashes(raw, ends, lower=True)
    w = windows(h, size)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        if b - a >= size:
            yield np.unique(w[a : b - size + 1])
        elif b > a:
            # a short text is one shingle; its length keeps it apart from whole windows
            yield windows(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield h[:0]


def _small_mix(x):
    """pi: a permutation of the 32-bit integers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles, bands=BANDS, rows=ROWS):
    """Coordinates min over x of pi(sigma(x) + shift * k)."""
    shifts = (np.arange(bands * rows, dtype=np.uint32) * np.uint32(0x9E3779B1))[:, None]
    sigma = (mix(shingles ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(bands * rows, 2**32 - 1, np.uint32)
    for i in range(0, len(sigma), STRIP):
        np.minimum(out, _small_mix(sigma[None, i : i + STRIP] + shifts).min(axis=1), out=out)
    return out


def band_keys(coordinates, bands=BANDS, rows=ROWS):
    parts = coordinates.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, r])
    return key.view(np.int64)


def _slices(batches):
    """The batches in slices of at most TEXTS rows, which bound what hashing their texts holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _signatures(size, bands, rows, keys):
    names = pa.schema([*((k, pa.int64()) for k in keys), ("n_shingles", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in _slices(batches):
            raw, ends = text_buffer(batch.column("text"))
            n, same, bands_of = [], [], []
            for s in _sets(raw, ends, size):
                n.append(len(s))
                if len(s):
                    # two independent sums over the set and its size tell sets apart
                    same.append(np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64), len(s)], np.uint64).tobytes())
                    bands_of.append(band_keys(signature(s, bands, rows), bands, rows))
                else:
                    same.append(None)
                    bands_of.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands_of, pa.list_(pa.int64()))], schema=names)

    return run


def _set_rows(size):
    names = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in _slices(batches):
            raw, ends = text_buffer(batch.column("text"))
            sets = [s.view(np.int64) for s in _sets(raw, ends, size)]
            places = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(places, np.concatenate(sets) if sets else np.zeros(0, np.int64))], schema=names)

    return run


def _compare(batches):
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])
    for batch in batches:
        both, either = [], []
        for x, y in zip(batch.column("left"), batch.column("right")):
            x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            n = int((y[at] == x).sum())
            both.append(n)
            either.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], schema=names)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact intersection and union of each pair (a, b)."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right")), "b")
    return materialize(both.select("a", "b", "left", "right").mapInArrow(_compare, "a long, b long, both long, either long"), "near-pairs")


def _maybe(ids: DataFrame) -> DataFrame:
    """A table of at most MAYBE_BITS bits that holds a bit for each id: (part, bits)."""
    at = F.pmod(F.xxhash64("rep"), F.lit(MAYBE_BITS))
    return ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def _possibly(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among the ids: all that are, and few others while the ids are fewer than the bits."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MAYBE_BITS))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # the table of bits is broadcast: 2 ** 20 bytes at most
    near = docs.withColumn("part", F.bitmap_bucket_number(at)).join(F.broadcast(_maybe(ids)), "part")
    return near.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("part", "bits")


def _with_count(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a written table whose key is not alone, with the number n of those that share it.

    The counts are written: a join of two written tables is one of which Spark
    splits the partition of a hot key, which it cannot where one side is an
    aggregate.
    """
    return rows.join(materialize(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "near-counts"), key)


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of classes whose shingles are shared widely enough for a link to be possible, in buckets that still hold two."""
    seen = sets.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.size("shingles").alias("size"), "shingles")
    alone = seen.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    able = seen.select("rep", "size").join(alone, "rep", "left").select("rep", "size", F.coalesce("own", F.lit(0)).alias("own")).where(f"100 * (size - own) >= {percent} * size")
    left = members.select("bucket", "rep").join(able, "rep")
    crowd = left.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(left.join(crowd, "bucket").select("bucket", "rep", "n", "size", "own"), "near-members")


def _possible(x: str, y: str, percent: int):
    """Whether two classes that were compared with one centre can be linked. They share at most the smaller part in common with the centre and, outside it, the smaller part that is not their own."""
    inside = F.least(F.col(f"{x}.both"), F.col(f"{y}.both"))
    outside = F.least(*(F.col(f"{n}.size") - F.col(f"{n}.both") - F.col(f"{n}.own") for n in (x, y)))
    return (100 + percent) * (inside + outside) >= percent * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node each one reaches; edges (a, b) over long ids. Nodes without an edge are absent."""
    links = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    labels = materialize(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    links = materialize(links, "near-links")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # then follow the label's own label, which doubles the reach
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "near-labels")
        changed = step.where("label <> was").limit(1).count()
        forget(labels)
        labels = step.select("node", "label")
        if not changed:
            forget(links)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union, and label what is connected.

    One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable, itself included), kept (doc_id is component_id). Rows
    with one doc_id are one document with several texts. A text without words,
    or null, has no shingles and links with nothing; a text shorter than a
    shingle is one shingle. A null doc_id links with nothing, has no component
    and is kept. An empty table gives an empty table. Other columns are not
    read, but carry, a long column that is returned with each row.

    A pair at the threshold shares a bucket but for a chance of
    (1 - j ** rows) ** bands, 5e-6 by default, which falls fast above it.
    """
    carried = [carry] if carry else []
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carried)
    rows_of = materialize(docs.mapInArrow(_signatures(size, bands, rows, ("doc_id", *carried)), "".join(f"{k} long, " for k in ("doc_id", *carried)) + "n_shingles long, same binary, bands array<long>"), "near-signatures")
    classes = rows_of.where("doc_id is not null and same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    dealt = classes.select("rep", F.explode("bands").alias("bucket"))
    crowded = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(dealt.join(crowded, "bucket").select("bucket", "rep", "n").distinct(), "near-members")
    involved = members.select("rep").distinct()
    # a class is compared by one of its texts: that of its smallest document
    texts = _possibly(docs, involved).join(involved.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "text")
    sets = materialize(texts.mapInArrow(_set_rows(size), "rep long, shingles array<long>"), "near-sets")
    open_, known, late = _linkable(members, sets, percent), None, None
    for _ in range(ROUNDS):
        central = open_.groupBy("rep").agg(F.sum("n").alias("weight"))
        elected = open_.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("centre"))).alias("top")).select("bucket", (-F.col("top.centre")).alias("centre"))
        elected = materialize(elected, "near-centres")
        stars = materialize(open_.join(elected, "bucket").where("rep <> centre").select("bucket", "rep", "centre", "size", "own"), "near-stars")
        pairs = stars.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        pairs = pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
        found = _verified(pairs, sets)
        known = found if known is None else known.unionByName(found)
        judged = stars.withColumns({"a": F.least("rep", "centre"), "b": F.greatest("rep", "centre")}).join(known, ["a", "b"])
        judged = materialize(judged.select("bucket", "rep", "size", "own", "both", F.expr(f"100 * both >= {percent} * either").alias("linked")), "near-judged")
        missed, settled = judged.where("not linked").alias("x"), judged.where("linked").alias("y")
        grey = missed.join(settled, (F.col("x.bucket") == F.col("y.bucket")) & _possible("x", "y", percent)).select(F.col("x.rep").alias("rep"), F.col("y.rep").alias("other"))
        late = grey if late is None else late.unionByName(grey)
        open_ = materialize(_with_count(judged.where("not linked").drop("linked"), "bucket"), "near-open")
    links = known.where(f"100 * both >= {percent} * either")
    label = components(links)
    rest = open_.alias("x").join(open_.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & _possible("x", "y", percent)).select(F.col("x.rep").alias("rep"), F.col("y.rep").alias("other"))
    more = late.select("rep", "other").unionByName(rest).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    of = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b").join(known, ["a", "b"], "left_anti")
    extra = _verified(more, sets).where(f"100 * both >= {percent} * either")
    label = components(links.select("a", "b").unionByName(extra.select("a", "b")))
    in_class = materialize(classes.select("same", "rep").join(label, classes["rep"] == label["node"], "left").select("same", F.coalesce("label", "rep").alias("component")), "near-components")
    # rows of one doc_id with several texts meet in the smallest of their components
    out = rows_of.select("doc_id", *carried, "n_shingles", "same").join(in_class, "same", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", *carried, "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
