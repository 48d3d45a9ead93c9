"""How filters over a corpus interact: what each removes, in any order and part, and what it costs.

Duplicates are found by sorting. Rows are dealt by range of text fingerprint
and doc_id and sorted by fingerprint, full text and doc_id; a row is a
duplicate if the run of its text began with a smaller doc_id. A run may have
begun in an earlier range: rows that only the seam between ranges can judge
carry the digest of their text, and so do the runs at the edges of each range.
These few meet in a join.

Each row ends as a mask of the filters it fails. Masks are counted by part,
and the counts answer every order: what the filters of a set leave is the sum
over the masks outside it, and an order walks from set to set.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER = bytes(range(65, 91))
SIGNS = "#$%&*|"


class Text(NamedTuple):
    """What a filter sees: a text, its UTF-8 bytes, and its words as bytes."""

    text: str
    data: bytes
    words: list[bytes]


def few_words(t: Text) -> bool:
    return len(t.words) < 50


def repetitive(t: Text) -> bool:
    return 100 * len(set(t.words)) < 65 * len(t.words)


def shouting(t: Text) -> bool:
    return 100 * (len(t.data) - len(t.data.translate(None, UPPER))) > 5 * len(t.text)


def has_signs(t: Text) -> bool:
    return any(map(t.text.__contains__, SIGNS))


#: Filters by letter: true is a failure. The letter after them is that of duplicates.
FILTERS: dict[str, Callable[[Text], bool]] = {"A": few_words, "B": repetitive, "C": shouting, "D": has_signs}
DUPLICATE = "E"

FOUND = "doc_id long, part string, mask int, n long, mark long, digest binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("mark", pa.int64()), ("digest", pa.binary())])
#: The mask of a row that stands for the run of a text at an edge.
EDGE = -1


def _judge(filters):
    """Rows in order of mark, text and doc_id become rows of FOUND; equal neighbours are one row with their number."""
    tests, bit = [*filters], 1 << len(filters)

    def run(batches):
        first = mark = text = low = mask = None
        edges, last = {}, None
        for batch in batches:
            out = []
            for m, t, i, part in zip(*(batch.column(c).to_pylist() for c in ("mark", "text", "doc_id", "part"))):
                if m != mark or t != text:
                    data = t.encode()
                    seen = Text(t, data, data.split())
                    mask = sum(1 << k for k, fails in enumerate(tests) if fails(seen))
                    if m != mark:
                        if mark is None:
                            first = m
                        elif mark == first:
                            # the runs of the first mark are an edge, those of later ones only if no other mark follows
                            out += [(x, None, EDGE, 0, mark, d) for d, x in edges.items()]
                        edges = {}
                    mark, text, low = m, t, i
                    digest = hashlib.sha256(data).digest()
                    edges[digest] = i
                later = low is not None and (i is None or i > low)
                row = (i, part, mask | bit * later, mark, digest if mark == first and not later else None)
                if out and last == row:
                    out[-1] = (*out[-1][:3], out[-1][3] + 1, *out[-1][4:])
                else:
                    out.append((*row[:3], 1, row[3], row[4]))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, FOUND_ARROW)], schema=FOUND_ARROW)
        out = [(x, None, EDGE, 0, mark, d) for d, x in edges.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, FOUND_ARROW)], schema=FOUND_ARROW)

    return run


def failures(docs: DataFrame, filters=FILTERS, text: str = "text", part: str = "source") -> DataFrame:
    """Rows (doc_id, part, mask, n): n equal rows of one part fail the filters whose bits the mask has; duplicates are the last bit.

    A null text is empty and a null part the empty string. A null doc_id is
    larger than any other; rows with equal doc_ids are no duplicates of each
    other. Rows of one text under one doc_id are read by one task, as a stream.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(part, F.lit("")).alias("part"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    last = F.asc_nulls_last("doc_id")
    dealt = rows.repartitionByRange(F.asc("mark"), last).sortWithinPartitions(F.asc("mark"), F.asc("text"), last)
    found = materialize(dealt.mapInArrow(_judge(filters.values()), FOUND), "audit-masks")
    runs = found.where(F.col("mask") == EDGE).groupBy("mark", "digest").agg(F.min("doc_id").alias("low"))
    rows = found.where(F.col("mask") != EDGE)
    seams = rows.where("digest is not null").join(runs, ["mark", "digest"], "left")
    later = F.when(F.col("low").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("low"))), 1 << len(filters)).otherwise(0)
    return rows.where("digest is null").select("doc_id", "part", "mask", "n").unionByName(seams.select("doc_id", "part", F.col("mask").bitwiseOR(later).alias("mask"), "n"))


def interactions(docs: DataFrame, labels: DataFrame, filters=FILTERS, duplicate: str = DUPLICATE, text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of all filters and step: what is kept and removed there, what it costs, and the filter's share over all orders.

    labels (doc_id, quality, toxic) tells good (quality 1) and toxic (toxic 1)
    documents; a doc_id with several labels is what any of them says, null
    doc_ids have none. Filters are those given, by letter, and that of
    duplicates. Counts are of rows, repeated ones included. Other columns are
    not read; an empty table gives an empty table.
    """
    letters = "".join(filters) + duplicate
    size, orders = 1 << len(letters), math.factorial(len(letters))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    # written, so that a doc_id with very many rows can be split in the join
    flags = materialize(labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic")), "audit-flags")
    rows = failures(docs, filters, text, part)
    known = rows.where("doc_id is not null").join(flags, "doc_id", "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    rest = rows.where("doc_id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    counts = known.unionByName(rest).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    outside = lambda s, n: F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, n).otherwise(0))
    left = lambda n: F.array(*(outside(s, n) for s in range(size)))
    share = lambda k: F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n") * F.expr(f"{orders} div bit_count(mask)")).otherwise(0))
    alone = lambda k: F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0))
    parts = counts.groupBy("part").agg(
        left(F.col("n")).alias("left"), left(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), left(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        F.array(*map(alone, range(len(letters)))).alias("alone"), F.array(*map(share, range(len(letters)))).alias("share"),
    )
    walks = ["".join(p) for p in itertools.permutations(letters)]
    steps = parts.withColumn("filter_order", F.explode(F.lit(walks))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bit = lambda c: f"shiftleft(1, instr('{letters}', {c}) - 1)"
    steps = steps.withColumns(
        {
            "own": F.expr("substr(filter_order, step, 1)"),
            "before": F.expr(f"aggregate(filter(split(substr(filter_order, 1, step - 1), ''), x -> x <> ''), 0, (s, x) -> s | {bit('x')})"),
        }
    )
    steps = steps.withColumns({"at": F.expr(f"instr('{letters}', own) - 1"), "after": F.expr(f"before | {bit('own')}"), "bit": F.expr(bit("own"))})
    removed = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return steps.select(
        "part", "filter_order", "step", F.get("left", F.col("after")).alias("kept"), removed("left").alias("removed"),
        (F.get("left", F.lit(0)) - F.get("left", F.col("bit")) - removed("left")).alias("redundant"), F.get("alone", F.col("at")).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("share", F.col("at")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
