"""Corpus-wide counting: blocks of texts ask, a tree of exchanges answers.

Texts are dealt by a hash of their row into blocks of bounded size. A block
sends each distinct entry (a hash) once, cut by its leading bits into FAN
buckets, so that no word, passage or source makes a large group. A node of the
tree merges what FAN blocks say of one bucket; where there are more blocks, it
passes the merged entries on, cut into FAN finer buckets, to a node that
merges FAN such nodes, and so on. Totals are known at the top and go back the
same way. A message of a node is about as large as one of a block, a node
reads at most FAN of them, and there are FAN of them for each block and level:
the number of messages grows in proportion to the input, and the number of
levels with its logarithm (one up to 1.3 GB of text, two up to 170 GB, four
up to 2.7 PB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 10 << 20
FAN_BITS = 7
FAN = 1 << FAN_BITS
NO_ID = np.int64(2**63 - 1)

#: kind tells the entries of different questions apart; values belong to keys, in their order.
ASK = "bucket long, grp long, child long, kind int, keys binary, vals binary"
ASK_ARROW = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("child", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
TELL = "bucket long, child long, kind int, vals binary"
TELL_ARROW = pa.schema([("bucket", pa.int64()), ("child", pa.int64()), ("kind", pa.int32()), ("vals", pa.binary())])


def n_blocks(total_bytes: int) -> int:
    return max(1, -(-total_bytes // BLOCK_BYTES))


def levels_of(blocks: int) -> int:
    """Levels of the tree over so many blocks."""
    n = 1
    while FAN**n < blocks:
        n += 1
    return n


def total_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def with_block(docs: DataFrame, blocks: int) -> DataFrame:
    """Blocks by the row's own key and text, so that a repeated key is dealt out too."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64), F.octet_length("text")), F.lit(blocks)))


def cut(keys, shift=64 - FAN_BITS):
    """Places where sorted keys pass from one of FAN buckets to the next; a bucket is the FAN_BITS bits from `shift` on."""
    edges = np.arange(1, FAN, dtype=np.uint64) << np.uint64(shift)
    base = (keys[0] >> np.uint64(shift + FAN_BITS)) << np.uint64(shift + FAN_BITS) if len(keys) and shift + FAN_BITS < 64 else np.uint64(0)
    return np.concatenate([[0], np.searchsorted(keys, edges + base), [len(keys)]])


def local(keys, width):
    """The width bytes that follow a key's bucket bits, as integers."""
    return (keys << np.uint64(FAN_BITS)) >> np.uint64(64 - 8 * width)


def pack(keys, width):
    """Sorted integers as the differences of neighbours, byte by byte: first the lowest byte of all, the highest last, which is mostly zero and compresses."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data, width):
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def kept_bits(keys, width):
    """Keys with the bits that local() drops set to zero."""
    drop = 64 - 8 * width - FAN_BITS
    return keys if drop <= 0 else (keys >> np.uint64(drop)) << np.uint64(drop)


def encode(values) -> bytes:
    """Unsigned 64-bit values in as few bytes as the largest needs: none for zeros, bits, 1, 2, 4 or 8 bytes each."""
    top = int(values.max()) if len(values) else 0
    if top < 2:
        return b"\0" + np.packbits(values.astype(bool)).tobytes() if top else b""
    wide = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([wide]) + values.astype(f"<u{wide}").tobytes()


def decode(data, n):
    if not data:
        return np.zeros(n, np.uint64)
    if data[0] == 0:
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n).astype(np.uint64)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def sums(values, where, n):
    """Values are twice a count, plus one if another child may have the entry too: counts are added, and the bit is set for entries of two children."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, where, values >> np.uint64(1))
    shared = np.bincount(where, minlength=n) > 1
    shared[where[(values & np.uint64(1)) > 0]] = True
    return total << np.uint64(1) | shared.astype(np.uint64)


def smallest(values, where, n):
    """Values are document ids as unsigned 64-bit patterns."""
    out = np.full(n, NO_ID)
    np.minimum.at(out, where, values.view(np.int64))
    return out.view(np.uint64)


def ask_rows(block, asked):
    """Rows of ASK for a block: asked has (kind, width, sorted distinct keys, values)."""
    rows = []
    for kind, width, keys, values in asked:
        at = cut(keys)
        for k in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[k], at[k + 1])
            rows.append((k, block // FAN, block, kind, pack(local(keys[part], width), width), encode(values[part])))
    return table(ASK_ARROW, list(zip(*rows)) if rows else [[]] * 6)


def told_to(told, kind, keys):
    """What a block was told of its sorted distinct keys of one kind, from rows of TELL."""
    at, out = cut(keys), np.zeros(len(keys), np.uint64)
    mine = told.filter(pa.array(told.column("kind").to_numpy() == kind)) if told.num_rows else told
    for bucket, values in zip(mine.column("bucket").to_pylist(), mine.column("vals").to_pylist()):
        out[at[bucket] : at[bucket + 1]] = decode(values, at[bucket + 1] - at[bucket])
    return out


def _merged(part, width, reduce):
    """(children, distinct keys, reduced values, places of each child's keys among them, borders between children) of rows of one kind."""
    raw = part.column("keys").to_pylist()
    at = np.cumsum([0, *(len(r) // width for r in raw)])
    keys, where = np.unique(np.concatenate([unpack(r, width) for r in raw]), return_inverse=True)
    values = np.concatenate([decode(v, n) for v, n in zip(part.column("vals").to_pylist(), np.diff(at).tolist())])
    return part.column("child").to_pylist(), keys, reduce(values, where, len(keys)), where, at


def _kinds(table_, widths):
    kind = table_.column("kind").to_numpy()
    for k in np.unique(kind).tolist():
        yield k, widths[k], table_.filter(pa.array(kind == k))


def _answers(bucket, kind, children, values, where, at):
    return [(bucket, c, kind, encode(values[where[i:j]])) for c, i, j in zip(children, at[:-1].tolist(), at[1:].tolist())]


def _top(widths, reduce, totals, mask=None):
    def run(rows):
        bucket, out = rows.column("bucket")[0].as_py(), []
        for kind, width, part in _kinds(rows, widths):
            children, keys, values, where, at = _merged(part, width, reduce)
            out += _answers(bucket, kind, children, values if mask is None else values & np.uint64(mask), where, at)
            if kind == totals and mask is None:
                out.append((bucket, -1, kind, int((values > 1).sum()).to_bytes(8, "little")))
        return table(TELL_ARROW, list(zip(*out)) if out else [[]] * 4)

    return run


def _up(level, widths, reduce):
    def run(rows):
        bucket, grp, out = rows.column("bucket")[0].as_py(), rows.column("grp")[0].as_py(), []
        for kind, width, part in _kinds(rows, widths):
            _, keys, values, _, _ = _merged(part, width, reduce)
            at = cut(keys, 8 * width - FAN_BITS * level)
            for k in np.flatnonzero(np.diff(at)).tolist():
                s = slice(at[k], at[k + 1])
                out.append((bucket * FAN + k, grp // FAN, grp, kind, pack(keys[s], width), encode(values[s])))
        return table(ASK_ARROW, list(zip(*out)) if out else [[]] * 6)

    return run


def _down(level, widths, reduce):
    def run(rows, told):
        if rows.num_rows == 0:
            return table(TELL_ARROW, [told.column("bucket"), told.column("child"), told.column("kind"), told.column("vals")])
        bucket, out = rows.column("bucket")[0].as_py(), []
        for kind, width, part in _kinds(rows, widths):
            children, keys, values, where, at = _merged(part, width, reduce)
            mine = told.filter(pa.array(told.column("kind").to_numpy() == kind))
            edges = cut(keys, 8 * width - FAN_BITS * level)
            values = np.zeros(len(keys), np.uint64)
            for finer, data in zip(mine.column("bucket").to_pylist(), mine.column("vals").to_pylist()):
                i, j = edges[finer % FAN], edges[finer % FAN + 1]
                values[i:j] = decode(data, j - i)
            out += _answers(bucket, kind, children, values, where, at)
        return table(TELL_ARROW, list(zip(*out)) if out else [[]] * 4)

    return run


def exchange(asks: DataFrame, blocks: int, widths: dict[int, int], reduce=sums, totals: int | None = None, depth: int | None = None, masks=(None,)) -> list[DataFrame]:
    """Answer rows of ASK with rows of TELL (child: the block): for each block and bucket the reduced values of its keys, in their order.

    widths: bytes of a key by kind. totals: a kind of which the number of
    entries with a count is told to child -1, by bucket. depth: levels of the
    tree, where it shall have more than the blocks need. masks: one answer for
    each, of the bits of the values that the mask has (None: all).
    """
    levels = [asks]
    for level in range(1, depth or levels_of(blocks)):
        levels.append(levels[-1].groupBy("bucket", "grp").applyInArrow(_up(level, widths, reduce), ASK))
    out = []
    for mask in masks:
        told = levels[-1].groupBy("bucket", "grp").applyInArrow(_top(widths, reduce, totals, mask), TELL)
        for level in range(len(levels) - 1, 0, -1):
            # a finer bucket answers to the node that cut it
            home = told.withColumn("home", F.when(F.col("child") < 0, F.col("bucket")).otherwise(F.shiftright("bucket", FAN_BITS)))
            told = levels[level - 1].groupBy("bucket", "grp").cogroup(home.groupBy("home", "child")).applyInArrow(_down(level, widths, reduce), TELL)
        out.append(told)
    return out


def table(schema, columns):
    return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
