"""Substring deduplication by level-wise doubling.

A window of 2L words can repeat across documents only where the windows of L
words at both of its halves repeat. The first level asks about the windows of
FIRST words of all texts; only positions whose windows repeat go on to windows
of twice the length, level by level, until the target length is reached; where
no candidate survives, a level has nothing to ask. Up to the last level
"repeats" is tested on shortened hashes, which can only let too much through;
the last level compares 64-bit hashes and finds the smallest document that
holds each window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .words import inside, mix, text_buffer, windows, word_hashes

#: Words of the windows of the first level.
FIRST = 4
#: Bytes of a hash beyond its bucket bits: in the levels that filter, and in the last one.
SHORT, WHOLE = 4, 8
NO_ID = B.NO_ID


def levels(window: int) -> list[int]:
    """Window lengths: doubled from FIRST on, the last being the target."""
    out = [min(FIRST, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _hashed(table):
    raw, ends = text_buffer(table.column("text"))
    h, places = word_hashes(raw, ends, lower=False)
    ids = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else table.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
    return h, places, ids.astype(np.int64)


def _longer(h, short, long):
    """Hash of a window of `long` words from those of its first and last `short` words."""
    n = len(h) - (long - short)
    return mix(h[:n] * np.uint64(0x9FB21C651E98DF25) + h[long - short :] * np.uint64(0xD6E8FEB86659FD93)) if n > 0 else np.zeros(0, np.uint64)


def _chain(h, lengths):
    """Window hashes of every level for all positions."""
    out = [windows(h, lengths[0])]
    for a, b in zip(lengths, lengths[1:]):
        out.append(_longer(out[-1], a, b))
    return out


def _survivors(chain, places, lengths, told):
    """Positions at which a window of the last of these lengths fits, and of which both halves repeat at every level before."""
    alive = None
    for k, length in enumerate(lengths):
        w = chain[k]
        ok = inside(places, length, len(w))
        if alive is not None:
            gap = length - lengths[k - 1]
            ok &= alive[: len(w)] & alive[gap : gap + len(w)]
        if k == len(lengths) - 1:
            return ok
        at = np.flatnonzero(ok)
        keys, where, counts = np.unique(B.kept_bits(w[at], SHORT), return_inverse=True, return_counts=True)
        good = ((B.told_to(told, k, keys) & np.uint64(1)) > 0) | (counts > 1)
        alive = np.zeros(len(w), bool)
        alive[at[good[where]]] = True


def _ask(lengths):
    """Windows of a level that filters."""

    def run(docs, told):
        if docs.num_rows == 0:
            return B.ASK_ARROW.empty_table()
        h, places, _ = _hashed(docs)
        chain = _chain(h, lengths)
        keys = np.unique(B.kept_bits(chain[-1][_survivors(chain, places, lengths, told)], SHORT))
        return B.ask_rows(docs.column("block")[0].as_py(), [(len(lengths) - 1, SHORT, keys, np.zeros(len(keys), np.uint64))])

    return run


def _last_ask(lengths):
    """Candidates of the last level with the smallest document of the block that holds them."""

    def run(docs, told):
        if docs.num_rows == 0:
            return B.ASK_ARROW.empty_table()
        h, places, ids = _hashed(docs)
        chain = _chain(h, lengths)
        at = np.flatnonzero(_survivors(chain, places, lengths, told))
        keys, where = np.unique(chain[-1][at], return_inverse=True)
        low = B.smallest(np.repeat(ids, np.diff(places))[at].view(np.uint64), where, len(keys))
        return B.ask_rows(docs.column("block")[0].as_py(), [(len(lengths) - 1, WHOLE, keys, low)])

    return run


def _covered(h, places, ids, lengths, told, least):
    """The words that a window covers which a smaller document also holds."""
    chain = _chain(h, lengths)
    at = np.flatnonzero(_survivors(chain, places, lengths, told))
    keys, where = np.unique(chain[-1][at], return_inverse=True)
    low = B.told_to(least, len(lengths) - 1, keys).view(np.int64)
    hit = at[np.repeat(ids, np.diff(places))[at] > low[where]]
    gone = np.zeros(len(h) + 1, np.int64)
    np.add.at(gone, hit, 1)
    np.add.at(gone, hit + lengths[-1], -1)
    return np.cumsum(gone[:-1]) > 0


def _remove(lengths, with_text):
    names = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * with_text])

    def run(docs, told):
        if docs.num_rows == 0:
            return names.empty_table()
        h, places, ids = _hashed(docs)
        last = len(lengths) - 1
        final = told.column("kind").to_numpy() == last
        gone = _covered(h, places, ids, lengths, told.filter(pa.array(~final)), told.filter(pa.array(final)))
        rows = [[], [], [], []]
        for i, text in enumerate(docs.column("text")):
            words = (text.as_py() or "").encode().split()
            drop = gone[places[i] : places[i + 1]]
            n = int(drop.sum())
            if n:
                words = [w for w, d in zip(words, drop.tolist()) if not d]
            kept = b" ".join(words)
            rows[0].append(len(drop))
            rows[1].append(n)
            rows[2].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                rows[3].append(kept.decode())
        return pa.Table.from_arrays([docs.column("doc_id"), *(pa.array(r, f.type) for r, f in zip(rows, list(names)[1:]))], schema=names)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", with_text: bool = False, depth: int | None = None) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller key.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 and, on
    request, kept_text (words joined by one space). Windows are judged on the
    input. A null text has no words; a null key is larger than any other, and
    rows with equal keys never take words from each other. Repeats within one
    document stay. Other columns are not read. An empty table gives an empty
    table. depth: levels of the exchange, if not as few as the texts need.
    """
    lengths = levels(window)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = B.n_blocks(B.total_bytes(docs, "text"))
    dealt, told = B.with_block(docs, blocks), docs.sparkSession.createDataFrame([], B.TELL)
    for k in range(len(lengths)):
        last = k == len(lengths) - 1
        asks = dealt.groupBy("block").cogroup(told.groupBy("child")).applyInArrow((_last_ask if last else _ask)(lengths[: k + 1]), B.ASK)
        (more,) = B.exchange(asks, blocks, {k: WHOLE if last else SHORT}, B.smallest if last else B.sums, depth=depth)
        told = more if k == 0 else told.unionByName(more)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("block").cogroup(told.groupBy("child")).applyInArrow(_remove(lengths, with_text), schema)


def op7_substring(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
