"""Byte-level BPE encoding and decoding by tree reduction over a monoid.

The encodings of byte strings form a monoid: the product of the encodings of x
and y is the encoding of xy. A piece is cut into halves, again and again, down
to LEAF bytes, which are merged rank by rank; neighbours are joined on the way
up. To join two encodings, the last tokens of the left one and the first of
the right one are encoded anew together, in a window that doubles until its
first and last tokens come out as they went in.

Why that settles it: tokens are the encoding of their bytes if each of them is
that of its own bytes and each two neighbours are that of theirs, since a merge
across a border would have been the next one for the two neighbours alone, too.
Neighbours outside the window were so before; a window that begins and ends
with the token it had keeps the two seams as they were; and within the window
the tokens are an encoding. So no token outside can change.

Decoding joins the bytes of the tokens, neighbour by neighbour, up the same
kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import FIRST_LATER, LATER

#: Bytes that are merged directly, at the bottom of the tree.
LEAF = 8
#: Bytes from which on a window is merged with a heap.
LONG = 96
NONE = 1 << 60
#: Pieces kept from one batch to the next, in each of two generations.
MEMO_PIECES = 200_000
#: Merged windows that are kept.
MEMO_WINDOWS = 200_000
#: Characters of the pieces after which the next generation begins.
MEMO_CHARS = 8_000_000
#: Texts whose pieces are looked up together.
TEXTS = 200
#: Stands for a letter or number that the library's tables don't know yet and take for a sign.
SIGN = "☃"


class Ranks:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line."""

    def __init__(self, source: bytes, pattern: str):
        self.rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
        self.bytes_of = {r: t for t, r in self.rank_of.items()}
        # tuples, which the garbage collector need not visit
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.pattern = regex.compile(pattern)
        later = "".join("-".join(map(regex.escape, (chr(int(x, 16)) for x in run.split("-")))) for run in LATER.split())
        self.later = regex.compile(f"[{later}]")

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, in order."""
        if not text.isascii() and np.frombuffer(text.encode("utf-32-le"), np.uint32).max() >= FIRST_LATER:
            seen = self.later.sub(SIGN, text)
            if seen != text:
                return [text[m.start() : m.end()] for m in self.pattern.finditer(seen)]
        return self.pattern.findall(text)

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Ranks of the tokens of a byte string by merging: the pair of lowest rank first, the leftmost of equals."""
        if len(data) > LONG:
            return self._merged_by_heap(data)
        out = self.windows.get(data)
        if out is None:
            if len(self.windows) >= MEMO_WINDOWS:
                self.windows.clear()
            out = self.windows[data] = self._merged_in_list(data)
        return out

    def _merged_in_list(self, data: bytes) -> tuple[int, ...]:
        """The same over a list of the places between tokens and one of the ranks of neighbours."""
        get, n = self.rank_of.get, len(data)
        cuts = [*range(n + 1)]
        pairs = [get(data[i : i + 2], NONE) for i in range(n - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(data[cuts[i - 1] : cuts[i + 1]], NONE)
            if i < len(pairs):
                pairs[i] = get(data[cuts[i] : cuts[i + 2]], NONE)
        rank_of = self.rank_of
        return tuple([rank_of[data[i:j]] for i, j in zip(cuts, cuts[1:])])

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        """The same in n log n steps: pairs wait in a heap, and one that has changed since is skipped."""
        rank_of, n = self.rank_of, len(data)
        stop, before, after = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        rank = [rank_of.get(data[i : i + 2], NONE) for i in range(n - 1)] + [NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            stop[i], after[i], rank[j] = stop[j], after[j], NONE
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    m = after[k]
                    rank[k] = rank_of.get(data[k : stop[m]], NONE) if m < n else NONE
                    if rank[k] != NONE:
                        heapq.heappush(heap, (rank[k], k))
        out, i = [], 0
        while i < n:
            out.append(rank_of[data[i : stop[i]]])
            i = after[i]
        return tuple(out)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encodings' bytes together."""
        if not left or not right:
            return left + right
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            mid = self.merged(b"".join(map(self.bytes_of.__getitem__, a + b)))
            if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            size *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Ranks of the tokens of a byte string: halves first, then joined."""
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ranks of a match of the pattern; one that is a token itself is that token."""
        data = piece.encode()
        whole = self.rank_of.get(data)
        return self.encode(data) if whole is None else (whole,)

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """The bytes of tokens, joined in pairs up a tree; ids out of the vocabulary are an error."""
        if len(ids) < 3:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids (joined by commas) and of the decoded bytes of every row; with_ids adds the ids themselves.

    ranks: path of the vocabulary file, read on the driver and broadcast (a
    vocabulary has a fixed size). pattern: splits a text into the pieces that
    are encoded. A null text is empty: no tokens and the digests of nothing.
    Repeated rows and null keys are encoded like any other, long texts and
    long pieces whole; other columns are not read. An empty table gives an
    empty table.
    """
    with open(ranks, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = docs.schema[key].dataType
    schema = f"doc_id {key_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = pa.schema([("doc_id", to_arrow_type(key_type)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches):
        table, memo, older, size = Ranks(source.value, pattern), ({}, {}), ({}, {}), 0
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [table.pieces(t or "") for t in part.column("text").to_pylist()]
                if len(memo[0]) > MEMO_PIECES or size > MEMO_CHARS:
                    older, memo, size = memo, ({}, {}), 0
                ids_of, bytes_of = memo
                for piece in set().union(*texts).difference(ids_of):
                    size += len(piece)
                    if piece in older[0]:
                        ids_of[piece], bytes_of[piece] = older[0][piece], older[1][piece]
                    else:
                        tokens = table.encode_piece(piece)
                        ids_of[piece], bytes_of[piece] = ",".join(map(str, tokens)), table.decode(tokens)
                rows = [[], [], [], []]
                for pieces in texts:
                    ids = ",".join(map(ids_of.__getitem__, pieces))
                    rows[0].append(ids.count(",") + 1 if ids else 0)
                    rows[1].append(digest(ids.encode()))
                    rows[2].append(digest(b"".join(map(bytes_of.__getitem__, pieces))))
                    if with_ids:
                        rows[3].append(np.array(ids.split(",") if ids else [], np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(names[0].type), *(pa.array(r, f.type) for r, f in zip(rows, [*names][1:]))], schema=names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
