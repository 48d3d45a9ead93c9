"""BPE encoding and decoding with a pair occurrence index.

The distinct word forms of a batch are laid out as one linked list of
symbols. An index maps every adjacent pair to all its positions in the batch;
the active ranks are taken in ascending order, each merge is applied at all
positions of its pair at once, and only the lists of the neighbouring pairs
change. Word forms are then looked up for each text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word pattern and special texts of the vocabulary file: fixed values.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
#: Letters and numbers of later Unicode versions than that of the tokenizer (16), which takes them for signs: fixed values, first and last of each run.
LATER = "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
FIRST_LATER = int(LATER.split("-")[0], 16)
#: Word forms kept from one batch to the next, in each of two generations.
MEMO_FORMS = 150_000
#: Texts whose forms are merged together.
TEXTS = 300
SYMBOL_BITS = 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Tables of a vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        self.ids = spec["model"]["vocab"]
        #: by rank: the two symbols and what they make; rank by pair
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.rank_of = {a << SYMBOL_BITS | b: r for r, (a, b, _) in reversed([*enumerate(self.merges)])}
        pairs = np.array(list(self.rank_of), np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.array(list(self.rank_of.values()), np.int64)[order]
        # bytes out of the vocabulary would be dropped, as the format has no unknown token
        alphabet = byte_alphabet()
        self.inner = np.array([self.ids.get(c, -1) for c in alphabet], np.int64)
        self.final = np.array([self.ids.get(c + WORD_END, -1) for c in alphabet], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.names}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        later = "".join("-".join(map(regex.escape, (chr(int(x, 16)) for x in run.split("-")))) for run in LATER.split())
        self.later = regex.compile(f"[{later}]")
        self.words_with_later = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{later}])\p{{L}})+|(?![{later}])\p{{N}}|(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{later}])+")

    def forms(self, text: str) -> list[str]:
        """The word forms of a text in order; a special token is a form of its own, which no other text gives."""
        parts = self.split_special.split(text) if any(map(text.__contains__, self.special)) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                has_later = not part.isascii() and np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).max() >= FIRST_LATER and self.later.search(part)
                out += (self.words_with_later if has_later else self.words).findall(part)
        return out


def encode_forms(vocab: Vocabulary, forms: list[str]) -> list[list[int]]:
    """Ids of each word form, by merging all forms together."""
    data = [b"" if f in vocab.special else f.encode() for f in forms]
    lengths = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(lengths)
    sym = vocab.inner[raw]
    last = ends[lengths > 0] - 1
    sym[last] = vocab.final[raw[last]]
    form_of = np.repeat(np.arange(len(forms)), lengths)
    sym, form_of = sym[sym >= 0], form_of[sym >= 0]
    n = len(sym)
    joined = form_of[:-1] == form_of[1:]
    right, left = np.full(n, -1), np.full(n, -1)
    right[:-1][joined] = np.flatnonzero(joined) + 1
    left[1:][joined] = np.flatnonzero(joined)
    # the index: for each rank, all positions of its pair, in order
    at = np.flatnonzero(joined)
    pair = sym[at] << SYMBOL_BITS | sym[at + 1]
    found = np.minimum(np.searchsorted(vocab.pairs, pair), len(vocab.pairs) - 1)
    known = vocab.pairs[found] == pair
    at, rank = at[known], vocab.pair_ranks[found[known]]
    order = np.argsort(rank, kind="stable")
    active, first = np.unique(rank[order], return_index=True)
    index = dict(zip(active.tolist(), (p.tolist() for p in np.split(at[order], first[1:]))))
    heap = active.tolist()  # sorted, so a heap
    sym, left, right = sym.tolist(), left.tolist(), right.tolist()
    rank_of, merges = vocab.rank_of.get, vocab.merges
    while heap:
        rank = heapq.heappop(heap)
        a, b, new = merges[rank]
        places = index.pop(rank)
        if a == b:
            places.sort()
        for i in places:
            j = right[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue  # an earlier merge took one of the two
            k = right[i] = right[j]
            sym[i], sym[j] = new, -1
            if k >= 0:
                left[k] = i
                r = rank_of(new << SYMBOL_BITS | sym[k])
                if r is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(heap, r)
            h = left[i]
            if h >= 0:
                r = rank_of(sym[h] << SYMBOL_BITS | new)
                if r is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(heap, r)
    out = np.array(sym, np.int64)
    alive = out >= 0
    bounds = np.searchsorted(form_of[alive], np.arange(len(forms) + 1)).tolist()
    out = out[alive].tolist()
    return [[vocab.special[f]] if f in vocab.special else out[x:y] for f, x, y in zip(forms, bounds, bounds[1:])]


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """The file names no decoder, so tokens are joined by one space as they are written in the vocabulary; ids out of it are skipped."""
    return " ".join(filter(None, map(vocab.names.get, ids)))


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and of the decoded text of every row; with_ids adds the ids themselves.

    vocabulary: path of the file, read on the driver and broadcast (a
    vocabulary has a fixed size). A null text is empty: no tokens and the
    digests of the empty text. Repeated rows and null keys are scored like any
    other; other columns are not read. An empty table gives an empty table.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        vocab, ids_of, text_of, older = Vocabulary(source.value), {}, {}, ({}, {})
        names = pa.schema([("doc_id", docs_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int32()))] * with_ids])
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [vocab.forms(t or "") for t in part.column("text").to_pylist()]
                if len(ids_of) > MEMO_FORMS:
                    older, ids_of, text_of = (ids_of, text_of), {}, {}
                new = []
                for form in set().union(*texts).difference(ids_of):
                    if form in older[0]:
                        ids_of[form], text_of[form] = older[0][form], older[1][form]
                    else:
                        new.append(form)
                for form, ids in zip(new, encode_forms(vocab, new)):
                    ids_of[form], text_of[form] = " ".join(map(vocab.numbers.__getitem__, ids)), decode_ids(vocab, ids)
                rows = [[], [], [], []]
                for forms in texts:
                    ids = " ".join(filter(None, map(ids_of.__getitem__, forms)))
                    rows[0].append(ids.count(" ") + 1 if ids else 0)
                    rows[1].append(digest(ids))
                    rows[2].append(digest(" ".join(filter(None, map(text_of.__getitem__, forms)))))
                    if with_ids:
                        rows[3].append(np.array(ids.split(), np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(docs_type), *(pa.array(r, s.type) for r, s in zip(rows, list(names)[1:]))], schema=names)

    from pyspark.sql.pandas.types import to_arrow_type

    docs_type = to_arrow_type(docs.schema[key].dataType)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
