"""Benchmark decontamination by q-gram lemma filtering.

Two passages of w characters within e edits share at least
w + 1 - q * (e + 1) q-grams, and these lie within e diagonals of one another.
So a text's q-grams that also occur in a benchmark item are counted in
overlapping bands of diagonals (pairs of a text place and an item place with
nearly the same difference). Regions where a window of w characters reaches
that bound are kept and verified by a banded alignment.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

Q, WINDOW, ERRORS = 10, 50, 3
#: A passage counts from this share of its item on, or from this many characters on.
SHARE, ENOUGH = 0.5, 100
#: Characters of benchmark text whose index is broadcast at a time.
BLOCK_CHARS = 4_000_000
#: log2 of the size of the table of q-grams asked first.
TABLE_BITS = 22
#: Pairs of a text place and an item place that are looked at together.
HITS = 1_000_000
#: Texts looked at together have about so many characters.
CHUNK_CHARS = 400_000

FOUND = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, edits long"
FOUND_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in FOUND.split(", ")])


def normal(text) -> str:
    """Lower case with single spaces; null is empty."""
    return " ".join((text or "").lower().split())


def _codes(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes, q):
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(29)
    out, weight = np.zeros(n, np.uint64), 1
    for k in range(q):
        out += wide[k : k + n] * np.uint64(weight)
        weight = weight * 0xD1342543DE82EF95 % 2**64
    return mix(out)


class Index:
    """Places of the q-grams of a block of benchmark items."""

    def __init__(self, items, q):
        self.ids = [i for i, _ in items]
        self.codes = [_codes(normal(t)) for _, t in items]
        grams = [_grams(c, q) for c in self.codes]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True


def banded_edits(a, b, most):
    """Edit distance of two character arrays, or most + 1 if it is larger: only cells within `most` diagonals are filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) == len(b) and (a == b).all():
        return 0
    width = 2 * most + 1
    far = most + 1
    shift = np.arange(width)
    row = np.where((shift >= most) & (shift - most <= len(b)), shift - most, far)
    for i in range(1, len(a) + 1):
        j = i + shift - most  # column of each cell
        inner = (j >= 1) & (j <= len(b))
        differs = np.ones(width, np.int64)
        differs[inner] = b[j[inner] - 1] != a[i - 1]
        new = np.where(inner, row + differs, far)
        new[:-1] = np.minimum(new[:-1], np.where((j[:-1] >= 0) & (j[:-1] <= len(b)), row[1:] + 1, far))
        new = np.where(j == 0, i, new)
        # insertions run along the row
        new = np.minimum.accumulate(new - shift) + shift
        row = np.where((j >= 0) & (j <= len(b)), np.minimum(new, far), far)
        if row.min() > most:
            return far
    return int(row[len(b) - len(a) + most])


def _dense(index, q, window, errors, starts, at, found, owner):
    """Rows (owner, item, band, first place in the item, last, first hit, last) of the regions of each band in which windows meet the bound. at are text places, found the index's keys there."""
    times = index.count[found]
    hit = np.repeat(at, times)
    entry = np.repeat(index.first[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    item, place, owner = index.item[entry], index.place[entry], np.repeat(owner, times)
    diagonal = hit - starts[owner] - place
    # bands of 2 * (errors + 1) diagonals begin every errors + 1
    band = diagonal // (errors + 1)
    item, place, owner, hit, band = (np.concatenate([x, y]) for x, y in ((item, item), (place, place), (owner, owner), (hit, hit), (band, band - 1)))
    order = np.lexsort((hit, band, item, owner))
    item, place, owner, hit, band = item[order], place[order], owner[order], hit[order], band[order]
    need = window + 1 - q * (errors + 1)
    n = len(hit) - need + 1
    if n <= 0:
        return np.zeros((0, 7), np.int64)
    group = np.concatenate([[0], np.cumsum((item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (band[1:] != band[:-1]))])
    dense = np.flatnonzero((group[:n] == group[need - 1 :]) & (hit[need - 1 :] - hit[:n] <= window + errors - q))
    if not len(dense):
        return np.zeros((0, 7), np.int64)
    # runs of windows that meet the bound and lie near each other are one region
    new = np.flatnonzero(np.concatenate([[True], (group[dense][1:] != group[dense][:-1]) | (hit[dense][1:] - hit[dense + need - 1][:-1] > window)]))
    first, last = dense[new], dense[np.concatenate([new[1:], [len(dense)]]) - 1] + need - 1
    ends = np.stack([first, last + 1], axis=1).ravel()
    low, high = (f.reduceat(np.append(place, place[-1]), ends)[::2] for f in (np.minimum, np.maximum))
    return np.stack([owner[first], item[first], band[first], low, high, hit[first], hit[last]], axis=1)


def _candidates(index, q, window, errors, codes, starts):
    """(text, first place in the item, last, first place in the text, last) of each region of a band that meets the bound; codes holds several texts, and a region stays within one.

    Places are taken in strips of at most HITS pairs, so that what repeats in
    text and item is held in parts. A strip begins a window early: each window
    lies within one, and regions of one band that go on in the next are joined.
    """
    grams = _grams(codes, q)
    at = np.flatnonzero(index.table[grams >> np.uint64(64 - TABLE_BITS)])
    if not len(at):
        return []
    found = np.minimum(np.searchsorted(index.keys, grams[at]), len(index.keys) - 1)
    same = index.keys[found] == grams[at]
    at, found = at[same], found[same]
    owner = np.searchsorted(starts, at, side="right") - 1
    inside = at + q <= starts[owner + 1]
    at, found, owner = at[inside], found[inside], owner[inside]
    if not len(at):
        return []
    strip = np.cumsum(index.count[found]) // HITS
    begins = np.flatnonzero(np.concatenate([[True], strip[1:] != strip[:-1]]))
    parts = []
    for i, j in zip(begins, np.append(begins[1:], len(at))):
        i = np.searchsorted(at, at[i] - (window + errors - q))
        parts.append(_dense(index, q, window, errors, starts, at[i:j], found[i:j], owner[i:j]))
    rows = np.concatenate(parts)
    if len(parts) > 1 and len(rows):
        rows = rows[np.lexsort((rows[:, 6], rows[:, 5], rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1) | (rows[1:, 5] - rows[:-1, 6] > window)]))
        rows = np.concatenate([rows[new, :3], np.minimum.reduceat(rows[:, 3:4], new), np.maximum.reduceat(rows[:, 4:5], new), np.minimum.reduceat(rows[:, 5:6], new), np.maximum.reduceat(rows[:, 6:7], new)], axis=1)
    return [(o, item, low, high + q, h0 - int(starts[o]), h1 - int(starts[o]) + q) for o, item, _, low, high, h0, h1 in rows.tolist()]


def _runs(a, b, q, slack):
    """Runs of q or more equal characters on a best alignment of two character arrays, as rows of (start in a, start in b, edits before, end in a, end in b). Only diagonals within `slack` of the ends are filled."""
    low = min(0, len(b) - len(a)) - slack
    shift = np.arange(abs(len(b) - len(a)) + 2 * slack + 1)
    far = len(a) + len(b) + 1
    cost = np.full((len(a) + 1, len(shift)), far, np.int32)
    cost[0] = np.where((shift + low >= 0) & (shift + low <= len(b)), shift + low, far)
    for i in range(1, len(a) + 1):
        j = i + shift + low
        inner = (j >= 1) & (j <= len(b))
        new = np.where(inner, cost[i - 1] + (b[np.clip(j - 1, 0, len(b) - 1)] != a[i - 1]), far)
        new[:-1] = np.minimum(new[:-1], cost[i - 1][1:] + 1)
        new = np.where((j >= 0) & (j <= len(b)), new, far)
        cost[i] = np.minimum(np.minimum.accumulate(new - shift) + shift, far)
    i, j, runs = len(a), len(b), []
    while i > 0 and j > 0:
        end = i, j
        while i > 0 and j > 0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        if end[0] - i >= q:
            runs.append((i, j, int(cost[i, j - i - low]), *end))
        k = j - i - low
        if i > 0 and j > 0 and cost[i, k] == cost[i - 1, k] + 1:
            i, j = i - 1, j - 1
        elif i > 0 and k + 1 < len(shift) and cost[i, k] == cost[i - 1, k + 1] + 1:
            i -= 1
        else:
            j -= 1
    return np.array(runs[::-1], np.int64).reshape(-1, 5)


def _parts(runs, least, errors, window):
    """The longest stretch from one run to another within errors / window edits a character and of the least length, then those beside it."""
    begin, end = errors * runs[:, 0] - window * runs[:, 2], errors * runs[:, 3] - window * runs[:, 2]
    todo = [(0, len(runs))]
    while todo:
        i, j = todo.pop()
        if i == j or runs[j - 1, 3] - runs[i, 0] < least:
            continue
        # the last end that leaves each begin within the budget
        best = np.maximum.accumulate(end[i:j][::-1])[::-1]
        last = i + np.searchsorted(-best, -begin[i:j], side="right") - 1
        first = i + int(np.argmax(runs[last, 3] - runs[i:j, 0]))
        last = int(last[first - i])
        if runs[last, 3] - runs[first, 0] >= least:
            yield runs[first, 0], runs[last, 3], runs[first, 1], runs[last, 4]
            todo += [(i, first), (last + 1, j)]


def _widened(passage, text, i0, i1, d0, d1):
    """The region with the equal characters on both sides of it."""
    while i0 > 0 and d0 > 0 and passage[i0 - 1] == text[d0 - 1]:
        i0, d0 = i0 - 1, d0 - 1
    while i1 < len(passage) and d1 < len(text) and passage[i1] == text[d1]:
        i1, d1 = i1 + 1, d1 + 1
    return i0, i1, d0, d1


def _verify(passage, text, region, q, window, errors):
    """(i0, i1, d0, d1, edits) of the region, or of the parts of it that are within the budget if it is not; none below the least length."""
    i0, i1, d0, d1 = region
    least = min(max(window, SHARE * len(passage)), max(window, ENOUGH), len(passage))
    if i1 - i0 < least:
        return []
    most = errors * (i1 - i0) // window
    edits = banded_edits(passage[i0:i1], text[d0:d1], most)
    if edits <= most:
        return [(i0, i1, d0, d1, edits)]
    found = []
    for a0, a1, b0, b1 in _parts(_runs(passage[i0:i1], text[d0:d1], q, 2 * (errors + 1)), least, errors, window):
        a0, a1, b0, b1 = int(i0 + a0), int(i0 + a1), int(d0 + b0), int(d0 + b1)
        found.append((a0, a1, b0, b1, banded_edits(passage[a0:a1], text[b0:b1], errors * (a1 - a0) // window)))
    return found


def _passages(index, text, regions, q, window, errors):
    """(d0, d1, i0, i1, edits) of the passages in the regions of one text, no two of which share a place of the text: the longest first, of equals the first in the text.

    A region is aligned once no longer one is left, and only what accepted
    passages leave of it. So where text and item repeat themselves and meet on
    many diagonals, most of these need no alignment.
    """
    # a passage has no fewer characters of the text
    short = min(window, min(len(index.codes[item]) for item, *_ in regions)) * (window - errors) // window
    widened = {(item, *_widened(index.codes[item], text, *places)) for item, *places in regions}
    queue = [(d0 - d1, True, d0, d1, item, i0, i1, 0) for item, i0, i1, d0, d1 in widened]
    heapq.heapify(queue)
    begins, ends, found = [], [], []
    while queue:
        _, fresh, d0, d1, item, i0, i1, edits = heapq.heappop(queue)
        first, last = bisect.bisect_right(ends, d0), bisect.bisect_left(begins, d1)
        if first < last:
            for g0, g1 in zip([d0, *ends[first:last]], [*begins[first:last], d1]):
                j0, j1 = i0 + max(g0 - d0, 0), i1 - max(d1 - g1, 0)
                if g1 - g0 >= short and j0 < j1:
                    heapq.heappush(queue, (g0 - g1, True, g0, g1, item, j0, j1, 0))
        elif fresh:
            for i0, i1, d0, d1, edits in _verify(index.codes[item], text, (i0, i1, d0, d1), q, window, errors):
                heapq.heappush(queue, (d0 - d1, False, d0, d1, item, i0, i1, edits))
        else:
            begins.insert(first, d0)
            ends.insert(first, d1)
            found.append((d0, d1, i0, i1, edits))
    return sorted(found)


def _search(shared, q, window, errors):
    def run(batches):
        index = Index(shared.value, q)
        for batch in batches:
            ids, raw = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            texts, rows, i = [], [], 0
            while i < len(raw):
                j, size, texts = i, 0, []
                while j < len(raw) and (size < CHUNK_CHARS or j == i):
                    texts.append(normal(raw[j]))
                    size += len(texts[-1])
                    j += 1
                codes = _codes("".join(texts))
                starts = np.cumsum([0, *map(len, texts)])
                regions = {}
                for owner, item, i0, i1, d0, d1 in _candidates(index, q, window, errors, codes, starts):
                    regions.setdefault((owner, index.ids[item]), []).append((item, i0, i1, d0, d1))
                for (owner, item_id), places in regions.items():
                    found = _passages(index, codes[starts[owner] : starts[owner + 1]], places, q, window, errors)
                    rows += [(ids[i + owner], item_id, *x) for x in found]
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], schema=FOUND_ARROW)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, errors: int = ERRORS) -> DataFrame:
    """Passages of benchmark items in texts: item and text places (of the lower-cased text with single spaces), and edits.

    A passage is at least `window` characters of an item, and half of the item
    or ENOUGH characters, within errors / window edits a character. An item shorter than a window is sought whole,
    exactly, if it has window - q * errors characters or more, and not sought
    if it has fewer. Rows only for texts that hold a passage; null and empty
    texts hold none, and items that are null are not sought. Rows
    with a null key are reported with it; repeated rows each on their own. An
    empty table on either side gives an empty table. Other columns are not
    read. The benchmark is broadcast in blocks of BLOCK_CHARS characters, each
    of which is sought in all texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * size // BLOCK_CHARS))
    out = None
    for k in range(n):
        block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.toLocalIterator()])
        part = docs.mapInArrow(_search(shared, q, window, errors), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def op2_decontamination(spark, sf_dir):
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
