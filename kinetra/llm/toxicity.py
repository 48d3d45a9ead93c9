"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelt, one of toxic and one of ordinary training
texts. A character's probability after its history is the discounted count of
its own class, backed off order by order; up to SHARED_ORDER characters the
continuation counts are those of both classes together, so that rare spellings
are smoothed alike in both. A text's two log-likelihoods, each divided by the text's
length, are compared: over the whole text, and over its most toxic run of words
(with a prior length), since toxic phrases are a small part of long texts. The
two differences enter a logistic calibration, fitted on a part of the training
rows that the models have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, crc_mod, forget, materialize
from .words import mix, text_buffer, word_hashes

ORDER, SHARED_ORDER, DISCOUNT = 5, 2, 0.75
#: Added to a word's length, so that very short words carry little evidence.
PRIOR_LENGTH = 4
#: Words in a run, at most.
RUN = 2
#: Labelled rows of each class that are learnt from, at most.
SAMPLE = 6000
CALIBRATE = 4
THRESHOLD = 0.3
EVIDENCE = ("strongest", "toxic_log", "ordinary_log")
HEAD, TAIL = "\x02", "\x03"
#: Distinct words whose evidence a worker keeps.
MEMO_WORDS = 200_000
#: Texts looked at together.
TEXTS = 500


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Up to per_class labelled training rows of each class, those of smallest hash; held-out rows are left out."""
    usable = labels.where("toxic is not null and doc_id is not null").where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    picked = None
    for toxic in (True, False):
        part = usable.where(F.col("toxic") == F.lit(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of 9 bytes
    return docs.join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").select("doc_id", "text", "toxic")


def spelling_counts(rows: DataFrame) -> DataFrame:
    """(toxic, gram, n): the character n-grams of order ORDER of padded, lower-cased words."""
    words = rows.select("toxic", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE)).alias("word")).where("word <> ''").groupBy("toxic", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(HEAD * (ORDER - 1)), "word", F.lit(TAIL))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    return words.select("toxic", "n", F.explode(grams).alias("gram")).groupBy("toxic", "gram").agg(F.sum("n").alias("n"))


def _codes(grams):
    """Unicode characters of equally long strings as a matrix."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), -1)


def _hash(codes):
    """A hash of each row of characters."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + codes[:, k])
    return out


def fit_models(toxic, grams, counts):
    """For each order: sorted gram keys with the discounted probability in both classes, and history keys with the weight of backing off."""
    cls, codes, n = np.asarray(toxic, bool), _codes(grams), np.asarray(counts, float)
    levels = []
    for order in range(ORDER, 0, -1):
        keys, histories = _hash(codes[:, -order:]), _hash(codes[:, -order:-1]) if order > 1 else np.zeros(len(codes), np.uint64)
        if order < ORDER:
            # continuation counts: distinct longer grams; shared ones don't ask for the class
            who = np.zeros(len(cls), bool) if order <= SHARED_ORDER else cls
            longer = _hash(codes[:, -order - 1 :])
            _, first = np.unique(mix(longer * np.uint64(2) + who), return_index=True)
        else:
            first = np.arange(len(cls))
        k, h, c = keys[first], histories[first], cls[first]
        weight = n[first] if order == ORDER else np.ones(len(first))
        gram_keys, at_gram, where = np.unique(k, return_index=True, return_inverse=True)
        history_keys, of_history = np.unique(h, return_inverse=True)
        found, fail = [], []
        for want in (True, False):
            mine = np.ones(len(c)) if order <= SHARED_ORDER else (c == want).astype(float)
            times = np.bincount(where, weight * mine, len(gram_keys))
            total = np.bincount(of_history, weight * mine, len(history_keys))
            of_gram = of_history[at_gram]
            kinds = np.bincount(of_gram, times > 0, len(history_keys))
            cut = np.minimum(times, DISCOUNT)
            with np.errstate(divide="ignore", invalid="ignore"):
                found.append(np.where(times > 0, (times - cut) / total[of_gram], 0.0))
                fail.append(np.where(total > 0, DISCOUNT * kinds / total, 1.0))
        levels.append((gram_keys, np.stack(found), history_keys, np.minimum(np.stack(fail), 1.0)))
    return levels[::-1]


def word_likelihoods(models, words):
    """Rows (toxic, ordinary, length) of the words: their two log-likelihoods, and their characters with the end."""
    lengths = np.array([len(w) for w in words])
    text = "".join([HEAD * (ORDER - 1) + w + TAIL for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    steps = lengths + 1
    starts = np.cumsum(steps + ORDER - 1) - (steps + ORDER - 1)
    place = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    at = np.repeat(starts, steps) + place
    view = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at] if len(at) else np.zeros((0, ORDER), np.uint32)
    grams, where = np.unique(_hash(view), return_inverse=True)
    first = np.zeros(len(grams), np.int64)
    first[where] = np.arange(len(where))
    view = view[first]
    p = np.full((2, len(view)), 1e-5)
    for order, (gram_keys, found, history_keys, fail) in enumerate(models, 1):
        if not len(gram_keys):
            continue
        key = _hash(view[:, -order:])
        history = _hash(view[:, -order:-1]) if order > 1 else np.zeros(len(view), np.uint64)
        i = np.minimum(np.searchsorted(gram_keys, key), len(gram_keys) - 1)
        j = np.minimum(np.searchsorted(history_keys, history), len(history_keys) - 1)
        p = np.where(gram_keys[i] == key, found[:, i], 0.0) + np.where(history_keys[j] == history, fail[:, j], 1.0) * p
    sums = [np.add.reduceat(np.log(p[k])[where], np.cumsum(steps) - steps) if len(words) else np.zeros(0) for k in range(2)]
    return np.stack([*sums, steps.astype(float)], axis=1)


class Memo:
    """Likelihoods of up to `most` words by their hash, in sorted arrays (32 bytes a word)."""

    def __init__(self, most):
        self.most, self.keys, self.rows = most, np.zeros(0, np.uint64), np.zeros((0, 3))

    def get(self, keys):
        """A row for each key, nan where it is not known."""
        out = np.full((len(keys), 3), np.nan)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.rows[at[known]]
        return out

    def add(self, keys, rows):
        """Keys are sorted and new."""
        if len(self.keys) < self.most:
            at = np.searchsorted(self.keys, keys)
            self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows, axis=0)


def _evidence(models, raw, ends, memo):
    """For each text the difference of its strongest run, and its toxic and ordinary log-likelihoods by length; 0 for a text without words."""
    h, places, (starts, stops) = word_hashes(raw, ends, lower=True, spans=True)
    keys, first, where = np.unique(h, return_index=True, return_inverse=True)
    n = len(places) - 1
    out = np.zeros((n, 3))
    if not len(h):
        return out
    value = memo.get(keys)
    new = np.flatnonzero(np.isnan(value[:, 0]))
    if len(new):
        data = raw.tobytes()
        value[new] = word_likelihoods(models, [data[a:b].decode().lower() for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist())])
        memo.add(keys[new], value[new])
    filled = np.flatnonzero(np.diff(places))
    alone = ((value[:, 0] - value[:, 1]) / (value[:, 2] - 1 + PRIOR_LENGTH))[where]
    best, total = alone.copy(), alone.copy()
    last = np.repeat(places[1:], np.diff(places)) - 1
    for run in range(2, RUN + 1):
        total[: len(h) - run + 1] += alone[run - 1 :]
        fits = np.arange(len(h)) + run - 1 <= last
        best = np.where(fits, np.maximum(best, total / run), best)
    out[filled, 0] = np.maximum.reduceat(best, places[filled])
    toxic, ordinary, length = (np.add.reduceat(value[where, k], places[filled]) for k in range(3))
    out[filled, 1], out[filled, 2] = toxic / length, ordinary / length
    return out


def _logistic(x, y, ridge=1e-3, steps=60):
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        move = np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * w)
        w -= np.clip(move, -5, 5)
    return w


def _run_evidence(shared, keys):
    names = pa.schema([*((k, pa.int64()) for k in keys), *((k, pa.float64()) for k in EVIDENCE)])

    def run(batches):
        memo = Memo(MEMO_WORDS)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = _evidence(shared.value, *text_buffer(part.column("text")), memo)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *map(pa.array, found.T)], schema=names)

    return run


def evidence(texts: DataFrame, shared, *keys: str) -> DataFrame:
    keys = ("doc_id", *keys)
    return texts.select(*keys, "text").mapInArrow(_run_evidence(shared, keys), ", ".join(f"{k} long" for k in keys) + "".join(f", {k} double" for k in EVIDENCE))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, threshold: float = THRESHOLD, carry: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1) and predicted (score >= threshold).

    Learns from at most per_class labelled rows of each class, the bound of the
    models' size. Every text is scored whole; a null or empty text has no
    evidence and gets the score of none. Null and repeated keys are scored like
    any other. With labels of one class only, or none, the score is the share
    of that class. An empty table gives an empty table. Other columns are not
    read, but carry, a long column that is returned with each row.
    """
    more = [carry] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    spark = docs.sparkSession
    rows = materialize(training_rows(docs.select("doc_id", "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), per_class), "toxic-rows")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    counts = spelling_counts(rows.where(~apart)).toArrow()
    models = fit_models(counts.column("toxic").to_numpy(), counts.column("gram").to_pylist(), counts.column("n").to_numpy()) if counts.num_rows else []
    shared = spark.sparkContext.broadcast(models)
    # two numbers and a label for at most 2 * per_class rows
    seen = evidence(rows.where(apart), shared).join(rows.select("doc_id", F.col("toxic").cast("double").alias("y")).dropDuplicates(["doc_id"]), "doc_id").select("strongest", (F.col("toxic_log") - F.col("ordinary_log")).alias("whole"), "y").toArrow()
    x, y = np.column_stack([seen.column("strongest"), seen.column("whole")]), seen.column("y").to_numpy()
    if len(set(y.tolist())) == 2:
        a, b, c = map(float, _logistic(x, y))
    else:
        share = float(y.mean()) if len(y) else 0.0
        a, b, c = 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    forget(rows)
    score = 1 / (1 + F.exp(-(F.col("strongest") * a + (F.col("toxic_log") - F.col("ordinary_log")) * b + c)))
    return evidence(docs, shared, *more).select("doc_id", *more, (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *EVIDENCE)


def op8_toxicity(spark, sf_dir):
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
