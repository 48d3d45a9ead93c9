"""Language-model scoring with a weighted backoff automaton.

Training n-grams up to the order below the last are the automaton's states,
smoothed by a Dirichlet prior on the next shorter order. From the state of a
history h, the arc of a word w that was seen after it weighs

    (c(hw) + mu * P(w | h')) / (c(h) + mu)

and leads to the longest suffix of hw that is a state; the failure arc leads to
the shorter history h' and weighs mu / (c(h) + mu). At the root a word seen in
training weighs c(w) / (N + theta), any other theta / (N + theta), and leads
back to the root.

Counts cover every training text. A block of texts fetches the counts of its
own n-grams, which are all that its texts can reach, builds the states, arcs
and failure arcs of that part of the automaton as tables, and traverses its
texts from left to right: every step reads one token of each text, follows
failure arcs until the state has an arc for it, and carries the state and the
sum of log weights on. Long texts are walked in stretches: order - 1 tokens
from the root lead to the state in which a stretch begins.

N-grams of three words and more are asked for order by order, and only where
both shorter n-grams in them occur in another block too: any other n-gram
occurs in this block alone, whose own count of it is whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import crc_mod, materialize
from .words import mix, text_buffer, word_hashes

#: Hash that stands for the end of a text.
END = 0x5A17E0FDEADBEE15
ORDER = 3
NEW_WORDS = 6.0
#: Bytes of the hash of an n-gram beyond its bucket bits: whole for words, short for longer n-grams (one more for each level of the exchange).
WORD_BYTES, NGRAM_BYTES = 7, 5
#: Tokens of a stretch of a text that is walked by itself.
STRETCH = 512


def _tokens(table):
    """Hashes of all tokens (words and one end for each text) and the places where texts begin."""
    raw, ends = text_buffer(table.column("text"))
    h, places = word_hashes(raw, ends, lower=True)
    n = len(places) - 1
    out = np.empty(len(h) + n, np.uint64)
    starts = places + np.arange(n + 1)
    is_end = np.zeros(len(out), bool)
    is_end[starts[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = h
    return out, starts


class Grams:
    """The n-grams of a block's texts: for each order the sorted distinct hashes, the training count of each in the block, and the id of the n-gram that ends at each token (-1 where its text has none yet)."""

    def __init__(self, table, order, widths):
        self.tokens, self.starts = _tokens(table)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        train = np.repeat(table.column("train").to_numpy(zero_copy_only=False), np.diff(self.starts))
        self.keys, self.counts, self.at, self.shared = [], [], [], []
        longer = self.tokens
        for n in range(1, order + 1):
            if n > 1:
                longer = np.concatenate([longer[:1], mix(longer[:-1] * np.uint64(0x9FB21C651E98DF25) + self.tokens[1:] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n))])
            whole = self.place >= n - 1
            keys, where = np.unique(B.kept_bits(longer[whole], widths[n]), return_inverse=True)
            at = np.full(len(self.tokens), -1, np.int32)
            at[whole] = where
            self.keys.append(keys)
            self.counts.append(np.bincount(where, train[whole], len(keys)).astype(np.uint64))
            self.at.append(at)

    def asked(self, n):
        """Which n-grams of order n other blocks have to be asked about; the orders below have been told."""
        if n < 3:
            return np.ones(len(self.keys[n - 1]), bool)
        both = np.zeros(len(self.tokens), bool)
        below, at = self.shared[n - 2], self.at[n - 2]
        both[1:] = (at[1:] >= 0) & (at[:-1] >= 0) & below[at[1:]] & below[at[:-1]]
        out = np.zeros(len(self.keys[n - 1]), bool)
        out[self.at[n - 1][both & (self.at[n - 1] >= 0)]] = True
        return out

    def hear(self, n, told):
        """Take over the totals of order n."""
        asked = self.asked(n)
        values = B.told_to(told, n, self.keys[n - 1][asked])
        self.counts[n - 1][asked] = values >> np.uint64(1)
        shared = np.zeros(len(asked), bool)
        shared[asked] = (values & np.uint64(1)) > 0
        self.shared.append(shared)


def _ask(orders, widths):
    """Ask about n-grams of the given orders, when those below have been told."""

    def run(docs, told):
        if docs.num_rows == 0:
            return B.ASK_ARROW.empty_table()
        grams = Grams(docs, orders[-1], widths)
        for n in range(1, orders[0]):
            grams.hear(n, told)
        asked = [(n, grams.asked(n)) for n in orders]
        return B.ask_rows(docs.column("block")[0].as_py(), [(n, widths[n], grams.keys[n - 1][a], grams.counts[n - 1][a] << np.uint64(1)) for n, a in asked])

    return run


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block, as tables. State 0 is the root; the states of order n follow those of order n - 1."""

    def __init__(self, grams, n_tokens, mu, theta):
        order = len(grams.keys)
        first = np.cumsum([1, *map(len, grams.keys[: order - 1])])
        self.level, self.fail = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        self.log_back = np.zeros(first[-1])
        self.log_unknown = math.log10(theta / (n_tokens + theta))
        #: by order, for each n-gram: log weight of its arc (NaN if there is none), and the state it leads to
        self.log_arc, self.to = [], []
        weight = counts = suffix_state = None
        for n in range(1, order + 1):
            below, counts = counts, grams.counts[n - 1].astype(float)
            at = grams.at[n - 1]
            some = np.zeros(len(counts), np.int64)  # a place of each n-gram
            here = np.flatnonzero(at >= 0)
            some[at[here]] = here
            if n == 1:
                new = counts / (n_tokens + theta)
                suffix_state = np.zeros(len(counts), np.int64)
            else:
                history, suffix = grams.at[n - 2][some - 1], grams.at[n - 2][some]
                new = (counts + mu * weight[suffix]) / (below[history] + mu)
                suffix_state = first[n - 2] + suffix
            seen, weight = counts > 0, new
            self.log_arc.append(np.log10(weight, out=np.full(len(weight), np.nan), where=seen))
            if n < order:
                states = first[n - 1] + np.arange(len(counts))
                self.level[states], self.fail[states] = n, suffix_state
                self.log_back[states] = np.log10(mu / (counts + mu))
                self.to.append(states)
            else:
                self.to.append(suffix_state)
        if order == 1:
            self.to = [np.zeros(len(self.log_arc[0]), np.int64)]

    def walk(self, grams):
        """Sum of log weights over each text, in one pass from left to right with the state carried along."""
        order, sizes = len(self.to), np.diff(grams.starts)
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        begin = grams.starts[:-1][text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + STRETCH, grams.starts[1:][text])
        at = np.maximum(begin - (order - 1), grams.starts[:-1][text])
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            here, s = at[live], state[live]
            gained, todo = np.zeros(len(live)), np.arange(len(live))
            while len(todo):
                level, left = self.level[s[todo]], []
                for n in range(order):
                    mine = todo[level == n]
                    if not len(mine):
                        continue
                    arc = grams.at[n][here[mine]]
                    weight = self.log_arc[n][arc]
                    found = ~np.isnan(weight)
                    taken, lost = mine[found], mine[~found]
                    gained[taken] += weight[found]
                    s[taken] = self.to[n][arc[found]]
                    if n == 0:
                        gained[lost] += self.log_unknown
                        s[lost] = 0
                    else:
                        gained[lost] += self.log_back[s[lost]]
                        s[lost] = self.fail[s[lost]]
                        left.append(lost)
                todo = np.concatenate(left) if left else todo[:0]
            state[live] = s
            total[live] += np.where(here >= begin[live], gained, 0.0)
            at[live] += 1
            live = live[at[live] < end[live]]
        return np.bincount(text, total, len(sizes))


def _score(order, widths, n_tokens, mu, theta, names):
    def run(docs, told):
        if docs.num_rows == 0:
            types = sum(int.from_bytes(v, "little") for v in told.column("vals").to_pylist())
            return pa.Table.from_arrays([pa.nulls(1, names[0].type), *(pa.array([v], f.type) for v, f in zip([False, types, 0, 0.0, 0.0, True], list(names)[1:]))], schema=names)
        grams = Grams(docs, order, widths)
        for n in range(1, order + 1):
            grams.hear(n, told)
        score = Automaton(grams, n_tokens, mu, theta).walk(grams)
        count = grams.counts[0][grams.at[0]]
        per_text = lambda x: np.add.reduceat(x, grams.starts[:-1])  # noqa: E731  every text has its end
        columns = [docs.column("doc_id"), pa.array(~docs.column("train").to_numpy(zero_copy_only=False)), pa.array(np.diff(grams.starts)), pa.array(per_text((count > 0).astype(np.int64))), pa.array(per_text(np.log10(count + 1.0))), pa.array(score), pa.array(np.zeros(docs.num_rows, bool))]
        return pa.Table.from_arrays(columns, schema=names)

    return run


def _token_counts(batches):
    for batch in batches:
        _, ends = text_buffer(batch.column("text"))
        _, starts = _tokens(batch)
        train = batch.column("train").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([int(ends[-1])]), pa.array([int(np.diff(starts)[train].sum())])], ["bytes", "tokens"])


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, mu: float = 100.0, theta: float | None = None, key: str = "doc_id", text: str = "text", depth: int | None = None) -> DataFrame:
    """Score every text with a model of the texts for which `train` is true.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score, both log10. Tokens are words with
    A-Z lower-cased, and one end; a null text is empty and has the end alone.
    Null and repeated keys are scored like any other. With no training text
    every token is unknown. An empty table gives an empty table. Other columns
    are not read. Where theta is not given it follows Heaps' law for new words,
    NEW_WORDS * N ** 0.75. depth: levels of the exchange, if not as few as the
    texts need.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    seen = docs.mapInArrow(_token_counts, "bytes long, tokens long").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    blocks, n_tokens = B.n_blocks(seen["bytes"]), seen["tokens"]
    theta = theta or NEW_WORDS * max(1, n_tokens) ** 0.75
    names = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("is_total", pa.bool_())])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, is_total boolean"
    widths = {n: WORD_BYTES if n == 1 else min(7, NGRAM_BYTES + (depth or B.levels_of(blocks)) - 1) for n in range(1, order + 1)}
    dealt = B.with_block(docs, blocks)
    told = flags = docs.sparkSession.createDataFrame([], B.TELL)
    # words and pairs first, then order by order; what later orders need of earlier ones is one bit an n-gram
    for orders in [[*range(1, min(order, 2) + 1)], *([n] for n in range(3, order + 1))]:
        asks = dealt.groupBy("block").cogroup(flags.groupBy("child")).applyInArrow(_ask(orders, widths), B.ASK)
        more, bits = B.exchange(asks, blocks, widths, B.sums, totals=1, depth=depth, masks=(None, 1))
        told, flags = (more, bits) if orders[0] == 1 else (told.unionByName(more), flags.unionByName(bits))
    scored = materialize(dealt.groupBy("block").cogroup(told.groupBy("child")).applyInArrow(_score(order, widths, n_tokens, mu, theta, names), schema), "lm-scores")
    n_types = scored.where("is_total").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    return scored.where("not is_total").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(n_tokens + n_types + 1))).alias("base_score"), "score",
    )


def op4_lm_scoring(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_mod(F.col("doc_id"), 7) != 2)
