"""How the sources of a language differ: smoothed term rates, compared exactly.

The vocabulary takes two passes over blocks of texts. The first counts, for
each term of a block, the block's documents that hold it; what reaches the
least document frequency of its language is kept, and each block is told which
of its own terms are. The second pass builds an automaton of these, padded
with delimiters on both sides so that only whole terms match, runs it over the
block's texts and counts occurrences by source. No vocabulary is broadcast: a
block's automaton is no larger than the block.

The sums are sparse postings (language, source, term, count). Pairs of sources
are compared in buckets of terms: there a source without a posting has the
rate of zero occurrences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks as B
from .common import materialize

#: Bytes as terms need them: A-Z lower-cased, other ASCII but letters a delimiter, what is not ASCII unchanged.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Characters that an automaton reads at a time, whole texts.
READ = 1 << 20
#: Terms of a bucket in which pairs of sources are compared.
BUCKET_TERMS = 2000
#: Cells of the matrix of sources and terms that is compared at a time.
CELLS = 1 << 20


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def _frequencies(table):
    """The terms of a block with the number of its documents that hold each, by language."""
    found = defaultdict(Counter)
    for lang, text in zip(table.column("lang").to_pylist(), table.column("text")):
        found[lang].update(set(terms_of(text.as_py())))
    block = table.column("block")[0].as_py()
    langs = [x for lang, c in found.items() for x in [lang] * len(c)]
    terms = [t for c in found.values() for t in c]
    return pa.table({"block": pa.array([block] * len(terms), pa.int64()), "lang": pa.array(langs, pa.string()), "term": pa.array(terms, pa.binary()).cast(pa.string()), "docs": pa.array([n for c in found.values() for n in c.values()], pa.int64())})


POSTINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def _recount(texts, kept):
    """Occurrences of the kept terms in a block, by language and source."""
    if texts.num_rows == 0 or kept.num_rows == 0:
        return POSTINGS.empty_table()
    vocabulary = defaultdict(list)
    for lang, term in zip(kept.column("lang").to_pylist(), kept.column("term").to_pylist()):
        vocabulary[lang].append(term)
    out = [[], [], [], []]
    for lang, terms in vocabulary.items():
        automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            automaton.add_word(f" {term} ", k)
        automaton.make_automaton()
        counts, waiting, length = defaultdict(lambda: np.zeros(len(terms), np.int64)), defaultdict(list), Counter()

        def read(source):
            padded = (b" " + b" ".join(waiting.pop(source)) + b" ").decode()
            counts[source] += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(padded)), np.int64), minlength=len(terms))
            length[source] = 0

        mine = texts.filter(pa.array(np.array([x == lang for x in texts.column("lang").to_pylist()], bool)))
        for source, text in zip(mine.column("source").to_pylist(), mine.column("text")):
            words = terms_of(text.as_py())
            if words:
                waiting[source].append(b" ".join(words))
                length[source] += len(waiting[source][-1])
                if length[source] >= READ:
                    read(source)
        for source in [*waiting]:
            read(source)
        for source, n in counts.items():
            at = np.flatnonzero(n)
            out[0] += [lang] * len(at)
            out[1] += [source] * len(at)
            out[2] += map(terms.__getitem__, at.tolist())
            out[3] += n[at].tolist()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, POSTINGS)], schema=POSTINGS)


PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compare(rates, groups):
    """For each ordered pair of a language's sources the sum of the differences of their rates over a bucket's terms."""
    names, zero = groups.column("source").to_pylist(), groups.column("rate").to_numpy()
    n = len(names)
    if n < 2:
        return PAIRS.empty_table()
    at = {s: k for k, s in enumerate(names)}
    rows = np.array([at[s] for s in rates.column("source").to_pylist()], np.int64)
    _, cols = np.unique(np.array(rates.column("term").to_pylist(), object), return_inverse=True) if rates.num_rows else (None, np.zeros(0, np.int64))
    rate, terms = rates.column("rate").to_numpy(), int(cols.max()) + 1 if len(cols) else 0
    total = np.zeros((n, n), np.int64)
    step = max(1, CELLS // n)
    for first in range(0, terms, step):
        inside = (cols >= first) & (cols < first + step)
        matrix = np.repeat(zero[:, None], min(step, terms - first), axis=1)
        matrix[rows[inside], cols[inside] - first] = rate[inside]
        for k in range(n):
            total[k] += np.abs(matrix - matrix[k]).sum(axis=1)
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    source = pa.array(names, pa.string())
    return pa.Table.from_arrays([pa.repeat(groups.column("lang")[0], len(a)), source.take(pa.array(a)), source.take(pa.array(b)), pa.array(total[a, b])], schema=PAIRS)


def postings_of(docs: DataFrame, least: int = 30) -> DataFrame:
    """Occurrences (lang, source, term, n) of the terms that at least `least` documents of their language hold; zeros are left out."""
    blocks = B.n_blocks(B.total_bytes(docs, "text"))
    # both uses share one exchange of the texts
    dealt = docs.withColumn("block", F.pmod("row", F.lit(blocks))).select("block", "lang", "source", "text")
    found = dealt.groupBy("block").applyInArrow(_frequencies, "block long, lang string, term string, docs long")
    everywhere = W.partitionBy("lang", "term")
    kept = found.withColumn("docs", F.sum("docs").over(everywhere)).where(F.col("docs") >= least).select("block", "lang", "term")
    counted = dealt.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_recount, "lang string, source string, term string, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50, prior: int = 5, scale: int = 1_000_000_000, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Ranked differences of sources within a language: rows (lang, source, part, item, value, rank).

    A source's rate of a kept term is 1 + floor(scale * (count + prior) / (N +
    prior * V)), N being all its occurrences of kept terms and V their number;
    a language's rate is the same over all its sources. Part `pair` has every
    other source of the language with the sum of the differences of rates, part
    `term` the `top` terms that the source has more often than the language.
    Larger values first, then items in order of UTF-8 bytes.

    Nulls in text, lang and source are empty strings. A source without kept
    terms has rates too; in a language without any, pairs have the value 0.
    Repeated rows count each; those that are equal in doc_id, too, share a
    block. Other columns are not read. An empty table gives an empty table.
    """
    row = F.xxhash64(*(c for c in ("doc_id", text, lang, source) if c in docs.columns)).alias("row")
    docs = docs.select(row, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    postings = materialize(postings_of(docs, least), "divergence-postings")
    by_term = materialize(postings.groupBy("lang", "term").agg(F.sum("n").alias("all_n")), "divergence-terms")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    langs = by_term.groupBy("lang").agg((F.sum(exact("all_n")) + prior * F.count("*")).cast("decimal(24,0)").alias("all_size"), F.count("*").alias("terms"))
    sums = postings.groupBy("lang", "source").agg(F.sum(exact("n")).alias("own"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    size = (F.coalesce("own", F.lit(0)) + prior * F.coalesce("terms", F.lit(0))).cast("decimal(24,0)")
    rate = lambda n, of: F.expr(f"1 + cast({scale} as decimal(12,0)) * (cast({n} as decimal(19,0)) + {prior}) div {of}")
    groups = materialize(groups.select("lang", "source", size.alias("size"), "all_size").withColumn("rate", F.coalesce(rate("0", "nullif(size, 0)"), F.lit(0))), "divergence-groups")
    rated = postings.join(groups.select("lang", "source", "size", "all_size"), ["lang", "source"]).withColumn("rate", rate("n", "size"))

    buckets = 1 + by_term.count() // BUCKET_TERMS
    bucketed = rated.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "source", "term", "rate")
    everywhere = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), "source", "rate")
    sides = bucketed.groupBy("lang", "bucket").cogroup(everywhere.groupBy("lang", "bucket")).applyInArrow(_compare, "lang string, source string, item string, value long")
    pairs = sides.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    joined = rated.join(by_term, ["lang", "term"]).withColumn("value", F.col("rate") - rate("all_n", "all_size"))
    terms = joined.where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op12_divergence(spark, sf_dir):
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
