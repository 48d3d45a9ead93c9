"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS; two
multinomials over the buckets are counted, one of trusted target texts and one
of the whole raw corpus. A text's score is the mean over its n-grams of
log(target / raw), in whole millionths, so that sums don't depend on the order
of adding; texts below the threshold are rejected, and so are those that break
a base rule. Everything is DataFrame expressions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

BUCKETS = 1 << 14
#: Mean log ratio, in millionths, from which a text is kept.
THRESHOLD = -65_000
#: Trusted texts counted at most; the bound of the list of their keys.
TRUSTED = 20_000
#: Added to each bucket's count.
PRIOR = 1.0
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def n_gram_buckets(words: Column) -> Column:
    """The buckets of all words and pairs of neighbouring words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.when(F.size(words) > 1, F.concat(one, two)).otherwise(one)


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that the text holds twice or more, the first included; windows are compared by 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, places))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, covered))


def count_buckets(texts: DataFrame) -> DataFrame:
    grams = texts.select(F.explode(let(words_of(F.col("text")), n_gram_buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_weights(raw: DataFrame, target: DataFrame) -> list[int]:
    """log(target / raw) of each bucket in millionths; BUCKETS rows reach the driver."""
    counts = [{r["bucket"]: r["n"] for r in df.collect()} for df in (raw, target)]
    totals = [sum(c.values()) + PRIOR * BUCKETS for c in counts]
    share = lambda k, b: math.log((counts[k].get(b, 0) + PRIOR) / totals[k])
    return [round(1e6 * (share(1, b) - share(0, b))) for b in range(BUCKETS)]


def judge(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """One row per input row: doc_id, n_words, the base counts, base_failed, kept, and the score in millionths.

    Trusted texts are up to `trusted` labelled rows of quality 1, those of
    smallest hash; the raw multinomial counts every text. A null text has no
    words; a text without words has score 0 and fails the base rules. Null and
    repeated keys are judged like any other (a repeated key that is trusted
    counts each of its texts). Without trusted rows all weights are 0 up to the
    prior. An empty table gives an empty table. Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    target = docs.join(F.broadcast(good), "doc_id")  # at most `trusted` keys
    weights = F.from_json(F.lit(json.dumps(bucket_weights(count_buckets(docs), count_buckets(target)))), "array<bigint>")
    words = F.col("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumn("words", words_of(F.col("text"))).select(
        "doc_id",
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(F.col("text").rlike(f"[{SYMBOLS}]"), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(words, repeated_words).cast("long").alias("n_repeat_words"),
            F.aggregate(let(words, n_gram_buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b)).alias("total"),
        ).alias("x"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return counted.select("doc_id", "x.*").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("total") >= threshold * grams)).alias("kept"), (F.col("total") / grams).alias("score"),
    )


def op3_quality(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
