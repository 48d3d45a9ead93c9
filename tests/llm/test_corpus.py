"""Each operator against a plain-Python counterpart on hard cases, and on an empty table."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from helpers import CLASHES, ROWS, multiset, table, words
from pyspark.sql import functions as F

from kinetra.llm import bpe, lm_scoring, near_dedup, pii, quality, sharding, substring_dedup, toxicity
from kinetra.llm.common import crc_mod, let

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 1, 0), (10, 0, 1), (16, 0, 0), (12, 1, 0), (17, 1, 1), (None, 1, 1), (99, 1, None), (18, None, 0)], "doc_id long, quality int, toxic int")


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, sharding.topology(8), sharding.topology(9)).collect()
    raw = lambda t: (t or "").encode()
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == multiset((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in ROWS)
    of, slots = {}, collections.defaultdict(list)
    for r in got:
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"] and r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty, sharding.topology(8)).count() == 0


def test_sharding_moves_only_through_changed_subtrees(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    tree = [(0, 0, 0, 1.0), (0, 1, 1, 2.0), (1, 0, 2, 1.0), (1, 0, 3, 1.0), (1, 1, 4, 0.0)]
    more = [(g, k, s, 3.0 if s == 1 else w) for g, k, s, w in tree]
    moved = keys.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), more).alias("b")).groupBy("a", "b").count().collect()
    n = {(r["a"], r["b"]): r["count"] for r in moved}
    # region 0 gains; within it only rack 1 gains; region 1 keeps its inner choices
    assert not {k for k in n if k[0] != k[1]} - {(0, 1), (2, 0), (2, 1), (3, 0), (3, 1)}
    total = {s: sum(c for (a, _), c in n.items() if a == s) for s in range(4)}
    assert total[1] == pytest.approx(8000, rel=0.05) and total[0] == pytest.approx(4000, rel=0.08)


def test_quality(docs, empty, labels):
    got = quality.judge(docs, labels)
    expected = []
    for i, t in ROWS:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        twice = {k + d for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        expected.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)))
    rows = got.collect()
    assert multiset(r[:7] for r in rows) == multiset(expected)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(docs, labels.where("false")).count() == len(ROWS)


def test_quality_weights_agree_with_brute_force(spark, labels):
    rows = [(i, t) for i, t in ROWS if i in (1, 2, 4, 10, 16, 12)]
    docs = table(spark, rows, clashes=False)
    grams = docs.select("doc_id", F.posexplode(let(quality.words_of(F.col("text")), quality.n_gram_buckets))).collect()
    raw, target = collections.Counter(), collections.Counter()
    for r in grams:
        raw[r["col"]] += 1
        target[r["col"]] += r["doc_id"] in (1, 2, 4, 12)
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + quality.BUCKETS)
    weight = {b: round(1e6 * (math.log(share(target, b)) - math.log(share(raw, b)))) for b in raw}
    for r in quality.judge(docs, labels).collect():
        mine = [weight[g["col"]] for g in grams if g["doc_id"] == r["doc_id"]]
        assert r["score"] == pytest.approx(sum(mine) / max(1, len(mine)), abs=1)


@pytest.mark.parametrize("threshold", [-400_000, -65_000, 0, 30_000])
def test_quality_verdict_against_brute_force(spark, labels, threshold):
    """kept is the base rules and the sum of the weights, counted in plain Python from the buckets of each word and pair."""
    rows = [r for r in ROWS if r[0] != 12] + [(40 + k, " ".join(f"{'xyz'[(j * k) % 3]}{(j * j * k) % 61}" for j in range(60 + k))) for k in range(12)]
    hashed = sorted({(w,) for _, t in rows for w in words(t)} | {p for _, t in rows for p in zip(words(t), words(t)[1:])})
    known = spark.createDataFrame([(list(g),) for g in hashed], "g array<string>").select("g", F.when(F.size("g") > 1, F.xxhash64(F.get("g", 0), F.get("g", 1))).otherwise(F.xxhash64(F.get("g", 0))).alias("h"))
    bucket = {tuple(r["g"]): r["h"] % quality.BUCKETS for r in known.collect()}
    grams = lambda t: [bucket[(w,)] for w in words(t)] + [bucket[p] for p in zip(words(t), words(t)[1:])]
    trusted = {r["doc_id"] for r in labels.where("quality = 1 and doc_id is not null").collect()}
    raw, target = (collections.Counter(b for i, t in rows if keep(i) for b in grams(t)) for keep in (lambda i: True, lambda i: i in trusted))
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + quality.BUCKETS)
    weight = {b: round(1e6 * (math.log(share(target, b)) - math.log(share(raw, b)))) for b in raw}
    expected = []
    for i, t in rows:
        w, c = words(t), collections.Counter(zip(words(t), words(t)[1:], words(t)[2:]))
        twice = {k + d for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        expected.append((i, not failed and sum(weight[b] for b in grams(t)) >= threshold * len(grams(t))))
    got = quality.judge(table(spark, rows, clashes=False), labels, threshold=threshold).collect()
    assert multiset((r["doc_id"], r["kept"]) for r in got) == multiset(expected)
    assert any(k for _, k in expected) or threshold > -400_000


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scoring(docs, empty, order):
    got = lm_scoring.score_texts(docs, crc_mod(F.col("doc_id"), 7) != 2, order=order, mu=3.0, theta=50.0).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    rows = [(i, [*words(t, lower=True), None]) for i, t in ROWS]
    counts = collections.Counter(tuple(w[k : k + n]) for i, w in rows if not held(i) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    one = {k[0]: c for k, c in counts.items() if len(k) == 1}
    n, v = sum(one.values()), len(one)

    def p(w, k, m):
        if m == 1:
            return (one.get(w[k]) or 50.0) / (n + 50.0)
        low, h = p(w, k, m - 1), counts[tuple(w[k - m + 1 : k])] if k >= m - 1 else 0
        return (counts[tuple(w[k - m + 1 : k + 1])] + 3 * low) / (h + 3) if h else low

    expected = [(i, held(i), len(w), sum(t in one for t in w), n, sum(math.log10((one.get(t, 0) + 1) / (n + v + 1)) for t in w), sum(math.log10(p(w, k, order)) for k in range(len(w)))) for i, w in rows]
    near = lambda rows: multiset((*r[:5], round(r[5], 4), round(r[6], 4)) for r in rows)
    assert near(got) == near(expected)
    assert lm_scoring.score_texts(empty, F.lit(True), order=order).count() == 0


@pytest.mark.parametrize("depth", [2, 3])
def test_deep_exchanges_give_the_same(spark, depth):
    """Counts and repeats don't depend on the levels of the exchange."""
    docs = table(spark, [(i, t) for i, t in ROWS if len(t or "") < 300])
    lm = lambda d: multiset((*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm_scoring.score_texts(docs, crc_mod(F.col("doc_id"), 7) != 2, depth=d).collect())
    assert lm(depth) == lm(None)
    repeats = lambda d: multiset(substring_dedup.remove_repeats(docs, 13, depth=d).collect())
    assert repeats(depth) == repeats(None)


def test_automaton_walks_long_texts_in_stretches(spark):
    """Stretches begin in the state that the whole walk has there, and failure arcs are followed as in the recursive definition."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (1, 700, 1024, 3000, 511, 0)]
    table_ = pa.table({"text": pa.array(texts), "train": pa.array([True, True, False, True, False, True])})
    widths = {1: 7, 2: 5, 3: 5}
    grams = lm_scoring.Grams(table_, 3, widths)
    n = int(sum(len(words(t)) + 1 for t, x in zip(texts, (1, 1, 0, 1, 0, 1)) if x))
    automaton = lm_scoring.Automaton(grams, n, 2.0, 5.0)
    got = automaton.walk(grams)
    rows = [[*words(t), None] for t in texts]
    counts = collections.Counter(tuple(w[k : k + m]) for w, x in zip(rows, (1, 1, 0, 1, 0, 1)) if x for m in (1, 2, 3) for k in range(len(w) - m + 1))

    def p(h, w):
        if not h:
            return (counts[(w,)] or 5.0) / (n + 5.0)
        return (counts[(*h, w)] + 2 * p(h[1:], w)) / (counts[h] + 2) if counts[h] else p(h[1:], w)

    assert np.allclose(got, [sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(len(w))) for w in rows])


def test_lm_scoring_without_training_texts(docs):
    got = lm_scoring.score_texts(docs, F.lit(False)).collect()
    assert len(got) == len(ROWS) and all(r["held_out"] and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("window", [3, 13, 40])
def test_substring_dedup(docs, empty, window):
    got = substring_dedup.remove_repeats(docs, window, with_text=True).collect()
    key = lambda i: math.inf if i is None else i
    rows, low = [(i, words(t)) for i, t in ROWS], {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            low[s] = min(low.get(s, math.inf), key(i))
    expected = []
    for i, w in rows:
        gone = {k + d for k in range(len(w) - window + 1) if low[tuple(w[k : k + window])] < key(i) for d in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), sha(kept.encode()), kept))
    assert multiset(got) == multiset(expected)
    assert substring_dedup.remove_repeats(empty, window).count() == 0


def test_substring_dedup_levels():
    assert substring_dedup.levels(13) == [4, 8, 13] and substring_dedup.levels(40) == [4, 8, 16, 32, 40] and substring_dedup.levels(3) == [3]
    for w in range(1, 200):
        out = substring_dedup.levels(w)
        assert out[-1] == w and all(a < b <= 2 * a for a, b in zip(out, out[1:]))


def brute_components(rows, percent, size=5):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        if i is not None and s:
            sets.setdefault(i, set()).add(s)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in sets}


def test_near_dedup(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    label = brute_components([(i, t) for i, t in ROWS if i not in (15, 17)], 85) | {15: 15, 17: 17}
    assert len(got) == len(ROWS)
    for r in got:
        i = r["doc_id"]
        assert r["component_id"] == label.get(i, i) and r["kept"] == (i is None or label.get(i, i) == i)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_in_crowds(spark):
    """Chains and crowds of near copies at every distance from the threshold."""
    import random

    rng, rows = random.Random(5), []
    base = [[f"b{k}w{i}" for i in range(120)] for k in range(3)]
    for i in range(260):
        w = list(base[i % 3])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(["edit", f"e{rng.randrange(6)}"])
        rows.append((i * 7 % 1009, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows, 85)


@pytest.mark.parametrize("share, bands, rows", [(0.80, 32, 5), (0.85, 26, 6)])
def test_near_dedup_recall_at_the_threshold(share, bands, rows):
    """Circulant coordinates are not independent: recall of random pairs at the threshold is measured, not derived."""
    import numpy as np

    rng, missed = np.random.default_rng(1), 0
    for k in range(600):
        n = (6, 12, 30, 80, 200, 500)[k % 6]
        both = next(b for b in range(1, n + 1) if b >= share * (2 * n - b))
        x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = (near_dedup.band_keys(near_dedup.signature(np.unique(s), bands, rows), bands, rows) for s in (x[:n], np.concatenate([x[:both], x[n:]])))
        missed += not (a == b).any()
    assert missed == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200, 202: 200}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(docs, empty, labels):
    got = toxicity.score_toxicity(docs, labels).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    assert multiset((r["doc_id"], r["held_out"]) for r in got) == multiset((i, held(i)) for i, _ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.where("false")).count() == len(ROWS)


def test_toxicity_learns_words_and_their_parts(spark):
    import random

    rng = random.Random(1)
    plain = lambda n: [rng.choice(["river", "mountain", "walking", "window", "garden", "silver", "morning"]) + rng.choice(["", "s", "ly"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w, bad = plain(rng.randrange(20, 300)), i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), "zorg" + rng.choice(["ax", "oom", "ith", "elen", "uku", str(i)]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in toxicity.score_toxicity(table(spark, rows), labels).collect() if r["held_out"]]
    assert len(got) > 50 and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in got)


def test_kneser_ney_sums_to_one():
    grams = [("\x02\x02\x02\x02a", 3), ("\x02\x02\x02ab", 2), ("\x02\x02\x02ac", 1), ("\x02\x02ab\x03", 2), ("\x02\x02ac\x03", 1)]
    models = toxicity.fit_models([True] * len(grams) + [False], [g for g, _ in grams] + ["\x02\x02\x02\x02a"], [n for _, n in grams] + [1])
    words_of_two = ["a" + c for c in "bc"]
    keys, found, history, fail = models[-1]
    for h, f in zip(history, fail.T):
        mine = [k for k, g in enumerate(grams) if toxicity._hash(toxicity._codes([g[0][:-1]]))[0] == h]
        mass = sum(found[0][keys == toxicity._hash(toxicity._codes([grams[k][0]]))[0]][0] for k in mine)
        assert mass + f[0] == pytest.approx(1.0)
    assert toxicity.word_likelihoods(models, words_of_two).shape == (2, 3)


def test_toxicity_scores_against_brute_force():
    """Likelihoods of texts by the recursive definition of the two models, from counted strings."""
    import random

    rng = random.Random(5)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    train = [(k % 3 == 0, make("abcé" if k % 3 else "bcdz")) for k in range(120)]
    k, top = toxicity.DISCOUNT, toxicity.ORDER
    pad = lambda w: "\x02" * (top - 1) + w + "\x03"
    grams = collections.Counter((t, pad(w)[i : i + top]) for t, w in train for i in range(len(w) + 1))
    models = toxicity.fit_models([t for t, _ in grams], [g for _, g in grams], list(grams.values()))
    counts = {top: grams}
    for order in range(1, top):
        longer = {(False if order <= toxicity.SHARED_ORDER else t, g[-order - 1 :]) for t, g in grams}
        counts[order] = collections.Counter((t, g[1:]) for t, g in longer)

    def chance(t, g):
        if not g:
            return 1e-5
        mine = {h: n for (c, h), n in counts[len(g)].items() if h[:-1] == g[:-1] and c == (False if len(g) <= toxicity.SHARED_ORDER else t)}
        lower = chance(t, g[1:])
        return (max(mine.get(g, 0) - k, 0) + min(k, 1) * len(mine) * lower) / sum(mine.values()) if mine else lower

    spelt = lambda t, w: sum(math.log(chance(t, pad(w)[i : i + top])) for i in range(len(w) + 1))
    texts = ["", " ".join(make("abcdzé") for _ in range(40)), "zzz", "bcd dcb\nunseenq", "  a  "]
    import pyarrow as pa

    got = toxicity._evidence(models, *toxicity.text_buffer(pa.array(texts)), toxicity.Memo(7))
    for text, (strongest, toxic, ordinary) in zip(texts, got):
        w = text.split()
        length = sum(len(x) + 1 for x in w) or 1
        alone = [(spelt(True, x) - spelt(False, x)) / (len(x) + toxicity.PRIOR_LENGTH) for x in w]
        runs = [sum(alone[i : i + n]) / n for n in range(1, toxicity.RUN + 1) for i in range(len(w) - n + 1)]
        assert [strongest, toxic, ordinary] == pytest.approx([max(runs, default=0), sum(spelt(True, x) for x in w) / length, sum(spelt(False, x) for x in w) / length])


def test_pii(docs, empty):
    got = pii.find_pii(docs).collect()
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def passes(kind, t):
        d = re.sub("[^0-9]", "", t)
        luhn = sum(int(x) if k % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for k, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in t.split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn) or (kind == "phone" and 9 <= len(d) <= 15)

    expected = []
    for i, t in ROWS:
        base = [(k, m.start(), m.end()) for k, p in kinds for m in re.finditer(p, t or "") if passes(k, m.group())]
        expected.append((i, *(sum(b[0] == k for b in base) for k, _ in kinds), sha(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode())))
    assert multiset(r[:6] for r in got) == multiset(expected)
    assert pii.find_pii(empty).count() == 0


@pytest.mark.parametrize("text", ["a@b.com.c@d.com", "a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "999.1.1.1.1 0001.2.3.4", "12-34-56-78-90-12-34 5 6", "+1-(2)3 4.5-6 7890123 +", "4111 1111 1111 1111 9", "1" * 5000, "1 " * 5000, "a@" + "b." * 4000 + "c", "x." * 5000])
def test_pii_strict_patterns(spark, text):
    import pyspark.sql.functions as F

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    df = spark.createDataFrame([("é " + text,)], "text string")
    for kind, pattern in plain.items():
        got = df.select(pii.find(F.col("text"), pii.STRICT[kind])).first()[0]
        assert [(x["s"], x["e"], x["t"]) for x in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, "é " + text)], kind


def test_pii_adds_what_a_longer_run_hides(spark):
    rows = [(i, f"call +1 ({200 + i}) 555-{1000 + i} or mail a{i}@b.org now") for i in range(80)] + [(i + 100, f"pay {x} then") for i, x in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "371449635398431"] * 20)]
    hidden = [(900, "it is +1 (269) 555-3296 4012888888881881 here"), (901, "it is 4012888888881882 here")]
    got = {r["doc_id"]: r for r in pii.find_pii(table(spark, rows + hidden)).collect()}
    assert set(got[900]["spans"].split(",")) >= {"card:24:40", "phone:6:23"} and got[901]["spans"] == ""
    redacted = pii.redact(table(spark, rows + hidden, clashes=False)).where("doc_id = 900").first()["text"]
    assert redacted == "it is [PHONE] [CARD] here"


def test_pii_judges_by_form_and_context(spark):
    """What only looks like an address or a number stays; what is disguised is found."""
    cases = [
        ("items 5 @ 3.50 each", ""), ("ratio 3 @ 2.1", ""), ("meet me @ noon . thanks", ""), ("order 555 123-4567 now", ""), ("isbn 978 555 1234", ""), ("blah 4012888888881882 blah", ""),
        ("mail joe (at) host (dot) com now", "email:5:28"), ("write to bob [at] example [dot] org", "email:9:35"), ("call 555 123-4567 now", "phone:5:17"), ("tel. (269) 555-3296", "phone:5:19"), ("visa 4012 8888 8888 1881", "card:5:24"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(table(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(cases)} == dict(cases)


def test_pii_model_on_held_out_texts(spark):
    model = pii.fit(spark)
    assert all(precision >= 0.98 and recall >= 0.8 for precision, recall in model.figures.values()), model.figures
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(pii.FEATURES[node[0]])
            walk(node[2]), walk(node[3])

    [walk(t) for t in model.trees]
    assert {"telling", "denying"} <= used
    assert pii.examples() == pii.examples()


def test_pii_many_matches_in_one_text(spark):
    text = "é " + " ".join(f"10.0.{k // 200}.{k % 200}" for k in range(1500))
    got = pii.find_pii(table(spark, [(1, text)])).first()
    assert got["n_ip"] == 1500 and got["base_sha256"] == sha(",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9.]+", text)).encode())


def test_pii_redaction(spark):
    rows = [(1, "x a@b.org y 10.0.0.1 z"), (2, None), (3, ""), (4, "plain"), (5, "é a@b.org")]
    df = table(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "x [EMAIL] y [IP] z", 2: None, 3: "", 4: "plain", 5: "é [EMAIL]"}
    assert got[1]["n_chars"] == len(got[1]["text"]) and pii.redact(df).columns == df.columns


def test_bpe(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = bpe.encode_documents(docs, path, with_ids=True).collect()
    expected = []
    for i, t in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()), ids))
    assert multiset(got) == multiset(expected)
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_on_random_text():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, vocab = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(codec="utf-8", max_codepoint=0x1FFF), max_size=40))
    def check(text):
        forms = vocab.forms(text)
        ids = [i for x in bpe.encode_forms(vocab, forms) for i in x]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(vocab, ids) == tokenizer.decode(ids, skip_special_tokens=False)

    check()


def test_clashing_columns_are_in_the_table(docs):
    assert set(CLASHES) < set(docs.columns)
