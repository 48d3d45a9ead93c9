"""Filter audit, source divergence and byte-level BPE against plain-Python counterparts and the tiktoken library."""

import base64
import collections
import hashlib
import itertools
import random
import re

import public_tokenizers
import pytest
import tiktoken
from helpers import CLASHES, LONG, LOWER, PROSE, ROWS, multiset, words
from pyspark.sql import functions as F

from kinetra.llm import byte_bpe, divergence, filter_audit

sha = lambda b: hashlib.sha256(b).hexdigest()
LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, 1), (12, 1, 1), (15, 0, 0), (15, 1, None), (None, 1, 1), (99, 1, 1), (9, 1, 0)]


def sourced(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}) if clashes else df


def labelled(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def with_sources(rows):
    return [(i, t, ("en", "de", None)[k % 3], ("a", "b", None, "")[k % 4]) for k, (i, t) in enumerate(rows)]


def brute_audit(rows):
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    seen = [(i, t or "", s or "") for i, t, _, s in rows]

    def fails(i, t):
        w = words(t)
        less = any(x == t and j is not None and (i is None or j < i) for j, x, _ in seen)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), less)
        return {f for f, x in zip("ABCDE", tests) if x}

    out, removed_of = {}, collections.Counter()
    judged = [(s, i, fails(i, t)) for i, t, s in seen]
    for order in map("".join, itertools.permutations("ABCDE")):
        left = judged
        for k, f in enumerate(order):
            gone = [x for x in left if f in x[2]]
            left = [x for x in left if f not in x[2]]
            for s in {x[0] for x in judged}:
                mine = [x for x in gone if x[0] == s]
                failing = [x for x in judged if x[0] == s and f in x[2]]
                out[s, order, k + 1] = (sum(x[0] == s for x in left), len(mine), len(failing) - len(mine), sum(x[2] == {f} for x in failing), sum(x[1] in good for x in mine), sum(x[1] in toxic for x in mine))
                removed_of[s, f] += len(mine)
    return [(*k, *v, removed_of[k[0], k[1][k[2] - 1]]) for k, v in out.items()]


def test_filter_audit(spark):
    rows = with_sources(ROWS)
    got = filter_audit.interactions(sourced(spark, rows), labelled(spark)).collect()
    assert multiset(got) == multiset(brute_audit(rows))
    assert filter_audit.interactions(sourced(spark, []), labelled(spark)).count() == 0
    assert filter_audit.interactions(sourced(spark, rows), labelled(spark).where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_across_seams(spark):
    """Runs of one text that begin in one range and go on in others, with ties, null ids and repeated rows."""
    rng = random.Random(11)
    texts = [PROSE, PROSE + " #", "SHORT", "", *(f"t{k} " * 60 for k in range(3))]
    ids = [None, *range(-50, 250)]
    rows = [(i, rng.choice(texts[:2] if i and i % 3 else texts), "en", rng.choice("ab")) for i in ids for _ in range(rng.choice((1, 1, 2)))]
    rows += [(None, PROSE, "en", "a")] * 3
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = filter_audit.failures(sourced(spark, rows)).groupBy("doc_id", "part", "mask").agg(F.sum("n")).collect()
        whole = filter_audit.interactions(sourced(spark, rows), labelled(spark)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    low = {}
    for i, t, _, _ in rows:
        low[t] = min(low.get(t, 10**9), 10**9 if i is None else i)
    later = collections.Counter((i, s) for i, t, _, s in rows if (10**9 if i is None else i) > low[t])
    got = collections.Counter()
    for i, s, mask, n in found:
        got[i, s] += n * (mask >> 4)
    assert +got == later
    assert multiset(whole) == multiset(brute_audit(rows))


def test_filter_audit_with_other_filters(spark):
    rows = [(1, "x", "", ""), (2, "x", "", ""), (3, "y y", "", "")]
    got = filter_audit.interactions(sourced(spark, rows), labelled(spark), {"L": lambda t: len(t.words) < 2}, "S").collect()
    assert multiset(r[1:7] for r in got) == multiset([("LS", 1, 1, 2, 0, 1), ("LS", 2, 1, 0, 1, 0), ("SL", 1, 2, 1, 0, 0), ("SL", 2, 1, 1, 1, 1)])


def brute_divergence(rows, least, top=50):
    term = lambda t: [w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    docs, counts, groups = collections.Counter(), collections.Counter(), sorted({(x or "", s or "") for _, _, x, s in rows})
    for _, t, x, s in rows:
        docs.update((x or "", w) for w in set(term(t)))
        counts.update((x or "", s or "", w) for w in term(t))
    out = []
    for x, s in groups:
        kept = [w for (y, w), n in docs.items() if y == x and n >= least]
        rate = lambda ss, w: 1 + 10**9 * (sum(counts[x, z, w] for z in ss) + 5) // (sum(counts[x, z, v] for z in ss for v in kept) + 5 * len(kept))
        all_of = [z for y, z in groups if y == x]
        pairs = [(o, sum(abs(rate([s], w) - rate([o], w)) for w in kept)) for o in all_of if o != s]
        more = [(w, rate([s], w) - rate(all_of, w)) for w in kept if counts[x, s, w] and rate([s], w) > rate(all_of, w)]
        for part, items, n in (("pair", pairs, None), ("term", more, top)):
            ranked = sorted(items, key=lambda v: (-v[1], v[0].encode()))[:n]
            out += [(x, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("least", [1, 2, 4, 1000])
def test_divergence(spark, least):
    rows = with_sources([r for r in ROWS if r[1] != LONG and len(r[1] or "") < 30000])
    rng = random.Random(least)
    rows += [(100 + k, " ".join(rng.choice(["Eins", "zwei", "é", "a-b", "x1y", "中文", "ÀB", "zz"]) for _ in range(rng.randint(0, 40))), "en", rng.choice(["a", "b", "c", "d", "e"])) for k in range(80)]
    rows += [(300, "only here", "xx", "a"), (301, None, "xx", "b"), (302, "", "yy", "a")]
    got = divergence.divergence(sourced(spark, rows), least).collect()
    assert multiset(got) == multiset(brute_divergence(rows, least))
    assert divergence.divergence(sourced(spark, []), least).count() == 0


def test_divergence_does_not_depend_on_blocks(spark, monkeypatch):
    rows = [(k, " ".join(f"w{chr(97 + (k * j) % 23)}" for j in range(k % 50)), "en", f"s{k % 7}") for k in range(300)]
    whole = multiset(divergence.divergence(sourced(spark, rows, False), 20).collect())
    monkeypatch.setattr(divergence.B, "BLOCK_BYTES", 500)
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 3)
    monkeypatch.setattr(divergence, "CELLS", 14)
    monkeypatch.setattr(divergence, "READ", 40)
    assert multiset(divergence.divergence(sourced(spark, rows, False), 20).collect()) == whole == multiset(brute_divergence(rows, 20))


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return byte_bpe.Ranks(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, library):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(f"clash {c}") for c in CLASHES})
    got = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        assert library.decode_bytes(ids) == (t or "").encode()
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    assert multiset(got) == multiset(expected)
    assert byte_bpe.encode_documents(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_against_the_library(ranks, library):
    rng, tokens = random.Random(2), [*ranks.rank_of]
    later = "".join(map(chr, (0x558, 0x88F, 0x11DE0, 0x16FF4, 0x323B0)))
    kinds = [
        lambda: "".join(rng.choice("aeitnsr ") for _ in range(rng.randint(0, 90))),
        lambda: rng.choice(" \n\t　a=-#") * rng.randint(1, 400) + rng.choice("ab "),
        lambda: "".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0x4E00, 0x4FFF), rng.randint(0x1F300, 0x1F600), rng.randint(0x400, 0x450)])) for _ in range(rng.randint(1, 50))),
        lambda: b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))).decode("utf8", "replace"),
        lambda: "".join(rng.choice("ab1 " + later) for _ in range(rng.randint(1, 30))),
    ]
    for k in range(4000):
        text = kinds[k % 5]()
        ids = [i for p in ranks.pieces(text) for i in ranks.encode_piece(p)]
        assert ids == library.encode_ordinary(text), text
        assert ranks.decode(ids) == text.encode()


def test_byte_bpe_is_a_monoid(ranks):
    """Joined encodings are the encoding of the whole, wherever the bytes are cut, and the tree gives what merging gives."""
    rng, tokens = random.Random(3), [*ranks.rank_of]
    for k in range(1500):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))) if k % 3 else bytes(rng.choice(b"ab  \xc3\xa9") for _ in range(rng.randint(1, 60)))
        whole = ranks._merged_in_list(data)
        assert whole == ranks._merged_by_heap(data) == ranks.encode(data)
        x, y = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        a, b, c = (ranks._merged_in_list(d) if d else () for d in (data[:x], data[x:y], data[y:]))
        assert ranks.join(ranks.join(a, b), c) == ranks.join(a, ranks.join(b, c)) == whole
