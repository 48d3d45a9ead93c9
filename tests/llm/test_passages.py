"""Archives by round trip, benchmark passages against longest common substrings, and the whole pipeline against its parts."""

import bisect
import collections
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F
from test_corpus import brute_components

from kinetra.llm import decontamination, toxicity, warc

SF = "/root/testdata/sf0.001"
SAME, OTHER = "<p>same payload</p>" * 20, "é" * 60
#: (page_id, url, html): copies, a repeated row, short copies, nulls.
PAGES = [(1, "http://a", SAME), (1, "http://a", SAME), (2, "http://b", SAME), (None, "http://c", SAME), (3, None, None), (4, "http://d", "short"), (5, "http://d", "short"), (9, "http://e", OTHER), (-7, "http://f", OTHER), (6, "http://g\r\nx: y", ""), (2**40, "http://h", "\r\n\r\nWARC/1.1\r\n" * 30)]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("shard", "digest", "refers_to", "is_page")})


def test_warc_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/archive"
    manifest = warc.write_archives(pages, folder)
    assert manifest["records"] == len(PAGES)
    assert {x["name"] for x in manifest["files"]} | {warc.MANIFEST} == {n for n in os.listdir(tmp_path / "archive") if not n.startswith(".")}
    got = warc.read_archives(spark, folder, with_payload=True).collect()
    least = {}
    for i, _, html in PAGES:
        if i is not None and html is not None and len(html.encode()) >= 100:
            least[html] = min(least.get(html, i), i)
    expected, seen = [], set()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = i is None or html not in least or (i == least[html] and (i, html) not in seen)
        seen.add((i, html))
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first else "revisit", None if first else least[html]))
    rows = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]


def test_warc_files_depend_on_the_rows_alone(spark, pages, tmp_path):
    said = []
    for n in (1, 5):
        folder = f"file://{tmp_path}/by{n}"
        said.append(warc.write_archives(pages.repartition(n), folder, shard_bytes=500, roll_bytes=600))
    assert said[0] == said[1] and len(said[0]["files"]) > 4
    for x in said[0]["files"]:
        data = (tmp_path / "by1" / x["name"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == x["sha256"] and len(data) == x["bytes"]
        assert len([*warc.parse(gzip.decompress(data))]) == x["records"]


def test_warc_shards_of_far_and_hot_keys(spark, tmp_path):
    """One key far from all others, and one with a third of the bytes: shards stay near their size."""
    rows = [(k, "http://x", f"<p>{k}</p>" * 12) for k in range(300)] + [(2**62, "http://far", "far " * 30), (-(2**62), "http://far", "far off " * 30)] + [(150, f"http://hot/{k}", f"hot {k} " * 40) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sized = pages.select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    size = collections.Counter()
    for r in rows:
        size[r[0]] += len(r[2])
    borders = warc.shard_borders(sized, 3000)
    at = [b[0] for b in borders]
    total = collections.Counter()
    for k, n in size.items():
        total[bisect.bisect_right(at, k) - 1] += n
    assert len(borders) > 10 and all(total[i] <= 3000 * many for i, (_, many) in enumerate(borders)) and dict(borders)[150] == -(-size[150] // 3000)
    folder = f"file://{tmp_path}/far"
    manifest = warc.write_archives(pages, folder, shard_bytes=3000)
    assert manifest["records"] == len(rows) and len({x["name"].split("-")[0] for x in manifest["files"]}) > 10
    got = [(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_archives(spark, folder, with_payload=True).collect() if r["record_type"] == "response"]
    assert sorted(got) == sorted({(k, t) for k, _, t in rows})


def test_warc_of_null_keys_beside_keys_above_two_to_the_53(spark, tmp_path):
    """A null key in a batch must not change the shard of a large one: repeats stay revisits."""
    same = "shared payload " * 20
    rows = [(2**60 + k, "http://x", same if k % 2 else f"own {k} " * 30) for k in range(8)] + [(None, None, same), (None, "http://n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/large"
    warc.write_archives(pages, folder, shard_bytes=300)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, folder).where("page_id is not null").collect()}
    assert got == {(2**60 + k, "revisit" if k in (3, 5, 7) else "response", 2**60 + 1 if k in (3, 5, 7) else None) for k in range(8)}
    assert warc.read_archives(spark, folder).where("page_id is null").count() == 2


def test_warc_record_ids_are_unique(pages, tmp_path):
    manifest = warc.write_archives(pages, f"file://{tmp_path}/ids")
    found = [h for x in manifest["files"] for h, _ in warc.parse(gzip.decompress((tmp_path / "ids" / x["name"]).read_bytes()))]
    ids = [h["WARC-Record-ID"] for h in found if "WARC-Page-ID" in h]
    assert len(ids) == len(set(ids)) and {h["WARC-Refers-To"] for h in found if "WARC-Refers-To" in h} <= set(ids)


def test_warc_of_no_pages(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.write_archives(pages.where("false"), folder)["files"] == []
    assert warc.read_archives(spark, folder).count() == 0


def full_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(3) for _ in range(rng.randrange(0, 25))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(3)] * rng.randrange(2)
        for most in (0, 2, 5):
            assert decontamination.banded_edits(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(full_edits(a, b), most + 1)


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def test_leaks_against_longest_common_substrings(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(k, prose(60)) for k in range(4)] + [(10, None), (None, prose(60)), (11, "too short")]
    rows = []
    for i in range(60):
        item = items[i % 4][1]
        n = rng.choice([20, 60, 90, 98, 99, 101, 102, 130, 200])
        at = rng.randrange(len(item) - n)
        rows.append((i, f"{prose(rng.randrange(0, 30))} {item[at : at + n].upper() if i % 2 else item[at : at + n]}\n\t{prose(rng.randrange(0, 30))}"))
    rows += [(100 + i, prose(100)) for i in range(10)] + [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (None, items[1][1])]
    found = decontamination.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    normal = decontamination.normal
    expected = {(i, k) for i, t in rows for k, item in items[:4] if longest_common(normal(t), normal(item)) >= 100}
    assert got == expected and len({i for i, _ in got}) > 20
    for r in found:
        texts = [normal(t) for i, t in rows if i == r["doc_id"]]
        item = normal(dict(items)[r["item_id"]])
        assert any(full_edits(t[r["doc_start"] : r["doc_end"]], item[r["item_start"] : r["item_end"]]) == r["edits"] for t in texts)


def test_leaks_with_edits(spark):
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(50))
    changed = "".join("z" if k % 30 == 17 else c for k, c in enumerate(item))
    dropped = "".join(c for k, c in enumerate(item) if k % 30 != 17)
    ruined = "".join("z" if k % 8 == 3 else c for k, c in enumerate(item))
    rows = [(1, f"start {changed} end"), (2, f"start {dropped} end"), (3, f"start {ruined} end")]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = decontamination.find_leaks(table(spark, rows), bench).collect()
    assert {r["doc_id"] for r in found} == {1, 2} and all(r["edits"] <= 0.06 * (r["item_end"] - r["item_start"]) for r in found)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(table(spark, rows), empty).count() == 0 and decontamination.find_leaks(table(spark, []), bench).count() == 0


def test_leaks_beside_a_replaced_stretch(spark):
    """Exact quotes count although the stretch between them, or at one side, breaks the budget of the whole."""
    rng = random.Random(11)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    item = letters(400, "abcdefghijklmnop")
    quote = lambda *parts: "".join(item[p[0] : p[1]] if isinstance(p, tuple) else letters(p, "qrstuvwxyz") for p in parts)
    cases = {
        **{(1, n): (quote(30, (0, 100), n, (100 + n, 200 + n), 30), [(0, 100), (100 + n, 200 + n)]) for n in (20, 30, 40)},
        # the longest gap between hits lies within the passage that counts
        (2, 0): (quote((0, 70), 4, (74, 140), *(x for k in range(140, 344, 17) for x in (2, (k + 2, k + 17))), 30), [(0, 140)]),
        (3, 0): (quote((0, 90), 30, (120, 210), 30, (240, 330)), []),
        (4, 0): (quote((0, 100), 30, (130, 180), 30, (210, 310)), [(0, 100), (210, 310)]),
    }
    rows = [(100 * k + n, text) for (k, n), (text, _) in cases.items()]
    found = decontamination.find_leaks(table(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    for (k, n), (text, expected) in cases.items():
        got = sorted((r["item_start"], r["item_end"]) for r in found if r["doc_id"] == 100 * k + n)
        assert len(got) == len(expected) and all(a <= c and d <= b for (a, b), (c, d) in zip(got, expected)), (k, n, got)
    texts = dict(rows)
    for r in found:
        edits = full_edits(texts[r["doc_id"]][r["doc_start"] : r["doc_end"]], item[r["item_start"] : r["item_end"]])
        assert edits == r["edits"] <= 0.06 * (r["item_end"] - r["item_start"])


def test_leaks_of_one_period(spark):
    """Text and item meet on thousands of diagonals; passages share no place of the text, are exact but for the ends, and leave less than one between them."""
    items, rows = [(1, "ab " * 1500), (2, "x" * 120)], [(1, "ab " * 6000), (2, "ab " * 6000 + "end"), (3, "x" * 3000), (4, "ab cd " * 60)]
    found = decontamination.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (3, 2)}
    for doc, text in rows[:3]:
        spans = sorted((r["doc_start"], r["doc_end"]) for r in found if r["doc_id"] == doc)
        ends = [0, *(b for _, b in spans)]
        assert all(0 <= a - b < 94 for (a, _), b in zip(spans, ends)) and len(decontamination.normal(text)) - ends[-1] < 97
    assert all(r["edits"] <= 12 for r in found)


def test_leaks_in_strips_are_the_same(spark, monkeypatch):
    """However few pairs of places are looked at together, the same candidates come out, also of texts and items that repeat one period."""
    import random

    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    items = [(1, "ab " * 300), (2, prose(700)), (3, prose(300)), (4, "x" * 200)]
    edited = [(c if rng.random() > 0.03 else "#") for c in items[1][1]]
    texts = ["ab " * 900, prose(200) + "".join(edited) + prose(100), items[2][1] + "ab " * 60 + items[2][1], "x" * 1500, prose(50)]
    index = decontamination.Index(items, decontamination.Q)
    codes = decontamination._codes("".join(map(decontamination.normal, texts)))
    starts = np.cumsum([0, *(len(decontamination.normal(t)) for t in texts)])
    args = index, decontamination.Q, decontamination.WINDOW, decontamination.ERRORS, codes, starts
    whole = sorted(decontamination._candidates(*args))
    assert len(whole) > 100
    monkeypatch.setattr(decontamination, "HITS", 2000)
    # places between two dense windows of a region are seen where its strips are joined by its ends alone
    assert [(r[0], r[1], *r[4:]) for r in sorted(decontamination._candidates(*args))] == [(r[0], r[1], *r[4:]) for r in whole]


def test_pipeline(spark):
    """Every stage against a plain counterpart on what the stage before kept."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = [docs]
    for name in ("toxicity", "near_dedup", "decontamination", "pii"):
        out = corpus_pipeline.materialize(stages[name](spark, kept[-1], SF), f"test-{name}")
        assert out.columns == docs.columns
        kept.append(out)
    start, calm, single, clean, private = map(rows, kept)
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    assert toxic and set(calm) == set(start) - toxic
    group = brute_components(calm.items(), 80)
    assert len(single) < len(calm) and set(single) == {i for i in calm if group.get(i, i) == i}
    leaks = {r["doc_id"] for r in decontamination.find_leaks(kept[2], bench).collect()}
    assert leaks and set(clean) == set(single) - leaks
    assert set(private) == set(clean) and 0 < sum(private[i] != clean[i] for i in clean) < len(clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in final) == collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in private.items())


def test_pipeline_stages_on_hard_rows(spark):
    """Nulls, repeated rows and doc_ids, ties, long texts and clashing columns, and an empty table."""
    import corpus_pipeline
    from helpers import CLASHES, LONG, PROSE

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first()["text"]
    rows = [(1, PROSE), (1, PROSE), (2, PROSE + " again"), (None, PROSE), (None, "alone " + LONG), (None, "see " + leak), (3, "own text of three"), (3, "x " + leak), (4, None), (4, None), (None, None), (5, ""), (6, "mail a@b.org"), (6, "mail a@b.org"), (7, "other " + LONG)]
    docs = table(spark, rows).withColumns({"row0": F.lit(1).cast("long"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    stages = dict(corpus_pipeline.STAGES)
    text = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    out = corpus_pipeline.materialize(stages["toxicity"](spark, docs, SF), "hard-toxic")
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"), carry="row0").where("predicted = 1").collect()}
    assert out.columns == docs.columns and text(out) <= text(docs) and {k for k in text(docs) if k[0] not in toxic} <= set(text(out))
    single = corpus_pipeline.materialize(stages["near_dedup"](spark, docs, SF), "hard-single")
    assert single.columns == docs.columns
    got = text(single)
    assert got[1, PROSE] == 1 and not {(2, PROSE + " again"), (None, PROSE)} & set(got) and got[6, "mail a@b.org"] == 1 and got[4, None] == 2 and got[None, None] == 1
    assert {(3, "own text of three"), (5, "")} <= set(got) and ((None, "alone " + LONG) in got) != ((7, "other " + LONG) in got) and (7, "other " + LONG) in got
    clean = stages["decontamination"](spark, single, SF)
    assert clean.columns == docs.columns and text(clean) == collections.Counter({k: n for k, n in got.items() if leak not in (k[1] or "")})
    assert text(stages["pii"](spark, clean, SF))[6, "mail [EMAIL]"] == 1
    assert stages["bpe"](spark, clean, SF).count() == clean.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert set(CLASHES) < set(docs.columns)
