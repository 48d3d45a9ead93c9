"""Deterministic sharded WARC writer, and a reader of its archives.

Records are sorted by key within shards that are ranges of the key. Shard
borders come from exact counts of the keys' bytes, so that the same table
always gives the same files, whatever its partitioning; each shard is a task. Each record is a
gzip member of its own; a file is rolled when its compressed size would pass a
limit. Tasks write under temporary names of their own; after the job the
driver renames the files of the attempts that succeeded and writes a manifest
last, under a temporary name too. Readers take only files that the manifest
lists.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

#: A response must have at least so many bytes for others to refer to it.
LEAST_SHARED = 100
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Cells into which a range of keys is cut for counting.
CELLS = 1 << 12
#: Format constants: fixed values.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "_MANIFEST.json"


def record_id(page_id, digest, repeat: int = 0) -> str:
    """The id of the first, second, … record of a page with one payload."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest} {repeat}'.encode()).hexdigest()[:32])}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str, repeat: int = 0) -> bytes:
    """One WARC record with headers made anew; refers_to: the page of the response that a revisit repeats."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, repeat)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-ID", page_id),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = [VERSION, *(f"{k}: {' '.join(str(v).split())}".encode() for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data):
    """(headers, block) of each record of a decompressed archive, bytes or a stream; one record is held at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if line.rstrip(b"\r\n") != VERSION:
            raise ValueError(f"no record at {line[:40]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block


def shard_borders(sized: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """(least key, number of shards) of each range of keys, from exact byte counts: a range has one shard of shard_bytes at most, or one key and as many as its bytes need.

    Keys are counted in CELLS equal ranges between the least and the greatest;
    a cell that is over the size is cut again between its own least and
    greatest key, until none is or it holds one key. The driver sees one row
    for each cell, and the borders depend on the rows alone.
    """
    spark, sized = sized.sparkSession, sized.where("page_id is not null").select("page_id", "bytes", F.lit(0).cast("long").alias("cell"))
    span = sized.agg(F.min("page_id"), F.max("page_id")).first()
    todo, done = [] if span[0] is None else [(0, span[0], span[1])], []
    while todo:
        cuts = spark.createDataFrame([(c, lo, str((hi - lo) // CELLS + 1)) for c, lo, hi in todo], "cell long, lo long, width string").withColumn("width", F.col("width").cast("decimal(20,0)"))
        place = ((F.col("page_id").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("width")).cast("long")
        cut = sized.join(F.broadcast(cuts), "cell").select("page_id", "bytes", "cell", place.alias("sub"))
        found = cut.groupBy("cell", "sub").agg(F.sum("bytes").alias("bytes"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).toArrow().to_pylist()
        full = [x for x in found if x["bytes"] > shard_bytes and x["lo"] < x["hi"]]
        done += [(x["lo"], x["bytes"], x["lo"] == x["hi"]) for x in found if x["bytes"] <= shard_bytes or x["lo"] == x["hi"]]
        todo = [(k, x["lo"], x["hi"]) for k, x in enumerate(sorted(full, key=lambda x: x["lo"]))]
        if todo:
            again = spark.createDataFrame([(x["cell"], x["sub"], k) for k, x in enumerate(sorted(full, key=lambda x: x["lo"]))], "cell long, sub long, next long")
            sized = cut.join(F.broadcast(again), ["cell", "sub"]).select("page_id", "bytes", F.col("next").alias("cell"))
    borders, total = [], shard_bytes
    for low, size, one in sorted(done):
        if one and size > shard_bytes:
            borders.append((low, -(-size // shard_bytes)))
            total = shard_bytes
        else:
            if not borders or total + size > shard_bytes:
                borders.append((low, 1))
                total = 0
            total += size
    return borders


#: Shards of rows with a null key.
NULL_SHARDS = 64


def shard_of(borders: list[tuple[int, int]]):
    """A function of (page_id, digest hash) that gives the shard: binary search among the borders."""
    keys, many = np.array([b[0] for b in borders], np.int64), np.array([b[1] for b in borders], np.int64)
    first = np.cumsum(many) - many

    # Arrow arrays keep a key that is null apart from the numbers, which pandas would turn into floats
    @F.arrow_udf("long")
    def find(page_id: pa.Array, spread: pa.Array) -> pa.Array:
        given, spread = page_id.is_valid().to_numpy(zero_copy_only=False), spread.to_numpy()
        out = -1 - spread % NULL_SHARDS
        if given.any():
            at = np.searchsorted(keys, page_id.drop_null().to_numpy(), side="right") - 1
            out[given] = first[at] + spread[given] % many[at]
        return pa.array(out, pa.int64())

    return find


def _write(folder: str, roll_bytes: int, date: str):
    names = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("temp", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex
        shard, part, pending, size, n, done = None, 0, [], 0, 0, []

        def close():
            nonlocal pending, size, n, part
            if n:
                temp = f"_tmp/{attempt}-{shard}-{part}"
                data = b"".join(pending)
                with store.open_output_stream(f"{root}/{temp}", compression=None) as f:
                    f.write(data)
                done.append((shard, part, temp, n, size, hashlib.sha256(data).hexdigest()))
                part += 1
            pending, size, n = [], 0, 0

        role, last, repeat = (None, None, None), None, 0
        for batch in batches:
            for s, page_id, digest, is_page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    close()
                    shard, part = s, 0
                if not is_page:
                    role = (page_id, digest, refers_to)
                    continue
                payload = (html or "").encode()
                refer = None
                if role[:2] == (page_id, digest):
                    refer = role[2]
                    # of repeated rows of the smallest page, the first is the response
                    if refer == page_id and last != (page_id, digest):
                        refer = None
                repeat = repeat + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                member = gzip.compress(record(page_id, url, payload, digest, refer, date, repeat), 6, mtime=0)
                if size and size + len(member) > roll_bytes:
                    close()
                pending.append(member)
                size += len(member)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * 6, names)], schema=names)

    return run


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> dict:
    """Write one record for each row (page_id, url, html) and return the manifest.

    Of rows with equal payloads of LEAST_SHARED bytes or more, that with the
    smallest page_id is a response and the others revisit it; all others are
    responses. A null html is an empty payload; a null page_id or url leaves
    its header out, and rows with a null page_id are responses in shards of
    their own. Of
    repeated rows one is the response. An empty table gives a manifest without
    files. Other columns are not read.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    sized = pages.select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"))
    borders = shard_borders(sized, shard_bytes)
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    keyed = pages.withColumn("digest", digest)
    slim = keyed.where("page_id is not null").where(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest")
    shared = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    find, spread = shard_of(borders), F.pmod(F.xxhash64("digest"), F.lit(1 << 31))
    roles = slim.join(shared, "digest").distinct().select("page_id", "digest", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    rows = keyed.select("page_id", "digest", F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    columns = ["shard", "page_id", "digest", "is_page", "url", "html", "refers_to"]
    both = roles.unionByName(rows).withColumn("shard", find("page_id", spread)).select(*columns)
    # a task for each shard
    n = max(1, sum(k for _, k in borders))
    ordered = both.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/_tmp", recursive=True)
    done = ordered.mapInArrow(_write(folder, roll_bytes, date), "shard long, part long, temp string, records long, bytes long, sha256 string").toArrow().to_pylist()
    files = []
    for x in sorted(done, key=lambda x: (x["shard"], x["part"])):
        name = f"shard{x['shard']:+07d}-{x['part']:05d}.warc.gz"
        store.move(f"{root}/{x.pop('temp')}", f"{root}/{name}")
        files.append({"name": name} | x)
    manifest = {"records": sum(x["records"] for x in files), "files": files}
    with store.open_output_stream(f"{root}/_tmp-{MANIFEST}") as f:
        f.write(json.dumps(manifest, indent=1).encode())
    store.move(f"{root}/_tmp-{MANIFEST}", f"{root}/{MANIFEST}")
    store.delete_dir(f"{root}/_tmp")  # with what attempts that failed have left
    return manifest


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload):
    names = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * with_payload])

    def run(batches):
        for batch in batches:
            for content, name in zip(batch.column("content"), batch.column("path").to_pylist()):
                rows = []
                # a stream, as gzip.decompress() copies the rest of the file for each member
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
                        raise ValueError(f"{name}: a block differs from its digest")
                    end = block.index(b"\r\n\r\n") + 4
                    payload, told = block[end:], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    number = lambda k: int(headers[k]) if k in headers else None
                    length = int(block[:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    if headers["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    rows.append((number("WARC-Page-ID"), headers.get("WARC-Target-URI"), length, told, headers["WARC-Type"], number("WARC-Refers-To-Page-ID"), payload)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the files in the manifest; digests are checked. Of a revisit, length and digest are those of the payload that it repeats."""
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        files = json.loads(f.read())["files"]
    schema = READ + ", payload binary" * with_payload
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load([f"{folder}/{x['name']}" for x in files]).select("path", "content").mapInArrow(_read(with_payload), schema)


def op5_warc(spark, sf_dir):
    folder = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
