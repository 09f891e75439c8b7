"""Deterministic sharded WARC archives: write pages as records, read archives back.

Records are sorted by page id over ranges of ids that hold about equal payload. The ranges come from histograms of the ids, refined where
a bin is too heavy; not from a sample, so the same table gives the same files. A task writes its range to files under temporary
names and begins a new file when the compressed size reaches the limit; headers, ids and digests are made anew from the data alone. When all
tasks are done the driver renames the files of the successful attempts and writes the manifest, which lists every file with its records, size and
SHA-256; a reader takes the files of the manifest only. Lost tasks leave temporary files that no manifest names.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page id is a response and the others refer to it. Payloads
travel once: what a record refers to is found on digests alone and meets the payload in the sort.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St

from riskmart.llm.components import store

MIN_REVISIT = 100
#: Payload of one task's range of ids, and compressed size at which a file is closed.
SHARD_BYTES = 24_000_000
ROLL_BYTES = 16_000_000
PIECE_BYTES = 1 << 14
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "riskmart:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.json"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _header_text(value: str) -> str:
    """A header value without line breaks: control characters and non-ASCII ones percent-encoded as UTF-8."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    block = "\r\n".join(http).encode() + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": _header_text(url) if url else "urn:unknown",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if revisit:
        headers["WARC-Profile"] = _PROFILE
        headers["WARC-Refers-To"] = record_id(refers_to, digest)
        headers["X-Refers-To-Page-Id"] = "" if refers_to is None else str(refers_to)
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without a time stamp."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members; a block that is not what its digest says is an error.

    A member is fed in pieces, since what follows it in a piece is copied.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + PIECE_BYTES]
            if not piece:
                raise ValueError("the file ends inside a record")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in (x + " " if x.endswith(":") else x for x in head.decode().split("\r\n")[1:]))
        headers = {k: v.strip() for k, v in headers.items()}
        block = rest[: int(headers["Content-Length"])]
        if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        yield headers, block


def ranges(sizes: DataFrame, shard_bytes: int, bins: int = 1024) -> list[int]:
    """First ids of the ranges but the lowest, from ``sizes`` (id, n_bytes): each range holds about ``shard_bytes`` unless one id has more.

    Each round counts the bytes of equal bins of the ranges that are still too heavy; ranges and bins, not ids, reach the driver.
    """
    ends = sizes.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if ends.lo is None:
        return []
    from_zero = max(ends.lo, 0)  # below zero and above apart, so that no difference leaves 64 bits
    rows = sizes.withColumn("start", F.when(F.col("id") < 0, F.lit(ends.lo)).otherwise(F.lit(from_zero)))
    done, width = [], max(min(ends.hi, -1) - ends.lo, ends.hi - from_zero) + 1
    while True:
        step = -(-width // bins)
        rows = rows.withColumn("start", F.expr(f"start + ((id - start) div {step}L) * {step}L"))
        counted = rows.groupBy("start").agg(F.sum(F.col("n_bytes") + 500).alias("n")).collect()
        heavy = [(r.start,) for r in counted if r.n > shard_bytes and step > 1]
        done += [(r.start, r.n) for r in counted if r.n <= shard_bytes or step == 1]
        if not heavy:
            break
        starts = sizes.sparkSession.createDataFrame(heavy, "start long")
        rows = store(rows.join(starts, "start", "left_semi"), "heavy")
        width = step
    firsts, held = [], 0
    for start, n in sorted(done):
        if held and held + n > shard_bytes:
            firsts.append(start)
            held = 0
        held += n
    return firsts


def refer(digests: DataFrame) -> DataFrame:
    """For rows (id, digest, n_bytes) of large payloads that occur more than once: the smallest id of the payload, ``first_id``.

    Ids that are null count as larger than all others.
    """
    large = digests.filter(F.col("n_bytes") >= MIN_REVISIT)
    groups = large.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return large.join(groups.drop("n"), "digest").select("id", "digest", "first_id").distinct()


_FILE = "shard int, roll int, temporary string, records long, bytes long, sha256 string"


def _write_shard(rows: Iterator[pa.RecordBatch], out: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(out)
    attempt, held, done = uuid.uuid4().hex, [], []
    state = {"shard": None, "bytes": 0, "first": None, "previous": None}

    def close() -> None:
        if held:
            name = f"{attempt}-{len(done)}"
            data = b"".join(held)
            with fs.open_output_stream(f"{root}/_temporary/{name}") as sink:
                sink.write(data)
            done.append((state["shard"], state["roll"], name, len(held), len(data), hashlib.sha256(data).hexdigest()))
            held.clear()

    for batch in rows:
        for shard, page_id, digest, is_page, first_id, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != state["shard"]:
                close()
                state |= {"shard": shard, "roll": 0, "bytes": 0}
            if not is_page:  # comes before the pages of its id and digest
                state["first"] = (page_id, digest, first_id)
                continue
            copied = state["first"] is not None and state["first"][:2] == (page_id, digest)
            first = state["first"][2] if copied else None
            revisit = copied and (first != page_id or state["previous"] == (page_id, digest))
            state["previous"] = (page_id, digest)
            held.append(member(record(page_id, url, payload, digest, first, revisit)))
            state["bytes"] += len(held[-1])
            if state["bytes"] >= roll_bytes:
                close()
                state |= {"roll": state["roll"] + 1, "bytes": 0}
    close()
    names = [f.split(" ")[0] for f in _FILE.split(", ")]
    if done:
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def write(
    pages: DataFrame,
    out: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> list[dict]:
    """Write every row as a record below ``out``, a URI that all executors reach; returns the manifest.

    A null payload is an empty one, a null url is written as unknown; null ids are written last. Rows of the same id and payload are told apart by their order
    only: the first is the response. An empty table gives a manifest without files. Other columns are ignored. ``out`` must be new.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    described = source.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    firsts = ranges(described.select("id", "n_bytes").filter("id is not null"), shard_bytes)
    bounds = np.array(firsts, np.int64)

    @F.arrow_udf(St.IntegerType())
    def shard_of(ids: pa.Array) -> pa.Array:
        values = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), "right")
        return pa.array(values.astype(np.int32), pa.int32())

    rows = source.select(
        "id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("is_page"), F.lit(None).cast("long").alias("first_id"), "url", "payload"
    ).unionByName(
        refer(described).select(
            "id", "digest", F.lit(0).alias("is_page"), "first_id", F.lit(None).cast("string").alias("url"), F.lit(b"").alias("payload")
        )
    )
    sharded = rows.withColumn("shard", shard_of("id")).select("shard", *rows.columns)
    ordered = sharded.repartitionById(len(firsts) + 1, "shard").sortWithinPartitions(
        "shard", F.col("id").asc_nulls_last(), "digest", "is_page", "url"
    )
    _file_system(spark, out).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_temporary"))
    written = ordered.mapInArrow(lambda rows: _write_shard(rows, out, roll_bytes), _FILE).collect()  # one row per file
    return _commit(spark, out, sorted(tuple(r) for r in written))


def _file_system(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, out: str, files: list[tuple]) -> list[dict]:
    fs, new_path = _file_system(spark, out), spark._jvm.org.apache.hadoop.fs.Path
    manifest = []
    for shard, roll, temporary, records, size, digest in files:
        name = f"part-{shard:06d}-{roll:05d}.warc.gz"
        if not fs.rename(new_path(f"{out}/_temporary/{temporary}"), new_path(f"{out}/{name}")):
            raise OSError(f"{out}/{name} can't be put in place")
        manifest.append({"file": name, "records": records, "bytes": size, "sha256": digest})
    fs.delete(new_path(f"{out}/_temporary"), True)
    stream = fs.create(new_path(f"{out}/{MANIFEST}.tmp"), True)
    stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
    stream.close()
    if not fs.rename(new_path(f"{out}/{MANIFEST}.tmp"), new_path(f"{out}/{MANIFEST}")):
        raise OSError(f"the manifest of {out} can't be put in place")
    return manifest


_RECORD = (
    "page_id long, url string, record_type string, payload_digest string, refers_to long, stated_bytes long, payload binary"
)


def read(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """The records of the files that the manifest of ``out`` names, with the payload (null for a revisit) and its length as stated.

    Every block is checked against its digest, and a response's payload against its own.
    """
    text = "".join(r.value for r in spark.read.text(f"{out}/{MANIFEST}", wholetext=True).collect())  # one row per file of the archive
    files = [f"{out}/{f['file']}" for f in json.loads(text)]
    if not files:
        return spark.createDataFrame([], _RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse(content.as_buffer().to_pybytes()):
                    rows.append(_row(headers, block, payload))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, _RECORD)


_ROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("stated_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    http, _, body = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    response = headers["WARC-Type"] == "response"
    if response and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {
        "page_id": int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None,
        "url": None if headers["WARC-Target-URI"] == "urn:unknown" else headers["WARC-Target-URI"],
        "record_type": headers["WARC-Type"],
        "payload_digest": digest,
        "refers_to": int(headers["X-Refers-To-Page-Id"]) if headers.get("X-Refers-To-Page-Id") else None,
        "stated_bytes": len(body) if response else stated,
        "payload": body if response and with_payload else None,
    }
