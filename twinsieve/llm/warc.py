"""A deterministic sharded WARC writer, and a reader for its archives.

Records are range-sorted by page_id. A shard ends where the bytes of all records before,
in the order of ids, pass a multiple of its size; these sums do not depend on how rows
are dealt, and a shard's records are sorted completely, so the same table gives the same
files byte for byte. The bounds are a stored table, one row a shard, in which tasks look
their ids up; none of it comes to the driver. An id (or no id) with more bytes than a
shard is parted by payload. A revisit leaves its payload behind. Each shard is one task: it writes gzip members to a
temporary name, rolls to the next file by compressed size, and renames a file when
it is complete. A manifest table, committed last by Spark, lists the files that
count; what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.shared import filesystem, fresh_path, settle

#: Bytes a shard should hold, those that a record's headers count for, and compressed bytes after which a file is closed.
SHARD_BYTES, HEADERS, ROLL_BYTES = 32 << 20, 600, 64 << 20
#: The capture date that headers give; a fixed one, as the table has none.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5b0f5d1e-6f0c-4a53-9d5e-0b3f0a1c7e11")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _uri(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(rb"[^\x21-\x7E]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


def record(page_id, url: str | None, payload: bytes | None, refers_to=None, revisit: bool = False, digest: str = "", size: int = 0) -> bytes:
    """One WARC record. A revisit has the HTTP header of its payload, but not the payload, so digest and size do for it."""
    if payload is not None:
        digest, size = base32(hashlib.sha1(payload).digest()), len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url, page_id)}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
        lines += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's header fields (lower-cased names), HTTP length and payload; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if fields["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"block digest of {fields['warc-record-id']} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\ncontent-length: (\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != length or fields["warc-payload-digest"] != f"sha1:{base32(hashlib.sha1(payload).digest())}"):
        raise ValueError(f"payload digest of {fields['warc-record-id']} is wrong")
    return fields | {"http_length": length, "payload": payload}


def _id(x):
    return None if x is None or x != x else int(x)


def _bounds(sized: DataFrame, shard_bytes: int) -> tuple[str, int]:
    """``sized(page_id, size)`` -> the path of a stored table of bounds, and the number of shards.

    The table has the least id of each range (null first), its first shard, and the
    number of shards that it is parted into, which is over 1 for a single large id.
    """
    spark = sized.sparkSession
    per_id = sized.groupBy("page_id").agg(F.sum("size").alias("size"))
    ranged = per_id.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("page_id").asc_nulls_first())
    ranged = settle(ranged.withColumn("part", F.spark_partition_id()), "ids", narrow=True)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ranged.groupBy("part").agg(F.sum("size").alias("total")).select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("page_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.join(F.broadcast(starts), "part").select("page_id", "size", (F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before"))
    large = F.col("size") > shard_bytes
    ranges = before.groupBy(F.floor(F.col("before") / shard_bytes).alias("k"), large.alias("large")).agg(
        F.when(F.count_if(F.col("page_id").isNull()) == 0, F.min("page_id")).alias("least"), F.sum("size").alias("size")
    )
    ranges = ranges.withColumn("parts", F.when(F.col("large"), F.ceil(F.col("size") / shard_bytes)).otherwise(1).cast("long"))
    # One row a shard, about; as many as there will be files.
    first = F.coalesce(F.sum("parts").over(Window.orderBy("k", "large").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    path = fresh_path(spark, "bounds")
    ranges.select("least", first.cast("long").alias("first"), "parts").coalesce(1).write.parquet(path)
    return path, int(spark.read.parquet(path).agg(F.sum("parts")).first()[0] or 1)


def _shard_of(bounds: str):
    """(page_id, hash) -> shard, by binary search in the bounds that a task reads once."""
    tables: list = []

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, key: pd.Series) -> pd.Series:
        if not tables:
            import pyarrow.dataset as ds

            files, path = filesystem(bounds)
            t = ds.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=True).to_table().to_pandas().sort_values("least", na_position="first")
            tables.append(t)
        t = tables[0]
        named = t["least"].notna().to_numpy()
        least, ids = t["least"].to_numpy()[named].astype(np.int64), page_id.astype("Int64")
        missing = ids.isna().to_numpy()
        at = np.searchsorted(least, ids.fillna(0).to_numpy(np.int64), side="right") - 1 + (~named).sum()
        at = np.where(missing, 0, at)
        return pd.Series(t["first"].to_numpy()[at] + key.to_numpy(np.int64) % t["parts"].to_numpy()[at])

    return shard


def write(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit: int = 0, level: int = 4) -> DataFrame:
    """``pages(page_id, url, html)`` -> the manifest of the archives in ``out``: file, records, bytes.

    Of pages with equal payloads of at least ``least_revisit`` bytes the one with the
    largest page_id is the response and the others revisit it. Null html is an empty
    payload. Rows without page_id sort first and are never the one revisited unless
    no equal page has an id. Of rows that are equal in page_id and payload the first
    is the response. An empty table gives an empty manifest. Payloads of any size are
    written whole. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    same = p.groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    several = settle(same.where((F.col("copies") > 1) & (F.col("n") >= least_revisit)).select("digest", "n", "keeper", F.lit(True).alias("shared")), "shared")
    # The payload goes no further where another page is the response.
    other = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    known = p.join(several, ["digest", "n"], "left").withColumn("html", F.when(~other, F.col("html")))
    sized = p.select("page_id", "digest", "n").join(several, ["digest", "n"], "left").select("page_id", (F.when(~other, F.col("n")).otherwise(0) + HEADERS).alias("size"))
    bounds, shards = _bounds(sized, shard_bytes)
    dealt = known.withColumn("shard", _shard_of(bounds)("page_id", F.xxhash64("digest", "url")))
    dealt = dealt.select("page_id", "url", "html", "digest", "n", "keeper", "shared", "shard").repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = filesystem(out)
        files.create_dir(f"{base}/_temporary", recursive=True)
        done, now, stream, temporary, last, counts = [], None, None, None, None, [0, 0]

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                name = f"part-{now:06d}-{len([x for x in done if x[0] == now]):05d}.warc.gz"
                files.move(temporary, f"{base}/{name}")
                done.append((now, name, *counts))
                stream = None

        try:
            for batch in batches:
                for page_id, url, html, digest, size, keeper, shared, part in zip(*(batch[c].array for c in ("page_id", "url", "html", "digest", "n", "keeper", "shared", "shard")), strict=True):
                    if part != now or counts[1] >= roll_bytes:
                        close()
                        now = int(part)
                    if stream is None:
                        temporary, counts = f"{base}/_temporary/{uuid.uuid4().hex}", [0, 0]
                        stream = files.open_output_stream(temporary)
                    page_id, keeper = _id(page_id), _id(keeper)
                    first = last != (page_id, digest)
                    last = (page_id, digest)
                    revisit = shared is True or shared == True  # noqa: E712  a column with nulls holds objects
                    revisit = bool(revisit) and not (page_id == keeper and first)
                    payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else None
                    raw = record(page_id, url if isinstance(url, str) else None, payload, keeper, revisit, base32(bytes.fromhex(digest)), int(size))
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(raw) + packer.flush()
                    stream.write(data)
                    counts[0] += 1
                    counts[1] += len(data)
            close()
        finally:
            if stream is not None:
                stream.close()
                files.delete_file(temporary)
        if done:
            yield pd.DataFrame({"file": [x[1] for x in done], "records": [x[2] for x in done], "bytes": [x[3] for x in done]}).astype({"records": "int64", "bytes": "int64"})

    found = dealt.mapInPandas(run, "file string, records long, bytes long")
    found.write.parquet(f"{out}/_manifest")
    return spark.read.schema(found.schema).parquet(f"{out}/_manifest")


def members(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or stream.read(piece)
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(unpack.decompress(data))
        left = b""
        if unpack.eof:
            yield b"".join(parts)
            left, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)


def read(manifest: DataFrame, out: str) -> DataFrame:
    """Reads the archives that a manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Every digest is checked against the bytes; a revisit has no payload of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = filesystem(out)
        for batch in batches:
            for name, count in zip(batch["file"], batch["records"], strict=True):
                rows, size, seen = [], 0, 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        r = parse(raw)
                        page, to = r.get("x-page-id"), r.get("x-refers-to-page")
                        response = r["warc-type"] == "response"
                        rows.append((page and int(page), r["warc-target-uri"], r["http_length"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], to and int(to), r["payload"] if response else None))
                        seen, size = seen + 1, size + len(raw)
                        if size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if seen != count:
                    raise ValueError(f"{name}: {seen} records, the manifest has {count}")
                yield _frame(rows)

    files = manifest.select("file", "records")
    n = max(1, files.count())
    return files.repartition(n).mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    for c in ("page_id", "refers_to", "payload_bytes"):
        frame[c] = pd.array(frame[c], dtype="Int64")
    return frame


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to fresh archives in the shared folder and reads them back, without url and payload."""
    out = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, out, **options), out).drop("url", "payload")
