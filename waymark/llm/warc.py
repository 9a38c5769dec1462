"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset index.

The normaliser inflates a whole-file gzip stream once, chunk by chunk, parses its records as they come, writes each
record as a gzip member of its own, and writes a sidecar (JSON lines) with the offset and length of every member, so that any
record can be read alone. Files are opened through the file system of their URI, each task works
on its own files, and results name only files of tasks that ended well; a repeated task writes new files.

Defined results: a null payload counts as empty; a null url is left out; null ids are kept; repeated rows are records of
their own; a stream that breaks off gives the records before the break, and an index row with status 'truncated'; one that cannot be inflated or parsed, with status
'corrupt'; round_trip and resolved raise an error for either, and for a payload that differs from its digest; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import delete_path, materialize, new_path

#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 100
LEVEL = 6
CHUNK = 1 << 20
MAX_HEADER = 1 << 20

# Fixed value: the profile of revisits by equal payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path) if mode == "r" else store.open_input_stream(path, compression=None)


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: str | None, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but the digest and length of it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%" + c.encode().hex() for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, piece by piece. Raises EOFError if it breaks off."""
    z, open_member = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            open_member = True
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            if z.eof:
                data, z, open_member = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if open_member:
        rest = z.flush()
        if rest:
            yield rest
        if not z.eof:
            raise EOFError


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, head to final blank lines, of an inflated stream. Raises EOFError in the middle of one."""
    buf = bytearray()

    def more() -> None:
        try:
            buf.extend(next(pieces))
        except StopIteration:
            raise EOFError from None

    while True:
        while buf[:2] == b"\r\n":
            del buf[:2]
        if len(buf) < 2:
            try:
                more()
            except EOFError:
                if buf.strip():
                    raise
                return
            continue
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if len(buf) > MAX_HEADER:
                raise ValueError("no end of a record's head")
            more()
        size = end + 4 + int(parse_head(bytes(buf[:end]))["content-length"])
        while len(buf) < size + 4:
            more()
        yield bytes(buf[: size + 4])
        del buf[: size + 4]


def _chunks(f) -> Iterator[bytes]:
    while data := f.read(CHUNK):
        yield data


def normalise_file(source: str, target: str, level: int = LEVEL) -> list[dict]:
    """Rewrite one monolithic file member by member; returns and writes (target + '.idx') its index."""
    index, offset = [], 0
    with _open(source, "s") as f, _open(target, "w") as out:
        it = records(inflate(_chunks(f)))
        while True:
            try:
                rec = next(it)
            except StopIteration:
                break
            except (EOFError, zlib.error, ValueError) as e:
                index.append({"offset": offset, "length": 0, "record_id": None, "record_type": None, "status": "truncated" if isinstance(e, EOFError) else "corrupt"})
                break
            head = parse_head(rec[: rec.index(b"\r\n\r\n")])
            member = gzip.compress(rec, level, mtime=0)
            out.write(member)
            index.append({"offset": offset, "length": len(member), "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "status": "ok"})
            offset += len(member)
    with _open(target + ".idx", "w") as f:
        f.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return index


def read_member(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and payload (without HTTP head) of the record in one member."""
    f.seek(offset)
    rec = gzip.decompress(f.read(length))
    end = rec.index(b"\r\n\r\n")
    head = parse_head(rec[:end])
    block = rec[end + 4 : end + 4 + int(head["content-length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


def write_monolithic(rows: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """(path): one whole-file gzip stream for each partition of rows (page_id string, url, payload, digest, size, record_type, refers_to string)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, z = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(level, zlib.DEFLATED, 31)
        for b in batches:
            if out is None and len(b):
                out = _open(path, "w")
            for r in b.itertuples(index=False):
                out.write(z.compress(record_bytes(r.page_id, r.url, r.payload or b"", r.digest, r.record_type, r.refers_to, int(r.size))))
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"path": [path]})

    return rows.select("page_id", "url", "payload", "digest", "size", "record_type", "refers_to").mapInPandas(run, "path string")


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """The index of all files (column path): archive, offset, length, record_id, record_type, status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                index = pd.DataFrame(normalise_file(path, target, level), columns=["offset", "length", "record_id", "record_type", "status"])
                yield index.assign(archive=target)

    return files.mapInPandas(run, "archive string, offset long, length long, record_id string, record_type string, status string")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of normalised archives (column archive), each read alone through the sidecar: page_id, payload_bytes, payload_digest, record_type, refers_to (texts as stored), checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["archive"]:
                with _open(path + ".idx", "s") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with _open(path, "r") as f:
                    for x in (x for x in index if x["status"] == "ok"):
                        head, payload = read_member(f, x["offset"], x["length"])
                        if head["warc-type"] == "response":
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            ok = f"sha256:{digest}" == head.get("warc-payload-digest")
                        else:
                            size, digest, ok = int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:"), True
                        rows.append((head.get("warc-page-id"), size, digest, head["warc-type"], head.get("warc-refers-to-page"), ok))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "checked"])

    return archives.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, checked boolean")


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows for write_monolithic: equal payloads of REVISIT_BYTES or more are stored once, by the smallest id."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("size"))
    small = rows.select("id", "digest", "size").distinct()
    first = small.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = small.filter(F.col("size") >= REVISIT_BYTES).join(first, "digest").filter(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("again"), F.col("digest").alias("d"), "first")
    named = rows.join(again, F.col("id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("first").isNotNull()
    return named.select(
        F.col("id").cast("string").alias("page_id"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("first").cast("string").alias("refers_to"),
    )


def resolved(records: DataFrame) -> DataFrame:
    """Records of read_archives; a revisit has the size and digest of the response that it names. An error for wrong digests and for revisits without a response."""
    fault = lambda ok, c, what: F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(what), F.coalesce("page_id", F.lit("?"))))).alias(c)
    own = records.filter("record_type = 'response'").select("page_id", "payload_bytes", fault(F.col("checked"), "payload_digest", "wrong digest in record of page "), "record_type", "refers_to")
    said = records.filter("record_type = 'revisit'").select("page_id", F.col("payload_digest").alias("d"), "record_type", "refers_to")
    first = own.select(F.col("page_id").alias("p"), "payload_bytes", "payload_digest").distinct()
    met = said.join(first, F.col("refers_to").eqNullSafe(F.col("p")) & (F.col("d") == F.col("payload_digest")), "left")
    met = met.select("page_id", "payload_bytes", fault(F.col("payload_digest").isNotNull(), "payload_digest", "no response for the revisit of page "), "record_type", "refers_to")
    return own.unionByName(met)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to monolithic archives, normalise those, and read the records back."""
    spark = pages.sparkSession
    folder, normal = new_path(spark, "warc-whole"), new_path(spark, "warc")
    files = materialize(write_monolithic(plan_records(pages), folder), "warc-files")
    n = max(1, files.count())
    index = materialize(normalise(files.repartition(n), normal), "warc-index")
    delete_path(spark, folder)
    broken = index.filter("status <> 'ok'").select("archive", "status").first()
    if broken:
        raise ValueError(f"{broken.archive}: {broken.status}")
    archives = materialize(index.select("archive").distinct(), "warc-archives")
    kind = dict(pages.dtypes)["page_id"]
    records = materialize(read_archives(archives.repartition(n)), "warc-records")
    return resolved(records).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f < page_id THEN f END AS refers_to
FROM q
"""
