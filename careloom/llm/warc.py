"""WARC archives: written with one gzip member per record, read through an index (operator 1).

Method: the index comes first. It holds file, offset, length, URL and digest of every record.
Reading selects from the index, sorts what it wants by file and offset and coalesces
neighbouring byte ranges into few large reads.

Archives lie in a folder that all executors share, reached by its URI. A task writes files
under a fresh name, so that a repeated attempt never touches those of another; the index holds
the files of the attempts that succeeded, and only those are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.session import shared_folder

#: Bytes of a file after which a task begins the next one.
FILE_BYTES = 1 << 30
#: Records of one block of a file are read by one task.
BLOCK_BYTES = 64 << 20
#: Ranges closer than this are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"


def file_system(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """Line ends and other control characters can't stand in a header; they are percent-coded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def record_id(page_id, url: str | None, digest: str) -> str:
    """The same for every attempt and run; rows that repeat all three have records alike, ids included."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the headers of its response and no payload.

    A revisit names its response by the standard's headers (record id, URI and date) and by its page id.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {header_value(refers_url)}")
        head += [f"WARC-Refers-To-Date: {date}", f"Page-Refers-To: {refers_to}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_revisits(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Marks each page as response or as revisit of the page that holds the same payload.

    Of equal payloads of at least ``least_bytes`` bytes the one with the largest id is the
    response; a null id is smaller than any other. Rows that repeat the id and the payload
    of a response are responses too; of several URLs a revisit names the largest. A null
    payload is an empty one. An empty table gives an empty one; further columns are not read. Groups are formed on digests; the join back is
    one that adaptive execution can split where many pages share a payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("sha", F.sha1(F.col("body").cast("binary")))
    chosen = rows.filter(F.octet_length("body") >= least_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("chosen"), F.count(F.lit(1)).alias("n"))
    chosen = chosen.filter("n > 1").select("sha", F.col("chosen.page_id").alias("chosen"), F.col("chosen.url").alias("chosen_url"))
    again = F.col("chosen").isNotNull() & ~F.col("chosen").eqNullSafe(F.col("page_id"))
    return rows.join(chosen, "sha", "left").select("page_id", "url", "body", F.when(again, F.col("chosen")).alias("refers_to"), F.when(again, F.col("chosen_url")).alias("refers_url"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes rows of :func:`with_revisits` as archives under ``folder`` and returns their index.

    Every row is a record, repeated rows too. A record without a page id or URL lacks that header and
    has null in the index; an empty table gives an empty index and no archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = file_system(f"{folder}/archives")
        store.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, body, refers_to, refers_url in zip(*(batch[c] for c in ("page_id", "url", "body", "refers_to", "refers_url")), strict=True):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)  # members are compressed already
                payload = body.encode()
                digest = digest_of(payload)
                key = None if pd.isna(page_id) else int(page_id)
                kind = "response" if pd.isna(refers_to) else "revisit"
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record(kind, key, url, payload, digest, None if kind == "response" else int(refers_to), refers_url, date)) + packer.flush()
                out.write(raw)
                index.append((name, offset, len(raw), key, url, digest, kind))
                offset += len(raw)
            frame = pd.DataFrame(index, columns=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    rows.mapInPandas(run, INDEX).write.parquet(f"{folder}/index")
    return rows.sparkSession.read.parquet(f"{folder}/index")


def coalesced(records: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of records, sorted by offset, that one read fetches."""
    start, end, first = None, 0, 0
    offsets, lengths = records["offset"].to_numpy(), records["length"].to_numpy()
    for i, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
        if start is not None and (at - end > GAP_BYTES or at + n - start > READ_BYTES):
            yield records.iloc[first:i]
            start = None
        if start is None:
            start, first, end = at, i, at
        end = max(end, at + n)
    if start is not None:
        yield records.iloc[first:]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records that ``index`` lists, read back from the archives.

    Payload size and digest are taken from the payload itself; a revisit has no payload, so
    both come from its headers. ``intact`` tells whether digests of index, header and payload
    agree. A record that the index lists twice is read twice; an empty index gives an empty
    table; further columns of it are not read. Records are dealt by file and block, so that a large archive is read by many tasks.
    """
    wanted = index.select("file", "offset", "length", "payload_digest", F.floor(F.col("offset") / BLOCK_BYTES).alias("block"))
    wanted = wanted.repartition("file", "block").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = file_system(f"{folder}/archives")
        for batch in batches:
            for name, records in batch.groupby("file", sort=True):
                with store.open_input_file(f"{path}/{name}") as source:
                    for run_of in coalesced(records):
                        start = int(run_of["offset"].iloc[0])
                        data = source.read_at(int((run_of["offset"] + run_of["length"]).max()) - start, start)
                        yield parsed(run_of, data, start)

    return wanted.mapInPandas(run, RECORDS)


def parsed(records: pd.DataFrame, data: bytes, start: int) -> pd.DataFrame:
    out = []
    for offset, length, expected in zip(records["offset"], records["length"], records["payload_digest"], strict=True):
        fields, block = parse(zlib.decompress(data[offset - start: offset - start + length], 31))
        head, _, payload = block.partition(b"\r\n\r\n")
        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page_id = int(fields["Page-ID"]) if "Page-ID" in fields else None
        if fields["WARC-Type"] == "revisit":
            size = next(int(x[16:]) for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))
            out.append((page_id, fields.get("WARC-Target-URI"), size, told, "revisit", int(fields["Page-Refers-To"]), None, told == expected))
        else:
            digest = digest_of(payload)
            out.append((page_id, fields.get("WARC-Target-URI"), len(payload), digest, "response", None, payload, told == digest == expected))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "intact"]
    return pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_folder(spark) -> str:
    """A fresh folder for archives under the one that the executors share."""
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
