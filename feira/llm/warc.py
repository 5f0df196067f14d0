"""WARC archives: written one gzip member per record, read back sequentially and verified.

The reader inflates a file member by member with an incremental decompressor,
so it holds one record at a time. Header lines end at an empty line,
``Content-Length`` frames the block, and the member must end after it. Digests
of blocks and payloads are verified where a record has them, in any algorithm hashlib knows; anything
that does not fit is an error that names the file. Archives of other writers are read too: header names in any
case, with or without a space after the colon, folded lines, any record type and any record id.

Of pages with equal payloads of at least ``least`` bytes the one with the
largest id is a response and the others revisit it, without a payload of
their own. Rows that repeat that id and payload are responses too. A null payload is
empty, a null id counts as the smallest, a null address is left out of the record. Archives are
complete files named by the task that wrote them; the leftovers of lost tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import files, store

FILE_BYTES = 64 << 20
LEAST_BYTES = 1000
CHUNK = 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def digest_field(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def digest_value(field: str) -> tuple[str, str]:
    """Algorithm and hexadecimal value of a digest field, whose value may be base 32 or hexadecimal."""
    kind, _, value = field.strip().partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind in hashlib.algorithms_available and len(value) == 2 * hashlib.new(kind).digest_size:
        return kind, value.lower()
    return kind, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()


def differs(field: str | None, data: bytes) -> bool:
    """Whether a digest field is there, in a known algorithm, and is not that of ``data``."""
    if field is None or field.strip().partition(":")[0].strip().lower().replace("-", "") not in hashlib.algorithms_available:
        return False
    kind, value = digest_value(field)
    return hashlib.new(kind, data).hexdigest() != value


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, date: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One compressed record; ``refers_to`` is the record id that a revisit points to."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", digest_field(digest)),
        ("WARC-Block-Digest", digest_field(hashlib.sha1(block).hexdigest())),
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)
        fields.append(("WARC-Target-URI", safe))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + END) + squeeze.flush()


def members(stream: Any, name: str) -> Iterator[bytes]:
    """The inflated gzip members of a file, one after another."""
    inflate, held, waiting = zlib.decompressobj(31), [], b""
    started = False
    while True:
        chunk = waiting or stream.read(CHUNK)
        waiting = b""
        if not chunk:
            break
        held.append(inflate.decompress(chunk))
        started = True
        if inflate.eof:
            yield b"".join(held)
            waiting, held, inflate, started = inflate.unused_data, [], zlib.decompressobj(31), False
    if started:
        raise ValueError(f"{name}: the last member is cut off")


def header_fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with whitespace goes on with the field before."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t"):
            fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header field: {line}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def parse(member: bytes, name: str) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record, framed and verified."""
    head, found, rest = member.partition(END)
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError(f"{name}: no WARC record")
    fields = header_fields(lines[1:])
    size = int(fields["content-length"])
    block = rest[:size]
    which = f"{name}: {fields.get('warc-record-id')}"
    if len(block) < size or rest[size:] != END:
        raise ValueError(f"{which} does not end where its length says")
    if differs(fields.get("warc-block-digest"), block):
        raise ValueError(f"{which} has another block digest")
    if fields["warc-type"] != "revisit" and differs(fields.get("warc-payload-digest"), payload_of(fields, block)):
        raise ValueError(f"{which} has another payload digest")
    return fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What a block carries: of an HTTP message its body, else all of it."""
    return block.partition(END)[2] if fields.get("content-type", "").startswith("application/http") else block


RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("content_type", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def described(fields: dict[str, str], block: bytes) -> dict[str, Any]:
    """A record as a row of RECORD."""
    payload = payload_of(fields, block)
    revisit = fields["warc-type"] == "revisit"
    http = block.partition(END)[0].decode("latin-1").split("\r\n")[1:]
    size = header_fields(http).get("content-length") if revisit and http else None
    given = fields.get("warc-payload-digest")
    digest = digest_value(given)[1] if given and given.strip().lower().startswith("sha1:") else None
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "content_type": fields.get("content-type"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": int(size) if size is not None else None if revisit else len(payload),
        "payload_digest": digest or (None if revisit else hashlib.sha1(payload).hexdigest()),
        "payload": None if revisit else payload,
    }


def write_archives(
    df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str, date: str, least: int = LEAST_BYTES
) -> DataFrame:
    """Write one record per row under ``folder``; returns the archives as ``uri``."""
    spark = df.sparkSession
    store.ship(spark)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    pages = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
        F.xxhash64(payload).alias("second"),
    )
    # stored, so that the join lays this side out itself and can split a hot payload
    groups = store.stored(
        pages.where(F.col("size") >= least)
        .groupBy("digest", "size", "second")
        .agg(F.max(store.row_id("id")).alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        f"{folder}/groups",
    )
    marked = pages.join(groups, ["digest", "size", "second"], "left").select(
        "id",
        "url",
        "digest",
        "size",
        F.when(store.row_id("id") < F.col("response"), F.col("response")).alias("refers_to"),
        F.when(store.row_id("id") < F.col("response"), F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("id", "url", "digest", "size", "refers_to", "payload")}
                if out is None:
                    out = files.Output(folder, ".warc.gz")
                to = None if row["refers_to"] is None else _record_id(row["refers_to"])
                out.write(record(row["id"], row["url"], date, row["payload"] or b"", row["size"], row["digest"], to))
                if out.size >= FILE_BYTES:
                    out.close()
                    done.append(out.uri)
                    out = None
        if out is not None:
            out.close()
            done.append(out.uri)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["uri"])

    return store.stored(marked.mapInArrow(run, "uri string"), f"{folder}/archives")


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of the archives (``uri``), whatever its type: the columns of RECORD.

    ``payload_digest`` is the SHA-1 in hexadecimal; a revisit has that of its header, its size from the HTTP header it kept and no
    payload. Fields that a record does not have are null.
    """
    store.ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_stream(uri) as stream:
                    for member in members(stream, uri):
                        rows.append(described(*parse(member, uri)))
                        held += len(rows[-1]["payload"] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    # a task for each archive; their names alone are too few bytes for Spark to spread
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in RECORD)
    return archives.repartition(max(archives.count(), 1)).mapInArrow(run, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of the pages in archives.

    Pages are responses and revisits. Records of other writers have no page id: theirs are null.
    """

    def page(record_id: str) -> Column:
        return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return read_records(archives).where("record_type IN ('response', 'revisit')").select(
        page("record_id").alias("page_id"),
        F.col("target_uri").alias("url"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
        "payload",
    )
