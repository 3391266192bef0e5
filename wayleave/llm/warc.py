"""WARC archives: writing, normalising, reading back.

write() puts each partition's records into one monolithic gzip stream. normalise() inflates such a stream once, from front to
back, rewrites every record as a gzip member of its own and writes a sidecar index (offset and length of each member).
read() takes blocks of the index to tasks, which seek to their members. Files lie in the shared folder and are reached by
its file system (pyarrow.fs), so that any task can read what another one wrote; they are written under another name, then
moved into place, so that a task that runs again leaves the same files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayleave.llm.shared import join_hot, partitions, save, shared_dir, text_or_empty

#: A block to read back has at most so many records, and so many bytes of them unless one is longer.
BLOCK, BLOCK_BYTES = 256, 8 << 20
PLAIN = re.compile(r"[\x21-\x7E]*")
READ, INFLATED = 1 << 20, 4 << 20
NO_ID = -(1 << 63)


def digest(*parts: bytes | memoryview) -> str:
    whole = hashlib.sha1()
    for part in parts:
        whole.update(part)
    return base64.b32encode(whole.digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> list[bytes]:
    """A WARC record of a page in parts, the payload as it is given; a revisit has the HTTP head only and names the payload's digest, length and first holder."""
    plain = PLAIN.fullmatch(url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = [head] if revisit else [head, payload]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url or '' if plain else quote(url, safe=':/?#[]@!$&()*+,;=~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(*block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {sum(map(len, block))}",
    ]
    if not plain:
        lines.append("X-Target-URI-Encoding: percent")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", *block, b"\r\n\r\n"]


def _head(data: bytearray, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields of the record head at `at`, where its block starts, and where the next record starts; None if the head is not complete."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = dict(line.split(": ", 1) for line in bytes(data[at:end]).decode().split("\r\n")[1:])
    block = end + 4
    return fields, block, block + int(fields["Content-Length"]) + 4


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/mono-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{name}.{uuid.uuid4().hex}"
        n, pack = 0, zlib.compressobj(1, zlib.DEFLATED, 31)
        with store.open_output_stream(part, compression=None) as f:
            for batch in batches:
                for i in range(batch.num_rows):  # one page's text at a time
                    page_id, url, html, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                    for part_ in record(page_id, url, html.encode(), refers_to, revisit):
                        f.write(pack.compress(part_))
                    n += 1
            f.write(pack.flush())
        store.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "n"])

    return run


def _normalise(folder: str):
    """(path, offset, length, n): blocks of at most BLOCK records of the normalised files, and of at most BLOCK_BYTES of records or one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for mono, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = mono.replace("/mono-", "/members-")
                part = f"{name}.{uuid.uuid4().hex}"
                open_, data, at, n, blocks, held = zlib.decompressobj(31), bytearray(), 0, 0, [], 0
                with store.open_input_stream(mono, compression=None) as src, store.open_output_stream(part, compression=None) as dst, store.open_output_stream(f"{part}.idx", compression=None) as idx:
                    while chunk := open_.unconsumed_tail or src.read(READ):
                        data += open_.decompress(chunk, INFLATED)  # no more at once, however well the rest is packed
                        start = 0
                        while (head := _head(data, start)) and head[2] <= len(data):
                            fields, _, end = head
                            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                            with memoryview(data) as view, view[start:end] as one:
                                member = pack.compress(one) + pack.flush()
                            dst.write(member)
                            idx.write(f"{at} {len(member)} {fields['WARC-Record-ID']} {fields['WARC-Type']}\n".encode())
                            held += end - start
                            if not blocks or blocks[-1][2] == BLOCK or held > BLOCK_BYTES:
                                blocks.append([at, 0, 0])
                                held = end - start
                            at, n, start = at + len(member), n + 1, end
                            blocks[-1][1:] = [at - blocks[-1][0], blocks[-1][2] + 1]
                        del data[:start]
                if n != expected or data or not open_.eof or open_.unused_data:
                    raise ValueError(f"{mono}: {n} records of {expected}, {len(data)} bytes left, {'ended' if open_.eof else 'cut short'}")
                store.move(f"{part}.idx", f"{name}.idx")
                store.move(part, name)
                if blocks:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), *(pa.array(c) for c in zip(*blocks, strict=True))], ["path", "offset", "length", "n"])

    return run


def members(data: bytes | memoryview) -> Iterator[bytearray]:
    """The records of consecutive gzip members, in time that grows with the data: a member gets the data behind it in steps that double."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, out, step = zlib.decompressobj(31), bytearray(), 4096
        while not one.eof:
            if at >= len(view):
                raise ValueError("a member is cut short")
            out += one.decompress(view[at : at + step])
            at = min(at + step, len(view)) - len(one.unused_data)
            step *= 2
        yield out


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, offset, length, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as f:
                    f.seek(offset)
                    data = f.read(length)
                rows = []
                for raw in members(data):
                    fields, block, end = _head(raw, 0)
                    cut = raw.find(b"\r\n\r\n", block) + 4
                    size = int(dict(x.split(": ", 1) for x in raw[block : cut - 4].decode().split("\r\n")[1:])["Content-Length"])
                    payload, kind = memoryview(raw)[cut : end - 4], fields["WARC-Type"]
                    page = fields["WARC-Record-ID"][10:-1]
                    refers = fields.get("WARC-Refers-To", "<urn:page:>")[10:-1]
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (said != digest(payload) or size != len(payload)):
                        raise ValueError(f"{path}: payload of {page} is damaged")
                    rows.append((int(page) if page else None, unquote(fields["WARC-Target-URI"]) if "X-Target-URI-Encoding" in fields else fields["WARC-Target-URI"], size, said, kind, int(refers) if refers else None, str(payload, "utf-8") if kind == "response" else None))
                if len(rows) != n:
                    raise ValueError(f"{path}: {len(rows)} records at {offset}, not {n}")
                cols = zip(*rows, strict=True)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Monolithic archives of all rows: (path, n). Of equal payloads the largest page_id is the response, others revisit it.

    A null html is an empty payload. Rows without page_id revisit one that has it; where no row has, all are responses.
    Rows that repeat the largest page_id with an equal payload are all responses. Which payloads occur more than once comes from counts by digest,
    aggregated before the shuffle, so that pages themselves are not grouped; pages of a payload that very many share are dealt to several tasks.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), text_or_empty(f"`{html}`").alias("html"))
    key = [F.sha1(F.encode("html", "UTF-8")).alias("d"), F.length("html").alias("l")]
    keys = save(rows.select("page_id", *key), "payload-keys")
    last = keys.groupBy("d", "l").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1 and last is not null").drop("c")
    last = save(last, "payloads")
    joined = join_hot(rows.select("*", *key), last, ["d", "l"], ["page_id", "url"], counted=keys)
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit")).mapInArrow(_write(folder), "path string, n long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive (path, n) of write() rewritten with every record as a gzip member of its own, beside it a sidecar (offset, length, identifier, type of each).

    Returns the blocks of records to read back (path, offset, length, n). Archives without records give none. An archive that is cut short, or holds
    another number of records than n, raises.
    """
    return archives.where("n > 0").mapInArrow(_normalise(folder), "path string, offset long, length long, n long")


def read(index: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the blocks that normalise() gives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Records without page_id have null; equal records give equal rows. A payload that does not agree with its digest or length raises. No blocks give no rows.
    """
    return index.mapInArrow(_read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages, normalise the archives, and read them back: a row for each page as read()'s.

    Payloads may have any length (a task holds a record some five times over, and blocks of BLOCK_BYTES) and any bytes of UTF-8, the record marks included; what write() says of nulls and repeated rows
    holds here. An empty table gives an empty result. Only the three named columns are read, so others may have any name.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    n = partitions(pages.sparkSession)
    archives = save(write(pages, folder, **columns), "archives")
    index = save(normalise(archives.repartitionByRange(n, "path"), folder), "index")
    return read(index.repartitionByRange(n, "path", "offset"), folder)
