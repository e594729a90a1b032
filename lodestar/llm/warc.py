"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a footer in a skippable
frame: the seek table with every frame's compressed and plain size. The index maps a record's identifier to its
bundle, frame and offset inside the frame, so one record is read by seeking to one frame.

A payload is stored once: of pages with equal payloads of at least ``SMALLEST`` bytes the one with the largest
page_id is a response, the others revisit it. Pages are moved once, by page; what is
known of their payloads joins them in the same exchange, and hot groups of equal payloads only appear as digests.

Very long payloads are records of their own frame; only the three columns named are read, so others may have any name;
an empty table gives an empty result.

Defined cases: null html is an empty payload, always a response; a null url gives no target header; of repeated
rows (one page_id, one payload) the first is what the group asks of that page and the others revisit it; null
page_ids rank below all others.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import column_arrays, map_batches, text_of
from lodestar.sources.workspace import materialize, new_path

SMALLEST = 1000
#: Plain bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME, BUNDLE = 256 << 10, 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def _name(page_id: int | None, repeat: int = 0) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}" + (f":{repeat}" if repeat else "")


def _page(name: str) -> int | None:
    got = name.strip("<>").split(":")[2]
    return None if got == "null" else int(got)


def record(page_id: int | None, url: str | None, payload: bytes, repeat: int = 0, refers_to: str | None = None) -> bytes:
    """One WARC record: a response, or a revisit of the record named ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{_name(page_id, repeat)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}")
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of the records of a plain frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        yield at, stop + 4 - at, headers, frame[end + 4 : stop]
        at = stop + 4


def footer(sizes: list[tuple[int, int]]) -> bytes:
    """The seek table of frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames(f) -> list[tuple[int, int, int]]:
    """(position, compressed size, plain size) of the frames of an open bundle, from its footer."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    table = struct.iter_unpack("<II", f.read(8 * n))
    out, at = [], 0
    for packed, plain in table:
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(f, place: tuple[int, int, int]) -> bytes:
    """One frame, unpacked."""
    f.seek(place[0])
    return zstandard.ZstdDecompressor().decompress(f.read(place[1]), max_output_size=place[2])


def read_record(bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record by its place in the index."""
    store, path = fs.FileSystem.from_uri(bundle)
    with store.open_input_file(path) as f:
        plain = read_frame(f, frames(f)[frame])
    _, _, headers, block = next(parse(plain[offset : offset + length]))
    return headers, block


def keepers(pages: DataFrame) -> DataFrame:
    """(page_id, digest, keeper) of the pages whose payload occurs more than once; digests only are moved."""
    large = pages.filter(F.octet_length("html") >= SMALLEST).select("page_id", F.sha2("html", 256).alias("digest"))
    groups = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return large.join(groups, "digest").select("page_id", "digest", "keeper").distinct()


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write bundles of all pages under ``path`` and return the index.

    A task writes each bundle under a temporary name and moves it into place, so a repeated task replaces it whole.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), text_of(html).alias("html"))
    known = keepers(rows).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "keeper", F.lit(0).alias("kind"))
    dealt = rows.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"), F.lit(None).cast("long").alias("keeper"), F.lit(1).alias("kind"))
    dealt = dealt.unionByName(known).repartition(F.col("page_id")).sortWithinPartitions("page_id", "kind", "digest", "url")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        pack = zstandard.ZstdCompressor(level=LEVEL)
        number, out, temporary, name = 0, None, "", ""
        sizes: list[tuple[int, int]] = []
        frame, index, places = bytearray(), [], []
        last, repeat, same, shared = (), 0, None, {}

        def close_frame() -> None:
            nonlocal frame
            packed = pack.compress(bytes(frame))
            out.write(packed)
            index.extend((r, name, len(sizes), at, n) for r, at, n in places)
            sizes.append((len(packed), len(frame)))
            frame = bytearray()
            places.clear()

        def close() -> pa.RecordBatch:
            nonlocal out, number
            if frame:
                close_frame()
            out.write(footer(sizes))
            out.close()
            store.move(temporary, name)
            got = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*index, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["record_id", "bundle", "frame", "offset", "length"],
            )
            sizes.clear()
            index.clear()
            out, number = None, number + 1
            return got

        for batch in batches:
            for i, target, page, digest, keeper, kind in zip(*column_arrays(batch, "page_id", "url", "html", "digest", "keeper", "kind"), strict=True):
                if not last or last[0] != i:
                    shared, repeat, last = {}, -1, (i, None)
                if kind == 0:  # the keepers of a page's payloads come before the page
                    shared[digest] = keeper
                    continue
                if out is None:
                    temporary = f"{root}/_{context.taskAttemptId()}-{number}"
                    name = f"{root}/part-{context.partitionId():06d}-{number:04d}.warc.zst"
                    out = store.open_output_stream(temporary)
                repeat += 1
                again = digest in shared and last == (i, digest)  # a repeated row
                if not again:
                    same = repeat
                of = None
                if digest in shared and i != shared[digest]:
                    of = _name(shared[digest])
                elif again:
                    of = _name(i, same)
                last = (i, digest)
                raw = record(i, target, page.encode("utf-8", "surrogatepass"), repeat, of)
                places.append((_name(i, repeat), len(frame), len(raw)))
                frame += raw
                if len(frame) >= FRAME:
                    close_frame()
                    if sum(s for s, _ in sizes) >= BUNDLE:
                        yield close()
        if out is not None:
            yield close()

    return map_batches(dealt, save, INDEX)


def read(bundles: DataFrame, root: str) -> DataFrame:
    """All records of the bundles named in ``bundles.bundle``, each payload held against its digest."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for (name,) in zip(*column_arrays(batch, "bundle"), strict=True):
                with store.open_input_file(name) as f:
                    for place in frames(f):
                        yield from_frame(read_frame(f, place))

    def from_frame(plain: bytes) -> pa.RecordBatch:
        rows = []
        for _, _, headers, block in parse(plain):
            http, payload = block.split(b"\r\n\r\n", 1)
            size = int(http.rsplit(b"Content-Length: ", 1)[1])
            digest, name, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Record-ID"].strip("<>"), headers["WARC-Type"]
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{name} is damaged")
            rows.append((_page(name), size, digest, kind, _page(headers["WARC-Refers-To"]) if kind == "revisit" else None, name))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return map_batches(bundles, load, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages to bundles in the shared folder, then read all records back from the bundles."""
    path = new_path(pages.sparkSession, "warc")
    index = materialize(write(pages, path), "warc-index")
    bundles = index.select("bundle").distinct()
    return read(bundles.repartition(F.col("bundle")), path)
