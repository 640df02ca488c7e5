"""Binary formats that columns can't express, as Arrow-batched functions: chunk boundaries, log records, pack indexes, access lists, compression, signatures."""

from __future__ import annotations

import gzip
import hashlib
import hmac
import struct
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake import schemas

ColumnOrName = Column | str

#: Content-defined chunking: our own constants. A cut is where the low bits of the rolling hash are 0.
CDC_WINDOW, CDC_BITS, CDC_LEAST, CDC_MOST = 48, 10, 256, 8192
_MUL = 0x9E3779B97F4A7C15 | 1


def _mapped(one, kind: str):
    """A column function of a function of one value, run on Arrow batches; null gives null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else one(v) for v in values], dtype=object)

    return F.pandas_udf(run, kind)


def cut_points(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of content-defined chunks: a polynomial hash over the last CDC_WINDOW bytes, between CDC_LEAST and CDC_MOST bytes apart."""
    n = len(data)
    if not n:
        return []
    cuts = np.zeros(0, np.int64)
    if n > CDC_WINDOW:
        x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            h = np.zeros(n - CDC_WINDOW + 1, np.uint64)
            for k in range(CDC_WINDOW):
                h = h * np.uint64(_MUL) + x[k : k + len(h)]
            h ^= h >> np.uint64(32)
        cuts = np.flatnonzero((h & np.uint64((1 << CDC_BITS) - 1)) == 0) + CDC_WINDOW
    out, at, i = [], 0, 0
    while at < n:
        i = int(np.searchsorted(cuts, at + CDC_LEAST))
        end = int(cuts[i]) if i < len(cuts) else n
        end = min(end, at + CDC_MOST, n)
        out.append((at, end - at))
        at = end
    return out


def content_chunks(objects: DataFrame) -> DataFrame:
    """domain, doc_id, ref, seq, chunk_hash and size as fixed_chunks() gives them, cut by content."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in ("domain", "doc_id", "ref", "seq", "chunk_hash", "size")}
            for domain, doc, ref, data in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                for seq, (at, n) in enumerate(cut_points(data or b"")):
                    for c, v in zip(out, (domain, doc, ref, seq, hashlib.sha256(data[at : at + n]).hexdigest(), n), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("domain", pa.string()), ("doc_id", pa.int64()), ("ref", pa.string()), ("seq", pa.int64()), ("chunk_hash", pa.string()), ("size", pa.int64())]))

    return objects.select("domain", "doc_id", "ref", F.col("data").cast("binary")).mapInArrow(go, schemas.CHUNKS)


def encode_log(records: list[tuple]) -> bytes:
    """Framed records: length and CRC-32 as big-endian 32-bit numbers, then 45 bytes."""
    return b"".join(struct.pack(">II", len(body), zlib.crc32(body)) + body for body in (struct.pack(schemas.LOG_LAYOUT, *r) for r in records))


def decode_log(data: bytes) -> list[tuple]:
    """Records up to the first bad frame: a torn tail is dropped, and nothing after it is trusted."""
    out, at = [], 0
    while at + 8 <= len(data):
        size, crc = struct.unpack_from(">II", data, at)
        body = data[at + 8 : at + 8 + size]
        if size != struct.calcsize(schemas.LOG_LAYOUT) or len(body) != size or zlib.crc32(body) != crc:
            break
        out.append(struct.unpack(schemas.LOG_LAYOUT, body))
        at += 8 + size
    return out


def log_records(files: DataFrame) -> DataFrame:
    """Records of log segments (path, content) with their segment, ordered by (segment, seq) when sorted so."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in decode_log(c or b"")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["segment", "seq", "op", "inode", "indx", "off", "slice_id", "size", "slice_off", "slice_len"])

    return files.select("path", "content").mapInArrow(go, "segment string, " + schemas.WAL_RECORD)


def pack_index(data: Column) -> Column:
    """Entries of a pack's chunk index: off, len, stored_off, stored_len, codec; null where the size isn't a whole number of entries."""

    def one(b: bytes | None):
        if b is None or len(b) % struct.calcsize(schemas.ENTRY_LAYOUT):
            return None
        return [dict(zip(("off", "len", "stored_off", "stored_len", "codec"), e, strict=True)) for e in struct.iter_unpack(schemas.ENTRY_LAYOUT, b)]

    return _mapped(one, schemas.PACK_INDEX)(data)


def encode_pack_index(entries: list[tuple]) -> bytes:
    return b"".join(struct.pack(schemas.ENTRY_LAYOUT, *e) for e in entries)


def access_list(data: Column) -> Column:
    """Entries of a POSIX access list: version 2 as a little-endian 32-bit number, then (tag, perm, id); null for any other form."""

    def one(b: bytes | None):
        if b is None or len(b) < 4 or (len(b) - 4) % 8 or struct.unpack_from("<I", b)[0] != 2:
            return None
        return [{"tag": t, "perm": p, "id": i} for t, p, i in struct.iter_unpack("<HHI", b[4:])]

    return _mapped(one, schemas.ACL)(data)


def encode_access_list(entries: list[tuple]) -> bytes:
    return struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in entries)


def masked_access(acl, mode):
    """The entries of a default list as a new file gets them: owner and others are cut down to the mode's bits, and so is the mask, or the group where there is none."""
    bits = lambda n: F.shiftright(mode, n).bitwiseAND(F.lit(7))
    has_mask = F.exists(acl, lambda e: e["tag"] == 16)
    cut = lambda e: F.when(e["tag"] == 1, bits(6)).when((e["tag"] == 16) | ((e["tag"] == 4) & ~has_mask), bits(3)).when(e["tag"] == 32, bits(0)).otherwise(F.lit(7))
    return F.transform(acl, lambda e: F.struct(e["tag"].alias("tag"), e["perm"].bitwiseAND(cut(e)).alias("perm"), e["id"].alias("id")))


def _shrunk(raw: bytes, codec: int) -> tuple[bytes, int]:
    """raw under codec 1 (zstd) or 2 (gzip) and that codec, or raw itself and 0 where that isn't smaller."""
    body = zstandard.compress(raw) if codec == 1 else gzip.compress(raw, mtime=0) if codec == 2 else raw
    return (body, codec) if len(body) < len(raw) else (raw, 0)


def _grown(body: bytes, codec: int) -> bytes | None:
    return body if codec == 0 else zstandard.decompress(body) if codec == 1 else gzip.decompress(body) if codec == 2 else None


def framed(raw: bytes, codec: int) -> bytes:
    """A pack with its frame: magic, codec byte, body. A body that doesn't get smaller is stored raw."""
    body, codec = _shrunk(raw, codec)
    return schemas.PACK_MAGIC + bytes([codec]) + body


def framed_by_chunk(chunks: list[bytes], codec: int) -> bytes:
    """A pack whose chunks are compressed one by one, so that each can be read alone: magic, 3, the codec, the length of the index as a 32-bit number, an entry a chunk, the bodies. Without compression it is framed() of all."""
    if codec == 0:
        return framed(b"".join(chunks), 0)
    index, bodies, at, stored = [], [], 0, 0
    for raw in chunks:
        body, own = _shrunk(raw, codec)
        index.append((at, len(raw), stored, len(body), own))
        bodies.append(body)
        at, stored = at + len(raw), stored + len(body)
    packed = encode_pack_index(index)
    return schemas.PACK_MAGIC + bytes([3, codec]) + struct.pack(">I", len(packed)) + packed + b"".join(bodies)


def _by_chunk(data: bytes) -> bytes | None:
    """The content of a pack of framed_by_chunk; null where its index isn't whole, doesn't tile the content, or names bytes that aren't there."""
    size = struct.unpack_from(">I", data, 6)[0] if len(data) >= 10 else -1
    if size < 0 or size % struct.calcsize(schemas.ENTRY_LAYOUT) or len(data) < 10 + size:
        return None
    bodies, out, at = data[10 + size :], [], 0
    for off, n, stored, m, codec in struct.iter_unpack(schemas.ENTRY_LAYOUT, data[10 : 10 + size]):
        raw = _grown(bodies[stored : stored + m], codec) if off == at and stored + m <= len(bodies) else None
        if raw is None or len(raw) != n:
            return None
        out.append(raw)
        at += n
    return b"".join(out)


def unframed(data: bytes) -> bytes | None:
    """The content of a pack, compressed as a whole or chunk by chunk; without a frame it is the pack itself; null for an unknown codec or a body that can't be read."""
    if data[:4] != schemas.PACK_MAGIC or len(data) < 5:
        return data
    try:
        return _by_chunk(data) if data[4] == 3 else _grown(data[5:], data[4])
    except (zstandard.ZstdError, OSError, EOFError, zlib.error):
        return None


def compress_pack(raw: ColumnOrName, codec: ColumnOrName) -> Column:
    def run(raw: pd.Series, codec: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else framed(r, int(c)) for r, c in zip(raw, codec, strict=True)])

    return F.pandas_udf(run, "binary")(raw, codec)


def compress_pack_by_chunk(chunks: ColumnOrName, codec: ColumnOrName) -> Column:
    """Packs of arrays of chunks, each chunk compressed alone."""

    def run(chunks: pd.Series, codec: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else framed_by_chunk([bytes(x) for x in c], int(n)) for c, n in zip(chunks, codec, strict=True)])

    return F.pandas_udf(run, "binary")(chunks, codec)


def decompress_pack(data: ColumnOrName) -> Column:
    return _mapped(unframed, "binary")(data)


def signing_key(secret: str, date: str, region: str, service: str) -> bytes:
    key = b"AWS4" + secret.encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def canonical_request(method: str, path: str, query: dict[str, str], headers: dict[str, str], payload_hash: str) -> str:
    """The text that a request's signature covers: method, encoded path, query by encoded name and value, headers in lower case by name with runs of blanks as one, their names, and the payload's hash, a line each."""
    quote = lambda t, safe="": urllib.parse.quote(t, safe=f"-_.~{safe}")
    pairs = sorted((quote(k), quote(v)) for k, v in query.items())
    own = sorted((k.lower(), " ".join(v.split())) for k, v in headers.items())
    return "\n".join([method, quote(path or "/", "/"), "&".join(f"{k}={v}" for k, v in pairs), "".join(f"{k}:{v}\n" for k, v in own), ";".join(k for k, _ in own), payload_hash])


def string_to_sign(request: str, time: str, region: str, service: str) -> str:
    """What signature_of signs for a canonical request at a time (yyyymmddThhmmssZ)."""
    return "\n".join(["AWS4-HMAC-SHA256", time, f"{time[:8]}/{region}/{service}/aws4_request", hashlib.sha256(request.encode()).hexdigest()])


def signature_of(secret: str, date: str, region: str, service: str):
    """A function of string-to-sign columns that gives their hex signatures; the key stays on the workers."""
    key = signing_key(secret, date, region, service)

    return _mapped(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest(), "string")


def file_hashes(parts: DataFrame) -> DataFrame:
    """inode and sha256 of files from their segments (inode, start, end, data; null data: zeros), in order.

    Segments are sorted within their partition and streamed through a running digest: a file of any size takes the memory of one segment.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, at = None, None, 0
        done: list[tuple[int, str]] = []
        for b in batches:
            for ino, lo, hi, data in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if ino != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, at = ino, hashlib.sha256(), 0
                digest.update(bytes(lo - at))
                digest.update(bytes(hi - lo) if data is None else data[: hi - lo].ljust(hi - lo, b"\0"))
                at = hi
        if digest is not None:
            done.append((now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["inode", "sha256"])

    return parts.select("inode", "start", "end", F.col("data").cast("binary")).repartition("inode").sortWithinPartitions("inode", "start").mapInArrow(go, "inode long, sha256 string")
