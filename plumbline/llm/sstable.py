"""Token shards as sorted-string tables.

Shard file: data blocks, block index, Bloom filter, footer.
  block   zstd frame of entries in key order; an entry is
          varint shared key bytes, varint own key bytes, varint value bytes, own key, value
  key     one null flag byte (0: null id), the id as big-endian with the sign bit flipped,
          four bytes that number rows of an equal id
  value   little-endian int64 start (ids of the shard before this document), token ids as
          little-endian uint32, or uint16 where the footer says so
  index   JSON list of [first key (hex), offset, bytes] for each block (sparse)
  Bloom   bit array over ids, ten bits for each, seven probes
  footer  JSON, its length as uint32, magic
A lookup asks the Bloom filter, bisects the index and decodes a single block.

Documents are range-partitioned by (id, text hash), so equal ids may spread over
neighbouring shards; each task streams one shard, writes it under a name of its own
attempt and moves it into place, which makes retries harmless.  Only the manifest (one
row per shard) reaches the driver.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import fresh_path, inline_rows, partitions, text_batches

MAGIC = b"PLSST001"
BITS, PROBES = 10, 7
#: Characters of text that go to the library in one call; the texts of a call are never cut.
CALL = 1 << 20

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a JSON file, without truncation and padding; one for each worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def encoded(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Token ids of whole texts by the tokenizers library, as little-endian uint32 bytes; null is empty."""
    run, call, size = tokenizer(path), [], 0
    for i, text in enumerate(texts):
        call.append(text or "")
        size += len(call[-1])
        if size >= CALL or i == len(texts) - 1:
            for one in run.encode_batch_fast(call, add_special_tokens=False):
                yield np.array(array("I", one.ids), "<u4").tobytes()  # a third of the time that numpy takes for a list
            call, size = [], 0


def id_width(path: str, end_id: int) -> int:
    """Bytes that hold every id of the vocabulary and ``end_id``."""
    run = tokenizer(path)
    largest = max([end_id, *run.get_vocab(with_added_tokens=True).values()])
    if not 0 <= end_id <= largest < 1 << 32:
        raise ValueError(f"ids up to {largest} and end id {end_id} do not fit four bytes")
    return 2 if largest < 1 << 16 else 4


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_key(doc_id: int | None, nth: int = 0) -> bytes:
    if doc_id is None:
        return b"\0" + bytes(8) + struct.pack(">I", nth)
    return b"\1" + struct.pack(">QI", (doc_id + (1 << 63)) & (1 << 64) - 1, nth)


def unpack_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _probes(id_key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(id_key)
    a, b = h & (1 << 64) - 1, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _narrow(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >= 1 << 16:
        raise ValueError(f"token id {wide.max()} does not fit two bytes")
    return wide.astype("<u2").tobytes()


class ShardWriter:
    """Streams entries in key order to a file; memory holds one block and the id hashes."""

    def __init__(self, stream, width: int, block_bytes: int = 1 << 16):
        self.out, self.width, self.block_bytes = stream, width, block_bytes
        self.index: list[list] = []
        self.block, self.first, self.last = bytearray(), b"", b""
        self.first_id = self.last_id = None
        self.nulls = 0
        self.at = self.tokens = self.docs = self.nth = 0
        self.ids: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=1)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian uint32 token ids."""
        key = pack_key(doc_id)
        if doc_id is None:
            self.nulls += 1
        else:
            self.first_id = doc_id if self.first_id is None else self.first_id
            self.last_id = doc_id
        if self.last and self.last[:9] == key[:9]:
            self.nth += 1
            key = pack_key(doc_id, self.nth)
        else:
            self.nth = 0
            self.ids.append(key[:9])
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        body = ids if self.width == 4 else _narrow(ids)
        value = struct.pack("<q", self.tokens) + body
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.tokens += len(ids) // 4
        self.docs += 1
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append([self.first.hex(), self.at, len(data)])
            self._write(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.ids) * BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        if self.ids:
            spots = np.array([p for k in self.ids for p in _probes(k, bits)], np.int64)
            np.bitwise_or.at(bloom, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
        parts = {}
        for name, data in (("index", json.dumps(self.index).encode()), ("bloom", bloom.tobytes())):
            parts[name] = [self.at, len(data)]
            self._write(data)
        foot = json.dumps(parts | {"bits": bits, "width": self.width, "docs": self.docs, "tokens": self.tokens}).encode()
        self._write(foot + struct.pack("<I", len(foot)) + MAGIC)


class ShardReader:
    """Random and sequential access to one shard file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        n = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self._at(size - 12 - n, n))
        self.index = json.loads(self._at(*self.foot["index"]))
        self.firsts = [bytes.fromhex(x[0]) for x in self.index]
        self.bloom = self._at(*self.foot["bloom"])

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(pack_key(doc_id)[:9], self.foot["bits"]))

    def _entries(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        buf = zstandard.ZstdDecompressor().decompress(self._at(*self.index[k][1:]))
        at, key = 0, b""
        kind = "<u4" if self.foot["width"] == 4 else "<u2"
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            own, at = _read_varint(buf, at)
            size, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + own]
            at += own
            start = struct.unpack_from("<q", buf, at)[0]
            yield key, start, np.frombuffer(buf, kind, (size - 8) // (4 if kind == "<u4" else 2), at + 8)
            at += size

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of each row with this id (none: an empty list)."""
        if not self.index or not self.may_hold(doc_id):
            return []
        low, found = pack_key(doc_id), []
        for k in range(max(0, bisect.bisect_right(self.firsts, low) - 1), len(self.index)):
            if self.firsts[k][:9] > low[:9]:
                break
            found += [ids for key, _, ids in self._entries(k) if key[:9] == low[:9]]
        return found

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k in range(len(self.index)):
            for key, start, ids in self._entries(k):
                yield unpack_key(key), start, ids


MANIFEST = "shard int, path string, docs long, tokens long, nulls long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> list[dict]:
    """Encode ``docs`` and write them as shards in ascending id order; returns the manifest.

    ``width``: bytes for each token id, 2 or 4; by default the fewest that hold the whole
    vocabulary and ``end_id``, and fewer than those are refused.  Null texts are empty and
    hold only ``end_id``; null ids sort first; rows that repeat an id are entries of their own.
    """
    spark = docs.sparkSession
    need = id_width(tokenizer_path, end_id)
    width = need if width is None else width
    if width not in (2, 4) or width < need:
        raise ValueError(f"{width} bytes do not hold the ids of this vocabulary, {need} do")
    out = out or fresh_path(spark, "sstable")
    fs, path = open_fs(out)
    fs.create_dir(path, recursive=True)
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out)
        shard = TaskContext.get().partitionId()
        name = f"{folder}/part-{shard:06d}.sst"
        attempt = f"{folder}/.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(attempt) as stream:
            writer = ShardWriter(stream, width)
            for part, texts in text_batches(batches, "text"):
                for key, ids in zip(part.column(0).to_pylist(), encoded(tokenizer_path, texts)):
                    writer.add(key, ids + tail)
            writer.close()
        fs.move(attempt, name)
        row = [shard, name if out.startswith("/") else f"{out}/part-{shard:06d}.sst", writer.docs, writer.tokens, writer.nulls, writer.first_id, writer.last_id]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["shard", "path", "docs", "tokens", "nulls", "first_id", "last_id"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = [r.asDict() for r in ordered.mapInArrow(write, MANIFEST).collect()]
    return sorted(manifest, key=lambda r: r["shard"])


def read_shards(spark, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """Rows of the shard files: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 and, if asked for, ids.  One task reads one shard, block by block."""
    base, rows = 0, []
    for r in manifest:
        rows.append({"shard": r["shard"], "path": r["path"], "base": base})
        base += r["tokens"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got: list[tuple] = []
                for doc_id, start, ids in ShardReader(path).scan():
                    wide = ids.astype("<u4")
                    got.append((doc_id, base + start, len(wide), zlib.crc32(wide.tobytes()), *[wide.astype(np.int32)] * with_ids))
                    if len(got) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=names)
                        got = []
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=names)

    table = inline_rows(spark, rows, "shard int, path string, base long").repartition(max(1, len(rows)), "shard")
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def lookup(manifest: list[dict], doc_id: int | None) -> list[list[int]]:
    """Token ids of each row with this id (null is an id too), without a scan.

    The shards that may hold it are found by bisection of their last ids, then each by its
    Bloom filter and block index.
    """
    if doc_id is None:
        held = [r for r in manifest if r["nulls"]]
    else:
        ranged = [r for r in manifest if r["last_id"] is not None]
        held = ranged[bisect.bisect_left([r["last_id"] for r in ranged], doc_id) :]
    out = []
    for r in held:
        if doc_id is not None and r["first_id"] > doc_id:
            break
        out += [ids.tolist() for ids in ShardReader(r["path"]).get(doc_id)]
    return out
