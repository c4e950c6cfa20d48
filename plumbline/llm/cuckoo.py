"""Exact deduplication through a cuckoo-filter index of live digests.

``CuckooFilter`` holds 16-bit fingerprints in buckets of four slots with partial-key
cuckoo hashing; it supports deletion.  ``CuckooIndex`` pairs it with a bucketed
content store: a filter hit is only a hint and is verified against the full digests
of the bucket; a filter that overflows is rebuilt at twice the size from the stored
keys, so no digest is ever lost.

Distributed form: each input partition folds its rows in an index of its own
(pre-aggregation, so a digest that a third of the rows share leaves a partition as
one entry), entries go by digest to index shards, and shards answer with one verdict
for each digest.  Only 32-byte digests travel; texts never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import partitions, staged

SLOTS, KICKS = 4, 256
ENTRY = "digest binary, keep_id long, keep_uid long, n long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("n", pa.int64())])


class CuckooFilter:
    """Approximate membership with deletion; ``capacity`` is rounded up to 2^k buckets."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, (max(1, capacity * 10 // 9 // SLOTS)).bit_length())
        self.mask = self.buckets - 1
        self.table = np.zeros(self.buckets * SLOTS, np.uint16).tolist()
        self.size = 0
        self._turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        mark = (h >> 48) or 1
        first = h & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        t = self.table
        return mark in t[a * SLOTS : a * SLOTS + SLOTS] or mark in t[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, mark: int, bucket: int) -> bool:
        t = self.table
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not t[at]:
                t[at] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter overflows; the caller must then rebuild it from its keys."""
        mark, a, b = self._places(digest)
        self.size += 1
        if self._put(mark, a) or self._put(mark, b):
            return True
        bucket = b
        for _ in range(KICKS):
            self._turn = (self._turn * 5 + 1) & 0xFFFF
            at = bucket * SLOTS + (self._turn >> 6) % SLOTS
            mark, self.table[at] = self.table[at], mark
            bucket ^= mark * 0x5BD1E995 & self.mask
            if self._put(mark, bucket):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[at] == mark:
                    self.table[at] = 0
                    self.size -= 1
                    return True
        return False


class CuckooIndex:
    """Live digests with their verdict: (keep_id, keep_uid, n)."""

    def __init__(self, capacity: int = 1 << 12):
        self.filter = CuckooFilter(capacity)
        self.content: dict[bytes, list[list]] = {}
        self.live = 0
        self.resizes = 0

    def find(self, digest: bytes) -> list | None:
        """A filter hit, verified against the bucket's full digests."""
        if digest not in self.filter:
            return None
        for entry in self.content.get(digest[:6], ()):
            if entry[0] == digest:
                return entry
        return None

    def add(self, digest: bytes, keep_id: int | None, keep_uid: int, n: int = 1) -> None:
        entry = self.find(digest)
        if entry is None:
            self.content.setdefault(digest[:6], []).append([digest, keep_id, keep_uid, n])
            self.live += 1
            if not self.filter.insert(digest):
                self._resize()
            return
        entry[3] += n
        if _later((keep_id, keep_uid), (entry[1], entry[2])):
            entry[1], entry[2] = keep_id, keep_uid

    def remove(self, digest: bytes, n: int = 1) -> bool:
        """Take ``n`` rows of a digest away; the last one deletes it from filter and content."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[3] -= n
        if entry[3] <= 0:
            bucket = self.content[digest[:6]]
            bucket.remove(entry)
            if not bucket:
                del self.content[digest[:6]]
            self.live -= 1
            self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        capacity = max(self.live, self.filter.buckets * SLOTS)
        while True:
            capacity *= 2
            self.resizes += 1
            grown = CuckooFilter(capacity)
            if all(grown.insert(e[0]) for bucket in self.content.values() for e in bucket):
                self.filter = grown
                return

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


def _later(a: tuple, b: tuple) -> bool:
    """Larger doc_id first (null below all), then larger row number."""
    return (a[0] is not None, a[0] or 0, a[1]) > (b[0] is not None, b[0] or 0, b[1])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, keep_id, keep_uid, n in zip(*(c.to_pylist() for c in batch.columns)):
            index.add(digest, keep_id, keep_uid, n)
    rows = []
    for entry in index.entries():
        rows.append(entry)
        if len(rows) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Of equal texts the row with the largest id stays; null
    ids rank below all, and of rows that repeat an id exactly one stays.  Memory of a
    shard grows with its distinct digests (about 0.3 kB each): raise
    ``spark.sql.shuffle.partitions`` to hold it near a million per shard.
    """
    rows = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )
    local = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("n"))
    shards = local.mapInArrow(_fold, ENTRY).repartition(partitions(docs.sparkSession), "digest").mapInArrow(_fold, ENTRY)
    return rows.join(shards, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text."""
    keep = verdicts(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), sha.alias("sha"))
    one = marked.join(keep.hint("merge"), F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    return one.dropDuplicates(["id", "sha"]).select("row.*")
