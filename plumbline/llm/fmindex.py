"""Substring deduplication with a compressed FM-index per shard.

A window is ``width`` consecutive words of one document; a word goes when some window
that covers it also starts anywhere else.

Routing.  Each window names a fingerprint: its least (leftmost on ties) ``gram``-word hash.  Equal
windows name equal fingerprints, and the windows of one fingerprint occurrence are a
run, so a document falls into segments (a run's words) without sharing a window.  Only
segments of fingerprints that occur twice or more leave their document.  They go to the
shard of their fingerprint, where all their possible partners are: no shard reads
another's text.  A fingerprint of more than ``hot`` different segments (a phrase in many contexts) would be
too much for a shard; its windows are routed one by one by a hash of all their words, so
that a shard gets one segment, however often it stands.  A segment's words leave a task at
most twice; its places stay behind and meet the answer in a join.

Shard.  ``FMIndex`` keeps the distinct segments of a block (one that stands at two
places is entered twice) as the wavelet matrix of their Burrows-Wheeler transform in
bit vectors with sampled ranks.  Segments stream through it by backward search, many at
a time: from an end the match grows leftwards while it occurs twice, its length is the
matching statistic there, and lengths of ``width`` or more are reported as intervals.

Exact copies of whole texts are settled by digest first (all their windows repeat) and
one of them stands for all in the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import mix64, partitions, powers, staged, text_batches, unstage, word_spans


def _rolled(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` words."""
    n = len(words) - length + 1
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix64(h)


def winners(words: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its fingerprint's word position, and the hash of every gram."""
    h = _rolled(words, gram)
    views = np.lib.stride_tricks.sliding_window_view(h, width - gram + 1)
    return views.argmin(axis=1) + np.arange(len(views)), h


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of windows with one fingerprint occurrence."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return first, np.append(first[1:], len(at)) - 1


def _contents(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words of each span."""
    up, down = powers(len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return mix64((total[end] - total[first]) * down[first])


def _fingerprints(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            n, sha, prints, contents, times = [], [], [], [], []
            for text in texts:
                raw = (text or "").encode("utf-8")
                words = word_spans(raw)[2]
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                if len(words) < width:
                    prints.append([])
                    contents.append([])
                    times.append([])
                    continue
                at, h = winners(words, width, gram)
                first, last = _runs(at)
                content, where, count = np.unique(_contents(words, first, last + width), return_index=True, return_counts=True)
                prints.append(h[at[first[where]]].view(np.int64))
                contents.append(content.view(np.int64))
                times.append(count.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(prints, pa.list_(pa.int64())), pa.array(contents, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "digest", "n_words", "kept_all", "prints", "contents", "times"],
            )

    return run


def _windows(width: int, gram: int):
    """Hashes of the windows that name a hot fingerprint: (digest, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            out = []
            for text, hot in zip(texts, part.column("hot").to_pylist()):
                words = word_spans(text.encode("utf-8"))[2]
                at, h = winners(words, width, gram)
                out.append(_rolled(words, width)[np.isin(h[at], _prints(hot))].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(out, pa.list_(pa.int64()))], names=["digest", "windows"])

    return run


def _prints(chosen: list[int] | None) -> np.ndarray:
    return np.array(chosen or [], np.int64).view(np.uint64)


def _segments(width: int, gram: int):
    """Segments of the chosen fingerprints: (print, sid, seg, digest, at: word positions).

    ``sid`` names a segment by its content; ``seg`` is null from a task's third place on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for part, texts in text_batches(batches, "text"):
            rows: list[tuple] = []
            columns = (part.column(k).to_pylist() for k in ("digest", "hits", "hot", "windows"))
            for text, digest, chosen, hot, shared in zip(texts, *columns):
                raw = text.encode("utf-8")
                starts, ends, words = word_spans(raw)
                at, h = winners(words, width, gram)
                runs, last = _runs(at)
                keep = np.isin(h[at[runs]], np.setdiff1d(_prints(chosen), _prints(hot)))
                parts = [(h[at[runs[keep]]], runs[keep], last[keep])]
                if shared:
                    whole = _rolled(words, width)
                    one = np.flatnonzero(np.isin(h[at], _prints(hot)) & np.isin(whole, _prints(shared)))
                    parts.append((mix64(whole[one]), one, one))
                prints, low, high = (np.concatenate(x) for x in zip(*parts))
                found: dict[bytes, tuple[int, bytes, list[int]]] = {}
                for p, lo, hi in zip(prints.view(np.int64).tolist(), low.tolist(), high.tolist()):
                    seg = b" ".join(raw[starts[lo] : ends[hi + width - 1]].split())
                    found.setdefault(xxhash.xxh3_128_digest(seg), (p, seg, []))[2].append(lo)
                for sid, (p, seg, spots) in found.items():
                    before = sent.get(sid, 0)
                    sent[sid] = min(2, before + len(spots))
                    rows.append((p, sid, seg if before < 2 else None, digest, spots))
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["print", "sid", "seg", "digest", "at"])

    return run


class BitRank:
    """A bit vector with ranks sampled at every 64 bits."""

    __slots__ = ("before", "words")

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def ones(self, upto: np.ndarray) -> np.ndarray:
        at = upto >> 6
        low = self.words[at] & ((np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at].astype(np.int64) + np.bitwise_count(low)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; every separator must be a symbol of its own."""
    rank = text.astype(np.int64)
    n, step = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Counts of symbol strings in a list of segments; symbols are 1..sigma."""

    def __init__(self, segments: list[np.ndarray], sigma: int):
        m = len(segments)
        sized = np.array([len(s) for s in segments], np.int64)
        text = np.zeros(int(sized.sum()) + m, np.int64)
        seps = np.cumsum(sized + 1) - 1
        text[np.setdiff1d(np.arange(len(text)), seps, assume_unique=True)] = np.concatenate(segments) + (m - 1)
        text[seps] = np.arange(m)
        order = suffix_array(text)
        plain = np.maximum(text - (m - 1), 0)
        plain[seps] = 0
        bwt = plain[order - 1]
        self.sigma, self.size = sigma, len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=sigma + 1))])
        self.levels: list[tuple[BitRank, int]] = []
        self.shifts = list(range(max(1, int(sigma).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = (bwt >> shift & 1).astype(np.uint8)
            self.levels.append((BitRank(bits), int(len(bits) - bits.sum())))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])
        self.base = self.first[:-1] - self._walk(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, (bits, zeros) in zip(self.shifts, self.levels):
            ones = bits.ones(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after each match is grown by a symbol on its left."""
        both = self._walk(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.base[symbols]
        n = len(symbols)
        return base + both[:n], base + both[n:]

    def repeats(self, segments: list[np.ndarray], width: int) -> list[list[tuple[int, int]]]:
        """For each segment the maximal intervals of ``width`` or more words that occur twice."""
        sized = np.array([len(s) for s in segments], np.int64)
        flat, at = np.concatenate(segments), np.concatenate([[0], np.cumsum(sized)[:-1]])
        out: list[list[tuple[int, int]]] = [[] for _ in segments]
        end, left = sized.copy(), sized.copy()
        low, high = np.zeros(len(sized), np.int64), np.full(len(sized), self.size, np.int64)
        live = np.flatnonzero(sized >= width)
        while len(live):
            symbol = flat[at[live] + left[live] - 1]
            a, b = self.step(symbol, low[live], high[live])
            grows = b - a >= 2
            low[live], high[live] = a, b
            left[live] -= grows
            stop = ~grows | (left[live] == 0)
            ended = live[stop]
            if len(ended):
                long = end[ended] - left[ended] >= width
                for s in ended[long].tolist():
                    out[s].append((int(left[s]), int(end[s])))
                block = left[ended] - 1
                end[ended] = np.where(long, np.minimum(end[ended] - 1, block + width), end[ended] - 1)
                end[ended[left[ended] == 0]] = 0
                left[ended], low[ended], high[ended] = end[ended], 0, self.size
                live = live[end[live] >= width]
        return out


def _search(width: int, block_words: int):
    """Per block of whole fingerprints: index, stream, report (sid, spans: lo and hi in words).

    A block ends once it holds ``block_words``; no fingerprint brings more than ``hot`` segments of
    less than two windows.
    """

    def answers(block: dict[bytes, list]) -> pa.RecordBatch | None:
        ids: dict[bytes, int] = {}
        coded = [np.array([ids.setdefault(w, len(ids) + 1) for w in seg.split()], np.int64) for seg, _ in block.values()]
        entries = [c for c, (_, n) in zip(coded, block.values()) for _ in range(min(n, 2))]
        spans = FMIndex(entries, len(ids)).repeats(coded, width)
        got = [(sid, [{"lo": lo, "hi": hi} for lo, hi in found]) for sid, found in zip(block, spans) if found]
        kinds = [pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], names=["sid", "spans"]) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[bytes, list] = {}
        now, size = None, 0
        for batch in batches:
            for p, sid, seg, n in zip(*(c.to_pylist() for c in batch.columns)):
                if p != now:
                    if size > block_words:
                        if got := answers(block):
                            yield got
                        block, size = {}, 0
                    now = p
                entry = block.get(sid)
                if entry is None:
                    entry = block[sid] = [seg, 0]
                    size += seg.count(b" ") + 1
                entry[1] += n
        if block and (got := answers(block)):
            yield got

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept words of a text after its spans (sorted or not) are removed."""
    for part, texts in text_batches(batches, "text"):
        removed, kept = [], []
        for text, spans in zip(texts, part.column("spans").to_pylist()):
            words = np.array(text.encode("utf-8").split(), object)
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                gone[s["lo"]] += 1
                gone[s["hi"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words[~gone].tolist()).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["digest", "n_removed", "kept"])


def intervals(docs: DataFrame, width: int, gram: int, block_words: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row facts; per distinct text its copies; and the repeated intervals of the
    texts that stand once, with those texts."""
    n_parts = partitions(docs.sparkSession)
    texts = docs.select("doc_id", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    rows = staged(texts.mapInArrow(_fingerprints(width, gram), "doc_id long, digest binary, n_words long, kept_all string, prints array<long>, contents array<long>, times array<int>"), "prints")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Rows that repeat an id and its text stand in here twice; both carry the same facts.
    reps = staged(rows.where(F.size("prints") > 0).join(copies, "digest").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "digest", F.arrays_zip("prints", "contents", "times").alias("prints")).dropDuplicates(["digest"]), "reps")
    prints = reps.select("doc_id", "digest", F.explode("prints").alias("p")).select("doc_id", "digest", F.col("p.prints").alias("print"), F.col("p.contents").alias("content"), F.col("p.times").alias("times"))
    different = prints.groupBy("print", "content").agg(F.sum("times").alias("c"))
    # Written, so that the joins below read plain exchanges, which adaptive execution can split.
    again = staged(different.groupBy("print").agg(F.sum("c").alias("c"), F.count("*").alias("different")).where(F.col("c") > 1).select("print", "different"), "again")
    hits = prints.drop("content", "times").join(again, "print").groupBy("doc_id", "digest").agg(F.collect_set("print").alias("hits"), F.collect_set(F.when(F.col("different") > hot, F.col("print"))).alias("hot"))
    on = texts["doc_id"].eqNullSafe(hits["doc_id"]) & (texts["digest"] == hits["digest"])
    chosen = texts.join(hits.hint("merge"), on).select(texts["digest"], "text", "hits", "hot")
    candidates = staged(chosen.dropDuplicates(["digest"]), "candidates", compression="zstd")
    for done in (reps, again):
        unstage(done)

    windows = staged(candidates.where(F.size("hot") > 0).mapInArrow(_windows(width, gram), "digest binary, windows array<long>"), "windows")
    each = windows.select("digest", F.explode("windows").alias("window"))
    twice = staged(each.groupBy("window").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("window"), "twice")
    shared = each.join(twice, "window").groupBy("digest").agg(F.collect_set("window").alias("windows"))

    segments = staged(candidates.join(shared, "digest", "left").mapInArrow(_segments(width, gram), "print long, sid binary, seg binary, digest binary, at array<int>"), "segments")
    for done in (windows, twice):
        unstage(done)
    sent = segments.where("seg is not null").select("print", "sid", "seg", F.size("at").alias("n"))
    found = sent.repartition(n_parts, "print").sortWithinPartitions("print").mapInArrow(_search(width, block_words), "sid binary, spans array<struct<lo:int,hi:int>>")
    places = segments.select("sid", "digest", "at").join(staged(found, "found"), "sid").select("digest", F.explode("at").alias("start"), "spans")
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi")))
    spans = places.groupBy("digest").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return rows, copies, candidates.join(spans, "digest").select("digest", "text", "spans")


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 8, block_words: int = 400_000, hot: int = 4000, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept (null where nothing went).

    Null texts have no words; texts shorter than a window keep all; of texts that stand
    more than once every window repeats.  Rows that repeat an id are rows of their own.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, copies, spans = intervals(plain, width, gram, block_words, hot)
    cut = spans.mapInArrow(_cut, "digest binary, n_removed long, kept string")
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256))
    if not keep_text:
        cut = cut.drop("kept")
    several = (F.col("copies") > 1) & (F.col("n_words") >= width)
    out = rows.select("doc_id", "digest", "n_words", "kept_all").join(copies.drop("rep"), "digest").join(cut, "digest", "left")
    kept = [F.when(several, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []
    return out.select(
        "doc_id",
        "n_words",
        F.when(several, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(several, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "kept_all")).alias("kept_sha256"),
        *kept,
    )
