"""Toxicity by compression distance with two zstandard dictionaries.

Training uses a bounded sample of labelled rows (``max_toxic``, ``max_ordinary`` and
``max_bytes``; near copies within the sample count once, since their shared words say
nothing about toxicity).  Two dictionaries are trained by zstandard in the same way, one on
toxic and one on ordinary text: each on the words that its class holds significantly more
often than the other (a log-likelihood ratio of document counts, ``SIGNIFICANT``).  Words that
both classes hold alike would only add noise to the comparison; they go into a third
trained dictionary that both compressors share, so a window's length difference is what
the words of one class save against those of the other.

A document is every window of its text, compressed with both dictionaries; the
differences' maximum, mean and frequencies go through a logistic calibration fitted on sampled
rows that did not train the dictionaries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.logit import Logit
from plumbline.llm.shared import inline_rows, text_batches

#: Chances below one in a hundred thousand a word, so that few words of a vocabulary pass by luck.
SIGNIFICANT = 20.0

def windows(text: str | None, size: int) -> list[bytes]:
    """All words of the text in runs of ``size`` bytes or a little more, blanks made single."""
    out, run, n = [], [], 0
    for word in (text or "").encode("utf-8").lower().split():
        run.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(run) + b" ")
            run, n = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def _distinct(texts: list[str]) -> list[str]:
    """Drops texts that share a pair of minwise words with an earlier one."""
    seen: set[tuple] = set()
    out = []
    for text in texts:
        words = set(text.encode("utf-8").lower().split())
        if not words:
            continue
        keys = [(band, *[min(xxhash.xxh3_64_intdigest(w, seed=10 * band + j) for w in words) for j in range(2)]) for band in range(4)]
        if not any(k in seen for k in keys):
            seen.update(keys)
            out.append(text)
    return out


def _document_counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for text in texts:
        out.update(set(text.encode("utf-8").lower().split()))
    return out


def significance(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a in n against b in m; negative where the first share is smaller."""

    def fit(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    if not n or not m:
        return 0.0
    both = (a + b) / (n + m)
    ratio = 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, both) - fit(b, m, both))
    return ratio if a * m > b * n else -ratio


def own_words(texts: list[str], own: Counter, n: int, other: Counter, m: int) -> list[bytes]:
    """Each occurrence of a word that these texts hold significantly more often than the others."""
    keep = {w for w, c in own.items() if significance(c, n, other[w], m) >= SIGNIFICANT}
    return [b" " + w + b" " for t in texts for w in t.encode("utf-8").lower().split() if w in keep]


def trained(size: int, samples: list[bytes], **options: int) -> bytes:
    """A dictionary that zstandard trains on ``samples``; samples too few to train on are its content."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


@dataclass
class Model:
    """Both dictionaries and the calibration; small enough to travel with the tasks."""

    ordinary: bytes
    toxic: bytes
    window: int
    bias: float
    coef: np.ndarray

    def features(self, text: str | None) -> list[float]:
        if not hasattr(self, "_pair"):
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        plain, tox = self._pair[0].compress, self._pair[1].compress
        d = np.array([len(plain(w)) - len(tox(w)) for w in windows(text, self.window)] or [0], float)
        top = np.sort(d)[::-1]
        return [top[0], top[:3].mean(), d.mean(), (d >= 2).mean(), (d >= 4).mean(), np.log1p(len(d))]

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.dot(self.coef, self.features(text)))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}


#: Segment lengths and sizes of a class's own dictionary that ``fit`` tries.
SEGMENTS, SIZES = (10, 16, 24), (768, 1024, 2048)


def fit(toxic: list[str], ordinary: list[str], toxic_share: float, window: int = 64, shared: int = 16_384) -> Model:
    """Train on samples; a fifth of each class calibrates. ``toxic_share``: of all labelled rows.

    ``shared``: bytes of the common dictionary.  Which segment length and size zstandard is
    given for a class's own dictionary is settled on the calibrating rows, too.
    """
    held = [toxic[::5], ordinary[::5]]
    bad, good = (_distinct([t for i, t in enumerate(x) if i % 5]) for x in (toxic, ordinary))
    samples = [w for t in good for w in windows(t, window)]
    common = trained(shared, samples[:: max(1, len(samples) // 40_000)])
    counts = _document_counts(bad), _document_counts(good)
    own = own_words(good, counts[1], len(good), counts[0], len(bad)), own_words(bad, counts[0], len(bad), counts[1], len(good))
    pad = b"\0" * 8  # the last bytes of a dictionary are not indexed
    y = np.concatenate([np.ones(len(held[0])), np.zeros(len(held[1]))])
    weight = np.where(y == 1, toxic_share / max(1e-9, y.mean()), (1 - toxic_share) / max(1e-9, 1 - y.mean())) if len(y) else y
    best, least = None, math.inf
    for k in SEGMENTS:
        for size in SIZES:
            plain, tox = (common + trained(size, words, k=k, d=6).rjust(size, b"\0") + pad for words in own)
            model = Model(plain, tox, window, 0.0, np.zeros(6))
            if not toxic or not ordinary:
                model.bias = math.log((toxic_share + 1e-6) / (1 - toxic_share + 1e-6))
                return model
            rows = np.array([model.features(t) for texts in held for t in texts])
            fitted = Logit(0.1).fit(rows, y, weight)
            model.bias, model.coef = fitted.plain
            p = np.clip(fitted.prob(rows), 1e-6, 1 - 1e-6)
            loss = -float(np.sum(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))))
            if loss < least:
                best, least = model, loss
    return best


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2500, max_ordinary: int = 5000, max_bytes: int = 48_000_000, window: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``max_toxic`` and ``max_ordinary`` labelled rows, drawn by hash of the id.

    Texts are taken in that order while they fit ``max_bytes`` together, half for each class; a
    longer one is passed over whole.  Of rows that repeat an id one is taken; null ids and
    labels are left out.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts: dict[int, list[str]] = {}
    for y, most in ((1, max_toxic), (0, max_ordinary)):
        ids = marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        own = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"), F.octet_length(text).alias("_n")).join(F.broadcast(ids), "_id")
        sizes = own.groupBy("_id").agg(F.min(F.struct("_n", F.xxhash64("_t").alias("_h"))).alias("_s")).select("_id", "_s.*").collect()
        room, chosen = max_bytes // 2, []
        for r in sorted(sizes, key=lambda r: xxhash.xxh3_64_intdigest(str(r["_id"]))):
            if r["_n"] <= room:
                room -= r["_n"]
                chosen.append((r["_id"], r["_h"]))
        place = {k: i for i, (k, _) in enumerate(chosen)}
        wanted = inline_rows(docs.sparkSession, [{"_id": k, "_h": h} for k, h in chosen], "_id long, _h long")
        got = own.withColumn("_h", F.xxhash64("_t")).join(F.broadcast(wanted), ["_id", "_h"]).select("_id", "_t").dropDuplicates(["_id"]).collect()
        texts[y] = [r["_t"] for r in sorted(got, key=lambda r: place[r["_id"]])]
    return fit(texts[1], texts[0], counts.get(1, 0) / max(1, sum(counts.values())), window)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts are scored as no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
