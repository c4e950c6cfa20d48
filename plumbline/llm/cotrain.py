"""Quality by co-training: a text-content view and a page-metadata view.

The text view reads what a text is made of: shares of kinds of characters and words over the
whole text, and the log-odds of its words, hashed to ``BUCKETS``.  The metadata view reads
the language and the source only; nothing of it follows from the text.  Both start from
labelled rows.  In each round each view scores all unlabelled rows and hands the other those
that it is surest of, of either class, as labels with its calibrated probability, weighted by how
far that is from the prior; a view that knows little hands over labels that weigh next to
nothing.  The calibrated views are then combined by a logistic regression on labelled
rows that trained neither.

Features are written once, about a third of the texts' size, and every round reads them
alone.  Labelled rows are a bounded sample (``max_labelled``); the rows handed over are
``handed`` of each class, view and round, found by a tree of bounded top lists.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.logit import Logit
from plumbline.llm.shared import staged, text_batches

SOURCES, LANGS, BUCKETS = 64, 16, 8192
SHARES = ("letters", "capitals", "digits", "marks", "lines", "bare_marks", "distinct", "log_words", "distinct_by_log", "top_word", "own_lines", "is_empty")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_KIND = np.full(256, 5, np.uint8)  # other marks
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32, *b".,;:'-"]] = 3
_KIND[10] = 4


def shares(text: str, words: list[str]) -> list[float]:
    """The values of ``SHARES``, over the whole text."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    kind = np.bincount(_KIND[raw], minlength=6) / max(1, len(raw))
    n, counts = max(1, len(words)), Counter(words)
    lines = text.split("\n")
    size, distinct = math.log1p(n), len(counts) / n
    top = max(counts.values(), default=0) / n
    return [kind[0] + kind[1], kind[1], kind[2], kind[5], kind[4], len(_BARE.findall(text)) / n, distinct, size, distinct * size, top, len(set(lines)) / len(lines), float(not words)]


def buckets(words: list[str]) -> np.ndarray:
    """Distinct hashed words."""
    return np.unique(np.array([zlib.crc32(w.encode("utf-8")) % BUCKETS for w in set(words)], np.uint16))


def _place(value: str | None, size: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode("utf-8")) % (size - 1)


@dataclass
class Rows:
    """Features of some rows: shares, hashed words (flat, with the row of each), metadata."""

    x: np.ndarray
    codes: np.ndarray
    owner: np.ndarray
    meta: np.ndarray

    @staticmethod
    def of(texts: list[str | None], langs: list, sources: list) -> Rows:
        split = [(t or "").split() for t in texts]
        x = np.array([shares(t or "", w) for t, w in zip(texts, split)], np.float32).reshape(-1, len(SHARES))
        meta = np.array([[_place(a, LANGS), _place(b, SOURCES)] for a, b in zip(langs, sources)], np.uint8).reshape(-1, 2)
        return Rows.joined(x, [buckets(w) for w in split], meta)

    @staticmethod
    def joined(x: np.ndarray, codes: list[np.ndarray], meta: np.ndarray) -> Rows:
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint16)
        return Rows(x, flat, np.repeat(np.arange(len(codes)), [len(c) for c in codes]), meta)

    @staticmethod
    def read(x: list[bytes], codes: list[bytes], meta: list[bytes]) -> Rows:
        return Rows.joined(
            np.frombuffer(b"".join(x), np.float32).reshape(-1, len(SHARES)),
            [np.frombuffer(c, np.uint16) for c in codes],
            np.frombuffer(b"".join(meta), np.uint8).reshape(-1, 2),
        )

    def __len__(self) -> int:
        return len(self.x)

    def pick(self, at: np.ndarray) -> Rows:
        place = np.full(len(self), -1)
        place[at] = np.arange(len(at))
        keep = place[self.owner] >= 0
        order = np.argsort(place[self.owner[keep]], kind="stable")
        return Rows(self.x[at], self.codes[keep][order], place[self.owner[keep]][order], self.meta[at])

    def plus(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate(p) for p in ((self.x, other.x), (self.codes, other.codes), (self.owner, other.owner + len(self)), (self.meta, other.meta))))


class TextView:
    """Shares and word log-odds.  The weights are fitted on all rows, each with the log-odds that
    the other half of the rows gives its words, so that no row vouches for itself."""

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray) -> TextView:
        half = np.arange(len(rows)) % 2
        inputs = np.zeros((len(rows), rows.x.shape[1] + 2))
        for k in (0, 1):
            inputs[half == k] = self._inputs(rows, self._odds(rows, y, weight * (half != k)))[half == k]
        self.bias, self.coef = Logit().fit(inputs, y, weight).plain
        self.odds = self._odds(rows, y, weight)
        return self

    @staticmethod
    def _odds(rows: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        good, bad = (np.bincount(rows.codes, (weight * v)[rows.owner], BUCKETS) for v in (y, 1 - y))
        n_good, n_bad = (float((weight * v).sum()) for v in (y, 1 - y))
        return np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))

    @staticmethod
    def _inputs(rows: Rows, odds: np.ndarray) -> np.ndarray:
        n = np.maximum(1, np.bincount(rows.owner, minlength=len(rows)))
        value = odds[rows.codes]
        mean = np.bincount(rows.owner, value, len(rows)) / n
        worst = np.bincount(rows.owner, np.minimum(value, 0), len(rows)) / n
        return np.column_stack([rows.x, mean, worst])

    def decision(self, rows: Rows) -> np.ndarray:
        return np.clip(self.bias + self._inputs(rows, self.odds) @ self.coef, -8, 8)


class MetaView:
    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray) -> MetaView:
        self.bias, self.coef = Logit().fit(self._inputs(rows), y, weight).plain
        return self

    @staticmethod
    def _inputs(rows: Rows) -> np.ndarray:
        return np.column_stack([np.eye(LANGS)[rows.meta[:, 0]], np.eye(SOURCES)[rows.meta[:, 1]]])

    def decision(self, rows: Rows) -> np.ndarray:
        return np.clip(self.bias + self._inputs(rows) @ self.coef, -8, 8)


def _prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and slope from a view's decisions to probabilities; a view that ranks no better
    than chance gets the prior for every row."""
    bias, slope = Logit(0.1).fit(z[:, None], y).plain
    if slope[0] <= 0:
        return math.log(y.mean() / (1 - y.mean())), np.zeros(1)
    return bias, slope


@dataclass
class Model:
    """Both views with their calibrations, and the weights that combine them; ``prior`` alone where
    labels were too few to learn from.  ``rounds``: labels handed over in each."""

    prior: float
    text: TextView | None = None
    meta: MetaView | None = None
    scales: tuple = ()
    joint: tuple | None = None
    rounds: tuple = ()

    def views(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        if self.text is None:
            return np.full(len(rows), self.prior), np.full(len(rows), self.prior)
        return tuple(_prob(b + c[0] * view.decision(rows)) for view, (b, c) in zip((self.text, self.meta), self.scales))

    def score(self, rows: Rows) -> np.ndarray:
        if self.joint is None:
            return np.full(len(rows), self.prior)
        z = np.column_stack([self.text.decision(rows), self.meta.decision(rows)])
        return _prob(self.joint[0] + z @ self.joint[1])


#: For a model: of each view (text, meta) and class (good, bad) the rows it is surest of.
Surest = Callable[["Model"], dict[tuple[str, str], Rows]]


def fit(rows: Rows, y: np.ndarray, surest: Surest, rounds: int = 3) -> Model:
    """``rows``, ``y``: labelled rows, every fourth of which is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    model = Model(float((np.sum(y) + 1) / (len(y) + 2)))
    if not len(y) or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return model
    kept = rows.pick(np.flatnonzero(held))
    start = rows.pick(np.flatnonzero(~held)), y[~held].astype(float), np.ones(int((~held).sum()))
    taught = {"text": start, "meta": start}
    prior = float(y[held].mean())
    log = []
    for turn in range(rounds + 1):
        views = TextView().fit(*taught["text"]), MetaView().fit(*taught["meta"])
        scales = tuple(_calibrated(v.decision(kept), y[held]) for v in views)
        model = Model(model.prior, *views, scales, None, tuple(log))
        if turn == rounds:
            break
        handed = surest(model)
        moved = {"text_to_meta": 0, "meta_to_text": 0}
        for (giver, _), got in handed.items():
            if not len(got):
                continue
            taker = "meta" if giver == "text" else "text"
            p = model.views(got)[0 if giver == "text" else 1]
            old, labels, weight = taught[taker]
            told = np.where(p > prior, (p - prior) / (1 - prior), (prior - p) / prior)
            taught[taker] = old.plus(got), np.concatenate([labels, p]), np.concatenate([weight, told])
            moved[f"{giver}_to_{taker}"] += len(got)
        log.append(moved)
    z = np.column_stack([v.decision(kept) for v in views])
    model.joint = Logit(0.1).fit(z, y[held]).plain
    return model


FEATURES = "doc_id long, uid long, x binary, codes binary, meta binary"
_NAMES = ["doc_id", "uid", "x", "codes", "meta"]


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and source as the features read them; absent metadata are null."""
    given = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), given("text"), given("lang"), given("source"))


def featured(docs: DataFrame) -> DataFrame:
    """One row of features for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            rows = Rows.of(texts, part.column("lang").to_pylist(), part.column("source").to_pylist())
            ends = np.searchsorted(rows.owner, np.arange(len(rows) + 1))
            codes = [rows.codes[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            cols = [[r.tobytes() for r in rows.x], codes, [r.tobytes() for r in rows.meta]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), *[pa.array(c, pa.binary()) for c in cols]], names=_NAMES)

    return _inputs(docs).withColumn("uid", F.xxhash64("doc_id", "text")).mapInArrow(run, FEATURES)


def _read(part: pa.RecordBatch) -> Rows:
    return Rows.read(*(part.column(c).to_pylist() for c in ("x", "codes", "meta")))


def _top(many: int) -> Callable:
    """Of each ``list`` the ``many`` rows of the highest ``sure``, ties by uid; memory holds twice as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            best = table if best is None else pa.concat_tables([best, table])
            order = best.select(["list", "sure", "uid"]).to_pandas().sort_values(["list", "sure", "uid"], ascending=[True, False, True])
            best = best.take(order.groupby("list").head(many).index.to_numpy())
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, handed: int = 300, rounds: int = 3, label_col: str = "quality") -> tuple[Model, DataFrame]:
    """(model, features of all rows).  Labelled rows are drawn by hash of doc_id; null labels and
    ids are left out, and of rows that repeat an id one is taken.  All other rows are unlabelled."""
    feats = staged(featured(docs), "quality-features")
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    drawn = marked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    chosen = feats.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.max("_y").alias("_y"), F.min(F.struct(*_NAMES[1:])).alias("f"))
    got = sorted(chosen.select("_id", "_y", "f.*").collect(), key=lambda r: zlib.crc32(str(r["_id"]).encode()))
    seen = {r["_id"] for r in got}
    used: set[int] = set()
    tasks = max(1, math.isqrt(feats.rdd.getNumPartitions()))

    def surest(model: Model) -> dict[tuple[str, str], Rows]:
        known, gone = np.array(sorted(seen), np.int64), np.array(sorted(used), np.int64)

        def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                free = ~np.isin(batch.column(0).to_numpy(zero_copy_only=False), known) & ~np.isin(batch.column(1).to_numpy(), gone)
                part = batch.filter(pa.array(free))
                if not part.num_rows:
                    continue
                for view, p in zip(("text", "meta"), model.views(_read(part))):
                    for kind, sure in (("good", p), ("bad", 1 - p)):
                        at = np.argsort(-sure, kind="stable")[:handed]
                        lists = pa.array([f"{view} {kind}"] * len(at))
                        yield pa.RecordBatch.from_arrays([lists, pa.array(sure[at]), *[part.column(c).take(pa.array(at)) for c in _NAMES[1:]]], names=["list", "sure", *_NAMES[1:]])

        schema = "list string, sure double, uid long, x binary, codes binary, meta binary"
        lists = feats.mapInArrow(propose, schema).mapInArrow(_top(handed), schema)
        lists = lists.repartition(tasks).mapInArrow(_top(handed), schema).repartition(1).mapInArrow(_top(handed), schema)
        out: dict[tuple[str, str], list] = {}
        for r in lists.collect():
            out.setdefault(tuple(r["list"].split(" ")), []).append(r)
            used.add(r["uid"])
        return {k: Rows.read([r["x"] for r in v], [r["codes"] for r in v], [r["meta"] for r in v]) for k, v in sorted(out.items())}

    rows = Rows.read([r["x"] for r in got], [r["codes"] for r in got], [r["meta"] for r in got])
    return fit(rows, np.array([r["_y"] for r in got], float), surest, rounds), feats


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score, accepted for every row of ``docs``.

    Null and empty texts have shares of nothing; null or absent languages and sources are a
    value of their own; rows that repeat get equal scores; an empty table gives no rows.
    """
    model, feats = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _read(batch)
            cols = [*model.views(rows), model.score(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols), pa.array(cols[2] >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "accepted"])

    return feats.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, accepted boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that the combined views accept, with their own columns only."""
    model, _ = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            column = lambda c: part.column(part.schema.get_field_index(c)).to_pylist() if c in part.schema.names else [None] * part.num_rows
            text_of = lambda v: None if v is None else str(v)
            rows = Rows.of(texts, list(map(text_of, column("lang"))), list(map(text_of, column("source"))))
            yield part.filter(pa.array(model.score(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
