"""Near-duplicate classes by a chosen-path set similarity join.

1.  Every text becomes its set of word shingles and a signature of ``COORDS`` minwise
    tokens.  Equal sets form one class; classes, not rows, take part from here on.
2.  ``trees`` independent trees branch the classes recursively.  A node chooses minwise
    coordinates by a hash of its path: one always and a second with probability
    1/threshold - 1, so a pair at the threshold keeps one shared child in expectation at
    every level.  A class moves to the child named by its token at a chosen coordinate.
    Branching stops at nodes of at most ``small`` classes; larger nodes branch on.
3.  A small node is compared exhaustively by signatures.  Pairs that may reach the
    threshold join classes into families (spanning edges only, never all pairs).
4.  Families hold every candidate pair, and links are confirmed inside them on full
    sets: a family of bounded work is compared exhaustively in one task; a larger one
    goes through ``ROUNDS`` rounds of hubs (``_hub_round``), each compared with all members
    in parallel, which link most members into one cluster.  Every pair of different
    clusters that may still be linked is then compared once, in blocks (``_crossed``).

Recall at the threshold t: for a pair that agrees on a share p of the coordinates a level
keeps it with about 1 - (1 - pq)(1 - p(1/t - 1)q) where q is the rate of the level below.
Depth follows the logarithm of the number of classes, as recursion to small nodes would.
The number of trees follows from ``miss``, the probability that a pair at exactly the
threshold shares no node at the last level to which crowded nodes branch, averaged over
the binomial agreement of the coordinates, which all trees share.
Nodes, edges and families name a class by eight bytes of its digest; two classes that
share them fall into one family and are told apart there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import mix64, partitions, staged, text_batches, word_spans

COORDS = 64
#: Rounds of hubs for a large family; their number doubles from round to round.
ROUNDS = 3
#: A task of a large family reads about so many members, or so many shingles, and in blocks holds so many shingles.
CHUNK_ROWS, CHUNK_ITEMS, BLOCK_ITEMS = 4000, 2_000_000, 500_000
_rng = np.random.default_rng(20)
_MULT = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; fewer words give one shingle of them all."""
    h = word_spans((text or "").encode("utf-8").lower())[2]
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048, None] * _MULT + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)


def digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text", 1024):
            n, keys, shorts, sigs = [], [], [], []
            for text in texts:
                items = shingles(text, width)
                n.append(len(items))
                keys.append(digest(items))
                shorts.append(int.from_bytes(keys[-1][:8], "little", signed=True))
                sigs.append(signature(items).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(shorts, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n", "key", "k", "sig"])

    return run


def _branch(paths: np.ndarray, rows: np.ndarray, sigs: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of (path, row): one chosen coordinate always, another with probability ``second``."""
    draw = mix64(paths ^ np.uint64(0xA24BAED4963EE407))
    one = (draw % np.uint64(COORDS)).astype(np.int64)
    other = (one + 1 + (mix64(draw) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
    also = mix64(draw + np.uint64(7)) < np.uint64(int(second * 2**64))
    out_paths, out_rows = [], []
    for coord, mask in ((one, slice(None)), (other, also)):
        p, r, c = paths[mask], rows[mask], coord[mask]
        token = sigs[r, c].astype(np.uint64) | (c.astype(np.uint64) << np.uint64(20))
        out_paths.append(mix64(mix64(p) + mix64(token + np.uint64(0x632BE59BD9B4E019))))
        out_rows.append(r)
    return np.concatenate(out_paths), np.concatenate(out_rows)


def _paths(trees: int, depth: int, second: float):
    """Rows (path, k) of the first ``depth`` levels, or of one more level below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, COORDS)
                n = len(sigs)
                if "path" in part.schema.names:
                    paths, rows = part.column("path").to_numpy(zero_copy_only=False).view(np.uint64), np.arange(n)
                else:
                    paths = np.repeat(mix64(np.arange(1, trees + 1, dtype=np.uint64)), n)
                    rows = np.tile(np.arange(n), trees)
                for _ in range(depth):
                    paths, rows = _branch(paths, rows, sigs, second)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column("k").take(pa.array(rows))], names=["path", "k"])

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Runs of rows with an equal value of ``by`` in sorted input."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and run[0][by] != row[by]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _compare(least: int):
    """Spanning edges of the signature graph of each node, all pairs of which are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for node in _groups(batches, "path"):
            sigs = np.frombuffer(b"".join([r["sig"] for r in node]), np.uint16).reshape(-1, COORDS)
            union = _Union(len(node))
            for i in range(len(node) - 1):
                for j in np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(axis=1) >= least).tolist():
                    if union.join(i, i + 1 + j):
                        a.append(node[i]["k"])
                        b.append(node[i + 1 + j]["k"])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * common >= percent * (a + b - common)


def _exact(width: int, percent: int):
    """All pairs of each family on full sets; rows (key, root, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family in _groups(batches, "fam"):
            sets: dict[bytes, np.ndarray] = {}
            for row in family:
                items = shingles(row["text"], width)
                if row["key"] not in sets and digest(items) == row["key"]:
                    sets[row["key"]] = items
            keys = sorted(sets)
            sizes = np.array([len(sets[k]) for k in keys], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            ids = np.unique(np.concatenate([sets[k] for k in keys]), return_inverse=True)[1]
            mark = np.zeros(int(ids.max()) + 1, np.int32)
            union, links = _Union(len(keys)), np.zeros(len(keys), np.int64)
            for i in range(len(keys) - 1):
                own = ids[starts[i] : starts[i] + sizes[i]]
                mark[own] = 1
                common = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
                mark[own] = 0
                for j in np.flatnonzero(linked(common, sizes[i], sizes[i + 1 :], percent)).tolist():
                    union.join(i, i + 1 + j)
                    links[i] += 1
                    links[i + 1 + j] += 1
            roots = [keys[union.find(i)] for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(roots, pa.binary())], names=["a", "b"])

    return run


def _with_text(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Members with the text of their representative; equal ids of other texts drop out by digest.

    Both sides grow with the corpus, so the join is a sort-merge join at every size.
    """
    return members.hint("merge").join(docs, members["cid"] == docs["doc_id"]).drop("doc_id")


def _chunks(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of tasks that read the members of their family."""
    count = F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("n") / CHUNK_ITEMS)).cast("int").alias("chunks")
    return rows.join(rows.groupBy("fam").agg(count), "fam")


def _dealt(held: DataFrame, read: DataFrame, by: list[str]) -> DataFrame:
    """Both sides by the task that compares them, what is held ahead of what is read."""
    both = held.withColumn("side", F.lit(0)).unionByName(read.withColumn("side", F.lit(1)))
    return both.repartition(partitions(both.sparkSession), *by).sortWithinPartitions(*by, "side", "key")


def _distances(width: int):
    """Common shingles and size of each hub of its family for a member; hubs stand before the members of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                out = {k: [] for k in ("fam", "key", "cid", "n", "common", "sizes", "hub_keys")}
                for row in batch.slice(first, 1024).to_pylist():
                    if (row["fam"], row["chunk"]) != at:
                        at, hubs = (row["fam"], row["chunk"]), []
                    items = shingles(row["text"], width)
                    if digest(items) != row["key"]:
                        continue
                    if row["side"] == 0:
                        if row["key"] not in [k for k, _ in hubs]:
                            hubs.append((row["key"], items))
                        continue
                    for k in ("fam", "key", "cid", "n"):
                        out[k].append(row[k])
                    out["common"].append([len(np.intersect1d(items, h, assume_unique=True)) for _, h in hubs])
                    out["sizes"].append([len(h) for _, h in hubs])
                    out["hub_keys"].append([k for k, _ in hubs])
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def _hub_round(members: DataFrame, docs: DataFrame, width: int, percent: int, hubs: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Compare ``hubs`` members of each big family with all its members; links and what is left.

    ``members``: fam, key, cid, n, main (already in the family's main cluster).  Hubs come
    from outside the main cluster first.  Left are members outside the new main cluster
    and those of it that the triangle inequality of the Jaccard distance still allows to
    be linked to one outside; hubs themselves are settled.
    """
    draw = F.xxhash64("key", F.lit(turn))
    picked = members.groupBy("fam", F.pmod(draw, F.lit(hubs)).alias("slot")).agg(F.min(F.struct("main", draw.alias("draw"), "key", "cid", "n")).alias("h"))
    sized = _chunks(members)
    chosen = picked.select("fam", "h.key", "h.cid", "h.n").join(sized.select("fam", "chunks").distinct(), "fam")
    held = chosen.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    read = sized.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit("chunk")), "chunks").cast("int")).drop("chunks", "main")
    rows = _dealt(_with_text(held, docs), _with_text(read, docs), ["fam", "chunk"])
    dist = staged(rows.mapInArrow(_distances(width), "fam long, key binary, cid long, n long, common array<long>, sizes array<long>, hub_keys array<binary>").dropDuplicates(["fam", "key"]), "hub-distances")
    pairs = F.arrays_zip("common", "sizes", "hub_keys")
    is_link = lambda p: 100 * p["common"] >= percent * (p["sizes"] + F.col("n") - p["common"])
    dist = dist.withColumns({
        "to": F.transform(F.filter(pairs, is_link), lambda p: p["hub_keys"]),
        "d": F.transform(pairs, lambda p: 1 - p["common"] / (p["sizes"] + F.col("n") - p["common"])),
    })
    # A member is tied to one of its hubs, and its hubs to each other: clusters, not all links.
    tied = dist.where(F.size("to") > 0).withColumn("to", F.array_sort("to"))
    own = tied.select(F.col("key").alias("a"), F.get("to", F.lit(0)).alias("b"))
    chain = tied.select("to").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size("to")), lambda i: F.struct(F.get("to", i - 1).alias("a"), F.get("to", i).alias("b")))).alias("e")).select("e.*")
    links = staged(own.unionByName(chain.where(F.col("b").isNotNull()).distinct()), "hub-links")
    roots = components(links).select(F.col("node").alias("key"), "root")
    placed = dist.join(members.select("fam", "key", F.col("main").alias("was")), ["fam", "key"]).join(roots, "key", "left")
    # Clusters that reach the main cluster join it; at first it is the largest of hubs and what is linked to them.
    sizes = placed.where(F.col("root").isNotNull()).groupBy("fam", "root").agg(F.count("*").alias("m"), F.max("was").alias("was"))
    most = sizes.groupBy("fam").agg(F.max(F.struct("m", "root")).alias("most")).select("fam", "most.root")
    begun = placed.where("was").select("fam").distinct()
    main = sizes.where("was").select("fam", "root").unionByName(most.join(begun, "fam", "left_anti")).withColumn("reached", F.lit(True))
    marked = placed.join(main, ["fam", "root"], "left").withColumn("main", F.col("was") | F.coalesce("reached", F.lit(False))).drop("root", "was", "reached")
    spread = marked.where(~F.col("main")).select("fam", F.posexplode("d").alias("i", "x")).groupBy("fam", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bounds = spread.groupBy("fam").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("bounds"))
    reach = 1 - percent / 100 + 1e-9
    near = F.forall(F.arrays_zip("d", "bounds"), lambda z: (z["d"] >= z["bounds"]["lo"] - reach) & (z["d"] <= z["bounds"]["hi"] + reach))
    left = marked.join(bounds, "fam").where((~F.col("main") | near) & ~F.array_contains("hub_keys", F.col("key")))
    outside = left.where(~F.col("main")).select("fam").distinct()
    return links, left.join(outside, "fam", "left_semi").select("fam", "key", "cid", "n", "main")


class _Held:
    """Sets of a block by size, and the cluster that each is in so far."""

    def __init__(self, keys: list[bytes], sets: list[np.ndarray], of: np.ndarray):
        self.keys, self.sets, self.of = keys, sets, of
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.items, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.items), np.int32)

    def window(self, n: int, percent: int) -> slice:
        """Sets whose sizes alone allow a link to one of ``n``."""
        return slice(int(np.searchsorted(self.sizes * 100, percent * n)), int(np.searchsorted(self.sizes * percent, 100 * n, "right")))

    def common(self, items: np.ndarray, w: slice) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        at = at[self.items[at] == items]
        self.mark[at] = 1
        low = self.ends[w.start]
        out = np.add.reduceat(self.mark[self.ids[low : self.ends[w.stop]]], self.ends[w] - low)
        self.mark[at] = 0
        return out

    def without(self, cluster: int) -> _Held | None:
        keep = np.flatnonzero(self.of != cluster).tolist()
        return _Held([self.keys[i] for i in keep], [self.sets[i] for i in keep], self.of[keep]) if keep else None


def _cross(width: int, percent: int):
    """Links (a, b) that tie clusters of a block of held sets and the members read against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held, few, numbers, union = None, [], None, (-1, None), {}, _Union(0)

        def number(root: bytes) -> int:
            if root not in numbers:
                numbers[root] = len(union.up)
                union.up.append(len(union.up))
            return union.find(numbers[root])

        for batch in batches:
            a, b = [], []
            for row in (r for first in range(0, batch.num_rows, 1024) for r in batch.slice(first, 1024).to_pylist()):
                if (row["fam"], row["block"], row["chunk"]) != at:
                    at, waiting, held, few, numbers, union = (row["fam"], row["block"], row["chunk"]), [], None, (-1, None), {}, _Union(0)
                if row["side"] == 0:
                    items = shingles(row["text"], width)
                    if digest(items) == row["key"]:
                        waiting.append((len(items), row["key"], items, number(row["root"])))
                    continue
                if waiting:
                    waiting.sort(key=lambda x: x[:2])
                    held = _Held([x[1] for x in waiting], [x[2] for x in waiting], np.array([x[3] for x in waiting]))
                    waiting = []
                own = number(row["root"])
                # What is held by size and not yet in this member's cluster.
                now = few[1] if few[0] >= 0 and union.find(few[0]) == own else held
                if now is None:
                    continue
                w = now.window(row["n"], percent)
                if (now.of[w] == own).all():
                    continue
                items = shingles(row["text"], width)
                if digest(items) != row["key"]:
                    continue
                hits = linked(now.common(items, w), now.sizes[w], len(items), percent) & (now.of[w] != own)
                for j in (np.flatnonzero(hits) + w.start).tolist():
                    other = int(now.of[j])
                    if union.join(own, other):
                        a.append(row["key"])
                        b.append(now.keys[j])
                        for block in (held, few[1]):
                            if block is not None:
                                block.of[(block.of == own) | (block.of == other)] = union.find(own)
                        own = union.find(own)
                if 2 * int((now.of != own).sum()) < len(now.of):
                    few = own, now.without(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _crossed(left: DataFrame, links: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the clusters that ``links`` makes of the members that are left.

    Members outside the largest cluster of their family are held in blocks, and every
    member is read against each block, one outside only against blocks up to its own.
    """
    roots = components(links).select(F.col("node").alias("key"), "root")
    rows = _chunks(left.select("fam", "key", "cid", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    rows = staged(rows.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit("chunk")), "chunks").cast("int")), "clusters")
    sizes = rows.groupBy("fam", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("fam").agg(F.max(F.struct("m", "root")).alias("most")).select("fam", F.col("most.root").alias("main"))
    rows = rows.join(main, "fam").withColumn("outside", F.col("root") != F.col("main")).drop("main")
    blocks = rows.where("outside").groupBy("fam").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    rows = rows.join(blocks, "fam").withColumn("own", F.pmod(F.xxhash64("key", F.lit("block")), "blocks").cast("int"))
    held = rows.where("outside").withColumn("block", F.col("own")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    read = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("own")).otherwise(F.col("blocks") - 1))))
    names = ["fam", "block", "chunk", "key", "cid", "n", "root"]
    dealt = _dealt(_with_text(held.select(names), docs), _with_text(read.select(names), docs), names[:3])
    return dealt.mapInArrow(_cross(width, percent), "a binary, b binary")


def _shared(agree: int, second: float, levels: int) -> float:
    """Probability that a pair agreeing on ``agree`` coordinates shares a node of one tree so many levels down."""
    one = agree / COORDS
    both = one * (agree - 1) / (COORDS - 1)
    keep = 1.0
    for _ in range(levels):
        lost = 1 - keep
        keep = 1 - (1 - second) * (1 - one * keep) - second * (1 - 2 * one + both + 2 * (one - both) * lost + both * lost**2)
    return keep


def plan_trees(classes: int, percent: int, miss: float, small: int = 64, deeper: int = 0) -> tuple[int, int]:
    """(depth, trees) for so many classes, where crowded nodes branch on for ``deeper`` more levels.

    All trees read the same coordinates, so the miss is averaged over how many of them a
    pair at the threshold agrees on; trees are independent only for a given number.
    """
    t = percent / 100
    depth = max(2, round(math.log(max(2, classes)) / math.log(small)))
    odds = np.array([math.comb(COORDS, k) * t**k * (1 - t) ** (COORDS - k) for k in range(COORDS + 1)])
    lost = np.array([1 - _shared(k, 1 / t - 1, depth + deeper) for k in range(COORDS + 1)])
    trees = 1
    while float(odds @ lost**trees) > miss:
        trees += 1
    return depth, trees


def labelled(docs: DataFrame, width: int = 2, percent: int = 80, miss: float = 1e-5, small: int = 1000, deeper: int = 2, family_work: float = 3e9, family_items: int = 4_000_000, hubs: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of ``docs``.

    Null and wordless texts have no shingles and are linked with nothing; rows with a
    null id take no part (component null, kept false).  Rows of equal sets share a class.
    Nodes above ``small`` branch on for at most ``deeper`` levels; members of one that is
    still large agree on many tokens and form a family as they are.
    """
    n_parts = partitions(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    rows = staged(hashed.mapInArrow(_describe(width), "doc_id long, text_hash long, n long, key binary, k long, sig binary"), "shingles")
    live = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = staged(live.groupBy("key", "k").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    second = 100 / percent - 1
    depth, trees = plan_trees(classes.count(), percent, miss, deeper=deeper)

    edges = None
    level = staged(classes.select("k", "sig").mapInArrow(_paths(trees, depth, second), "path long, k long"), "paths")
    for turn in range(deeper + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("size"), F.min("k").alias("hub")).where(F.col("size") > 1)
        nodes = staged(level.join(sizes, "path"), "nodes")
        little = nodes.where(F.col("size") <= small).select("path", "k").join(classes.select("k", "sig"), "k")
        got = little.repartition(n_parts, "path").sortWithinPartitions("path", "k").mapInArrow(_compare(int(COORDS * (percent / 100 - 0.24))), "a long, b long")
        edges = got if edges is None else edges.unionByName(got)
        big = nodes.where(F.col("size") > small)
        if big.isEmpty():
            break
        if turn == deeper:
            edges = edges.unionByName(big.where(F.col("k") != F.col("hub")).select(F.col("k").alias("a"), F.col("hub").alias("b")))
            break
        level = staged(big.select("path", "k").join(classes.select("k", "sig"), "k").mapInArrow(_paths(trees, 1, second), "path long, k long"), "paths")

    # Written first, so that no task holds two Python workers, which stay alive with all that they remember.
    edges = staged(edges, "candidates")
    families = components(edges).select(F.col("node").alias("k"), F.col("root").alias("fam"))
    members = staged(families.join(classes.select("k", "key", "cid", "n"), "k").drop("k"), "families")
    links, tied = [], []
    turn = 0
    left = members.withColumn("main", F.lit(False))
    while True:
        weight = left.groupBy("fam").agg(F.count("*").alias("m"), F.sum("n").alias("items"))
        left = left.join(weight.select("fam", ((F.col("m") * F.col("items") > family_work) | (F.col("items") > family_items)).alias("large")), "fam")
        local = _with_text(left.where(~F.col("large")).select("fam", "key", "cid"), texts)
        links.append(local.repartition(n_parts, "fam").sortWithinPartitions("fam", "key").mapInArrow(_exact(width, percent), "a binary, b binary"))
        large = left.where("large").drop("large")
        if large.isEmpty():
            break
        if turn == 0:  # from here on only their texts are read, not all of them in every round
            held = large.select(F.col("cid").alias("doc_id")).distinct()
            texts = staged(texts.join(held.hint("merge"), "doc_id", "left_semi"), "large-texts")
        if turn == ROUNDS:
            links.append(_crossed(large, reduce(DataFrame.unionByName, tied), texts, width, percent))
            break
        got, rest = _hub_round(large, texts, width, percent, hubs << turn, turn)
        tied.append(got)
        links.append(got)
        left = staged(rest, "hub-left")
        turn += 1
    found = reduce(DataFrame.unionByName, links)
    if turn:  # links of one family come from several rounds
        found = components(staged(found, "links")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = staged(found.select(F.col("a").alias("key"), F.col("b").alias("root")), "roots")
    joined = classes.select("key", "cid").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = joined.groupBy("root").agg(F.min("cid").alias("component_id"))
    by_class = joined.join(least, "root").select("key", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "key").join(by_class, "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def cluster(docs: DataFrame, width: int = 2, percent: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; see ``labelled``."""
    return labelled(docs, width, percent, **options).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the least id; all columns kept.

    Rows that repeat that id and its text stay together; exact deduplication is another step.
    """
    gone = labelled(docs, width, percent, id_col=id_col, text_col=text_col, **options).where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = gone.select("doc_id", "text_hash").distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    return marked.join(gone.hint("merge"), (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
