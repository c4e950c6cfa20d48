"""Near duplicates (op4), decontamination (op8) and repeated substrings (op9) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF, assert_agrees

pytest.importorskip("plumbline.llm")
from plumbline.llm import components, cpsjoin, decontam, fmindex, queries

DOCS = "doc_id long, text string, row string, id long, hash long, key string, digest string, w string"


def near_brute(rows, width, percent=80):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])

    sets = {i: grams(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders, links = defaultdict(list), 0
    for i in ids:
        common = Counter(j for g in sets[i] for j in holders[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i) if i in up else i) for i in sets}, links


def family_rows(rnd, groups, size, words, edits):
    rows = []
    vocab = [f"w{i}" for i in range(3000)]
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(words)] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"small": 6, "deeper": 1}, {"family_work": 1.0, "hubs": 3}])
def test_op4_matches_brute_force(spark, options):
    rows = family_rows(random.Random(4), 12, 20, 60, 9)
    want, links = near_brute(rows, 2)
    got = cpsjoin.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, **options).collect()
    assert links > 100 and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op4_long_chain_in_hub_rounds(spark):
    """A chain whose ends share nothing, all of it in one family, settles in few rounds."""
    words = [f"x{i}" for i in range(1500)]
    rows = [(200 - k, " ".join(words[6 * k : 6 * k + 120])) for k in range(200)]
    want, _ = near_brute(rows, 2)
    turns = []
    plain = cpsjoin._hub_round
    cpsjoin._hub_round = lambda *a: turns.append(a[4]) or plain(*a)
    try:
        got = cpsjoin.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, family_work=1.0, hubs=4).collect()
    finally:
        cpsjoin._hub_round = plain
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) == 1
    assert turns[:3] == [4, 8, 16] and len(turns) <= 7


def test_op4_large_family_ends_in_blocks(spark, monkeypatch):
    """Clusters of one family that no hub ties: three rounds of hubs, then each pair of clusters once."""
    words, at, rows = [f"x{i}" for i in range(4000)], 0, []
    for k in range(240):
        rows.append((1000 - k, " ".join(words[at : at + 120])))
        at += 20 if k % 12 == 11 else 6
    random.Random(8).shuffle(rows)
    want, _ = near_brute(rows, 2)
    turns = []
    plain = cpsjoin._hub_round
    monkeypatch.setattr(cpsjoin, "_hub_round", lambda *a: turns.append(a[4]) or plain(*a))
    for name, value in (("CHUNK_ROWS", 50), ("BLOCK_ITEMS", 3000)):
        monkeypatch.setattr(cpsjoin, name, value, raising=False)
    got = cpsjoin.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, family_work=1.0, hubs=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) == 20
    assert turns == [2, 4, 8]


def test_op4_recall_against_all_rows(spark):
    """Every row whose id is divisible by 50 against all rows of 10,000, by exact sets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: cpsjoin.shingles(r["text"], 2) for r in docs.collect()}
    holders = defaultdict(list)
    for i, items in sets.items():
        for x in items.tolist():
            holders[x].append(i)
    component = {r["doc_id"]: r["component_id"] for r in cpsjoin.cluster(docs, 2, 80).collect()}
    linked = found = 0
    for q in (i for i in sets if i % 50 == 0):
        for j, n in Counter(j for x in sets[q].tolist() for j in holders[x]).items():
            if j != q and cpsjoin.linked(n, len(sets[q]), len(sets[j]), 80):
                linked += 1
                found += component[q] == component[j]
    assert linked > 40 and found == linked, (found, linked)


def test_op4_chains_reach_the_least_id(spark):
    words = [f"x{i}" for i in range(100)]
    rows = [(9 - k, " ".join(words[4 * k : 4 * k + 60])) for k in range(10)]
    want, _ = near_brute(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in cpsjoin.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in want.items()} and len(set(got.values())) == 1


def test_op4_oracle(spark, duck):
    assert_agrees(queries.op4_chosen_path_join(spark, SF), duck, queries.ORACLES["op4_chosen_path_join"])


def test_op4_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One"), (5, "one"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (7, "é É"), (8, "é é"), (9, "z " * 40_000)]
    df = spark.createDataFrame([(*r, "r", 1, 2, "k", "d", "w") for r in rows], DOCS)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in cpsjoin.cluster(df, 2).collect())
    assert got == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 4, 6, True), (6, 4, 6, True), (None, 4, None, False), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True)])
    kept = cpsjoin.drop_near_duplicates(df, 2)
    assert kept.columns == df.columns and 5 not in [r["doc_id"] for r in kept.collect()]
    assert cpsjoin.cluster(df.where("doc_id > 99")).count() == 0


def test_trees_meet_the_target():
    for n in (10, 10**4, 10**8, 10**11):
        depth, trees = cpsjoin.plan_trees(n, 80, 1e-5)
        keep = 1.0
        for _ in range(depth):
            keep = 1 - (1 - 0.8 * keep) * (1 - 0.2 * keep)
        assert (1 - keep) ** trees <= 1e-5 and trees < 40


def test_op4_crowded_nodes_keep_the_target(spark):
    """4,000 pairs at exactly 0.8 whose nodes all count as crowded, so each branches on to the last level."""
    rows = []
    for i in range(4000):
        common = [f"c{i}x{k}" for k in range(40)]
        for side in "ab":
            rows.append((len(rows), " ".join(common + [f"{side}{i}x{k}" for k in range(5)])))
    got = {r["doc_id"]: r["component_id"] for r in cpsjoin.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, small=1).collect()}
    assert sum(got[i + 1] != i for i in range(0, 8000, 2)) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 300), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def leaks_brute(docs, items, width=10):
    grams = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            grams[tuple(w[k : k + width])].add(str(i))
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (12, "short ITEM here"), (3, None), (4, "..."), (5, "one one one one one one one one one one one")]
LEAKY = [
    (1, "x ALPHA, beta gamma-delta epsilon zeta eta theta iota kappa y alpha"),
    (2, "a short item here, short item here"),
    (3, None),
    (4, ""),
    (5, "one " * 30),
    (5, "one " * 30),
    (None, "É short item here"),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (8, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (9, "shorté item here " + "pad " * 30_000),
]


@pytest.mark.parametrize("bound", [128_000_000, 1])
def test_op8_matches_brute_force(spark, bound):
    """Both sides of the broadcast bound, whole rows."""
    df = spark.createDataFrame([(*r, "r", 1, 2, "k", "d", "w") for r in LEAKY], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(map(tuple, decontam.scan(df, items, broadcast_bytes=bound).collect())) == leaks_brute(LEAKY, ITEMS)
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(df, items, broadcast_bytes=bound).collect()}
    assert cut[2] == "a" and cut[5] == "" and cut[1] == "x y alpha"


def test_op8_bound_counts_bytes(spark):
    items = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(30))) for i in range(50)], "item_id long, text string")
    grams = decontam.benchmark_windows(items, 10, "item_id", "text")
    assert 21 * 50 * 10 * 8 < decontam.table_bytes(grams) < 21 * 50 * 1000 and decontam.table_bytes(grams.where("off > 99")) == 0


def test_op8_removal(spark):
    df = spark.createDataFrame([(*r, "r", 1, 2, "k", "d", "w") for r in LEAKY], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontam.drop_contaminated(df, items)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 7, 9]
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(df, items).collect()}
    assert cut[2] == "a" and cut[5] == "" and cut[1] == "x y alpha"
    assert decontam.scan(df.where("doc_id > 99"), items).count() == 0
    assert not any(r["contaminated"] for r in decontam.scan(df, items.where("item_id > 99")).collect())


def repeats_brute(docs, width):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + width]) for _, w in words for i in range(len(w) - width + 1))
    out = []
    for d, w in words:
        gone = {k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block, hot", [(400_000, 4000), (120, 4000), (400_000, 3), (120, 0)])
def test_op9_matches_brute_force(spark, block, hot):
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    passages = [" ".join(rnd.choices(vocab, k=rnd.randint(30, 90))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(vocab, k=rnd.randint(5, 60))))
        docs.append((i, "  \t".join(parts)))
    docs += [(200, "the " * 500), (201, "ab ba " * 100), (202, None), (203, ""), (204, docs[3][1]), (204, docs[3][1]), (None, docs[5][1]), (205, " ".join(passages[0].split()[:34])), (206, "é É " + passages[1].upper())]
    df = spark.createDataFrame([(*r, "r", 1, 2, "k", "d", "w") for r in docs], DOCS)
    got = fmindex.remove_repeats(df, 35, block_words=block, hot=hot)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == repeats_brute(docs, 35)
    assert fmindex.remove_repeats(df.where("doc_id > 999"), 35).count() == 0


def test_fm_index_counts():
    rnd = np.random.default_rng(1)
    segs = [rnd.integers(1, 5, rnd.integers(3, 30)).astype(np.int64) for _ in range(40)]
    index = fmindex.FMIndex(segs, 4)
    for n in (1, 2, 3, 5):
        for pattern in rnd.integers(1, 5, (30, n)):
            want = sum(1 for s in segs for i in range(len(s) - n + 1) if (s[i : i + n] == pattern).all())
            low, high = np.zeros(1, np.int64), np.full(1, index.size, np.int64)
            for c in pattern[::-1]:
                low, high = index.step(np.array([c]), low, high)
            assert max(0, int((high - low)[0])) == want


def test_fm_index_matching_intervals():
    rnd = random.Random(5)
    segs = [np.array([rnd.randint(1, 3) for _ in range(rnd.randint(4, 40))]) for _ in range(30)]
    index = fmindex.FMIndex(segs, 3)
    width = 6
    seen = Counter(tuple(s[i : i + width]) for s in segs for i in range(len(s) - width + 1))
    for s, spans in zip(segs, index.repeats(segs, width)):
        want = {k for i in range(len(s) - width + 1) if seen[tuple(s[i : i + width])] > 1 for k in range(i, i + width)}
        assert {k for a, b in spans for k in range(a, b)} == want
