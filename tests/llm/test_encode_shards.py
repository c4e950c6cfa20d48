"""Token shards (op1), BPE automaton (op10), ring (op3) and exact deduplication (op2)."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("plumbline.llm")
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import bpedfa, cuckoo, queries, ring, sstable

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, key string, digest string"
ODD = [
    (5, None, "en", "s", 1, "r", 1, "k", "d"),
    (3, "", None, None, None, None, None, None, None),
    (9, "same text", "en", "s", 9, "r", 2, "k", "d"),
    (7, "same text", "en", "s", 9, "r", 3, "k", "d"),
    (9, "same text", "en", "s", 9, "r", 4, "k", "d"),
    (None, "same text", "en", "s", 9, "r", 5, "k", "d"),
    (1, "Ünïcode ÀÉ 中文 😀 <|endoftext|> don't\x1cstop", "fr", "s", 9, "r", 6, "k", "d"),
    (2, "word " * 30_000, "en", "s", 9, "r", 7, "k", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def libraries():
    out = []
    for path in (BYTE, WORD):
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        out.append(t)
    return out


def test_op1_matches_library(spark, libraries):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_sstable_tokens(spark, SF).collect()
    want = {i: [*libraries[0].encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    start = 0
    for r in sorted(got, key=lambda r: r["doc_id"]):
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_op1_odd_rows_and_lookup(odd, empty, libraries):
    manifest = sstable.write_shards(odd, BYTE, 2)
    rows = sstable.read_shards(odd.sparkSession, manifest).collect()
    want = Counter((r[0], tuple(libraries[0].encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in ODD)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert sorted(map(len, sstable.lookup(manifest, 9))) == [3, 3] and sstable.lookup(manifest, 4) == []
    blank = tuple(libraries[0].encode("same text", add_special_tokens=False).ids) + (2,)
    assert [tuple(x) for x in sstable.lookup(manifest, None)] == [blank]
    for i in {r[0] for r in ODD}:  # every id, whichever rows stand before it
        assert Counter(map(tuple, sstable.lookup(manifest, i))) == Counter({k[1]: n for k, n in want.items() if k[0] == i})
    assert sstable.read_shards(empty.sparkSession, sstable.write_shards(empty, BYTE, 2)).count() == 0


def test_op1_ids_keep_their_width(odd):
    rows = odd.where("doc_id = 5")
    wide = sstable.read_shards(rows.sparkSession, sstable.write_shards(rows, BYTE, 70_000)).collect()
    assert [r["ids"] for r in wide] == [[70_000]]
    with pytest.raises(ValueError):
        sstable.write_shards(rows, BYTE, 70_000, width=2)


def test_shard_file_round_trip(tmp_path):
    rnd = random.Random(1)
    keys = sorted(rnd.sample(range(-(10**12), 10**12), 3000))
    path = str(tmp_path / "x.sst")
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 2, block_bytes=2000)
        for k in keys:
            w.add(k, np.arange(k % 50, dtype="<u4").tobytes())
        w.close()
    r = sstable.ShardReader(path)
    assert len(r.index) > 20 and [k for k, _, _ in r.scan()] == keys
    for k in rnd.sample(keys, 200):
        assert [x.tolist() for x in r.get(k)] == [list(range(k % 50))]
    absent = [k for k in range(5000) if k not in set(keys)]
    assert all(r.get(k) == [] for k in absent) and sum(r.may_hold(k) for k in absent) < 250
    with open(path, "rb") as f, open(str(tmp_path / "cut.sst"), "wb") as g:
        g.write(f.read()[:-3])
    with pytest.raises(ValueError):
        sstable.ShardReader(str(tmp_path / "cut.sst"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="latin-1"), st.sampled_from("ΣςﬁÅ中文😀 ​'")), max_size=40))
def test_automaton_matches_library(text):
    assert bpedfa.codec(WORD).encode(text) == _library(WORD).encode(text, add_special_tokens=False).ids


_cache = {}


def _library(path):
    if path not in _cache:
        _cache[path] = Tokenizer.from_file(path)
        _cache[path].no_truncation()
        _cache[path].no_padding()
    return _cache[path]


def test_op10_matches_library(spark, libraries):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_automaton_bpe(spark, SF).collect():
        ids = libraries[1].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(libraries[1].decode(ids, skip_special_tokens=False))


def test_op10_odd_rows_and_decode(odd, empty, libraries):
    got = bpedfa.decode(bpedfa.encode(odd, WORD, ("ids", "decoded")).withColumnRenamed("decoded", "first"), WORD).collect()
    assert len(got) == len(ODD) and all(r["first"] == r["decoded"] for r in got)
    assert bpedfa.encode(empty, WORD).count() == 0


def test_automaton_accepts_only_what_bpe_emits():
    auto = bpedfa.codec(WORD).auto
    name = auto.vocab.labels.index
    tokens = auto.word(b"worthlessness")
    assert auto.arc(np.array(tokens[:-1]), np.array(tokens[1:])).all() and auto.arc(-1, tokens[0])
    assert not auto.arc(name("t"), name("h"))  # "t h" merges, so the two never stand side by side


def test_merge_gadgets_by_brute_force(tmp_path):
    """All token pairs of small vocabularies: an arc exists where BPE keeps the two apart."""
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    for n in (3, 40, 150):
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"][:n]]
        keep = {t: i for t, i in spec["model"]["vocab"].items() if i < 512} | {a + b: 512 + i for i, (a, b) in enumerate(merges)}
        small = spec | {"model": spec["model"] | {"merges": merges, "vocab": keep}, "added_tokens": []}
        path = str(tmp_path / f"{n}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(small, f)
        auto, rank = bpedfa.MergeAutomaton(path), {tuple(m): i for i, m in enumerate(merges)}
        labels = auto.vocab.labels
        some = [labels.index(t) for t in dict.fromkeys([t for m in merges for t in (*m, "".join(m))])]

        def bpe(parts):
            while True:
                spots = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
                if not spots:
                    return parts
                i = min(spots)[1]
                parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

        for u in some:
            for v in some:
                if auto.vocab.inner[u]:
                    chars = [*labels[u], *(list(labels[v][:-5]) + [labels[v][-5:]] if not auto.vocab.inner[v] else labels[v])]
                    assert bool(auto.arc(u, v)) == (bpe(chars) == [labels[u], labels[v]]), (labels[u], labels[v])


def test_op10_refuses_other_settings(tmp_path):
    import json

    for path, change in ((BYTE, {}), (WORD, {"normalizer": None}), (WORD, {"pre_tokenizer": {"type": "Whitespace"}})):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f) | change
        other = str(tmp_path / "other.json")
        with open(other, "w", encoding="utf-8") as f:
            json.dump(spec, f)
        with pytest.raises(ValueError):
            bpedfa.Vocabulary(other)


def test_op10_long_words_and_unknown_ids(spark, libraries):
    rows = [(1, "ab" * 5000), (2, "\u00e9" * 3000 + " x"), (3, "<|endoftext|>" * 3), (4, " \n "), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpedfa.encode(docs, WORD).collect():
        assert r["ids"] == libraries[1].encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids
    with pytest.raises(Exception, match="vocabulary"):
        bpedfa.codec(WORD).decode([10**6 % 49408, 49408])
    got = bpedfa.decode(spark.createDataFrame([(1, None), (2, [])], "n int, ids array<int>"), WORD).collect()
    assert {r["n"]: r["decoded"] for r in got} == {1: None, 2: ""}


def test_op3_law(spark):
    rows = ring.shard_rows(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    src = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(src[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(src[r["doc_id"]])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(src)


def test_op3_odd_rows(odd, empty):
    rows = ring.shard_rows(odd, shards=3).collect()
    assert len(rows) == len(ODD) and max(Counter(r["shard"] for r in rows).values()) == 3
    assert ring.shard_rows(empty).count() == 0


def test_op3_overflow_moves_clockwise():
    points = [(0, 0), (10, 1), (20, 2)]
    segs = ring.place_arcs(points, {0: 6, 1: 0, 2: 0}, 3)
    assert [(s["lo"], s["hi"], s["shard"]) for s in segs] == [(0, 2, 0), (2, 4, 1), (4, 6, 2)]


def _placed(spark, rows, shards, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string") if isinstance(rows, list) else rows
    return sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in ring.shard_rows(docs, shards, **options).collect())


def test_op3_layout_of_the_input_has_no_say(spark):
    rows = [(i * 7919 % 100_003, f"t{i % 50}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _placed(spark, docs.repartition(13), 16) == _placed(spark, docs.orderBy("text").coalesce(2), 16)


def test_op3_one_more_shard_moves_few_keys(spark):
    docs = spark.range(60_000).selectExpr("id * 31 as doc_id", "'x' as text")
    few, more = ({r[0]: r[2] for r in _placed(spark, docs, n)} for n in (16, 17))
    moved = sum(few[k] != more[k] for k in few) / len(few)
    between = sum(few[k] != more[k] != 16 for k in few) / len(few)
    assert 1 / 17 - 0.001 < moved < 0.075 and between < 0.015


def test_op3_hot_key_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ring, "BLOCK", 100)
    monkeypatch.setattr(ring, "CELL_ROWS", 1)
    rows = [(5, "same")] * 1700 + [(None, None)] * 900 + [(i, f"t{i}") for i in range(2000)]
    got = _placed(spark, [r for r in rows if r[0] is not None], 7)
    assert len(got) == 3700
    got = ring.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows) and all(r["slot"] < sizes[r["shard"]] for r in got)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)


def test_cuckoo_filter_grows_and_deletes():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    index = cuckoo.CuckooIndex(64)
    for i, d in enumerate(digests):
        index.add(d, i, i)
    assert index.resizes > 3 and all(index.find(d) for d in digests)
    for d in digests[::2]:
        assert index.remove(d)
    assert not any(index.find(d) for d in digests[::2]) and all(index.find(d) for d in digests[1::2]) and index.live == 10_000
    assert not index.remove(digests[0])


def test_op2_odd_rows(odd, empty):
    got = cuckoo.verdicts(odd).collect()
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same text").hexdigest()]
    assert {r["keep_id"] for r in same} == {9} and [r["kept"] for r in same].count(True) == 1 and {r["group_size"] for r in same} == {4}
    blank = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {(r["doc_id"], r["kept"]) for r in blank} == {(5, True), (3, False)}
    kept = cuckoo.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 9]
    assert cuckoo.verdicts(empty).count() == 0 and cuckoo.exact_dedup(empty).count() == 0
