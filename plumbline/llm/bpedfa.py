"""BPE encoding and decoding with a tokenization automaton compiled from the merges.

``compile_arcs`` reads the merge list in order and applies one merge gadget for each merge
``u v -> w`` to a deterministic automaton over tokens, whose states are "the last token
was t": the new state ``w`` takes over the arcs of ``v``; the arc ``v`` leaves state ``u``;
every state with an arc ``u`` gains an arc ``w``.  What is left accepts exactly the token
sequences that BPE emits.  The arcs are one bit each (state by token, 92 MB for 49,000
merges, about 9 MB compressed); the driver compiles them once and broadcasts them, a size
that the vocabulary fixes.

Encoding reads pre-split words byte by byte through two tables: the transitions of the trie
of token spellings, completed by its suffix links, and the arcs.  At every byte the token that
ends there is the one, among the spellings that end there, whose arc leaves the token before
it; BPE makes it unique.  All distinct words of a call take their steps together as arrays.
Decoding takes ids and emits the labels of their arcs.

The tokenizer file must name the normaliser, pre-tokenizer and model settings that this
module implements; any other is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that are encoded in one go; a text is never cut.
CALL = 1 << 21
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}
#: White space as the tokenizer's own regular expressions see it.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Classes of Latin-1 texts, for the faster standard library.
LETTERS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF"
NUMBERS = r"0-9\xB2\xB3\xB9\xBC-\xBE"
BLANKS = r"\t-\r\x20\x85\xA0"
LATIN_WORDS = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: What the words above and ``Codec.words`` implement, as a tokenizer file writes it (fixed values).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _refuse(spec: dict) -> None:
    """ValueError for a tokenizer file with settings that are not implemented here."""
    model = spec["model"]
    wrong = [k for k, v in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("decoder", None)) if spec.get(k) != v]
    wrong += [f"model {k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [f"added token {t['content']}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if model.get("type") != "BPE" or wrong:
        raise ValueError(f"tokenizer settings that this automaton does not implement: {', '.join(wrong) or model.get('type')}")


class Vocabulary:
    """Tokens of a tokenizer file in merge order: base tokens first, then one for each merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse(spec)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merged}
        self.labels = sorted((t for t in vocab if t not in made), key=vocab.get)
        self.n_base = len(self.labels)
        number = {t: i for i, t in enumerate(self.labels)}
        self.parts: list[tuple[int, int]] = []
        for a, b in merged:
            self.parts.append((number[a], number[b]))
            number[a + b] = len(self.labels)
            self.labels.append(a + b)
        self.ids = np.array([vocab[t] for t in self.labels], np.int32)
        last = [bool(end) and t.endswith(end) and t != end for t in self.labels]
        self.bodies = [bytes(BYTE_OF[c] for c in (t[: -len(end)] if z else t)) for t, z in zip(self.labels, last)]
        #: Whether a word may go on after the token, and whether it may end with it.
        self.inner = np.array([not z for z in last])
        self.final = np.array(last) if end else np.ones(len(last), bool)
        #: State of each token (only tokens inside a word have one), then of the start of a word.
        self.state = np.append(np.where(self.inner, np.cumsum(self.inner) - 1, -1), self.inner.sum()).astype(np.int32)

    @property
    def n_states(self) -> int:
        return int(self.state[-1]) + 1


def compile_arcs(vocab: Vocabulary) -> np.ndarray:
    """Bits [token, state]: whether the token may follow, once every merge gadget is applied."""
    width = (vocab.n_states + 7) // 8
    arcs = np.zeros((len(vocab.labels), width), np.uint8)
    begin = np.zeros(8 * width, np.uint8)
    begin[vocab.state[: vocab.n_base][vocab.inner[: vocab.n_base]]] = 1
    begin[vocab.state[-1]] = 1
    arcs[: vocab.n_base] = np.packbits(begin, bitorder="little")
    state = vocab.state.tolist()
    for w, (u, v) in enumerate(vocab.parts, vocab.n_base):
        if state[w] >= 0:  # the new state takes over the arcs of v
            byte, bit = divmod(state[v], 8)
            at, shift = divmod(state[w], 8)
            arcs[:w, at] |= (arcs[:w, byte] >> bit & 1) << shift
        byte, bit = divmod(state[u], 8)
        arcs[v, byte] &= 255 ^ 1 << bit  # u v is merged, so v no longer follows u
        arcs[w] = arcs[u]  # what u could follow, w can follow
    return arcs


def shared(arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the set of each token, the bits of each set): every distinct row of ``arcs`` once."""
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in arcs], np.int32)
    return of, np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), -1)


class Spellings:
    """The trie of token spellings, completed by suffix links.

    ``step``: transitions.  A node without longer spellings goes on as its suffix link does and
    shares its row; a byte that leads to the same node from everywhere has no column.
    ``ends``: for each kind (inner, final) and node the longest token that ends there, and
    ``shorter`` for each token the next one of its kind (-1: none).
    """

    def __init__(self, vocab: Vocabulary):
        order = sorted({b[:k] for b in vocab.bodies for k in range(len(b) + 1)}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(order)}
        children: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(order[1:], 1):
            children.setdefault(number[p[:-1]], []).append((p[-1], i))
        kinds = (vocab.inner, vocab.final)
        self.ends = np.full((2, len(order)), -1, np.int32)
        self.shorter = np.full((2, len(vocab.labels)), -1, np.int32)
        for t, body in enumerate(vocab.bodies):
            for kind in (0, 1):
                if kinds[kind][t]:
                    self.ends[kind, number[body]] = t
        go = np.zeros((len(children), 256), np.int32)
        self.row = np.zeros(len(order), np.int32)
        fail = np.zeros(len(order), np.int64)
        rows = 0
        for i in range(len(order)):  # by length, so what a suffix link leads to is complete
            if i:
                for kind in (0, 1):
                    if self.ends[kind, i] < 0:
                        self.ends[kind, i] = self.ends[kind, fail[i]]
                    else:
                        self.shorter[kind, self.ends[kind, i]] = self.ends[kind, fail[i]]
            below = children.get(i)
            if not below:
                self.row[i] = self.row[fail[i]]
                continue
            self.row[i] = rows
            if i:
                go[rows] = go[self.row[fail[i]]]
            for byte, child in below:
                fail[child] = go[rows, byte]
                go[rows, byte] = child
            rows += 1
        same = (go == go[0]).all(axis=0)
        self.fixed = np.where(same, go[0], -1).astype(np.int32)
        self.slot = np.where(same, 0, np.cumsum(~same) - 1).astype(np.int32)
        self.go = np.ascontiguousarray(go[:, ~same])

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        fixed = self.fixed[byte]
        return np.where(fixed >= 0, fixed, self.go[self.row[node], self.slot[byte]])


class MergeAutomaton:
    """The compiled tables of one tokenizer file; ``arcs`` may come ready-made (see ``shared``)."""

    def __init__(self, path: str, arcs: tuple[np.ndarray, np.ndarray] | None = None):
        self.vocab = Vocabulary(path)
        self.follows, self.arcs = arcs or shared(compile_arcs(self.vocab))
        self.spelling = Spellings(self.vocab)
        self.length = np.array([len(b) for b in self.vocab.bodies], np.int32)
        self.state = self.vocab.state

    def arc(self, u: np.ndarray | int, v: np.ndarray | int) -> np.ndarray:
        """Whether token v may follow token u (-1: the start of a word)."""
        at = self.state[u]
        return (self.arcs[self.follows[v], at >> 3] >> (at & 7) & 1).astype(bool)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of non-empty words (bytes ``data[offsets[i]:offsets[i + 1]]``), flat, and their offsets.

        Each step reads one more byte of every word that has one; longer words come first,
        so those that still read, and those at their last byte, are slices.
        """
        lengths = np.diff(offsets).astype(np.int64)
        n = len(lengths)
        order = np.argsort(-lengths, kind="stable")
        size, start = lengths[order], offsets[:-1][order].astype(np.int64)
        base = start + order  # one more place for each word holds its start
        last = np.full(len(data) + n, -1, np.int32)
        count = np.zeros(len(data) + n, np.int32)
        node = np.zeros(n, np.int32)
        longer = n
        for j in range(int(size[0]) if n else 0):
            active = longer
            longer = int(np.searchsorted(-size, -(j + 1), side="left"))
            node = self.spelling.step(node[:active], data[start[:active] + j])
            for kind, lo, hi in ((0, 0, longer), (1, longer, active)):
                if lo == hi:
                    continue
                shorter = self.spelling.shorter[kind]
                token = self.spelling.ends[kind][node[lo:hi]]
                here = base[lo:hi] + (j + 1)
                before = here - self.length[token]
                wrong = np.flatnonzero(~self.arc(last[before], token))
                while len(wrong):
                    token[wrong] = shorter[token[wrong]]
                    before[wrong] = here[wrong] - self.length[token[wrong]]
                    wrong = wrong[~self.arc(last[before[wrong]], token[wrong])]
                last[here] = token
                count[here] = count[before] + 1
        ends = offsets[1:].astype(np.int64) + np.arange(n)
        out_offsets = np.zeros(n + 1, np.int64)
        np.cumsum(count[ends], out=out_offsets[1:])
        out = np.empty(int(out_offsets[-1]), np.int32)
        begin, at, spot = ends - lengths, ends, out_offsets[1:] - 1
        while len(at):  # step back by whole tokens
            token = last[at]
            out[spot] = token
            at, spot = at - self.length[token], spot - 1
            more = at > begin
            at, spot, begin = at[more], spot[more], begin[more]
        return out, out_offsets

    def word(self, word: bytes) -> list[int]:
        """Tokens (merge order) of one word."""
        return self.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0].tolist()


class Codec:
    """Whole texts: normalise, pre-split, encode distinct words by the tables, put ids together; and back."""

    def __init__(self, path: str, arcs: tuple[np.ndarray, np.ndarray] | None = None):
        self.auto = MergeAutomaton(path, arcs)
        vocab = self.auto.vocab
        self.special = vocab.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {int(i): t for i, t in zip(vocab.ids, vocab.labels)} | {i: t for t, i in self.special.items()}
        self.labels = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.decimals = pa.array([str(i) for i in range(max(names) + 1)], pa.string())

    @staticmethod
    def _plain(text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return LATIN_WORDS.findall(text.lower())
        except UnicodeEncodeError:
            return WORDS.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def words(self, text: str) -> list[str]:
        """Pre-split words in order; a special token's spelling is one of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self._plain(part))]

    def _spelled(self, words: pa.Array) -> pa.ListArray:
        """Ids of each distinct word; a special token has no words of its spelling beside it."""
        names = words.to_pylist() if self.special and pc.any(pc.is_in(words, pa.array(list(self.special)))).as_py() else []
        special = [i for i, w in enumerate(names) if w in self.special]
        if special:
            words = pa.array(["a" if w in self.special else w for w in names], pa.string())  # a place for one id
        offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        tokens, at = self.auto.words(data, offsets)
        ids = self.auto.vocab.ids[tokens]
        for i in special:
            ids[at[i]] = self.special[names[i]]
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))

    def ids_of(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of each text; null counts as empty."""
        words, ends = [], [0]
        for text in texts:
            if text:
                words += self.words(text)
            ends.append(len(words))
        if not words:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(ends), np.int32)), pa.array([], pa.int32()))
        coded = pa.array(words, pa.string()).dictionary_encode()
        spelled = self._spelled(coded.dictionary)
        sizes = np.diff(spelled.offsets.to_numpy())[coded.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[ends]
        return pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), spelled.take(coded.indices).flatten())

    def encode(self, text: str) -> list[int]:
        return self.ids_of([text])[0].as_py()

    @staticmethod
    def _joined(names: pa.Array, ids: pa.ListArray) -> pa.Array:
        values = ids.flatten()
        spread = pc.min_max(values)
        known = values.null_count == 0 and (not len(values) or (spread["min"].as_py() >= 0 and spread["max"].as_py() < len(names)))
        flat = names.take(values) if known else None
        if flat is None or flat.null_count:
            raise ValueError("an id that the vocabulary does not hold")
        if ids.null_count:
            ids = pa.ListArray.from_arrays(pa.array(np.append(ids.offsets.to_numpy()[:-1], ids.offsets[-1].as_py())), ids.values, mask=ids.is_null())
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, flat)
        return pc.if_else(ids.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """Labels of each row's ids, joined by one space (the model has no decoder of its own); null stays."""
        return self._joined(self.labels, ids)

    def decimal_all(self, ids: pa.ListArray) -> pa.Array:
        return self._joined(self.decimals, ids)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_codecs: dict[str, Codec] = {}
_packed: dict[str, tuple[bytes, bytes]] = {}


def codec(path: str, packed: tuple[bytes, bytes] | None = None) -> Codec:
    """One codec for each file in a process; ``packed``: compressed arcs of the driver."""
    if path not in _codecs:
        arcs = None
        if packed is not None:
            of, bits = (zstandard.ZstdDecompressor().decompress(p) for p in packed)
            of = np.frombuffer(of, np.int32)
            arcs = of, np.frombuffer(bits, np.uint8).reshape(int(of.max()) + 1, -1)
        _codecs[path] = Codec(path, arcs)
    return _codecs[path]


def shipped(spark: SparkSession, path: str):
    """A broadcast of the compressed arcs of ``path``; compiled once in a driver."""
    if path not in _packed:
        small = zstandard.ZstdCompressor(level=3).compress
        _packed[path] = tuple(small(part.tobytes()) for part in shared(compile_arcs(Vocabulary(path))))
    return spark.sparkContext.broadcast(_packed[path])


FIELDS = {"n_tokens": "long", "ids": "array<int>", "ids_text": "string", "decoded": "string"}


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of rows together until they hold ``CALL`` characters."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        at, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= CALL or i == len(lengths) - 1:
                part = batch.slice(at, i + 1 - at)
                yield part.column(0), part.column(1).to_pylist()
                at, size = i + 1, 0


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen ``outputs`` of every row: n_tokens, ids, ids_text (decimal ids
    joined by a space), decoded (the labels that decoding those ids emits).

    Null texts count as empty and have no tokens; rows that repeat are encoded each; an
    empty table gives no rows.
    """
    arcs = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for keys, texts in _calls(batches):
            one = one or codec(path, arcs.value)
            ids = one.ids_of(texts)
            cols = []
            for k in outputs:
                if k == "n_tokens":
                    cols.append(pc.cast(pc.list_value_length(ids), pa.int64()))
                else:
                    cols.append(ids if k == "ids" else one.decimal_all(ids) if k == "ids_text" else one.decode_all(ids))
            yield pa.RecordBatch.from_arrays([keys, *cols], names=["doc_id", *outputs])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {FIELDS[k]}" for k in outputs))


def decoded(spark: SparkSession, path: str, ids: Column) -> Column:
    """The labels of an array of ids; a null array gives null, an id outside the vocabulary an error."""
    arcs = shipped(spark, path)

    @F.arrow_udf("string")
    def labels(rows: pa.Array) -> pa.Array:
        return codec(path, arcs.value).decode_all(rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows)

    return labels(ids)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` added, from the ids alone."""
    return encoded.withColumn("decoded", decoded(encoded.sparkSession, path, F.col(ids_col)))
