"""Byte-pair encoding by an automaton, and decoding by its arc labels.

``Automaton`` starts from one state in which every base symbol may follow every other, and takes the
merges in order. The gadget of a merge u v -> uv forbids the arc v in the state that u leads to, and adds a
label uv: it may stand wherever u may stand so far, and leads where v leads so far. A state is therefore
the right edge of the label before it (the label, its right part, that one's right part, ...), each with the
merge that ended its life as an edge, and a label's arcs are its left edge likewise: an arc is closed
if some merge of a right edge with a left edge comes before both have been merged away. Exactly one path
of open arcs spells a word, and one each of its prefixes, so ``word`` goes from left to right once and keeps one label for each prefix.
Arcs that were looked up stay in a table. Words repeat, so each task keeps the ids of words seen, up to a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = 1 << 60
#: Stands for the end of a word; no letter of a byte.
END = "\ue000"
#: Words in each of the two generations that a worker process keeps, and arcs it keeps. A process lives on through later
#: tasks and stages with what it keeps, so this is memory of an executor for each of its processes.
KEPT, ARCS = 60_000, 300_000


class Automaton:
    """Compiled merges: deterministic, one open path per word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.closed: dict[int, int] = {}  # u, v -> number of the merge that forbids v after u
        self.width = max(vocab.values(), default=0) + 1
        left: dict[int, tuple] = {}
        right: dict[int, tuple] = {}
        joined = {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in joined:
                left[i] = right[i] = ((i, NEVER),)
        for n, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in left or v not in left or not self._open(right[u], left[v]):
                continue  # the arc v is closed after u already, so this merge finds no place
            self.closed.setdefault(u * self.width + v, n)
            if w in left:  # a second merge that spells a known label adds no label
                continue
            left[w] = ((w, NEVER), *((x, min(t, n)) for x, t in left[u]))
            right[w] = ((w, NEVER), *((x, min(t, n)) for x, t in right[v]))
        self.left, self.right = left, right
        self.labels = ahocorasick.Automaton()  # finds in one pass where each label may stand
        for t, i in vocab.items():
            if i in left:
                spelled = t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
                self.labels.add_word(spelled, (i, len(spelled)))
        self.labels.make_automaton()
        self.arcs: dict[int, bool] = {}
        ends = ((t, i) for t, i in vocab.items() if i in left and t.endswith(suffix))
        self.whole = {t[: len(t) - len(suffix)]: i for t, i in ends}  # words that one arc spells

    def open(self, a: int, b: int) -> bool:
        """May label b follow label a?"""
        key = a * self.width + b
        got = self.arcs.get(key)
        if got is None:
            got = self._open(self.right[a], self.left[b])
            if len(self.arcs) < ARCS:
                self.arcs[key] = got
        return got

    def _open(self, right: tuple, left: tuple) -> bool:
        for x, until_x in right:
            for y, until_y in left:
                n = self.closed.get(x * self.width + y)
                if n is not None and n < until_x and n <= until_y:  # of one merge's places the leftmost comes first
                    return False
        return True

    def word(self, word: str) -> list[int]:
        """The ids of one pre-split word. Each prefix has one open path, so from left to right the label that ends it
        is kept: the one that may follow the label that ends where it starts. No path (a letter that is no
        label) gives none."""
        one = self.whole.get(word)
        if one is not None:
            return [one]
        if self.suffix:
            word += END
        arcs, width = self.arcs, self.width
        ends = [-1] * (len(word) + 1)  # the label that ends at each place
        begins = [0] * (len(word) + 1)
        for j, (t, n) in self.labels.iter(word):
            i = j + 1 - n
            if ends[j + 1] < 0 and (i == 0 or ends[i] >= 0):
                if i:
                    ok = arcs.get(ends[i] * width + t)
                    if not (self.open(ends[i], t) if ok is None else ok):
                        continue
                ends[j + 1], begins[j + 1] = t, i
        at = len(word)
        if ends[at] < 0:
            return []
        path = []
        while at:
            path.append(ends[at])
            at = begins[at]
        return path[::-1]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: the byte's own where it prints, else from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return out


class Codec:
    """Text to ids and back, as a tokenizer file states it: NFC, one blank for white space, lower case by code
    point, a split pattern, letters for bytes, then the automaton. The file's special tokens are cut out first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # The same pattern where a lower-case text is ASCII.
        self.ascii_pieces = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\ra-z0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        self.letters = dict(enumerate(_byte_letters()))  # for bytes read as code points
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() would look at its neighbours
                text = text.replace("Σ", "σ")
        return text.lower()  # white space parts pieces whatever it is, so it need not be folded

    def piece(self, piece: str) -> bytes:
        """The ids of one word as 32-bit integers. What was asked for lately is kept in two generations."""
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                letters = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
                path = self.automaton.word(letters)
                got = pack(f"{len(path)}i", *path)
            if len(piece) <= 64:
                if len(self.young) >= KEPT:
                    self.young, self.old = {}, self.young
                self.young[piece] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append(pack("i", self.special[part]))
            elif part:
                words = (self.ascii_pieces if part.isascii() else self.pieces).findall(self.normal(part))
                known = self.young.get
                out += [known(w) or self.piece(w) for w in words]
        return np.frombuffer(b"".join(out), np.int32)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Compiled once in each worker process."""
    return Codec(path)


@lru_cache(maxsize=2)
def arc_labels(path: str) -> pa.Array:
    """The label of each id, special tokens included; decoding needs nothing else. Null where there is none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    label = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([label.get(i) for i in range(max(label, default=-1) + 1)], pa.string())


def _spread(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of bounded bytes, at least one row each."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the token ids of each whole text; a null or empty text has none. An own column ``out_col`` gives way."""
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for big in batches:
            for b in _spread(big):
                yield pa.RecordBatch.from_arrays([*b.columns, encoded(b.column(at), c)], [*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the labels of the ids' arcs, joined by a blank as a tokenizer without a decoder does; null ids give an
    empty text, an unknown id raises an error. An own column ``out_col`` gives way."""
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = arc_labels(path)
        for big in batches:
            for b in _spread(big):
                yield pa.RecordBatch.from_arrays([*b.columns, spelled(b.column(at), label)], [*b.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The other columns with what ``encode`` and then ``decode`` add, without the text. One process for each task does
    both, where a chain of the two has two, each with memory of its own. Own columns of such names give way."""
    docs = docs.drop(ids_col, out_col)
    at = docs.columns.index(text_col)
    rest = [k for k in range(len(docs.columns)) if k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, label = codec(path), arc_labels(path)
        for big in batches:
            for b in _spread(big):
                ids = encoded(b.column(at), c)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), ids, spelled(ids, label)], [*(b.schema.names[k] for k in rest), ids_col, out_col])

    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.StringType())]
    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in rest), *added]))


def encoded(texts: pa.Array, c: Codec) -> pa.ListArray:
    """The ids of each row's text; a null or empty one has none."""
    ids = [c.encode(t) for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def spelled(ids: pa.ListArray, label: pa.Array) -> pa.Array:
    """The labels of each row's ids, joined by a blank."""
    flat = label.take(ids.flatten())
    if flat.null_count:
        raise KeyError("an id has no label")
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat), " ")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and then decoding the ids."""
    coded = round_trip(docs.select("doc_id", "text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
