"""BPE encoding with a priority queue of merge ranks over a doubly linked symbol list, and decoding.

Edge cases: a null text counts as empty and gives no ids; a text of white space gives none either. Repeated rows
are encoded one by one; other columns, whatever their names, pass through `encode` unchanged. An empty table gives an
empty table. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of memory that a worker's known words may take, roughly. Beyond it the older half goes; results don't depend on it.
CACHE_BYTES = 1 << 28
#: Longer words are never kept. Characters of a text that are cut into words at once. What a kept word takes besides characters, about, with one value and with three.
LONG_WORD, CHUNK, ENTRY, ENTRIES = 200, 1 << 20, 210, 370
#: Rows that are encoded before they are handed on; their ids are in memory together.
AT_ONCE = 500


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones are themselves, the others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def cut(text: str) -> Iterator[list[str]]:
    """The parts between blanks and line ends, some at a time; the tokenizer drops white space, and no rule of it reaches across."""
    text, at = text.replace("\n", " "), 0
    while len(text) - at > CHUNK and (end := text.find(" ", at + CHUNK)) >= 0:
        yield text[at:end].split(" ")
        at = end + 1
    yield (text[at:] if at else text).split(" ")


class WordCache:
    """A memory of what words give, bounded in bytes: a full young generation becomes the old one, and what is used again comes back."""

    def __init__(self, make: Callable[[list[str]], list], most: int = CACHE_BYTES, entry: int = ENTRY):
        self.make, self.most, self.entry = make, most // 2, entry
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def __call__(self, words: list[str]) -> list:
        found = list(map(self.young.get, words))
        if None in found:
            new = self.learn({w for w, v in zip(words, found, strict=True) if v is None})
            found = [new[w] if v is None else v for w, v in zip(words, found, strict=True)]
        return found

    def learn(self, new: set[str]) -> dict:
        known = {w: v for w in new if (v := self.old.get(w)) is not None}
        rest = [w for w in new if w not in known]
        known.update(zip(rest, self.make(rest), strict=True))
        for w, v in known.items():
            if len(w) <= LONG_WORD:
                if self.held > self.most:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[w] = v
                self.held += self.entry + 4 * len(w)
        return known


class BpeCodec:
    """A tokenizer file (normalizer NFC, white space to a space, lower case; split by a pattern; byte level; BPE with an end-of-word suffix)."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        #: By left symbol: the rank of the merge with each right one.
        self.ranks: list[dict[int, int]] = [{}] * (max(self.vocab.values(), default=-1) + 1)
        for i, (a, b) in enumerate(pairs):
            if not self.ranks[self.vocab[a]]:
                self.ranks[self.vocab[a]] = {}
            self.ranks[self.vocab[a]][self.vocab[b]] = i
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.first = [self.vocab.get(x) for x in letters]
        self.last = [self.vocab.get(x + self.suffix) for x in letters]
        self.words = WordCache(self._words, cache_bytes * 2 // 3, ENTRIES)
        self.known_pieces = WordCache(lambda pieces: list(map(self._piece, pieces)), cache_bytes // 3)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a list of symbol ids, by rank, then position. Entries whose pair has changed since are stale and skipped.

        The list is doubly linked by `before` and `after`; `now` has the rank of the pair that begins at each symbol, -1 if
        there is none. A queue entry is rank and position in one number.
        """
        n, ranks, merged = len(ids), self.ranks, self.merged
        now = [ranks[a].get(b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        now.append(-1)
        shift = n.bit_length()
        queue = [(r << shift) + i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return ids
        sym, before, after, place = ids[:], list(range(-1, n - 1)), list(range(1, n + 1)), (1 << shift) - 1
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, r = entry & place, entry >> shift
            if now[i] != r:
                continue
            j = after[i]
            sym[i] = new = merged[r]
            sym[j] = now[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = r = ranks[new].get(sym[k], -1)
                if r >= 0:
                    push(queue, (r << shift) + i)
            else:
                now[i] = -1
            if (h := before[i]) >= 0:
                now[h] = r = ranks[sym[h]].get(new, -1)
                if r >= 0:
                    push(queue, (r << shift) + h)
        return [s for s in sym if s >= 0]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece as 32-bit numbers; bytes that the vocabulary lacks give none."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return array("i", self.merge([s for s in ids if s is not None] if None in ids else ids)).tobytes()

    def _pieces(self, word: str) -> list[str]:
        part = word if word.isascii() else unicodedata.normalize("NFC", word)
        return self.pieces.findall(part.lower() if part.isascii() else "".join(map(str.lower, part)))

    def _words(self, words: list[str]) -> list[tuple[bytes, str, str]]:
        """Of pieces of text without blanks: their ids as 32-bit numbers, as decimals joined by a space, and decoded."""
        cut_up: list[list[str]] = []
        special: list[dict[int, bytes]] = []  # by number of pieces before
        for word in words:
            own, at = [], {}
            for part in self.cut_special.split(word) if self.cut_special and "<|" in word else [word]:
                if part in self.special:
                    at[len(own)] = at.get(len(own), b"") + array("i", [self.special[part]]).tobytes()
                elif part:
                    own += self._pieces(part)
            cut_up.append(own)
            special.append(at)
        codes = iter(self.known_pieces([p for own in cut_up for p in own]))
        out, text = [], self.strings
        for own, at in zip(cut_up, special, strict=True):
            code = b"".join([next(codes) for _ in own]) if not at else b"".join([at.get(k, b"") + (next(codes) if k < len(own) else b"") for k in range(len(own) + 1)])
            ids = array("i", code).tolist()
            out.append((code, " ".join(map(str, ids)), " ".join([text[i] for i in ids])))
        return out

    def parts(self, text: str | None) -> list[tuple[bytes, str, str]]:
        """One entry for each word that has ids."""
        return [x for words in cut(text or "") for x in self.words(words) if x[0]]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join([p[0] for p in self.parts(text)]), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of the ids; the tokenizer has no decoder of its own, so they are joined by a space."""
        return " ".join([s for s in map(self.strings.get, ids) if s is not None])


@lru_cache(2)
def codec(path: str, cache_bytes: int = CACHE_BYTES) -> BpeCodec:
    return BpeCodec(path, cache_bytes)


def as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "i4"), *arrays]), pa.int32()))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of every whole text as an array; a column of that name is replaced."""
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([*batch.columns, as_lists([own.encode(t.as_py()) for t in batch.column(at)])], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of every list of ids; null lists give an empty text."""
    kept = encoded.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)])
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, tokenizer: str, ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text that they decode to; with the ids themselves if asked for.

    A text's decoding is that of its words' ids, joined as decode() joins them, so what a known word decodes to is remembered with its ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, cache_bytes)
        sha = lambda parts, k: hashlib.sha256(" ".join([p[k] for p in parts]).encode()).hexdigest()
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            counts, coded, decoded, arrays = [], [], [], []
            for text in batch.column(1):
                parts = own.parts(text.as_py())
                counts.append(sum([len(p[0]) for p in parts]) // 4)
                coded.append(sha(parts, 1))
                decoded.append(sha(parts, 2))
                if ids:
                    arrays.append(np.frombuffer(b"".join([p[0] for p in parts]), "<i4"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": as_lists(arrays)} if ids else {}))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS + ", ids array<int>" * ids)
