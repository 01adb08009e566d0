"""Substring dedup over words: suffix automata of reference shards, through which documents stream for their matching statistics.

A window is LENGTH words in a row of one document. A word goes if a window that covers it also starts in a document with a smaller doc_id.

1.  Each window has an anchor: the smallest hash of GRAM words among its SPREAD places (the last on ties). It depends on the window's words alone, so equal windows
    have equal anchors. Windows of one anchor follow one another and form a piece of the text. Anchors seen in one document only are left
    out: nothing there can repeat. A Bloom filter of the others, of bounded size, keeps the pieces that matter; what it lets through wrongly costs time and changes nothing.
    Where there are too many anchors for it, pieces are joined with them instead.
2.  The distinct pieces, each with the smallest doc_id that has it, are the reference. Anchors deal it into shards of a bounded number of pieces.
    An anchor with very many different pieces (a common phrase) is cut into single windows, which are dealt by a hash of their own.
3.  A shard's suffix automaton has the shard's pieces, over words, and in each state the smallest doc_id of what it stands for. It goes to every task that has documents' pieces
    of the shard, as many as their number asks for, so no passage is too common. Pieces stream through it; where LENGTH words or more match, the suffix link that first
    covers LENGTH words tells the first document with them.
4.  Documents take the maximal spans above the length back. All matches are of words, never of hashes.

Documents are in order of doc_id, null before all others; rows with one doc_id take nothing from each other. Edge cases: a null text has no words; texts shorter than LENGTH words lose
nothing; texts of any length are treated whole; an empty table gives an empty table; other columns pass through `dedup` unchanged, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.runs import WORDS, runs, slices
from fieldloom.llm.shared import materialize, release, small, text_or_empty

LENGTH, SPREAD = 13, 9
GRAM = LENGTH - SPREAD + 1
#: Windows of a text that are looked at together; pieces of a shard, of an anchor before it is cut into windows, and of one task's share of the documents' pieces.
PLACES, SHARD, MANY, SHARE = 1 << 20, 1 << 14, 1 << 11, 1 << 17
#: Bits of the Bloom filter for each anchor, and at most; with under half of them for each anchor, pieces are joined with anchors.
BITS, MOST_BITS = 16, 1 << 27
LEAST = -(2**63)
MASK = np.uint64((1 << 21) - 1)
BASE = 0x9E3779B97F4A7C15
NEVER = 2**63 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse, modulo 2^64."""
    up, down = np.ones(n, "u8"), np.ones(n, "u8")
    up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))
    return np.cumprod(up, dtype="u8"), np.cumprod(down, dtype="u8")


@lru_cache(1)
def letters() -> np.ndarray:
    return np.random.default_rng(13).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def at_least(n: int) -> int:
    return 1 << max(10, int(n - 1).bit_length())


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word of a binary array made by runs()."""
    starts = np.frombuffer(words.buffers()[1], "i4", len(words) + 1).astype("i8")
    data = np.frombuffer(words.buffers()[2] or b"", "u1")
    if not len(words):
        return np.zeros(0, "u8")
    sizes = np.diff(starts)
    place = np.arange(len(data)) - np.repeat(starts[:-1], sizes)
    return mixed(np.add.reduceat(letters()[data] * powers(at_least(sizes.max()))[0][place], starts[:-1], dtype="u8") + sizes.astype("u8"))


def pieces(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, further windows, anchor's hash) of all pieces of texts whose words have the hashes h; text numbers each word's text."""
    up, down = powers(at_least(PLACES + LENGTH + 1))
    out = [np.zeros((0, 3), "i8")]
    for begin in range(0, max(len(h) - LENGTH + 1, 0), PLACES):
        x, own = h[begin : begin + PLACES + LENGTH - 1], text[begin : begin + PLACES + LENGTH - 1]
        n, n_grams = len(x) - LENGTH + 1, len(x) - GRAM + 1
        sums = np.zeros(len(x) + 1, "u8")
        np.cumsum(x * up[: len(x)], out=sums[1:], dtype="u8")
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[:n_grams])
        near, span = (gram & ~MASK) | (MASK - np.arange(n_grams, dtype="u8")), 1
        while 2 * span <= SPREAD:
            near, span = np.minimum(near[:-span], near[span:]), 2 * span
        near = np.minimum(near[:n], near[SPREAD - span :][:n])
        anchor = (MASK - (near & MASK)).astype("i8")
        fresh = np.ones(n, bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (own[1:n] != own[: n - 1])
        whole = np.flatnonzero(own[:n] == own[LENGTH - 1 :])
        heads = np.flatnonzero(fresh[whole])
        first = whole[heads]
        out.append(np.stack([first + begin, np.diff(np.append(heads, len(whole))) - 1, gram[anchor[first]].view("i8")], 1))
    got = np.concatenate(out)
    return got[:, 0], got[:, 1], got[:, 2]


def joined(words: pa.Array, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each run of n words from word number first on, a string of them with a space between."""
    starts = np.frombuffer(words.buffers()[1], "i4", len(words) + 1).astype("i8")
    spaced = np.full(starts[-1] + len(words), 0x20, "u1")
    data = np.frombuffer(words.buffers()[2] or b"", "u1")
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(starts))] = data
    starts = starts + np.arange(len(words) + 1)
    begin, sizes = starts[first], starts[first + n] - 1 - starts[first]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text = spaced[np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], sizes)]
    return pa.Array.from_buffers(pa.large_utf8(), len(first), [None, pa.py_buffer(bounds.astype("i8")), pa.py_buffer(text)]).cast(pa.utf8())


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(d, t, _text): d is a document's place, d and t together tell rows apart that differ in doc_id or text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("d"), F.xxhash64(text_or_empty(text)).alias("t"), text_or_empty(text).alias("_text"))


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Slices of (d, t, _text) with their words, the text of each word, where each text's words begin, and the pieces."""
    for batch in slices(batches, 2):
        words, n = runs(batch.column(2), WORDS)
        text = np.repeat(np.arange(len(n)), n)
        yield batch, words, text, np.cumsum(n) - n, pieces(word_hashes(words), text)


def anchors(texts: DataFrame) -> DataFrame:
    """(sig) of the anchors that documents with different doc_id share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, text, _, (first, _, sig) in scanned(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(batch.column(0).to_numpy()[text[first]])], names=["sig", "d"])

    ends = texts.mapInArrow(run, "sig long, d long").groupBy("sig").agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    return materialize(ends.where("_a < _b").select("sig"), "anchors")


def bloom(sigs: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with two bits set for each sig; at most `bits` / 64 numbers come to the driver."""
    places = [F.col("sig").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("sig", 32).bitwiseAND(F.lit(bits - 1))]
    at = sigs.select(F.explode(F.array(*places)).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")).alias("w")).toArrow()
    out = np.zeros(max(bits // 64, 1), "i8")
    out[words["k"].to_numpy()] = words["w"].to_numpy()
    return out


def has(bitmap: np.ndarray, sig: np.ndarray) -> np.ndarray:
    bits, s = np.int64(len(bitmap) * 64 - 1), sig.view("u8")
    one = lambda at: (bitmap[at >> 6] >> (at & 63)) & 1
    return (one(sig & bits) & one((s >> np.uint64(32)).astype("i8") & bits)).astype(bool)


def shared_pieces(texts: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(d, t, lo, sig, words): the pieces whose anchor several documents have, and a few more; lo is the first word's number."""
    sigs = anchors(texts)
    n = sigs.count()
    bits = min(at_least(BITS * max(n, 1)), most_bits)
    bitmap = texts.sparkSession.sparkContext.broadcast(bloom(sigs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, text, begin, (first, more, sig) in scanned(batches):
            kept = has(bitmap.value, sig)
            first, more, sig = first[kept], more[kept], sig[kept]
            own = text[first]
            columns = [batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own], (first - begin[own]).astype("i4"), sig]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), joined(words, first, more + LENGTH)], names=["d", "t", "lo", "sig", "words"])

    found = texts.mapInArrow(run, "d long, t long, lo int, sig long, words string")
    if bits < BITS // 2 * n:
        found = materialize(found, "found").join(sigs, "sig").select("d", "t", "lo", "sig", "words")
    out = materialize(found, "pieces")
    release(sigs)
    return out


def single_windows(df: DataFrame) -> DataFrame:
    """df (words, sig, ...) with a row for each window, which has a sig of its own; lo follows."""
    w = F.split("words", " ")
    k = F.explode(F.sequence(F.lit(0), F.size(w) - LENGTH)).alias("_k")
    out = df.select("*", k).withColumn("words", F.array_join(F.slice(w, F.col("_k") + 1, LENGTH), " ")).withColumn("sig", F.xxhash64("words"))
    return (out.withColumn("lo", F.col("lo") + F.col("_k")) if "lo" in df.columns else out).drop("_k")


class Automaton:
    """The suffix automaton of several word sequences; `first` of a state is the smallest document of what it stands for."""

    def __init__(self, sequences: list[list[int]], docs: list[int], n_words: int):
        most = 2 * sum(map(len, sequences)) + 1  # states, at most
        steps: list[dict[int, int]] = [{}]
        link, size, first = [0] * most, [0] * most, [NEVER] * most
        link[0] = -1

        def clone(p: int, c: int, q: int) -> int:
            """A state for what leads from p by c to q and is shorter than q's longest."""
            new = len(steps)
            steps.append(dict(steps[q]))
            size[new], link[new], link[q] = size[p] + 1, link[q], new
            while p >= 0 and steps[p].get(c) == q:
                steps[p][c] = new
                p = link[p]
            return new

        for sequence, doc in zip(sequences, docs, strict=True):
            last, here = 0, steps[0]
            for c in sequence:
                q = here.get(c)
                if q is not None:
                    last = q if size[q] == size[last] + 1 else clone(last, c, q)
                    here = steps[last]
                    if doc < first[last]:
                        first[last] = doc
                    continue
                new = here[c] = len(steps)
                here = {}
                steps.append(here)
                size[new], first[new] = size[last] + 1, doc
                p = link[last]
                while p >= 0:
                    q = steps[p].get(c)
                    if q is not None:
                        link[new] = q if size[q] == size[p] + 1 else clone(p, c, q)
                        break
                    steps[p][c] = new
                    p = link[p]
                last = new
        n = len(steps)
        self.link, self.size = np.array(link[:n]), np.array(size[:n])
        documents, self.earliest = np.array(first[:n]), np.full(n, NEVER)
        by_size = np.argsort(self.size, kind="stable")
        levels = np.split(by_size, np.flatnonzero(np.diff(self.size[by_size])) + 1)[1:]  # the root is alone at size 0
        for states in reversed(levels):  # what a state stands for ends wherever longer ones of its suffix do
            np.minimum.at(documents, self.link[states], documents[states])
        #: For matches of LENGTH words or more that end in a state: the first document with the last LENGTH words of them.
        for states in levels:
            states = states[self.size[states] >= LENGTH]
            shorter = self.link[states]
            self.earliest[states] = np.where(self.size[shorter] < LENGTH, documents[states], self.earliest[shorter])
        self.n_words = max(n_words, 1)
        counts = np.fromiter(map(len, steps), "i8", n)
        keys = np.repeat(np.arange(n) * self.n_words, counts) + np.fromiter(chain.from_iterable(steps), "i8", counts.sum())
        to = np.fromiter(chain.from_iterable(map(dict.values, steps)), "i8", counts.sum())
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after a word; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = state * self.n_words + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def matched(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each row of words (n of them, in the row's first columns) and column: the first document with the LENGTH words that end there, NEVER without one."""
        state, length = np.zeros(len(words), "i8"), np.zeros(len(words), "i8")
        out = np.full(words.shape, NEVER)
        for k in range(words.shape[1]):
            live = np.flatnonzero(k < n)
            while len(live):
                then = self.step(state[live], words[live, k])
                found = then >= 0
                on = live[found]
                state[on], length[on] = then[found], length[on] + 1
                off = live[~found]
                stuck = state[off] == 0
                length[off[stuck]] = 0
                live = off[~stuck]
                state[live] = self.link[state[live]]
                length[live] = self.size[state[live]]
            long = (length >= LENGTH) & (k < n)
            out[long, k] = self.earliest[state[long]]
        return out


SPANS = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def covered(key: tuple, own: pa.Table, reference: pa.Table) -> pa.Table:
    """Spans of words that go from documents' pieces (d, t, lo, words), by the automaton of a shard's reference (words, d)."""
    if not own.num_rows or not reference.num_rows:
        return SPANS.empty_table()
    texts = pc.dictionary_encode(own["words"].combine_chunks())  # a piece that several documents have goes through once
    both = pa.concat_arrays([texts.dictionary, reference["words"].combine_chunks().cast(texts.dictionary.type)])
    words, n = runs(both, WORDS)
    coded = words.dictionary_encode()
    ids, bounds = coded.indices.to_numpy().astype("i8"), np.concatenate([[0], np.cumsum(n)])
    n_own = len(texts.dictionary)
    flat = ids.tolist()
    sequences = [flat[a:b] for a, b in zip(bounds[n_own:-1].tolist(), bounds[n_own + 1 :].tolist(), strict=True)]
    gc.disable()  # states are many small tables without cycles, which the collector would look through again and again
    try:
        machine = Automaton(sequences, reference["d"].to_pylist(), len(coded.dictionary))
    finally:
        gc.enable()
    table = np.zeros((n_own, int(n[:n_own].max())), "i8")
    table[np.arange(table.shape[1]) < n[:n_own, None]] = ids[: bounds[n_own]]
    ends = machine.matched(table, n[:n_own])[:, LENGTH - 1 :]
    gone = ends[texts.indices.to_numpy()] < own["d"].to_numpy()[:, None]
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype("i1"), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    lo = own["lo"].to_numpy()[row]
    return pa.table([own["d"].to_numpy()[row], own["t"].to_numpy()[row], (lo + start).astype("i4"), (lo + end + LENGTH - 1).astype("i4")], schema=SPANS)


def repeats(texts: DataFrame, shard: int = SHARD, many: int = MANY, share: int = SHARE, most_bits: int = MOST_BITS) -> DataFrame:
    """(d, t, spans): the word spans [start, end) that go, of the documents that lose any."""
    found = shared_pieces(texts, most_bits)
    reference = materialize(found.groupBy("sig", "words").agg(F.min("d").alias("d")), "reference")
    common = materialize(reference.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > many).select("sig"), "common")
    if common.limit(1).count():
        cut = lambda df, *columns: df.join(common, "sig", "left_anti").select(*columns).unionByName(single_windows(df.join(common, "sig").select(*columns)))
        found = cut(found, "d", "t", "lo", "sig", "words")
        reference = materialize(cut(reference, "sig", "words", "d").groupBy("sig", "words").agg(F.min("d").alias("d")), "reference")
    n_shards = max(1, -(-reference.count() // shard))
    dealt = lambda df: df.withColumn("shard", F.pmod(F.xxhash64("sig"), F.lit(n_shards)))
    shares = dealt(found).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_k"))
    shares = small(materialize(shares, "shares"))
    own = dealt(found).join(shares, "shard").select("shard", F.pmod(F.xxhash64("d", "lo"), F.col("_k")).cast("int").alias("slice"), "d", "t", "lo", "words")
    sent = dealt(reference).join(shares, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("slice"), "words", "d")
    spans = own.groupBy("shard", "slice").cogroup(sent.groupBy("shard", "slice")).applyInArrow(covered, "d long, t long, start int, end int")
    return materialize(spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def gone(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n words go."""
    edge = np.zeros(n + 1, "i8")
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, text: str, **how) -> DataFrame:
    """(_row, _text, _spans): _row holds all columns of docs. Texts move only where words go, unless very many documents lose some."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), *keyed_columns(text))
    spans = repeats(keyed(docs, text), **how).withColumnsRenamed({"spans": "_spans", "d": "_d", "t": "_t"})
    keys, columns = spans.select("_d", "_t"), ["_row", "_text", "_spans"]
    if (found := small(keys)) is keys:
        return own.join(spans, ["_d", "_t"], "left").select(columns)
    touched = own.join(found, ["_d", "_t"], "left_semi").join(spans, ["_d", "_t"])
    rest = own.join(found, ["_d", "_t"], "left_anti").withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType))
    return touched.select(columns).unionByName(rest.select(columns))


def keyed_columns(text: str) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_d"), F.xxhash64(text_or_empty(text)).alias("_t"), text_or_empty(text).alias("_text")]


def digests(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by a space) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = raw.encode("utf-8", "replace").split()
                off = gone(len(words), spans)
                kept = [w for w, x in zip(words, off.tolist(), strict=True) if not x] if spans else words
                rows.append((len(words), int(off.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(docs.select("doc_id", text), text, **how).select(F.col("_row.doc_id").cast("long").alias("doc_id"), "_text", "_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without the words that go, each with the white space after it; a text that loses nothing stays as it is."""

    def without(raw: str, spans: list[dict]) -> str:
        words = WORD.findall(data := raw.encode("utf-8", "replace"))
        lead = data[: len(data) - sum(map(len, words))]
        off = gone(len(words), spans)
        return (lead + b"".join(w for w, x in zip(words, off.tolist(), strict=True) if not x)).decode()

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without(x, s) if s else x for x, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    out = with_spans(docs, text, **how)
    kept = F.when(F.col("_spans").isNull(), F.col("_row").getField(text)).otherwise(cut("_text", "_spans"))
    return out.select(*[kept.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
