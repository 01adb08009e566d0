"""Token ids as directly addressable codes, in files of segments.

A segment holds the ids of whole documents in ascending doc_id order. Its payload splits each id into chunks of eight
bits, lowest first. Level k keeps the k-th chunk of those ids that reach it, a bitmap that says which of them continue
on level k + 1, and a rank directory: the number of set bits before each block of 512. The chunk of an id on the next level
stands at the rank of its bit, so any token is read by one look-up a level, without decoding a block.

Files are Parquet tables written and read by Spark: one row per segment, with the range of positions it covers, its
doc_ids and their counts, and the payload. Position 0 is the first id of the smallest doc_id.

Edge cases: a null text is empty and has the end id alone; a null doc_id sorts first; rows with one doc_id follow one
another, by a hash of their text; a document longer than a segment has one of its own; an empty table gives empty files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.bpe import CACHE_BYTES, WordCache
from fieldloom.llm.shared import shared_dir, text_or_empty

#: A segment is closed when it holds so many ids.
SEGMENT_IDS = 1 << 17
BLOCK = 512
#: Words that go to the library together, the mark between them, and bytes of texts that are worked on at once.
TOGETHER, MARK, AT_ONCE = 500, "\x01", 1 << 22


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids: header (count, levels), then for each level its count, chunks, bitmap and directory."""
    rest = np.asarray(ids, dtype="<u4")
    levels: list[bytes] = []
    while True:
        chunks = (rest & 0xFF).astype("u1")
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, "u1")])
        in_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        directory = np.concatenate([np.zeros(1, "<u4"), np.cumsum(in_block, dtype="<u4")])
        levels.append(np.array([len(rest)], "<u8").tobytes() + chunks.tobytes() + bits.tobytes() + directory.astype("<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return np.array([len(ids), len(levels)], "<u8").tobytes() + b"".join(levels)


class Codes:
    """Read access to a payload of pack()."""

    def __init__(self, payload: bytes):
        self.count, n_levels = (int(x) for x in np.frombuffer(payload, "<u8", 2))
        self.levels, at = [], 16
        for _ in range(n_levels):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            n_bits = (-(-n // 8) + 7) // 8 * 8
            n_dir = -(-n // BLOCK) + 1
            chunks = np.frombuffer(payload, "u1", n, at + 8)
            bits = np.frombuffer(payload, "u1", n_bits, at + 8 + n)
            directory = np.frombuffer(payload, "<u4", n_dir, at + 8 + n + n_bits)
            self.levels.append((chunks, bits, directory))
            at += 8 + n + n_bits + 4 * n_dir

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        """The id at a place: one chunk a level, found by rank."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            own = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(directory[block]) + int(own.sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.count, "<u4")
        at: np.ndarray | slice = slice(None)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype("<u4") << np.uint32(8 * k)
            more = np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)
            at = np.flatnonzero(more) if isinstance(at, slice) else at[more]
        return out


class Encoder:
    """The tokenizers library with a bounded memory of words. Only for tokenizers that drop white space and let no rule reach across it."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.words = WordCache(self.by_library, cache_bytes)

    def by_library(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words go to the library together, parted by a mark of one id; where that id comes up otherwise too, each word goes alone."""
        out: list[bytes] = []
        for k in range(0, len(words), TOGETHER):
            own = words[k : k + TOGETHER]
            found = self.library.encode_batch_fast([f" {MARK} ".join(own)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            at = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) > 1 or len(at) != len(own) - 1:
                out += [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(own, add_special_tokens=False)]
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True)]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts (null: empty), one after another, and the number of ids of each. A word is looked up once for all of them."""
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        own = cut.flatten().dictionary_encode()
        codes = self.words(own.dictionary.to_numpy(zero_copy_only=False).tolist())
        known = np.frombuffer(b"".join(codes), "<u4")
        sizes = np.array([len(c) for c in codes], "i8") // 4
        word = own.indices.to_numpy()
        ends = np.concatenate([np.zeros(1, "i8"), np.cumsum(sizes[word])])
        from_ = (np.cumsum(sizes) - sizes)[word] - ends[:-1]
        ids = known[np.repeat(from_, sizes[word]) + np.arange(ends[-1])]
        borders = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return ids, np.diff(ends[borders])


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (third column) have AT_ONCE bytes or little more; a longer text is one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype="i8")
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SEGMENTS = "part int, segment int, in_part bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode documents (doc_id, text), end each with end_id, write them to path in doc_id order; return the table of files.

    One shuffle: texts are range-partitioned and sorted by doc_id. Positions need the number of ids in the parts before,
    which are added when the table is read: one row for each part, never one for each document.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # a range of one doc_id (or of nulls) is split by a hash of the text, so that no id has to fit into one part
    rows = rows.withColumn("_t", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_t").sortWithinPartitions("doc_id", "_t", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number, before = encoder(tokenizer), None, 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        codes: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            payload = pack(np.concatenate(codes))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["part", "segment", "in_part", "doc_ids", "counts", "payload"])

        for batch in (piece for whole in batches for piece in pieces(whole)):
            part = batch.column(0)[0].as_py()
            found, sizes = own(batch.column(2))
            ends = np.cumsum(sizes)
            found = np.insert(found, ends, end_id)
            for doc_id, size, stop in zip(batch.column(1).to_pylist(), (sizes + 1).tolist(), (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                ids.append(doc_id)
                counts.append(size)
                codes.append(found[stop - size : stop])
                held += size
                if held >= SEGMENT_IDS:
                    yield segment()
                    number, before, ids, counts, codes, held = number + 1, before + held, [], [], [], 0
        if ids:
            yield segment()

    rows.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)
    return read(docs.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' segments, with the position of their first id and the number of ids."""
    files = spark.read.schema(SEGMENTS).parquet(path).withColumn("n_ids", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = sizes.select("part", (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_start"))
    # one row for each part: as many as the writer had partitions, some bytes each
    return files.join(F.broadcast(before), "part").withColumn("first", F.col("_start") + F.col("in_part")).drop("_start", "in_part")


def tokens_at(files: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, id) for a table of positions: only the segments that hold one are read, and no block is decoded."""
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct()
    spans = files.select("part", "segment", "first", "n_ids").withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / SEGMENT_IDS), F.floor((F.col("first") + F.col("n_ids") - 1) / SEGMENT_IDS))))
    hits = wanted.withColumn("bin", F.floor(F.col("position") / SEGMENT_IDS)).join(spans, "bin").where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids")))
    lists = hits.groupBy("part", "segment").agg(F.collect_list(F.col("position") - F.col("first")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                codes = Codes(payload)
                yield pa.RecordBatch.from_arrays([pa.array([first + i for i in places], pa.int64()), pa.array([codes[i] for i in places], pa.int64())], names=["position", "id"])

    return files.join(lists, ["part", "segment"]).select("first", "payload", "places").mapInArrow(run, "position long, id long")


def digests(files: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, counts, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens = Codes(payload).all()
                ends = np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("first", "doc_ids", "counts", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
