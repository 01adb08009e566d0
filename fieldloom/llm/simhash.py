"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 2 or fewer differing bits share a value at 1 or fewer bits from both. Every distinct fingerprint emits itself and
its 64 one-bit variants; those who meet at a variant are linked, whatever the number of documents behind them. All
who meet at one variant lie within 2 bits of each other, 65 at most, so a chain through them in order holds the same
components as all their pairs; each link is deduplicated and verified.

Edge cases: a null text is empty; a text with fewer words than a shingle has one shingle of all its words; one without words
has fingerprint zero and is linked like any other. Rows with a null doc_id take part, but are never the smallest of a component
(null if there is no other). Repeated rows stay apart in the result, one row each. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.components import components
from fieldloom.llm.shared import materialize

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Bits of each byte value, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype("i8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the hashes of the text's shingles (A-Z lower-cased, repeats included)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    runs = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)), strict=False)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(r), SEED) for r in runs], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    ones = np.zeros(BITS, "i8")
    lanes = hashes.view("u1").reshape(-1, 8)
    if len(hashes) < 64:
        ones += BYTE_BITS[lanes].reshape(-1, BITS).sum(0)
    else:
        for k in range(8):
            ones[8 * k : 8 * k + 8] = np.bincount(lanes[:, k], minlength=256) @ BYTE_BITS
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, fp: str = "fp") -> DataFrame:
    """docs with the fingerprint of every whole text, as a signed long."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, fp])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    return with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "text", shingle).select("doc_id", "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): distinct fingerprints at RADIUS or fewer bits, enough of them for all components."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i"))
    balls = fps.select("fp").distinct().withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1)))).select("fp", F.when(F.col("_i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit)).alias("variant"))
    chain = balls.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("other")).where("other IS NOT NULL").select(F.col("other").alias("a"), F.col("fp").alias("b"))
    return chain.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def grouped(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp, ...) with root, a fingerprint that names the component, and component_id, the smallest doc_id reachable."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return fps.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    fps = materialize(fingerprints(docs, text), "fingerprints")
    return grouped(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
