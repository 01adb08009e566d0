"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and then towards a multiple of the identity. A score is the logistic of
the difference of the classes' log-densities and log-priors; Mahalanobis distances use Cholesky factors that are made once and sent with
the model. Learning takes moments (counts, sums, sums of products) that Spark adds up over every labelled row; only those reach the driver.

Edge cases: a null text is empty and is scored like any other; a row with a null doc_id is never held out, has no label and gets a
score; null labels don't count; repeated rows or labels count as often as they occur. Without any label every score is 0.5, with labels of one class alone
it is that class. Texts of any length are measured whole; an empty table gives an empty table; other columns pass through, and
columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.runs import slices
from fieldloom.llm.shared import drop, materialize, scratch, text_or_empty

STATISTICS = ("log_words", "word_chars", "symbols", "bars", "bangs", "digits", "upper", "marks", "again", "varied", "log_line_words", "line_again")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PRIOR = 20
COUNTED = {"symbols": b"#*$%&<>", "bars": b"|", "bangs": b"!", "digits": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "marks": b".,;:?"}


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text: logarithms of lengths, square roots of shares."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    c = {k: int(counts[list(v)].sum()) for k, v in COUNTED.items()}
    # each share is that of the text followed by PRIOR ordinary words, so that a few words don't give extreme shares
    per_word = lambda x, usual=0.0: ((x + usual * PRIOR) / (n + PRIOR)) ** 0.5
    letters = c["upper"] + c["lower"]
    return [
        np.log1p(n),
        np.log1p((len(raw) - int(counts[SPACE].sum()) + 5 * PRIOR) / (n + PRIOR)),
        per_word(c["symbols"]),
        per_word(c["bars"]),
        per_word(c["bangs"]),
        per_word(c["digits"]),
        ((c["upper"] + 0.1 * PRIOR) / (letters + 5 * PRIOR)) ** 0.5,
        per_word(c["marks"], 0.1),
        per_word(sum(map(eq, words, words[1:]))),
        ((len(set(words)) + PRIOR) / (n + PRIOR)) ** 0.5,
        np.log1p(n / max(len(lines), 1)),
        ((len(lines) - len(set(lines))) / (len(lines) + 2)) ** 0.5,
    ]


def table(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], float).reshape(-1, len(STATISTICS))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = table(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Qda:
    """Means and inverse Cholesky factors by class, made once; const: half log-determinants and log-priors. only: the score if a class is missing."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    const: tuple[float, float] = (0.0, 0.0)
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        dens = []
        for k in (0, 1):
            z = self.factors[k] @ (x - self.means[k]).T
            dens.append(self.const[k] - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -500, 500)))


def fit(feats: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Qda:
    """Learn from the labelled rows that aren't held out. shrink: towards the pooled covariance; ridge: then towards its mean variance."""
    d = len(STATISTICS)
    use = feats.where(~held_out()).join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)"), "doc_id").select("y", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(y), d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "m"])

    parts = use.mapInArrow(moments, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "m"))
    sums = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("y", "i").agg(F.sum("m").alias("m")).collect():  # 2 x 157 numbers, whatever the input
        sums[r["y"], r["i"]] = r["m"]
    n = sums[:, 0]
    if not n.all():
        return Qda(only=0.5 if not n.any() else float(n[1] > 0))
    means = sums[:, 1 : d + 1] / n[:, None]
    scatter = sums[:, d + 1 :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    factors, const = [], []
    for k in (0, 1):
        cov = (1 - shrink) * scatter[k] / n[k] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d + 1e-9) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        const.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))
    return Qda(means, np.array(factors), tuple(const))


def score(feats: DataFrame, model: Qda) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of features()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(STATISTICS))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    return feats.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Qda, DataFrame]:
    """The model, and the features of all documents as a table in the shared folder."""
    feats = materialize(features(docs), "features")
    return fit(feats, labels), feats


def keep(docs: DataFrame, model: Qda, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs whose score is least or more; measured and judged in one pass, only texts go to Python, nothing is shuffled."""

    @F.arrow_udf(T.DoubleType())
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(table(texts.to_pylist())))

    return docs.where(judge(text_or_empty(text)) >= least)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """Learn from labels and keep the rows of docs whose score is least or more. Texts are measured twice, to learn and to judge: the table between holds statistics only and is gone when this returns."""
    with scratch() as tables:
        model = fit(materialize(features(docs, text), "features"), labels)
        drop(tables)
    return keep(docs, model, least, text)
