"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 is clean; rows labelled toxic get 1, 2 or 3 by how much marked text they hold (thirds
of the training rows), since labels know only 0 and 1.  The model shares one weight vector over all thresholds:
P(grade >= k) = sigmoid(x w - c_k) with c_1 < c_2 < c_3, and a text's severity is its expected grade,
the sum of these probabilities.

Features are hashed words and word beginnings of 4, 5 and 6 bytes (case folded for A-Z).  Which of
them are used is decided on the bounded sample of labelled rows: document counts by label are summed
on the executors, and those far more frequent in toxic rows are kept, at most MAX_FEATURES, so the
model is small.  A feature enters as log(1 + count) over the whole text.

Defined results: a null or empty text has no features; without labelled rows of both kinds nothing is
rejected and severity is 0; a long text counts whole; equal texts, and repeated rows, get equal results;
an empty table gives an empty one; input columns travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import cells as C
from tidemill.llm.samples import Adam, labelled, sigmoid
from tidemill.llm.textvec import Rolling, Words, mix, row_chunks, text_buffer

WORD = Rolling(51)
#: Rows of each label that the fit may use; most features; their largest hash.
TOXIC_ROWS, CLEAN_ROWS, MAX_FEATURES, BITS = 4000, 12000, 4096, 26
STARTS = (4, 5, 6)
#: A feature is used if its log odds and its likelihood ratio statistic exceed these.
MIN_ODDS, MIN_SURPRISE = 2.5, 20.0
GRADES = 3
TALLY = np.dtype([("f", "<u4"), ("toxic", "<u4"), ("clean", "<u4")])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(buf: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and of their beginnings, and the word each comes from.

    A word's leading and trailing ASCII symbols don't count.
    """
    prefix = WORD.of_bytes(_LOWER[buf])
    at = np.flatnonzero(_LETTER[buf])
    a, b = np.searchsorted(at, words.start), np.searchsorted(at, words.end)
    use = np.flatnonzero(b > a)
    start, end = at[a[use]], at[b[use] - 1] + 1
    mask = np.uint64((1 << BITS) - 1)
    found, owner = [WORD.ranges(prefix, start, end) & mask], [use]
    for n in STARTS:
        ok = end - start >= n
        found.append(mix(WORD.ranges(prefix, start[ok], start[ok] + n) + np.uint64(n)) & mask)
        owner.append(use[ok])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def _tally(batches, buckets: int):
    for t in row_chunks(batches):
        buf, offs = text_buffer(t.column("text"))
        words = Words(buf, offs)
        f, owner = features(buf, words)
        both = np.unique(f << 32 | words.doc()[owner])
        toxic = t.column("y").to_numpy()[both & 0xFFFFFFFF] > 0
        names, place = np.unique(both >> 32, return_inverse=True)
        out = np.zeros(len(names), TALLY)
        out["f"], out["toxic"], out["clean"] = names, np.bincount(place, toxic, len(names)), np.bincount(place, ~toxic, len(names))
        if len(out):
            yield C.packed((names % buckets).astype(np.int32), out)


def _summed(_, column):
    a = C.unpacked(column, TALLY)
    names, place = np.unique(a["f"], return_inverse=True)
    toxic, clean = (np.bincount(place, a[k].astype(float), len(names)).astype(np.int64) for k in ("toxic", "clean"))
    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(toxic), pa.array(clean)], ["f", "toxic", "clean"])


class Lookup:
    """Columns of chosen feature numbers."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = np.sort(chosen)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.chosen & 0xFFFF] = True

    def counts(self, buf: np.ndarray, offs: np.ndarray):
        """Document, column and count of each chosen feature that occurs."""
        words = Words(buf, offs)
        f, owner = features(buf, words)
        near = self.maybe[f & 0xFFFF]
        f, doc = f[near], words.doc()[owner[near]]
        i = np.searchsorted(self.chosen, f)
        hit = self.chosen[np.minimum(i, len(self.chosen) - 1)] == f if len(self.chosen) else np.zeros(len(f), bool)
        both, n = np.unique(doc[hit] * len(self.chosen) + i[hit], return_counts=True)
        return both // max(1, len(self.chosen)), both % max(1, len(self.chosen)), n


def train(doc, column, value, grade: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and rising thresholds by full-batch likelihood."""
    n = len(grade)
    w8 = np.full(n, 1 / n)
    p = {"w": np.zeros(size), "c": np.array([1.0, 0.0, 0.0])}
    adam = Adam(p, 0.1)
    over = np.arange(1, GRADES + 1)[None, :] <= grade[:, None]
    cuts = lambda c: c[0] + np.r_[0, np.cumsum(np.exp(c[1:]))]
    for _ in range(300):
        z = np.bincount(doc, p["w"][column] * value, n)
        c = cuts(p["c"])
        up = np.c_[np.ones(n), sigmoid(z[:, None] - c), np.zeros(n)]
        at = np.arange(n)
        hi, lo = up[at, grade], up[at, grade + 1]
        like = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        dz = -w8 * (dhi - dlo)
        dc = np.zeros(GRADES + 2)
        np.add.at(dc, grade, w8 * dhi)
        np.add.at(dc, grade + 1, -w8 * dlo)
        dc = dc[1:-1]
        rest = np.array([dc[k:].sum() for k in range(1, GRADES)]) * np.exp(p["c"][1:])
        adam.step({"w": np.bincount(column, dz[doc] * value, size) + 2e-5 * p["w"], "c": np.r_[dc.sum(), rest]})
    return p["w"], cuts(p["c"])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple | None:
    spark = docs.sparkSession
    sample = labelled(docs, labels, "toxic", TOXIC_ROWS, CLEAN_ROWS, id_col=id_col, text_col=text_col).select("y", "text")
    n_toxic, n_all = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if n_toxic == 0 or n_toxic == n_all:
        return None
    buckets = C.partitions(spark)
    tally = C.gathered(sample.mapInArrow(lambda b: _tally(b, buckets), C.CELLS), _summed, "f int, toxic long, clean long")
    n_clean = n_all - n_toxic
    seen = F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.1) / n_toxic) - F.log((F.col("clean") + 0.1) / n_clean)
    surprise = 2 * (F.col("toxic") * F.log((F.col("toxic") + 1e-9) / (seen * n_toxic / n_all)) + F.col("clean") * F.log((F.col("clean") + 1e-9) / (seen * n_clean / n_all)))
    best = tally.withColumn("surprise", surprise).where((odds > MIN_ODDS) & (F.col("surprise") > MIN_SURPRISE)).orderBy(F.desc("surprise"), "f").limit(MAX_FEATURES)
    chosen = np.array([r.f for r in best.select("f").collect()], np.int64)  # at most MAX_FEATURES
    look = spark.sparkContext.broadcast(Lookup(chosen))

    def reduced(batches):
        for t in row_chunks(batches):
            doc, column, n = look.value.counts(*text_buffer(t.column("text")))
            bounds = np.searchsorted(doc, np.arange(t.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (column, n)]
            yield pa.RecordBatch.from_arrays([t.column("y").combine_chunks(), *lists], ["y", "f", "n"])

    got = sample.mapInArrow(reduced, "y int, f array<int>, n array<int>").toArrow()  # at most the sample's rows
    y = got.column("y").to_numpy()
    f, n = got.column("f").combine_chunks(), got.column("n").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(f.offsets.to_numpy()))
    column, count = f.flatten().to_numpy(), n.flatten().to_numpy().astype(float)
    marked = np.bincount(doc, np.log1p(count), len(y))
    thirds = np.quantile(marked[y > 0], [1 / 3, 2 / 3])
    grade = np.where(y > 0, 1 + np.searchsorted(thirds, marked, "left"), 0)
    weights, cuts = train(doc, column, np.log1p(count), grade, len(chosen))
    return look, weights, cuts


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Each input row as ``row`` with its text, severity (0 to 3), the likeliest grade, and toxic: P(grade >= 1) reaches the threshold."""
    fitted = fit(docs, labels, text_col, id_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for t in row_chunks(batches):
            up = np.zeros((t.num_rows, GRADES))
            if fitted:
                look, weights, cuts = fitted
                doc, column, n = look.value.counts(*text_buffer(t.column("text")))
                up = sigmoid(np.bincount(doc, weights[column] * np.log1p(n), t.num_rows)[:, None] - cuts)
            grades = np.c_[1 - up[:, 0], up[:, :-1] - up[:, 1:], up[:, -1]]
            out = t.append_column("severity", pa.array(up.sum(1))).append_column("grade", pa.array(grades.argmax(1), pa.int32()))
            yield from out.append_column("toxic", pa.array(up[:, 0] >= threshold)).to_batches()

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("text", "string").add("severity", "double").add("grade", "integer").add("toxic", "boolean"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "severity", "grade", F.col("toxic").cast("int").alias("toxic"))
