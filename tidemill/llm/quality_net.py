"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are each word (case folded for A-Z, hashed to a fixed number of slots) and each word's shape
(upper, lower, digit or the symbol itself, runs joined; marked where the word repeats the one before
it).  Every slot has a sparse ternary index vector that follows from its number.  Over the whole
corpus, each slot sums the index vectors of its neighbours: that is its word vector.  The sums are
integers of a fixed size, made per map task and added up by slot, so the result does not depend on
how rows are dealt.  A document's features are the mean and spread of its tokens' vectors, weighted
against frequent slots, for words and shapes apart.  A network with one hidden layer in numpy is fit
on a bounded sample of labelled rows; its temperature is fit on rows left out of that, with the
shares of all labelled rows that may be learned from.

Defined results: a null text is empty and has features zero; without labelled rows of both kinds
every score is the share of label 1 (a half without labels); a long text counts whole; equal texts, and
repeated rows, get equal scores; an empty table gives an empty one; input columns travel in ``row`` and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import cells as C
from tidemill.llm.samples import Adam, labelled, platt, shares, sigmoid
from tidemill.llm.textvec import Rolling, Words, mix, row_chunks, text_buffer

WORD, SHAPE = Rolling(41), Rolling(42)
#: Slots of words and shapes, vector length, non-zero entries of an index vector, neighbours on each side.
SLOTS, SIZE, NONZERO, REACH = 1 << 13, 32, 4, 2
#: Rows of each label that the fit may use, hidden units.
TRAIN_ROWS, HIDDEN = 1500, 32
FEATURES = 4 * SIZE + 2
SUMS = np.dtype([("slot", "<u4"), ("n", "<i8"), ("v", "<i8", (SIZE,))])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each slot's index vector."""
    draw = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(0xA5A5)).reshape(SLOTS, NONZERO)
    return (draw % np.uint64(SIZE)).astype(np.int32), np.where(draw >> np.uint64(63) > 0, 1, -1).astype(np.int8)


def tokens(buf: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word and of each word's shape."""
    half = np.uint64(SLOTS // 2)
    word = WORD.ranges(WORD.of_bytes(_LOWER[buf]), words.start, words.end)
    kind = _CLASS[buf]
    head = np.ones(len(buf), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[words.start] = True
    at = np.flatnonzero(head)
    shape = SHAPE.ranges(SHAPE.prefix(mix(kind[at])), np.searchsorted(at, words.start), np.searchsorted(at, words.end))
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[words.bounds[:-1][words.counts > 0]] = False
    shape = mix(shape + again.astype(np.uint64))
    return (word % half).astype(np.int32), (shape % half + half).astype(np.int32)


def _sums(batches, buckets: int):
    """Word vectors of one map task: neighbours' index vectors summed by slot."""
    where, sign = index_vectors()
    total, seen = np.zeros(SLOTS * SIZE, np.int64), np.zeros(SLOTS, np.int64)
    for t in row_chunks(batches, 1 << 19):
        buf, offs = text_buffer(t.column("text"))
        words = Words(buf, offs)
        word, shape = tokens(buf, words)
        doc = words.doc()
        seen += np.bincount(word, minlength=SLOTS) + np.bincount(shape, minlength=SLOTS)
        pairs = [(word, shape), (shape, word)]
        for step in range(1, REACH + 1):
            near = doc[step:] == doc[:-step]
            for one in (word, shape):
                a, b = one[:-step][near], one[step:][near]
                pairs += [(a, b), (b, a)]
        for a, b in pairs:
            both, n = np.unique(a.astype(np.int64) * SLOTS + b, return_counts=True)
            a, b = both // SLOTS, both % SLOTS
            for k in range(NONZERO):
                total += np.bincount(a * SIZE + where[b, k], n * sign[b, k], SLOTS * SIZE).astype(np.int64)
    full = np.flatnonzero(seen)
    for part in np.array_split(full, max(1, len(full) >> 12)):
        out = np.empty(len(part), SUMS)
        out["slot"], out["n"], out["v"] = part, seen[part], total.reshape(SLOTS, SIZE)[part]
        if len(part):
            yield C.packed((part % buckets).astype(np.int32), out)


def _added(_, column):
    """Sums of all tasks, by slot; of one size however large the corpus is."""
    a = C.unpacked(column, SUMS)
    slot, place = np.unique(a["slot"], return_inverse=True)
    n, v = np.zeros(len(slot), np.int64), np.zeros((len(slot), SIZE), np.int64)
    np.add.at(n, place, a["n"])
    np.add.at(v, place, a["v"])
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 1) * SIZE, pa.int32()), pa.array(v.ravel().astype(np.float64)))], ["slot", "n", "v"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(SLOTS, SIZE + 1): unit vectors of all slots over the whole corpus, and each slot's weight."""
    buckets = C.partitions(docs.sparkSession)
    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda b: _sums(b, buckets), C.CELLS)
    got = C.gathered(made, _added, "slot int, n long, v array<double>").toArrow()  # at most SLOTS rows
    n, v = np.zeros(SLOTS), np.zeros((SLOTS, SIZE))
    if got.num_rows:
        slot = got.column("slot").to_numpy()
        n[slot] = got.column("n").to_numpy()
        v[slot] = np.stack(got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE))
    weight = 1e-2 / (1e-2 + n / max(1.0, n.sum() / 2))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return np.c_[v, weight].astype(np.float32)


def pooled(vectors: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each text."""
    words = Words(buf, offs)
    out = np.zeros((len(offs) - 1, FEATURES), np.float32)
    full = np.flatnonzero(words.counts)
    if not len(full):
        return out
    first = words.bounds[full]
    for k, slot in enumerate(tokens(buf, words)):
        w = vectors[slot, SIZE]
        x = vectors[slot, :SIZE] * w[:, None]
        mass = np.maximum(np.add.reduceat(w, first), 1e-9)[:, None]
        mean = np.add.reduceat(x, first, axis=0) / mass
        square = np.add.reduceat(x * vectors[slot, :SIZE], first, axis=0) / mass
        out[full, k * 2 * SIZE : (k + 1) * 2 * SIZE] = np.c_[mean, np.sqrt(np.maximum(square - mean * mean, 0))]
    out[full, -2] = np.log1p(words.counts[full]) / 10
    out[full, -1] = 1
    return out


def network(p: dict, x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - p["mean"]) / p["spread"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"])[:, 0]


def train(x: np.ndarray, y: np.ndarray, prior: float) -> dict | None:
    """Network and temperature; none without both labels.  A quarter of the rows is kept for the temperature."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.Generator(np.random.PCG64(7))
    held = np.zeros(len(y), bool)
    held[rng.permutation(len(y))[: len(y) // 4]] = True
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    use = ~held
    fixed = {"mean": x[use].mean(0), "spread": x[use].std(0) + 1e-3}
    p = {"w1": rng.normal(0, 0.1, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.1, (HIDDEN, 1)), "b2": np.zeros(1)}
    adam = Adam(p, 0.01)
    z, t = (x[use] - fixed["mean"]) / fixed["spread"], y[use]
    balance = np.where(t == 1, 0.5 / (t == 1).sum(), 0.5 / (t == 0).sum())
    for _ in range(300):
        h = np.tanh(z @ p["w1"] + p["b1"])
        d = (balance * (sigmoid((h @ p["w2"] + p["b2"])[:, 0]) - t))[:, None]
        back = d @ p["w2"].T * (1 - h * h)
        adam.step({"w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(0), "w1": z.T @ back + 1e-4 * p["w1"], "b1": back.sum(0)})
    p |= fixed
    use = held if held.any() else use
    weight = np.where(y == 1, prior / max(1, (y[use] == 1).sum()), (1 - prior) / max(1, (y[use] == 0).sum())) * use.sum()
    slope, offset = platt(network(p, x[use]), y[use], weight[use])
    return p | {"temperature": 1 / max(slope, 1e-3), "offset": offset}


def quality_net(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", where=None) -> DataFrame:
    """Each input row as ``row`` with its text and ``score``.  ``where`` (on doc_id and y) limits the labels that are learned."""
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size

    def reduced(batches):
        for t in row_chunks(batches):
            x = pooled(shared.value, *text_buffer(t.column("text")))
            yield pa.RecordBatch.from_arrays([t.column("y").combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))], ["y", "x"])

    sample = labelled(docs, labels, "quality", TRAIN_ROWS, TRAIN_ROWS, where, id_col, text_col)
    got = sample.select("y", "text").mapInArrow(reduced, "y int, x array<float>").toArrow()  # at most 2 * TRAIN_ROWS rows
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("quality"), F.col("quality").alias("y"))
    prior = shares(usable.where(where) if where is not None else usable, "quality")
    y = got.column("y").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(float) if len(y) else np.zeros((0, FEATURES))
    order = np.lexsort((*x.T[:4], y))
    model = docs.sparkSession.sparkContext.broadcast((train(x[order], y[order], prior), prior))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        p, base = model.value
        for t in row_chunks(batches, 1 << 19):
            x = pooled(shared.value, *text_buffer(t.column("text")))
            found = sigmoid(network(p, x) / p["temperature"] + p["offset"]) if p else np.full(len(x), base)
            yield from t.append_column("score", pa.array(found, pa.float64())).to_batches()

    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("text", "string").add("score", "double"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    done = quality_net(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out)
    return done.select(F.col("row.doc_id").alias("doc_id"), "score").withColumns({"held_out": F.coalesce(held_out, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")}).select("doc_id", "held_out", "score", "predicted")
