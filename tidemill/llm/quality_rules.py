"""Quality rules: countable rules, and a logistic regression on hashed word and character n-grams.

The rules are exact counts over whole texts, made for many texts at once.  The regression averages
weights over the hashed words, word pairs and character 4-grams of a text (so length does not
count), is trained on a bounded sample of labelled rows, and its score becomes a probability by a
logistic fit on rows it was not trained on, weighted to the label shares of all labelled rows.
Scoring runs in Arrow batches; a text is kept if no rule fails and its probability reaches a fixed
threshold.

Defined results: a null text has no words and fails the rules; without labelled rows of both kinds
the rules alone decide (probability null); a long text counts whole; equal texts, and repeated rows, get
equal results; an empty table gives an empty one; input columns travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.samples import Adam, labelled, platt, shares, sigmoid
from tidemill.llm.textvec import Rolling, Words, covered, mix, row_chunks, text_buffer, window_starts

WORD, SEQ = Rolling(31), Rolling(32)
#: Symbols that the contract counts.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Hash slots of each feature kind, and the rows of each label that training may use.
SLOTS, TRAIN_ROWS = 1 << 17, 1000
MIN_WORDS, MAX_REPEAT_PERCENT, THRESHOLD = 20, 30, 0.5


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _has_twin(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Within each text: is an equal key anywhere else."""
    order = np.lexsort((key, doc))
    same = np.r_[False, (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])][: len(key)]
    twin = np.zeros(len(key), bool)
    twin[order] = same | np.r_[same[1:], False][: len(key)]
    return twin


def repeated_lines(buf: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """For each text its lines that equal an earlier one.  Lines of equal hash are compared; a text in which some differ is counted by the lines themselves."""
    order = np.lexsort((start, key, doc))
    same = np.flatnonzero((doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1]))
    before, after = order[same], order[same + 1]
    out = np.bincount(doc[after], minlength=texts)
    view = memoryview(np.ascontiguousarray(buf))
    span = lambda i: view[start[i] : end[i]]
    for d in {int(doc[j]) for i, j in zip(before.tolist(), after.tolist(), strict=True) if span(i) != span(j)}:
        held = [bytes(span(i)) for i in np.flatnonzero(doc == d)]
        out[d] = len(held) - len(set(held))
    return out


def counts(buf: np.ndarray, offs: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """Rule counts of each text."""
    lead = (buf & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(lead, dtype=np.int64)]
    in_words = chars[words.end] - chars[words.start]
    prefix = WORD.of_bytes(buf)
    word = WORD.ranges(prefix, words.start, words.end)
    # lines: the ranges between line feeds and text borders
    cut = np.flatnonzero(buf == 0x0A)
    starts = np.sort(np.r_[offs[:-1], cut + 1])
    ends = np.sort(np.r_[offs[1:], cut])
    line_doc = np.repeat(np.arange(len(offs) - 1), _per_text(buf == 0x0A, offs) + 1)
    n_before = np.searchsorted(words.start, starts)
    use = np.searchsorted(words.start, ends) > n_before
    lines = repeated_lines(buf, line_doc[use], starts[use], ends[use], WORD.ranges(prefix, starts[use], ends[use]), len(offs) - 1)
    at = window_starts(words.bounds, 8)
    seq = SEQ.prefix(word)
    twin = _has_twin(words.doc()[at], SEQ.ranges(seq, at, at + 8))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_text(in_words, words.bounds),
        "n_symbols": _per_text(SYMBOLS[buf], offs),
        "n_dup_lines": lines.astype(np.int64),
        "n_repeat_words": _per_text(covered(len(words.start), at[twin], 8), words.bounds),
    }


def features(buf: np.ndarray, offs: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of each text's words, word pairs and character 4-grams, with their bounds by text."""
    word = WORD.ranges(WORD.of_bytes(buf), words.start, words.end)
    mask = np.uint64(SLOTS - 1)
    pair_at = window_starts(words.bounds, 2)
    pair = mix(word[pair_at] * np.uint64(3) + word[np.minimum(pair_at + 1, max(len(word) - 1, 0))]) if len(word) else word
    gram_at = window_starts(offs, 4)
    raw = np.ndarray((max(len(buf) - 3, 0),), "<u4", np.ascontiguousarray(buf), 0, (1,)) if len(buf) > 3 else np.zeros(0, "<u4")
    gram = mix(raw[gram_at].astype(np.uint64) + np.uint64(1 << 40))
    return [
        ((word & mask).astype(np.int32), words.bounds),
        ((pair & mask).astype(np.int32), np.searchsorted(pair_at, words.bounds)),
        ((gram & mask).astype(np.int32), np.searchsorted(gram_at, offs)),
    ]


def score(weights: np.ndarray, found: list) -> np.ndarray:
    """Mean weight of each kind of feature, summed; weights is (kinds, SLOTS)."""
    out = np.zeros(len(found[0][1]) - 1)
    for w, (slot, bounds) in zip(weights, found, strict=True):
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        if len(full):  # each text summed by itself, so that its neighbours leave no trace in the last digits
            out[full] += np.add.reduceat(w[slot].astype(np.float64), bounds[:-1][full]) / n[full]
    return out


def _reduced(batches):
    """Each sampled text's distinct slots and their shares, under a hash of the text, so that the driver gets no texts."""
    for t in row_chunks(batches):
        buf, offs = text_buffer(t.column("text"))
        found = features(buf, offs, Words(buf, offs))
        slots, share = [], []
        for d in range(t.num_rows):
            parts = [np.unique(s[b[d] : b[d + 1]], return_counts=True) for s, b in found]
            slots.append(np.concatenate([u + k * SLOTS for k, (u, _) in enumerate(parts)]).astype(np.int32))
            share.append(np.concatenate([c / max(1, c.sum()) for _, c in parts]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([t.column("y").combine_chunks(), t.column("key").combine_chunks(), pa.array([s.tolist() for s in slots], pa.list_(pa.int32())), pa.array([s.tolist() for s in share], pa.list_(pa.float32()))], ["y", "key", "slots", "share"])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple | None:
    """Weights, slope and offset; none without both labels.  A quarter of the sample is kept for the calibration.

    The result is a function of the rows, however they are dealt to files and tasks.
    """
    sample = labelled(docs, labels, "quality", rows, rows, id_col=id_col, text_col=text_col)
    got = sample.select("y", F.xxhash64("text").alias("key"), "text").mapInArrow(_reduced, "y int, key long, slots array<int>, share array<float>").toArrow()
    # rows come in the order of files and tasks; the fit follows their content
    got = got.take(pa.array(np.lexsort((got.column("y").to_numpy(), got.column("key").to_numpy()))))
    y = got.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    listed = got.column("slots").combine_chunks(), got.column("share").combine_chunks()
    n = np.diff(listed[0].offsets.to_numpy())
    slot, share = (np.asarray(x.flatten().to_numpy(zero_copy_only=False)) for x in listed)
    held = np.zeros(len(y), bool)
    held[::4] = True  # rows lie by hash, so this is a random quarter
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    row = np.repeat(np.arange(len(y)), n)
    train = ~held
    balance = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    p = {"w": np.zeros(3 * SLOTS), "b": np.zeros(1)}
    adam = Adam(p, 0.5)
    for _ in range(60):
        z = np.bincount(row, p["w"][slot] * share, len(y)) + p["b"]
        d = balance * (sigmoid(z) - y)
        adam.step({"w": np.bincount(slot, d[row] * share, 3 * SLOTS) + 1e-7 * p["w"], "b": np.array([d.sum()])})
    z = np.bincount(row, p["w"][slot] * share, len(y)) + p["b"]
    use = held if held.any() else train
    prior = shares(labels, "quality")
    weight = np.where(y == 1, prior / max(1, (y[use] == 1).sum()), (1 - prior) / max(1, (y[use] == 0).sum())) * use.sum()
    slope, offset = platt(z[use], y[use], weight[use])
    return p["w"].reshape(3, SLOTS).astype(np.float32), slope, offset + slope * float(p["b"][0])


def quality_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Each input row as ``row`` (without its text) with the rule counts, base_failed, probability and kept."""
    fitted = fit(docs, labels, text_col, id_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # three tables of SLOTS floats

    def run(batches):
        model = shared.value
        for t in row_chunks(batches):
            buf, offs = text_buffer(t.column("text"))
            words = Words(buf, offs)
            c = counts(buf, offs, words)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            probability = sigmoid(model[1] * score(model[0], features(buf, offs, words)) + model[2]) if model else np.ones(t.num_rows)
            kept = ~failed & (probability >= threshold)
            table = pa.table({"row": t.column("row"), **{k: pa.array(v, pa.int64()) for k, v in c.items()}, "base_failed": failed, "probability": pa.array(probability, pa.float64(), mask=np.full(t.num_rows, model is None)), "kept": kept})
            yield from table.to_batches()

    schema = T.StructType([rows.schema["row"]])
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema.add("base_failed", "boolean").add("probability", "double").add("kept", "boolean"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
