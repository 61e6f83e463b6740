"""Best-fit packing by the configuration linear program over the length histogram.

Texts become token ids with an end id and are cut into pieces of at most ``capacity`` ids.  How many
pieces have which length is a histogram of at most ``capacity`` numbers, whatever the corpus size,
and only that goes to the driver.  There a configuration is a multiset of lengths that fits one
sequence; the program asks for the least total of configurations that covers the histogram.

* Multiplicative weights: each length has a price that falls exponentially with its coverage; in
  each round a knapsack by dynamic programming finds the configuration of highest total price, and
  as much of it is added as covers a fixed share of its scarcest length.
* Rounding: whole numbers of each configuration are taken as long as pieces are left; what remains
  is packed by best fit in falling length, on the histogram too.  A small histogram can lose by the
  rounding, so the whole histogram is packed by best fit as well, and the better of both plans counts.

The ids are those of the ``tokenizers`` library for the same file: its vocabulary, in which a lower id
is an earlier merge, and its special tokens, whose strings in a text are one id.  They are made with
``tiktoken``, which needs a quarter of the time (tests hold both to be equal).

The plan says, for each length, which ranks among its pieces go to which sequences and offsets.
Pieces get their rank from a number within their map task and an offset by (task, length), and look
their place up; all of that is DataFrame work.  No task gets all pieces of a frequent length.

Defined results: a null or empty text is one piece that holds the end id only; a long text is cut into
full pieces after a first one that may be shorter; repeated rows are packed each for itself; pieces of
one length take their places in the order of tasks and rows; an empty table gives an empty one; input
columns travel in ``row`` and cannot clash.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cells import save

CAPACITY, END_ID = 1024, 2
#: Rounds of the linear program, and the share of its scarcest length that a round covers.
ROUNDS, STEP = 400, 0.25
#: A price starts as the share of a sequence, slightly in favour of long pieces, and falls so fast with coverage.
LONG_FIRST, PACE = 1.1, 0.05
#: Bytes of the tasks' offsets that are broadcast at most; they are joined by shuffle beyond.
BROADCAST_BYTES = 64 << 20

_ENCODERS: dict[str, object] = {}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, pattern: str):
    """Byte-level BPE of a tokenizer file, one per worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {x["content"]: x["id"] for x in made["added_tokens"]}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(a, a + capacity) for a in range(first, n, capacity)]


def tokenised(docs: DataFrame, path: str, pattern: str, capacity: int, text_col: str) -> DataFrame:
    """One row per piece: row, piece, start, length, ids (little-endian uint32), and task and rank within it by length."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode = encoder(path, pattern).encode_to_numpy
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END_ID], "<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                doc, number, start, length, rank, ids = [], [], [], [], [], []
                for d, text in enumerate(pc.fill_null(b.column(1), "").to_pylist()):
                    made = np.concatenate([encode(text, allowed_special="all").astype("<u4"), end]) if text else end
                    for i, (x, y) in enumerate(cuts(len(made), capacity)):
                        doc.append(d)
                        number.append(i)
                        start.append(x)
                        length.append(y - x)
                        rank.append(seen[y - x])
                        seen[y - x] += 1
                        ids.append(made[x:y].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(doc), pa.int32()), pa.array(rank, pa.int64())],
                    ["row", "piece", "start", "length", "ids", "task", "rank"],
                )

    schema = T.StructType([rows.schema["row"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary").add("task", "integer").add("rank", "long")
    return rows.mapInArrow(run, schema)


def knapsack(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of sizes within the capacity of highest total price: index -> count, at most ``most`` of each."""
    worth = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, left, times = int(sizes[i]), int(min(most[i], capacity // sizes[i])), 1
        while left > 0:  # counts in powers of two
            n = min(times, left)
            with_it = worth[: capacity + 1 - n * size] + n * prices[i] if n * size <= capacity else worth[:0]
            if not len(with_it):
                break
            better = with_it > worth[n * size :]
            worth = np.concatenate([worth[: n * size], np.where(better, with_it, worth[n * size :])])
            taken.append((i, n, better))
            left, times = left - n, times * 2
    room, out = int(worth.argmax()), {}
    for i, n, better in reversed(taken):
        used = n * int(sizes[i])
        if room >= used and better[room - used]:
            out[i] = out.get(i, 0) + n
            room -= used
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """A fractional cover of the histogram: configuration (pairs of index and count) -> how many."""
    covered, found = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1)
        if not len(open_):
            break
        share = covered[open_]
        prices = (sizes[open_] / capacity) ** LONG_FIRST * np.exp(PACE * (share.mean() - share))
        config = knapsack(sizes[open_], prices, np.maximum(counts[open_], 1), capacity)
        key = tuple(sorted((int(open_[i]), n) for i, n in config.items()))
        amount = min(max(STEP, 1 / counts[i]) * counts[i] / n for i, n in key)
        found[key] = found.get(key, 0.0) + amount
        for i, n in key:
            covered[i] += amount * n / counts[i]
    return found


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in falling length, many equal pieces at a time: (contents, number of sequences)."""
    held: dict[int, list] = {}
    rooms: list[int] = []

    def put(room, contents, n):
        if n:
            if room not in held:
                held[room] = []
                insort(rooms, room)
            held[room].append((contents, n))

    for i in np.argsort(-sizes, kind="stable").tolist():
        size, left = int(sizes[i]), int(counts[i])
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                contents, n = held[room].pop()
                if not held[room]:
                    del held[room]
                    rooms.pop(at)
            else:
                room, contents, n = capacity, {}, left
            each = room // size
            full = min(n, left // each)
            put(room - each * size, {**contents, i: each}, full)
            left -= full * each
            n -= full
            if n and left:
                put(room - left * size, {**contents, i: left}, 1)
                left, n = 0, n - 1
            if contents or room < capacity:
                put(room, contents, n)
    return [g for groups in held.values() for g in groups]


def rounded(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the program's configurations, fullest first, and best fit for what they leave."""
    left, packed = counts.copy(), []
    found = configurations(sizes, left, capacity) if len(sizes) else {}
    for key, amount in sorted(found.items(), key=lambda x: (-sum(sizes[i] * n for i, n in x[0]), x[0])):
        n = min(int(amount), *(int(left[i]) // k for i, k in key))
        if n:
            packed.append((dict(key), n))
            for i, k in key:
                left[i] -= n * k
    return packed + best_fit(sizes, left, capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its segments (first rank, first sequence, pieces per sequence, first offset), and how many sequences."""
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    packed = min((rounded(sizes, counts, capacity), best_fit(sizes, counts, capacity)), key=lambda p: sum(n for _, n in p))
    segments: dict[int, list] = {s: [] for s in sizes.tolist()}
    used, sequence = np.zeros(len(sizes), np.int64), 0
    for contents, n in packed:
        offset = 0
        for i in sorted(contents, reverse=True):
            size, k = int(sizes[i]), contents[i]
            segments[size].append((int(used[i]), sequence, k, offset))
            used[i] += n * k
            offset += k * size
        sequence += n
    return segments, sequence


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, text_col: str = "text") -> DataFrame:
    """One row per piece: row (without the text), piece, start, length, ids, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = save(tokenised(docs, path, pattern, capacity, text_col), "pieces")
    by_task = pieces.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    histogram = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments, _ = plan(histogram, capacity)
    kind = "length long, segments array<struct<first:long,sequence:long,each:long,base:long>>"
    places = spark.createDataFrame([(s, x) for s, x in segments.items()], kind)  # at most ``capacity`` rows

    def dense(t: pa.Table) -> pa.Table:
        """One task's offsets, by length."""
        out = np.zeros(capacity + 1, np.int64)
        out[t.column("length").to_numpy()] = t.column("before").to_numpy()
        return pa.table({"task": t.column("task").slice(0, 1), "before": pa.array([out.tolist()], pa.list_(pa.int64()))})

    rows = save(offsets.groupBy("task").applyInArrow(dense, "task int, before array<long>"), "task-offsets")
    small = rows.count() * (capacity + 1) * 8 <= BROADCAST_BYTES
    ranked = pieces.join(F.broadcast(rows) if small else rows, "task").withColumn("rank", F.col("rank") + F.element_at("before", (F.col("length") + 1).cast("int"))).drop("before")
    placed = ranked.join(F.broadcast(places), "length").withColumn("s", F.element_at(F.filter("segments", lambda s: s["first"] <= F.col("rank")), -1))
    k = F.col("rank") - F.col("s.first")
    return placed.select("row", "piece", "start", "length", "ids", (F.col("s.sequence") + F.floor(k / F.col("s.each"))).alias("sequence_id"), (F.col("s.base") + k % F.col("s.each") * F.col("length")).alias("offset"))


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return done.select(F.col("row.doc_id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
