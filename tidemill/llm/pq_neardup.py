"""Embedding near-dedup by product quantisation.

Distinct vectors are put on coarse inverted lists (spherical k-means), and their residuals coded in
subspaces.  A query probes every list that two bounds cannot exclude (``Quantiser.within``): the angle
to the centroid against the widest angle on the list, and the distance to the border between the
list and the query's own.  On a list, the codes give the
query's distance to every coded vector.  A code comes with its own error, so a vector is passed over
only if the triangle inequality rules it out; all others are compared exactly, by cosine in double
precision.  No link is missed, and none below the threshold is kept.

Equal vectors are folded first and count by their number.  Lists are grouped (or cut) into parts of
about PART vectors, which meet in pairs: a vector travels once to each part that it may link with, and
no task holds more than two parts.  Tasks add up link counts and send on only links that join what was
apart, never all pairs.

The quantisers are fit on a bounded sample (SAMPLE distinct vectors, least hash first); all vectors
are indexed.  Lists hold about LIST_SIZE vectors each up to MAX_LISTS lists.  Where vectors lie far
from their centroids the bounds exclude little, and comparisons grow with the square of the rows.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing
and stay alone; vectors of different lengths never link, and each length is searched by itself; a
null vec_id has component null unless it links to others; ties and repeated rows count each for itself
and link with each other; an empty table gives an empty one; other input columns travel in ``row``
and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import cells as C
from tidemill.llm.cells import save
from tidemill.llm.graph import components, spanning
from tidemill.llm.textvec import mix

SAMPLE, LIST_SIZE, MAX_LISTS = 16384, 256, 4096
SUBSPACES, CODES = 8, 256
#: Vectors of a part, vectors that are asked about at once, and records that a map task holds at once.
PART, BLOCK, SENT = 8192, 2048, 16384


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids, starting from evenly spaced rows; an empty one keeps its place."""
    at = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, at)
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        at[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    half = (at * at).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ at.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        dims = sample.shape[1]
        self.lists = min(lists, max(1, len(sample) // 8))
        self.coarse = k_means(sample, self.lists)
        self.coarse /= np.maximum(np.linalg.norm(self.coarse, axis=1, keepdims=True), 1e-12)
        self.parts = np.array_split(np.arange(dims), min(SUBSPACES, dims))
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [k_means(residual[:, p], min(CODES, len(sample)), 6) for p in self.parts]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and the cosine to its centroid."""
        score = x @ self.coarse.T
        home = score.argmax(1)
        return home, score[np.arange(len(x)), home]

    def within(self, x: np.ndarray, home: np.ndarray, which: np.ndarray, least: np.ndarray, threshold: float) -> np.ndarray:
        """(vectors, lists): true unless no vector of the list can have that cosine.  ``least`` is the least cosine to the centroid on each list, 2 if it is empty."""
        score = x @ self.coarse[which].T
        angle = lambda c: np.arccos(np.clip(c, -1, 1))
        near = (least[which] <= 1.5) & (angle(score) - angle(least[which]) <= angle(threshold) + 1e-6)
        # a list's vectors are on its side of the border to the query's own list
        gap = np.sqrt(np.maximum(2 - 2 * self.coarse[home] @ self.coarse[which].T, 1e-12))
        own = np.einsum("ij,ij->i", x, self.coarse[home])
        near &= (own[:, None] - score) / gap <= np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        return near | (home[:, None] == which)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the error of each."""
        r = x - self.coarse[lists]
        codes = np.stack([nearest(r[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(r - back, axis=1)

    def squared(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of unit queries to the coded vectors of a list."""
        back = self.coarse[which] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return (1 + (back * back).sum(1)) - 2 * (queries @ back.T)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def near_links(classes: DataFrame, threshold: float, kind: str = "<f8") -> tuple[DataFrame, DataFrame]:
    """From distinct valid vectors (node, weight, vector): link counts (node, n) and spanning edges (a, b).  Components travel as ``kind``, which holds them exactly."""
    spark = classes.sparkSession
    sample = unit(_matrix(classes.orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).select("vector").toArrow().column("vector")))
    n = classes.count()
    shared = spark.sparkContext.broadcast(Quantiser(sample, int(min(MAX_LISTS, max(1, n // LIST_SIZE)))))  # at most MAX_LISTS vectors and the books
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    lists = shared.value.lists

    def farthest(batches):
        for b in batches:
            home, cosine = shared.value.home(unit(_matrix(b.column(0))))
            least = np.full(lists, 2.0)
            np.minimum.at(least, home, cosine)
            n = np.bincount(home, minlength=lists)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(least[held]), pa.array(n[held], pa.int64())], ["list", "least", "n"])

    least, held = np.full(lists, 2.0), np.zeros(lists, np.int64)
    for r in classes.select("vector").mapInArrow(farthest, "list int, least double, n long").groupBy("list").agg(F.min("least").alias("least"), F.sum("n").alias("n")).collect():  # at most MAX_LISTS rows
        least[r.list], held[r.list] = r.least - 1e-9, r.n
    cuts = np.maximum(1, -(-held // PART))  # parts of a list
    first = np.zeros(lists, np.int64)
    part, room = -1, -1
    for i in range(lists):
        if cuts[i] > 1 or held[i] > room:
            part, room = part + 1, PART
        first[i] = part
        room = room - held[i] if cuts[i] == 1 else 0
        part += cuts[i] - 1
    parts = int(part) + 1
    covers = (first[:, None] <= np.arange(parts)) & (np.arange(parts) < (first + cuts)[:, None])  # lists by parts
    dims = sample.shape[1]
    record = np.dtype([("part", "<i4"), ("home", "<i4"), ("node", "<i8"), ("weight", "<i8"), ("error", "<f8"), ("x", kind, (dims,)), ("codes", "u1", (len(shared.value.parts),))])

    def members(batches):
        q = shared.value
        step = max(1, min(1000, SENT // parts))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                made = np.zeros(b.num_rows, record)
                made["x"] = _matrix(b.column(2))
                x = unit(made["x"])
                made["node"], made["weight"] = b.column(0).to_numpy(), b.column(1).to_numpy()
                home, _ = q.home(x)
                made["home"], (made["codes"], made["error"]) = home, q.encode(x, home)
                own = made["part"] = first[home] + (mix(made["node"].view(np.uint64)) % cuts[home].astype(np.uint64)).astype(np.int64)
                row, other = np.nonzero(q.within(x, home, np.arange(lists), least, threshold).astype(np.float32) @ covers.astype(np.float32))
                pair = np.minimum(own[row], other) * parts + np.maximum(own[row], other)
                yield C.packed(pair.astype(np.int32), made[row])

    def compare(t: pa.Table) -> pa.Table:
        q_ = shared.value
        i, j = divmod(t.column("bucket")[0].as_py(), parts)
        a = C.unpacked(t.column("cell"), record)
        ask, data = a[a["part"] == i], a[a["part"] == j]
        data = data[np.lexsort((data["node"], data["home"]))]
        units = unit(data["x"])
        cut = np.flatnonzero(np.r_[True, data["home"][1:] != data["home"][:-1], True]) if len(data) else np.zeros(1, np.int64)
        which = data["home"][cut[:-1]]
        names = np.unique(a["node"])
        n = np.zeros(len(names), np.int64)
        at_ask, at_data = np.searchsorted(names, ask["node"]), np.searchsorted(names, data["node"])
        left, right = [], []
        for start in range(0, len(ask), BLOCK):
            x, home = unit(ask["x"][start : start + BLOCK]), ask["home"][start : start + BLOCK]
            near = q_.within(x, home, which, least, threshold)
            for k, (u, v) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                rows = np.flatnonzero(near[:, k])
                q, d = np.nonzero(q_.squared(x[rows], int(which[k]), data["codes"][u:v]) <= (reach + data["error"][u:v] + 1e-9) ** 2)
                q, d = rows[q], d + u
                e, f = at_ask[start:][q], at_data[d]
                hit = np.flatnonzero(e != f)
                hit = hit[np.concatenate([np.einsum("ij,ij->i", x[q[h]], units[d[h]]) for h in np.array_split(hit, len(hit) // 65536 + 1)]) >= threshold]
                if not len(hit):
                    continue
                q, d, e, f = q[hit], d[hit], e[hit], f[hit]
                np.add.at(n, e, data["weight"][d])
                if i != j:  # within a part the other side asks too
                    np.add.at(n, f, ask["weight"][start:][q])
                e, f = spanning(len(names), [(e, f)])
                left.append(names[e])
                right.append(names[f])
        some = n > 0
        e, f = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (left, right))
        return pa.table({"node": np.r_[names[some], e], "n": np.r_[n[some], np.zeros(len(e), np.int64)], "other": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(f)])})

    cells = classes.select("node", "weight", "vector").mapInArrow(members, C.CELLS)
    found = save(cells.groupBy("bucket").applyInArrow(compare, "node long, n long, other long"), "pq-links")
    return found.where("other is null").groupBy("node").agg(F.sum("n").alias("n")), found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def pq_neardup(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each input row as ``row`` (without its vector) with n_links and component (the least id reached)."""
    others = [F.col(f"`{c}`") for c in rows.columns if c != vector_col]
    vector = F.col(vector_col).cast("array<double>")
    whole = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0), F.lit(False))
    given = rows.select(F.struct(*others).alias("row"), F.col(id_col).cast("long").alias("id"), F.when(whole, vector).alias("vector"))
    known = given.where("vector is not null").groupBy("vector").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    classes = save(known.withColumn("node", F.monotonically_increasing_id()), "pq-classes")
    sizes = classes.groupBy(F.size("vector").alias("k")).count().orderBy("k").collect()  # one row for each length of vectors
    if not sizes:
        return given.select("row", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    kind = "<f4" if rows.schema[vector_col].dataType == T.ArrayType(T.FloatType(), rows.schema[vector_col].dataType.containsNull) else "<f8"
    found = [near_links(classes.where(F.size("vector") == r.k), threshold, kind) for r in sizes if r["count"] > 1]
    counts, edges = classes.select("node", F.lit(0).cast("long").alias("n")).limit(0), classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for c, e in found:
        counts, edges = counts.union(c), edges.union(e)
    roots = components(edges)
    joined = classes.join(roots, "node", "left").join(counts, "node", "left").select("vector", "weight", "least", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    by_vector = joined.join(least, "root").select("vector", (F.col("weight") - 1 + F.col("n")).alias("n_links"), "component")
    return given.join(by_vector, "vector", "left").select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op3(spark, sf_dir: str) -> DataFrame:
    done = pq_neardup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return done.select(F.col("row.vec_id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("row.vec_id") == F.col("component"), F.lit(True)).alias("kept"))
