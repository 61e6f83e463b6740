"""Line dedup: range-partitioned line hashes with a secondary sort, and keep bitmaps instead of texts.

A line's key is the line without spaces at its ends, A-Z lower-cased.  Long enough keys become records
of two hashes, id, row and position, written once.  The records are range-partitioned and sorted by
(hashes, id from the largest, row, position): the order is total, so a key that a third of all rows
hold is split over many tasks like any other.  Each task streams its rows once and knows from the
order alone which document holds a key first (the largest id) and how many do.  Only a key that lies
across the border of two tasks stays open there; each task reports its two border keys, and the open
rows are settled against these reports (two rows a task).

What comes back is no text but a compressed bitmap per document, which the documents then join.

Defined results: a null or empty text is one empty line; rows of one id count as one document; null
ids are one document, less than all others; a long text counts whole, and one document's dropped
positions are held at once; repeated rows get equal results; ties in the order are rows that are equal
in all that counts; an empty table gives an empty one; input columns travel in the struct ``row`` and
cannot clash.  Keys are told apart by 96 bits of hash, so results are exact but for collisions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cells import NULL_ID, addressed, partitions, save

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Characters stripped at both ends of a line, and the letters that are lower-cased.
STRIP = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY, RECORD = ["h", "g"], ["h", "g", "doc", "uid", "pos"]
DROP, OPEN, BORDER = 0, 1, 2
COLUMNS = ["kind", *RECORD, "n", "first_doc", "last_doc", "task"]
DECIDED = "kind int, h long, g int, doc long, uid long, pos int, n long, first_doc long, last_doc long, task int"


def lower_ascii(c):
    """A-Z lower-cased, other letters as they are; ``lower`` does the same, faster, where there are no others."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def line_records(rows: DataFrame, least_chars: int) -> DataFrame:
    """h, g, doc, uid, pos and a tie for every line whose key is long enough, from rows with uid, doc_id and text."""
    lines = rows.select("uid", F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc", "uid", "pos", F.btrim("line", F.lit(STRIP)).alias("key")).where(F.length("key") >= least_chars)
    low = keys.withColumn("key", lower_ascii(F.col("key")))
    return low.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc", "uid", "pos", F.monotonically_increasing_id().alias("tie"))


class _Stream:
    """Decisions on one task's sorted records, which come in batches.

    A key that is done within the task is settled at once.  A key that goes on is held until it has
    been found in enough documents; from then on all its rows but those of its first document drop.
    """

    def __init__(self, task: int, least_docs: int):
        self.task, self.least, self.held, self.began = task, least_docs, None, False
        self.border = True  # the key at hand may have begun in another task
        self.n = self.first = self.last = 0  # of the part of the open key that is no longer held

    @staticmethod
    def _part(r: dict, at) -> dict:
        return {k: v[at] for k, v in r.items()}

    def _out(self, kind: int, r: dict) -> pa.RecordBatch:
        n = len(r["h"])
        same = np.zeros(n, bool)
        if n:  # a row that is listed twice
            same[1:] = np.logical_and.reduce([r[k][1:] == r[k][:-1] for k in RECORD])
        r = self._part(r, ~same)
        n = len(r["h"])
        zero = np.zeros(n, np.int64)
        columns = [np.full(n, kind, np.int32), *[r[k] for k in RECORD], zero, zero, zero, np.full(n, self.task, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=COLUMNS)

    def _report(self, h, g) -> pa.RecordBatch:
        values = (BORDER, h, g, 0, 0, 0, self.n, self.first, self.last, self.task)
        kinds = [np.int32 if c in ("kind", "g", "pos", "task") else np.int64 for c in COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array(np.array([v], kind)) for v, kind in zip(values, kinds, strict=True)], names=COLUMNS)

    def _take(self, r: dict) -> None:
        """Count further rows of the open key."""
        doc = r["doc"]
        if not len(doc):
            return
        fresh = np.count_nonzero(doc[1:] != doc[:-1]) + (self.n == 0 or int(doc[0]) != self.last)
        if self.n == 0:
            self.first = int(doc[0])
        self.n, self.last = self.n + int(fresh), int(doc[-1])

    def feed(self, batch: pa.RecordBatch):
        r = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in RECORD}
        if not len(r["h"]):
            return
        new = np.r_[True, (r["h"][1:] != r["h"][:-1]) | (r["g"][1:] != r["g"][:-1])]
        if self.began and (r["h"][0], r["g"][0]) == self.key:
            new[0] = False
        starts = np.flatnonzero(new)
        lead = self._part(r, slice(0, starts[0] if len(starts) else len(r["h"])))
        if len(lead["h"]):
            yield from self._go_on(lead)
        if not len(starts):
            return
        if self.began:
            yield from self._close()
        # keys that begin and end in this batch, but for the task's first
        inner = starts[0 if self.began else 1 :]
        if not self.began:
            yield from self._open(self._part(r, slice(0, inner[0] if len(inner) else len(r["h"]))), True)
            if not len(inner):
                return
            yield from self._close()
        lo, hi = inner[0], inner[-1]
        if hi > lo:
            yield self._settled(self._part(r, slice(lo, hi)), inner[:-1] - lo)
        yield from self._open(self._part(r, slice(hi, None)), False)

    def _settled(self, r: dict, starts: np.ndarray) -> pa.RecordBatch:
        size = np.diff(np.r_[starts, len(r["h"])])
        doc_new = np.r_[True, r["doc"][1:] != r["doc"][:-1]]
        doc_new[starts] = True
        docs = np.add.reduceat(doc_new, starts)
        drop = np.repeat(docs >= self.least, size) & (r["doc"] != np.repeat(r["doc"][starts], size))
        return self._out(DROP, self._part(r, drop))

    def _open(self, r: dict, border: bool):
        self.began, self.border, self.held = True, border, []
        self.key = (r["h"][0], r["g"][0])
        self.n = 0
        yield from self._go_on(r)

    def _go_on(self, r: dict):
        self._take(r)
        if self.border:  # what the tasks before hold of it is not known here
            yield self._out(OPEN, r)
            return
        self.held.append(r)
        if self.n >= self.least:
            for x in self.held:
                yield self._out(DROP, self._part(x, x["doc"] != self.first))
            self.held = []
        else:  # rows of the first document never drop here, but a later task may settle nothing else for them
            self.held = [x for x in (self._part(x, x["doc"] != self.first) for x in self.held) if len(x["h"])]

    def _close(self, last: bool = False):
        """The open key ends here, or with the task."""
        if self.border or last:
            yield self._report(*map(int, self.key))
        if last and not self.border:
            for x in self.held:
                yield self._out(OPEN, x)
        self.held, self.began = [], True

    def end(self):
        if self.began:
            yield from self._close(True)


def dropped_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, uid and pos of every line that goes."""
    spark = docs.sparkSession
    records = save(line_records(addressed(docs, id_col, text_col).select("uid", "doc_id", "text"), least_chars), "line-records")
    order = ["h", "g", F.col("doc").desc(), "uid", "pos", "tie"]
    dealt = records.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        stream = _Stream(TaskContext.get().partitionId(), least_docs)
        for b in batches:
            yield from stream.feed(b)
        yield from stream.end()

    decided = save(dealt.mapInArrow(run, DECIDED), "line-decisions")
    # parts of one key, in the order of the tasks; a document on a border counts once
    borders = decided.where(F.col("kind") == BORDER).select(*KEY, F.struct("task", "n", "first_doc", "last_doc").alias("p"))
    parts = borders.groupBy(*KEY).agg(F.array_sort(F.collect_list("p")).alias("p"))  # a part for each task at most
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    add = lambda s, p: F.struct((s["n"] + p["n"] - F.when(s["last"] == p["first_doc"], 1).otherwise(0)).alias("n"), p["last_doc"].alias("last"))
    totals = parts.select(*KEY, F.get("p", F.lit(0))["first_doc"].alias("top"), F.aggregate("p", start, add)["n"].alias("total"))
    # two keys a task at most
    settled = decided.where(F.col("kind") == OPEN).join(F.broadcast(totals), KEY).where((F.col("total") >= least_docs) & (F.col("doc") != F.col("top")))
    return decided.where(F.col("kind") == DROP).select("doc", "uid", "pos").union(settled.select("doc", "uid", "pos"))


def _bitmap(dropped: np.ndarray) -> bytes:
    bits = np.ones(int(dropped[-1]) + 1, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes() + len(bits).to_bytes(4, "little"), 1)


def keeps(bitmap: bytes) -> np.ndarray:
    """Which of the first lines stay; those behind the bitmap's end all do."""
    raw = zlib.decompress(bitmap)
    return np.unpackbits(np.frombuffer(raw[:-4], np.uint8))[: int.from_bytes(raw[-4:], "little")].astype(bool)


def keep_bitmaps(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, uid and the compressed ``bitmap`` of every document that loses lines; documents that lose none have no row."""
    spark = docs.sparkSession
    dropped = dropped_lines(docs, text_col, id_col, least_chars, least_docs)
    dealt = dropped.repartition(partitions(spark), "doc", "uid").sortWithinPartitions("doc", "uid", "pos")

    def run(batches):
        held: list = []  # of the document that may go on in the next batch
        key = None

        def made(doc, uid, parts):
            return doc, uid, _bitmap(np.unique(np.concatenate(parts)))

        def table(rows):
            doc, uid, bitmap = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(uid, pa.int64()), pa.array(bitmap, pa.binary())], names=["doc", "uid", "bitmap"])

        for b in batches:
            doc, uid, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "uid", "pos"))
            if not len(doc):
                continue
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1])) + 1
            out = []
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(doc)].tolist(), strict=True):
                now = (int(doc[lo]), int(uid[lo]))
                if held and now != key:
                    out.append(made(*key, held))
                    held = []
                key = now
                held.append(pos[lo:hi])
            if out:
                yield table(out)
        if held:
            yield table([made(*key, held)])

    return dealt.mapInArrow(run, "doc long, uid long, bitmap binary")


def without_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Each input row as ``row`` (without its text) with n_lines, n_dropped and the ``text`` that stays."""
    bitmaps = save(keep_bitmaps(docs, text_col, id_col, least_chars, least_docs), "line-bitmaps")
    rows = addressed(docs, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(int(NULL_ID)))).select("row", "doc", "uid", F.coalesce("text", F.lit("")).alias("text"))
    # bitmaps are the built side, so texts pass by unsorted
    joined = rows.join(bitmaps.hint("shuffle_hash"), ["doc", "uid"], "left").select("row", "text", "bitmap")
    schema = T.StructType([joined.schema["row"]]).add("n_lines", "long").add("n_dropped", "long").add("text", "string")

    def run(batches):
        for b in batches:
            texts, n_lines, n_dropped = b.column("text"), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            n_lines[:] = pa.compute.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1
            with_gaps = np.flatnonzero(b.column("bitmap").is_valid().to_numpy(zero_copy_only=False))
            if len(with_gaps):
                kept = texts.to_pylist()
                for i in with_gaps.tolist():
                    lines, keep = kept[i].split("\n"), keeps(b.column("bitmap")[i].as_py())
                    n_dropped[i] = len(keep) - np.count_nonzero(keep)
                    kept[i] = "\n".join([x for x, k in zip(lines, keep.tolist(), strict=False) if k] + lines[len(keep) :])
                texts = pa.array(kept, texts.type)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_lines), pa.array(n_dropped), texts], names=["row", "n_lines", "n_dropped", "text"])

    return joined.mapInArrow(run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = without_lines(docs)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_STRIPPED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP13_SQL = f"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate({_STRIPPED}, '{UPPER}', '{UPPER.lower()}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
j AS (SELECT k.doc_id, line, pos, top IS NOT NULL AND k.doc_id <> top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
