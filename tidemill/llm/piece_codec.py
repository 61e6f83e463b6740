"""SentencePiece encoding and decoding, exact for merge-type models with byte fallback.

Encoding takes no merge loop over the text.  An Aho-Corasick automaton lists the pieces that match at
each position; the encoder takes the longest one, accepts it if it is compatible with the piece
before it, else tries the next shorter one, and where none is left marks the position as failed and
goes back.  Two pieces are compatible if merging their joined characters again, in score order, gives
just these two; only merges next to the border can tell, so those are taken back and tried again.  A sequence is the model's encoding exactly if all neighbours are compatible, and the
encoding of each prefix is unique, so a failed position fails for every way to reach it: one bit each.

Texts are cut first where no piece can reach across: between a character and a following space mark,
and around characters that no piece holds.  Such units repeat, so each worker keeps a bounded cache.

Defined results: a null text is empty; an empty text has the end id only (if asked for); very long
texts and units need memory in proportion to their own length only; among ties the library's own order of
merges counts; repeated rows are encoded each for itself; an empty table gives an empty one; input columns
travel in ``row`` and cannot clash.
"""

from __future__ import annotations

import heapq
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


MARK = "▁"
#: Entries of each worker's caches; two such generations are held.
CACHE_UNITS = 500_000
LONG_UNIT = 64


class PieceModel:
    """Vocabulary of a sentencepiece model file of merge type, identity normaliser, with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rule = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or rule.precompiled_charsmap or rule.remove_extra_whitespaces:
            raise ValueError("needs a merge-type model with byte fallback and without text normalisation")
        self.prefix = rule.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: dict[int, bytes] = {}
        self.text: dict[int, str] = {}
        self.control, self.unknown = set(), 0
        trie = ahocorasick.Automaton()
        for i, piece in enumerate(proto.pieces):
            if piece.type == 6:
                value = int(piece.piece[1:-1], 16)
                self.byte[value], self.raw[i] = i, bytes([value])
            elif piece.type == 3:
                self.control.add(i)
            elif piece.type == 2:
                self.unknown = i
            else:
                self.text[i] = piece.piece
                self.id[piece.piece], self.score[piece.piece] = i, piece.score
                trie.add_word(piece.piece, (i, len(piece.piece)))
        trie.make_automaton()
        self.trie = trie
        self.end = next((i for i, p in enumerate(proto.pieces) if p.piece == "</s>"), -1)
        held = set("".join(self.id))
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in held)
        coarse = f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + f"|[{lone}]" * bool(lone)
        fine = f"{MARK}*[^\\W\\d_]+|{MARK}*(?:[^\\w{MARK}{lone}]|[\\d_])+|{MARK}+" + f"|[{lone}]" * bool(lone)
        # A cut is safe if no piece has one inside; letters and other characters part if the vocabulary allows it.
        safe = (re.compile(x).findall for x in (fine, coarse, r"(?s).+"))
        self.units = next(f for f in safe if all(len(f(p)) == 1 for p in self.id))
        self.plain = [b""] * len(proto.pieces)
        for i, piece in self.text.items():
            self.plain[i] = piece.replace(MARK, " ").encode()
        for i, value in self.raw.items():
            self.plain[i] = value
        self._pairs: dict[tuple, bool] = {}
        self._splits: dict[str, tuple[str, str] | None] = {}
        self.ids = _Cache(self.encode_unit)

    def merged(self, text: str, trace: list[int] | None = None) -> list[str]:
        """The pieces that merging in score order leaves, the leftmost of equal scores first; trace gets each border that went."""
        score, part, n = self.score, list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-score[text[i : i + 2]], i, text[i : i + 2]) for i in range(n - 1) if text[i : i + 2] in score]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j < 0 or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, ""
            if trace is not None:
                trace.append(j)
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (both := part[a] + part[b]) in score:
                    heapq.heappush(heap, (-score[both], a, both))
        return [p for p in part if p]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge last into a piece; none for a character or a piece that merging never makes."""
        if piece not in self._splits:
            found = None
            if len(piece) > 1:
                trace: list[int] = []
                if self.merged(piece, trace) == [piece]:
                    found = piece[: trace[-1]], piece[trace[-1] :]
            self._splits[piece] = found
        return self._splits[piece]

    def compatible(self, left: str, right: str) -> bool:
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= CACHE_UNITS:
                self._pairs.clear()
            found = self._pairs[left, right] = self._stays(left, right)
        return found

    def _stays(self, left: str, right: str) -> bool:
        """Whether merging left + right again leaves the border: take back merges next to it, last one first,
        and see whether a merge across it would have gone before the one taken back.  Of equal scores the
        leftmost goes first: a merge inside ``left`` precedes one across, one inside ``right`` follows it."""
        if any(len(p) > 1 and self.split(p) is None for p in (left, right)):
            return False
        if not left:
            return True
        score, last, none = self.score, (-1e30, 1), (1e30, 0)
        while True:
            across = score.get(left + right)
            if across is not None and (across, 0) > last:
                return False
            inner = (score[left], 1) if len(left) > 1 else none
            outer = (score[right], -1) if len(right) > 1 else none
            if inner is none and outer is none:
                return True
            if inner < outer:
                last, left = inner, self.split(left)[1]
            else:
                last, right = outer, self.split(right)[0]

    def pieces(self, unit: str) -> list[str]:
        """The encoding of a unit as strings, by backtracking over longest matches."""
        n = len(unit)
        lengths: list[list[int]] = [[] for _ in range(n)]
        for end, (_, size) in self.trie.iter(unit):
            lengths[end - size + 1].append(size)
        for options in lengths:
            if not options or options[0] != 1:
                options.insert(0, 1)
        failed = bytearray((n >> 3) + 1)
        pairs, compatible = self._pairs.get, self.compatible
        out, at, last = [], 0, ""
        tried = [lengths[0]] if n else []
        while at < n:
            options = tried[-1]
            while options:
                to = at + options[-1]
                if not failed[to >> 3] >> (to & 7) & 1:
                    piece = unit[at:to]
                    known = pairs((last, piece))
                    if known or known is None and compatible(last, piece):
                        break
                options.pop()
            if options:
                out.append(piece)
                at, last = to, piece
                if at < n:
                    tried.append(lengths[at])
            else:
                failed[at >> 3] |= 1 << (at & 7)
                tried.pop()
                at -= len(out.pop())
                last = out[-1] if out else ""
                tried[-1].pop()
        return out

    def encode_unit(self, unit: str) -> bytes:
        out = []
        for piece in self.pieces(unit):
            found = self.id.get(piece)
            out += [found] if found is not None else [self.byte[b] for b in piece.encode()]
        return array("i", out).tobytes()

    def encode(self, text: str, end: bool = True) -> bytes:
        """Ids as little-endian int32."""
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""
        return b"".join(map(self.ids.__getitem__, self.units(marked))) + (np.array([self.end], "<i4").tobytes() if end else b"")

    def decode(self, ids) -> str:
        """Text of any ids: control ids vanish, runs of byte pieces are read as UTF-8, the space before the text goes."""
        out, run, begun = [], b"", False

        def flush():
            nonlocal run
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                run = run[size:]

        for i in ids:
            if i in self.raw:
                run += self.raw[i]
                begun = True
                continue
            flush()
            if i in self.control:
                continue
            piece = self.text.get(i, " ⁇ ").replace(MARK, " ")
            if not begun and self.prefix and piece.startswith(" ") and i != self.unknown:
                piece = piece[1:]
            begun = True
            out.append(piece)
        flush()
        return "".join(out)

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids with the end id, and their decoding.  What encoding gives never breaks a character, so its bytes can be joined."""
        ids = self.encode(text)
        raw = b"".join(map(self.plain.__getitem__, array("i", ids)))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return ids, raw.decode()


class _Cache(dict):
    """Results by unit; when full, the older half goes, but for units that were met again since."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= LONG_UNIT:
            if len(self) >= CACHE_UNITS:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def piece_codec(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Each input row as ``row`` (without its text) with ``ids`` (array of int, end id last) and their ``decoded`` text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [m.round_trip(x) for x in pc.fill_null(b.column(1), "").to_pylist()]
                ids = np.frombuffer(b"".join(x[0] for x in made), "<i4")
                offsets = np.r_[0, np.cumsum([len(x[0]) >> 2 for x in made])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array([x[1] for x in made], pa.string())], ["row", "ids", "decoded"])

    schema = T.StructType([rows.schema["row"]]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return rows.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = piece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
