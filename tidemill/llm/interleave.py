"""Repeated intervals by merging shard Burrows-Wheeler transforms, byte by byte.

Each shard sorts its own suffixes once and keeps, for its sorted suffixes, the preceding byte (the
transform) and where the suffix that starts there stands (the LF step).  The merge sorts no suffix.  It
refines the interleave of the shards' orders: given all suffixes in the order of their first k bytes,
one stable pass by preceding byte gives the order by the first k + 1, since equal bytes keep their
order.  Neighbours that part in a pass have a common prefix of k bytes; those that stay together are an
interval of a string that occurs more than once.  A suffix that is alone closes, and so do all that
extend it to the left; strings that would cross a document's end close at once.

Every pass touches each open suffix, so a depth of 400 takes 400 passes over all repeated bytes.  README
has the measured cost; ``bwt_dedup`` takes the steps by phrase instead and is held to this by tests.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """Sorted suffixes of some documents: start in the buffer, preceding byte (-1 at a document's start), place of the preceding suffix, first byte."""

    start: np.ndarray
    before: np.ndarray
    step: np.ndarray
    first: np.ndarray


def shard(buf: np.ndarray, offs: np.ndarray, depth: int) -> Shard:
    """Suffixes of all documents, in the order of their first ``depth`` bytes at least, by doubling; a document's end sorts first."""
    n = len(buf)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # bytes up to the document's end
    rank, known = buf.astype(np.int64) + 1, 1
    while known < depth and n:
        ahead = np.where(left > known, rank[np.minimum(np.arange(n) + known, n - 1)], 0)
        _, rank = np.unique(rank << 32 | ahead, return_inverse=True)
        rank, known = rank.astype(np.int64) + 1, known * 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    head = np.zeros(n + 1, bool)
    head[offs] = True
    before = np.where(head[order], -1, buf[order - 1].astype(np.int64))
    return Shard(order, before, np.where(before < 0, -1, place[order - 1]), buf[order].astype(np.int64))


def repeated(shards: list[Shard], lengths: list[np.ndarray], depth: int) -> tuple[list[np.ndarray], int]:
    """For each shard the starts whose next ``depth`` bytes occur more than once in all shards, and how many suffixes all passes touched.

    ``lengths``: for each start of a shard, the bytes up to its document's end.
    """
    base = np.r_[0, np.cumsum([len(s.start) for s in shards])]
    before = np.concatenate([s.before for s in shards])
    step = np.concatenate([np.where(s.step < 0, -1, s.step + b) for s, b in zip(shards, base, strict=False)])
    first = np.concatenate([s.first for s in shards])
    room = np.concatenate([n[s.start] for s, n in zip(shards, lengths, strict=True)])
    item = np.argsort(first, kind="stable")  # the interleave at depth 1
    group, touched = first[item], len(item)
    for known in range(1, depth + 1):
        new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        part = np.cumsum(new) - 1
        open_ = np.bincount(part)[part] > 1 if len(part) else new
        item, part = item[open_], part[open_]
        if known == depth or not len(item):
            break
        byte = before[item]
        order = np.argsort(byte, kind="stable")
        order = order[np.searchsorted(byte[order], 0) :]  # nothing precedes a document's first byte
        touched += len(order)
        item, group = step[item[order]], part[order] << 8 | byte[order]
    whole = np.sort(item[room[item] >= depth])
    return [np.sort(s.start[whole[(whole >= a) & (whole < b)] - a]) for s, a, b in zip(shards, base[:-1], base[1:], strict=True)], touched
