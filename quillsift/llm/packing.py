"""Packing documents into windows of fixed length, by best-fit decreasing.

Documents are cut into pieces: full windows first, then the rest.  Pieces are placed from
the longest to the shortest, each into the open window with the least room that still takes
it (ties: the window opened first), found by a segment tree indexed by remaining capacity.

Best-fit decreasing sees only lengths, and all pieces of a length are alike, as are all
windows with the same room.  So the exact global packing is planned on the driver from the
histogram of lengths, which has at most ``CAPACITY`` rows whatever the corpus: one step of
the plan fills a run of equal windows with a run of equal pieces.  Executors then look up
each piece's window from its length and its rank among the pieces of that length.

Defined results: null, empty and blank texts have no tokens and no piece; a null ``doc_id``
is packed like any other; rows that repeat a ``doc_id`` are packed each; pieces of one
length are ordered by the hash of (doc_id, piece); an empty table gives an empty result;
other columns are not read.  Tokens are the maximal runs of non-blank characters, counted
over whole texts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunk_bits, materialize, ranked

CAPACITY = 2048


class CapacityTree:
    """Segment tree over remaining capacities 0..n: which of them have an open window."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, at: int, some: bool) -> None:
        at += self.size
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity that is at least ``need`` and has an open window."""
        at = need + self.size
        while not self.some[at]:
            while at & 1:  # a right child: all that is left lies above
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.size


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Steps (length, first rank, first window, pieces a window, offset in the window), sorted.

    The pieces of a length from a step's first rank on, up to the next step's, go in order
    into consecutive windows, so many to each, from that offset on.
    """
    return planned(lengths, capacity)[0]


def planned(lengths: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The steps, and the number of windows."""
    tree, rooms, steps, opened = CapacityTree(capacity), {}, [], 0

    def push(room: int, first: int, n: int) -> None:
        runs = rooms.setdefault(room, [])
        heapq.heappush(runs, (first, n))
        if len(runs) == 1:
            tree.set(room, True)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                push(capacity, opened, n)
                opened, room = opened + n, capacity
            first, n = heapq.heappop(rooms[room])
            if not rooms[room]:
                tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            for windows, pieces in ((full, each), (int(full < n), left - full * each if full < n else 0)):
                if windows and pieces:
                    steps.append((length, rank, first, pieces, capacity - room))
                    push(room - pieces * length, first, windows)
                    rank, left = rank + windows * pieces, left - windows * pieces
                    first, n = first + windows, n - windows
            if n:
                push(room, first, n)
    return np.array(sorted(steps), np.int64).reshape(-1, 5), opened


_PLACE = T.StructType([T.StructField("window", T.LongType()), T.StructField("offset", T.LongType())])


def _placer(steps: np.ndarray, capacity: int):
    """Places of pieces by their key, length and part in one number, and their rank among those of that key."""
    keys = steps[:, 0] * (1 << 44) + steps[:, 1]

    @F.arrow_udf(_PLACE)
    def place(of: pa.Array, ranks: pa.Array) -> pa.Array:
        key, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (of, ranks))
        _, lo, first, each, base = steps[np.searchsorted(keys, key * (1 << 44) + rank, "right") - 1].T
        window = first + (rank - lo) // each
        offset = base + (rank - lo) % each * (key % (capacity + 1))
        return pa.StructArray.from_arrays([pa.array(window), pa.array(offset)], names=["window", "offset"])

    return place


def packed(docs: DataFrame, capacity: int = CAPACITY, chunk_rows: int = 100_000, first: str | None = None) -> DataFrame:
    """One row a piece: window_id, window_offset, doc_id, piece, doc_offset, n_tokens.

    With ``first``, a boolean column, the documents for which it holds are packed as if there
    were no others, and the others, packed likewise, take the windows after theirs; the column
    is returned last.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint")
    sized = materialize(docs.select("doc_id", tokens.alias("n"), (F.lit(0) if first is None else F.when(F.col(first), 0).otherwise(1)).alias("part")).where("n > 0"), "tokens")
    last = F.ceil(F.col("n") / capacity) - 1
    cut = sized.select("doc_id", "n", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    length = F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity)
    pieces = cut.select("doc_id", "piece", (F.col("part") * (capacity + 1) + length).alias("key"))
    counts = {r["key"]: r["count"] for r in pieces.groupBy("key").count().collect()}  # at most ``capacity`` rows a part
    steps, opened = [], 0
    for part in (0, capacity + 1):
        own, windows = planned({k - part: n for k, n in counts.items() if 0 < k - part <= capacity}, capacity)
        steps.append(own + [part, 0, opened, 0, 0])
        opened += windows
    place = _placer(np.concatenate(steps), capacity)
    order = F.xxhash64("doc_id", "piece")
    bits = [chunk_bits(counts.get(k, 0), chunk_rows) for k in range(2 * (capacity + 1))]
    at = ranked(pieces, "key", order, bits, 0, "rank").withColumn("at", place(F.col("key"), F.col("rank")))
    return at.select(
        F.col("at.window").alias("window_id"), F.col("at.offset").alias("window_offset"), "doc_id", "piece",
        (F.col("piece") * capacity).alias("doc_offset"), F.pmod("key", F.lit(capacity + 1)).alias("n_tokens"),
        *([(F.col("key") <= capacity).alias(first)] if first else []),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


def flagged_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed, those in the mix by themselves, into the first windows; ``in_mix`` tells which."""
    return packed(docs, first="in_mix")
