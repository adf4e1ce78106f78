"""Exact dedup by a sharded cuckoo-filter index of content digests.

Documents are routed to shards by a 128-bit digest of their text; only digests and ids
travel, and of those with one digest in a batch of rows only the smallest id: the others take
its outcome, so that a text which a third of all documents share is not one task's.  Each
shard replays its part in order of ``doc_id`` against a cuckoo filter whose
slots keep, beside the 16-bit fingerprint, the stored key (digest and the document that
holds it).  A filter hit counts once the stored key in that bucket has the same digest; an
insertion that finds no slot doubles the table and re-inserts the stored keys; a deletion
removes a live digest, after which the next copy becomes its holder.  Digest hits are then
verified on content: the texts of the hits and of their holders are brought together by digest
and compared; texts that differ under one digest are grouped by text.  Texts that no hit needs
are dropped before they travel, by a bitmap of the digests that are needed (``bitmap``).

Defined results: a null text has no content and is no duplicate; empty texts are copies of
each other; a null ``doc_id`` is passed through as no duplicate and holds nothing; a ``doc_id``
must be a whole number, or a string of one (any other is an error); of rows
that repeat a ``doc_id`` and text, one is kept; the keeper is the smallest ``doc_id``; an
empty table gives an empty result; other columns are not read.  Texts are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmap import Bitmap
from .common import materialize

SLOTS = 4
FIRST_BUCKETS = 1 << 10
MAX_KICKS = 200


class CuckooIndex:
    """A cuckoo filter with stored keys: insert, look up and delete 128-bit digests."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.size = 0
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.stored: list[tuple[int, int, int] | None] = [None] * (buckets * SLOTS)

    @staticmethod
    def _print(b: int) -> int:
        return (b & 0xFFFF) or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 + 1 & self.buckets - 1)

    def _find(self, a: int, b: int) -> int:
        """The slot of the live digest (a, b), or -1; fingerprint hits are held against the stored key."""
        fingerprint, bucket = self._print(b), (a ^ b >> 16) & self.buckets - 1
        for at in (bucket, self._other(bucket, fingerprint)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.prints[slot] == fingerprint:
                    key = self.stored[slot]
                    if key[0] == a and key[1] == b:
                        return slot
        return -1

    def holder(self, a: int, b: int) -> int | None:
        slot = self._find(a, b)
        return None if slot < 0 else self.stored[slot][2]

    def insert(self, a: int, b: int, holder: int) -> None:
        """Add a digest that is not live."""
        self.size += 1
        left = self._place((a, b, holder))
        while left is not None:
            keys = [k for k in self.stored if k is not None] + [left]
            self._reset(2 * self.buckets)
            for n, key in enumerate(keys):
                left = self._place(key)
                if left is not None:  # still too full: keep all keys for the next doubling
                    rest = keys[n + 1 :]
                    self.stored += rest
                    self.prints += [0] * len(rest)
                    break

    def _place(self, key: tuple[int, int, int]) -> tuple[int, int, int] | None:
        """Store a key, moving others; returns the key without a slot after MAX_KICKS moves."""
        fingerprint, bucket = self._print(key[1]), (key[0] ^ key[1] >> 16) & self.buckets - 1
        for at in (bucket, self._other(bucket, fingerprint)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.stored[slot] = fingerprint, key
                    return None
        at = self._other(bucket, fingerprint)
        for kick in range(MAX_KICKS):
            slot = at * SLOTS + (key[0] + kick) % SLOTS
            (self.prints[slot], fingerprint), (self.stored[slot], key) = (fingerprint, self.prints[slot]), (key, self.stored[slot])
            at = self._other(at, fingerprint)
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.stored[slot] = fingerprint, key
                    return None
        return key

    def delete(self, a: int, b: int) -> bool:
        """Remove a live digest; false if it is not live."""
        slot = self._find(a, b)
        if slot < 0:
            return False
        self.prints[slot], self.stored[slot], self.size = 0, None, self.size - 1
        return True


_OUT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("id", "a", "b", "holder")] + [T.StructField("outcome", T.StringType())]
)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcome of each operation of a shard, in the order given: inserted, duplicate, deleted or absent."""
    index = CuckooIndex()
    for batch in batches:
        ids, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "a", "b"))
        removal = batch.column("removal").to_numpy(zero_copy_only=False)
        mask = (1 << 64) - 1
        holders, outcomes = np.zeros(len(ids), np.int64), []
        for i, (key, x, y, gone) in enumerate(zip(ids.tolist(), a.tolist(), b.tolist(), removal.tolist())):
            x, y = x & mask, y & mask
            held = index.holder(x, y)
            holders[i] = key if held is None else held
            if gone:
                outcomes.append("absent" if held is None else "deleted")
                index.delete(x, y)
            elif held is None:
                outcomes.append("inserted")
                index.insert(x, y, key)
            else:
                outcomes.append("duplicate")
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("a"), batch.column("b"), pa.array(holders), pa.array(outcomes, pa.string())], names=_OUT.names)


def _digests() -> list:
    return [F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), F.length("text"), "text").alias("b")]


def replay(log: DataFrame) -> DataFrame:
    """Replay insertions and deletions (id, seq, text, removal): (id, a, b, holder, outcome) of each, by ``seq``.

    A deletion names content: it removes the live digest of its text, whoever holds it.
    """
    keyed = log.where("text is not null and id is not null").select("id", "seq", *_digests(), "removal")
    return keyed.repartition("a", "b").sortWithinPartitions("seq", "id").select("id", "a", "b", "removal").mapInArrow(_replay, _OUT)


_LOCAL = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "a", "b", "rep")] + [T.StructField("goes", T.BooleanType())])


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``rep``, the smallest id of the rows of a batch with the same digest, and whether a row is the one that goes to the shard."""
    for batch in batches:
        ids, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "a", "b"))
        order = np.lexsort((ids, b, a))
        ids, a, b = ids[order], a[order], b[order]
        goes = np.ones(len(ids), bool)
        goes[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rep = ids[np.flatnonzero(goes)][np.cumsum(goes) - 1] if len(ids) else ids
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, a, b, rep, goes)], names=_LOCAL.names)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keeper_id, is_duplicate."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    content = docs.where("text is not null and id is not null").select("id", *_digests(), "text")
    local = materialize(content.select("id", "a", "b").mapInArrow(_smallest, _LOCAL), "local")
    shards = local.where("goes").select("id", "a", "b", F.lit(False).alias("removal")).repartition("a", "b").sortWithinPartitions("id")
    first = materialize(shards.mapInArrow(_replay, _OUT), "cuckoo")
    holders = first.select(F.col("id").alias("rep"), "a", "b", "holder").distinct()
    others = local.where("not goes").join(holders, ["rep", "a", "b"]).select("id", "a", "b", "holder")
    hits = materialize(first.where("outcome = 'duplicate'").select("id", "a", "b", "holder").unionByName(others), "hits")
    wanted = materialize(hits.select("id", "a", "b").union(hits.select("holder", "a", "b")).distinct(), "wanted")
    # Content is bucketed by digest, and each bucket keeps what its hits and their holders need;
    # hashing the narrow side leaves the texts unsorted, and the plan is the same at any size.
    some = content.where(Bitmap.filter(*Bitmap.write(wanted.select("a", "b").distinct()))(F.col("a"), F.col("b")))
    texts = some.join(wanted.hint("shuffle_hash"), ["id", "a", "b"], "left_semi").distinct()
    texts = materialize(texts, "texts")
    held = texts.withColumnsRenamed({"id": "holder", "text": "held"})
    same = F.col("text") == F.col("held")
    checked = hits.join(texts, ["id", "a", "b"]).join(held, ["holder", "a", "b"]).select("id", "a", "b", "holder", same.alias("same"), F.when(~same, F.col("text")).alias("text"))
    checked = materialize(checked, "checked")
    alike = W.partitionBy("a", "b", "text")
    differ = checked.where("not same").select(
        "id", F.min("id").over(alike).alias("keeper"), (F.row_number().over(alike.orderBy("id")) > 1).alias("dup")
    )
    out = (
        first.where("outcome = 'inserted'").select("id", F.col("id").alias("keeper"), F.lit(False).alias("dup"))
        .union(checked.where("same").select("id", F.col("holder"), F.lit(True)))
        .union(differ)
        .union(docs.where("text is null or id is null").select("id", "id", F.lit(False)))
    )
    return out.select(F.col("id").alias("doc_id"), F.col("keeper").alias("keeper_id"), F.col("dup").alias("is_duplicate"))


SQL = """
SELECT doc_id, CASE WHEN text IS NULL OR doc_id IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper_id,
       text IS NOT NULL AND doc_id IS NOT NULL AND row_number() OVER (PARTITION BY text, doc_id IS NULL ORDER BY doc_id) > 1 AS is_duplicate
FROM documents
"""
