"""Line dedup by a sharded minimal perfect hash.

Lines are hashed on the JVM and counted.  The distinct hashes of lines that occur at least
``min_count`` times are cut into shards; each shard gets a minimal perfect hash (levels of
bit arrays: a key that lands alone on a bit of a level is placed there, the others go on to
the next level; its rank among the set bits is its slot) over compact arrays: a fingerprint, a
16-bit saturating count, the smallest ``doc_id`` that holds the line, and how much text that
document has.  Documents then probe the arrays with their line hashes, so no line is joined: a
hash that is not indexed falls off the levels or misses the fingerprint.  A fingerprint has all
64 bits of the hash, as with 32 one line in four thousand million would go by mistake.

A line stays in the first document that holds it (smallest ``doc_id``), at its first place,
and goes everywhere else.  Lines are compared trimmed of spaces and in lower case; lines
shorter than ``min_chars`` are never touched.

The arrays are read from the shared folder by each Python worker while they fit
``PASS_BYTES``; beyond that the shards are probed in several passes of that size, so a
worker's memory does not grow with the corpus.

Defined results: a null text stays null and an empty one empty; a null ``doc_id`` passes
through and counts nowhere; a ``doc_id`` must be a whole number, or a string of one (any other
is an error); rows that repeat a ``doc_id`` each keep the first place in their own text of the
lines that this id is the first to hold (lines are counted once a row), so equal rows stay
equal; an empty table gives an empty result; all other columns of the documents are carried
along, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_buffer, materialize, mix, scratch, store

MIN_CHARS = 20
MIN_COUNT = 2
SHARD_KEYS = 1 << 20
PASS_BYTES = 256 << 20
KEY_BYTES = 27
#: From this share of text in common with one earlier document on, the stage takes a document for a copy with changes.
COPY_SHARE = 0.1

_GAMMA = 2.0
_SEED = 0xA0761D6478BD642F


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; ``slots`` maps a key to 0..n-1, a stranger to any slot or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys.astype(np.uint64)
        while len(left):
            size = -(-max(64, int(_GAMMA * len(left))) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(flat))])[:-1] if len(flat) else np.zeros(0)
        return cls(np.array(sizes, np.int64), flat, ranks.astype(np.uint32))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64(_SEED * (2 * level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = base + self._place(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[at[hit] >> 6] + below
            left, base = left[~hit], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0x2545F4914F6CDD1D))  # one to one


_SHARD = T.StructType(
    [T.StructField("shard", T.IntegerType())]
    + [T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "ranks", "prints", "counts", "holders", "chars")]
)


def build_shard(table: pa.Table) -> pa.Table:
    """One row with the arrays of a shard, from its (shard, line, count, holder, chars) rows."""
    keys = table["line"].to_numpy().view(np.uint64)
    mph = PerfectHash.build(keys)
    at, n = mph.slots(keys), len(keys)
    prints, counts, holders, chars = np.zeros(n, np.uint64), np.zeros(n, np.uint16), np.zeros(n, np.int64), np.zeros(n, np.int64)
    prints[at] = fingerprints(keys)
    counts[at] = np.minimum(table["count"].to_numpy(), 65535)
    holders[at], chars[at] = table["holder"].to_numpy(), table["chars"].to_numpy()
    parts = [mph.sizes, mph.words, mph.ranks, prints, counts, holders, chars]
    cols = [pa.array([table["shard"][0].as_py()], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]]
    return pa.Table.from_arrays(cols, names=_SHARD.names)


class Index:
    """The shards of one pass, as a Python worker holds them."""

    _held: tuple[tuple[str, int, int], Index] | None = None

    def __init__(self, path: str, shards: int, passes: int, turn: int):
        self.shards, self.by = shards, {}
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        for row in pq.read_table(at, filesystem=fs, filters=[("turn", "=", turn)] if passes > 1 else None).to_pylist():
            get = lambda c, t, row=row: np.frombuffer(row[c], t)
            mph = PerfectHash(get("sizes", np.int64), get("words", np.uint64), get("ranks", np.uint32))
            self.by[row["shard"]] = (mph, get("prints", np.uint64), get("counts", np.uint16), get("holders", np.int64), get("chars", np.int64))

    @classmethod
    def of(cls, path: str, shards: int, passes: int, turn: int) -> Index:
        key = (path, passes, turn)
        if cls._held is None or cls._held[0] != key:
            cls._held = None
            cls._held = (key, cls(path, shards, passes, turn))
        return cls._held[1]

    def holders(self, lines: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each line hash is indexed with at least ``min_count``, its first document, and that one's text in long lines."""
        found, holder, size = np.zeros(len(lines), bool), np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
        shard = np.mod(lines, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (mph, prints, counts, holders, chars) in self.by.items():
            at = order[cuts[s] : cuts[s + 1]]
            if len(at) and len(prints):
                keys = lines[at].view(np.uint64)
                slot = mph.slots(keys)
                ok = slot >= 0
                ok[ok] = (prints[slot[ok]] == fingerprints(keys[ok])) & (counts[slot[ok]] >= min(min_count, 65535))
                found[at[ok]], holder[at[ok]], size[at[ok]] = True, holders[slot[ok]], chars[slot[ok]]
        return found, holder, size


def doomed(ids: np.ndarray, offsets: np.ndarray, lines: np.ndarray, valid: np.ndarray, index: Index, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines of a batch go: indexed ones outside their first place in their first document; that document and its text."""
    out, by, chars = np.zeros(len(lines), bool), np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    at = np.flatnonzero(valid)
    found, holder, size = index.holders(lines[at], min_count)
    at, holder = at[found], holder[found]
    rows = np.searchsorted(offsets, at, "right") - 1
    out[at], by[at], chars[at] = True, holder, size[found]
    home = ids[rows] == holder
    at, rows = at[home], rows[home]
    _, first = np.unique(np.stack([rows, lines[at]], axis=1), axis=0, return_index=True) if len(at) else (0, [])
    out[at[first]] = False
    return out, by, chars


_MARKS = T.StructType([T.StructField("by", T.ArrayType(T.LongType())), T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("share", T.DoubleType())])


def shares(ids: np.ndarray, offsets: np.ndarray, gone: np.ndarray, by: np.ndarray, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of the text in long lines of a document, or of the earlier one that holds most of it if that has more, the share that both have."""
    total = np.concatenate([[0], np.cumsum(length)])
    own, share = total[offsets[1:]] - total[offsets[:-1]], np.zeros(len(ids))
    line = np.flatnonzero(gone)
    row = np.searchsorted(offsets, line, "right") - 1
    line, row = (x[by[line] != ids[row]] for x in (line, row))
    order = np.lexsort((by[line], row))
    line, row = line[order], row[order]
    if len(line):
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (by[line[1:]] != by[line[:-1]])]))
        both = np.add.reduceat(length[line], first)
        np.maximum.at(share, row[first], both / np.maximum(np.maximum(own[row[first]], chars[line[first]]), 1))
    return share


def _flat(lists: pa.Array) -> np.ndarray:
    return list_buffer(lists)[1].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _probe(path: str, shards: int, passes: int, turn: int, min_count: int):
    @F.arrow_udf(_MARKS)
    def probe(ids: pa.Array, lines: pa.Array, lengths: pa.Array) -> pa.Array:
        """Marks of each line; the share, from the lengths of the lines, counts what this pass found."""
        offsets, flat = list_buffer(lines)
        valid = flat.is_valid().to_numpy(zero_copy_only=False)
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        gone, by, chars = doomed(
            ids, offsets, flat.fill_null(0).to_numpy(zero_copy_only=False), valid & np.repeat(known, np.diff(offsets)), Index.of(path, shards, passes, turn), min_count
        )
        share = shares(ids, offsets, gone, by, chars, _flat(lengths)) if len(list_buffer(lengths)[1]) == len(flat) else np.zeros(len(ids))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, mask=~gone)) for x in (by, chars)]
        return pa.StructArray.from_arrays([*lists, pa.array(share)], names=_MARKS.names)

    return probe


@F.arrow_udf(T.DoubleType())
def _copied(ids: pa.Array, by: pa.Array, chars: pa.Array, lengths: pa.Array) -> pa.Array:
    """The shares, of marks that several passes found."""
    offsets, flat = list_buffer(by)
    gone = flat.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(shares(ids.fill_null(0).to_numpy(zero_copy_only=False), offsets, gone, _flat(by), _flat(chars), _flat(lengths)))


def line_hashes(text: Column, min_chars: int) -> Column:
    """The hash of every line, null where the line is too short to be touched."""

    def one(line: Column) -> Column:
        line = F.trim(line)
        return F.when(F.length(line) >= min_chars, F.xxhash64(F.lower(line)))

    return F.transform(F.split(text, "\n", -1), one)


def line_lengths(text: Column, min_chars: int) -> Column:
    """The length of every line, 0 where it is too short to be touched."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.when(F.length(F.trim(line)) >= min_chars, F.length(F.trim(line))).otherwise(0))


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, pass_bytes: int = PASS_BYTES, sizes: bool = False):
    """Write the shards; returns their path, the number of shards and of passes.  How much text the first document has is taken with ``sizes`` only."""
    text = F.aggregate(line_lengths(F.col("text"), min_chars), F.lit(0).cast("bigint"), lambda a, x: a + x)
    own = F.col("doc_id").cast("bigint")
    whole = docs.where("doc_id is not null").select((F.named_struct(F.lit("d"), own, F.lit("chars"), text) if sizes else own).alias("d"), line_hashes(F.col("text"), min_chars).alias("lines"))
    lines = whole.select("d", F.explode("lines").alias("line"))  # a step of its own, so that the text is gone before its lines are rows
    counted = lines.where("line is not null").groupBy("line").agg(F.count(F.lit(1)).alias("count"), F.min("d").alias("first"))
    holder = [F.col("first.d").alias("holder"), F.col("first.chars").alias("chars")] if sizes else [F.col("first").alias("holder"), F.lit(0).cast("bigint").alias("chars")]
    with scratch(docs.sparkSession):
        repeated = materialize(counted.where(F.col("count") >= min_count).select("line", "count", *holder), "lines")
        n = repeated.count()
        shards, passes = max(1, math.ceil(n / SHARD_KEYS)), max(1, math.ceil(n * KEY_BYTES / pass_bytes))
        shards = max(shards, passes)
        keyed = repeated.withColumn("shard", F.pmod("line", F.lit(shards)).cast("int"))
        built = keyed.groupBy("shard").applyInArrow(build_shard, _SHARD)
        return store(built.withColumn("turn", F.col("shard") % passes), "mph", outlives=True), shards, passes


def marked(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, pass_bytes: int = PASS_BYTES, sizes: bool = False) -> DataFrame:
    """(r: the row of the documents as a struct, hashes of its lines, marks: for each line that goes its first document, ``by``, and that one's ``chars``)."""
    path, shards, passes = build_index(docs, min_chars, min_count, pass_bytes, sizes)
    rows = docs.select(F.struct(*docs.columns).alias("r"))
    hashes = line_hashes(F.col("r.text"), min_chars)
    lengths = lambda text: line_lengths(text, min_chars) if sizes else F.lit(None).cast("array<int>")
    if passes == 1:
        marks = _probe(path, shards, 1, 0, min_count)(F.col("r.doc_id").cast("bigint"), hashes, lengths(F.col("r.text")))
        return rows.select("r", hashes.alias("hashes"), marks.alias("marks"))
    # Marks depend on a row's doc_id and text alone, so these are the key that brings them back to the rows.
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    none = F.lit(None).cast(_MARKS)
    narrow = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("d"), digest(F.col("text")).alias("k"), line_hashes(F.col("text"), min_chars).alias("l"), lengths(F.col("text")).alias("n"), none.alias("marks"))
    for turn in range(passes):
        more = _probe(path, shards, passes, turn, min_count)(F.col("d"), F.col("l"), F.col("n"))
        each = [F.zip_with(f"marks.{c}", f"more.{c}", lambda a, b: F.coalesce(a, b)).alias(c) for c in ("by", "chars")]
        both = F.when(F.col("marks").isNull(), F.col("more")).otherwise(F.struct(*each, F.col("more.share").alias("share")))
        narrow = materialize(narrow.withColumn("more", more).select("d", "k", "l", "n", both.alias("marks")), f"pass{turn}")
    if sizes:
        share = _copied(F.col("d"), F.col("marks.by"), F.col("marks.chars"), F.col("n"))
        narrow = narrow.withColumn("marks", F.struct("marks.by", "marks.chars", share.alias("share")))
    once = narrow.groupBy("d", "k").agg(F.first("marks").alias("marks"))
    on = (F.col("r.doc_id").cast("bigint") == F.col("d")) & (digest(F.col("r.text")) == F.col("k"))
    return rows.join(once, on, "left").select("r", hashes.alias("hashes"), "marks")


def _left(text: Column, by: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: F.get(by, i).isNull())
    return F.when(F.coalesce(F.exists(by, lambda g: g.isNotNull()), F.lit(False)), F.array_join(kept, "\n")).otherwise(text)


def _counts(hashes: Column, by: Column) -> tuple[Column, Column]:
    count = lambda xs: F.coalesce(F.when(xs.isNotNull(), F.size(F.filter(xs, lambda h: h.isNotNull()))), F.lit(0))
    return count(hashes), count(by)


def short_lines(text: Column, min_chars: int) -> Column:
    """The distinct hashes of the lines that are too short to be touched and not blank."""
    short = F.filter(F.split(text, "\n", -1), lambda x: (F.length(F.trim(x)) < min_chars) & (F.length(F.btrim(x, F.lit(" \t\r\f\v"))) > 0))
    return F.array_distinct(F.transform(short, lambda x: F.xxhash64(F.lower(F.trim(x)))))


def _own(docs: DataFrame, emptied: DataFrame, min_chars: int) -> DataFrame:
    """(d, own): of documents without a long line, given as (d, short), the short lines that no earlier document holds."""
    pairs = materialize(emptied.select("d", F.explode("short").alias("line")).distinct(), "short")
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("d"), F.explode(short_lines(F.col("text"), min_chars)).alias("line"))
    first = lines.join(pairs.select("line").distinct(), "line", "left_semi").groupBy("line").agg(F.min("d").alias("d"))
    return pairs.join(first, ["line", "d"]).groupBy("d").agg(F.collect_set("line").alias("own"))


def deduped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row a document: doc_id, its text without repeated lines, how many of its long lines went, keep.

    ``keep`` is false where lines went, no line of at least ``min_chars`` is left, and all
    shorter lines that are left occur in documents before it.
    """
    m = marked(docs, min_chars, min_count, pass_bytes)
    long, went = _counts(F.col("hashes"), F.col("marks.by"))
    emptied = (went > 0) & (went == long)
    left = m.select(
        F.col("r.doc_id").alias("doc_id"), _left(F.col("r.text"), F.col("marks.by")).alias("text"), long.alias("n_long_lines"), went.alias("n_removed"),
        emptied.alias("emptied"), F.when(emptied, short_lines(F.col("r.text"), min_chars)).alias("short"),
    )
    at_risk = materialize(left.where("emptied"), "emptied")  # a small part; the other texts are marked again rather than written
    own = _own(docs, at_risk.select(F.col("doc_id").cast("bigint").alias("d"), "short"), min_chars)
    saved = F.coalesce(F.arrays_overlap("short", "own"), F.lit(False))
    columns = ["doc_id", "text", "n_long_lines", "n_removed"]
    judged = at_risk.join(own, F.col("doc_id").cast("bigint") == F.col("d"), "left").select(*columns, saved.alias("keep"))
    return left.where("not emptied").select(*columns, F.lit(True).alias("keep")).unionAll(judged)


def stage(spark, docs: DataFrame, sf_dir: str, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents without repeated lines.  n_chars follows the text.

    A document left without a long line goes if its short lines, too, are all held by
    earlier documents; with a short line of its own it stays, with the text that is left.

    A copy with changes of an earlier document is left whole for the near-duplicate stage: cut
    down to its changed lines it would be a shred like no other text, and stay.  One is taken
    for such a copy if one earlier document holds lines of it that are at least ``COPY_SHARE``
    of the text of either; a passage that many long documents share is less.
    """
    m = marked(docs, pass_bytes=pass_bytes, sizes=True)
    long, went = _counts(F.col("hashes"), F.col("marks.by"))
    emptied = (went > 0) & (went == long)
    m = m.select("r", "marks", emptied.alias("emptied"), F.coalesce("marks.share", F.lit(0.0)).alias("share"))
    text = F.when(~F.col("emptied") & (F.col("share") >= COPY_SHARE), F.col("r.text")).otherwise(_left(F.col("r.text"), F.col("marks.by")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("r.text").isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)
    row = F.struct(*[(new.get(c, F.col("r")[c])).alias(c) for c in docs.columns])
    left = m.select(row.alias("r"), "emptied", F.when(F.col("emptied"), short_lines(F.col("r.text"), MIN_CHARS)).alias("short"))
    at_risk = materialize(left.where("emptied"), "emptied")  # a small part; the other texts are marked again rather than written
    own = _own(docs, at_risk.select(F.col("r.doc_id").cast("bigint").alias("d"), "short"), MIN_CHARS)
    saved = at_risk.join(own, F.col("r.doc_id").cast("bigint") == F.col("d")).where(F.arrays_overlap("short", "own"))
    kept = left.where("not emptied").select("r").unionAll(saved.select("r"))
    return kept.select(*[F.col("r")[c].alias(c) for c in docs.columns])


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), marked AS (
  SELECT *, length(trim(line)) >= {MIN_CHARS} AS long,
         row_number() OVER (PARTITION BY lower(trim(line)) ORDER BY doc_id, pos) > 1 AS later,
         count(*) OVER (PARTITION BY lower(trim(line))) >= {MIN_COUNT} AS often,
         length(trim(line)) < {MIN_CHARS} AND regexp_matches(line, '[^ \\t\\r\\f\\v]') AND doc_id = min(doc_id) OVER (PARTITION BY lower(trim(line))) AS own
  FROM lines
), per_doc AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (long AND later AND often)) AS text,
         CAST(count(*) FILTER (long) AS INTEGER) AS n_long_lines,
         CAST(count(*) FILTER (long AND later AND often) AS INTEGER) AS n_removed, bool_or(own) AS own
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(p.text, '') END AS text,
       coalesce(n_long_lines, 0) AS n_long_lines, coalesce(n_removed, 0) AS n_removed,
       NOT (coalesce(n_removed, 0) > 0 AND n_removed = n_long_lines AND NOT own) AS keep
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
