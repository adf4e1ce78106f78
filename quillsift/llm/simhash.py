"""SimHash near-dedup over variants of signature segments.

Every document gets a ``BITS``-bit SimHash of its words of more than ``SHORT`` bytes (of all
words, if it has no other): short words are those that all documents of a language share, and
would make strangers look alike.  To find all signatures within a few bits without comparing
all pairs, the signature is cut into ``segments``.  If two signatures differ in at most
``3 * segments - 1`` bits, some segment differs by at most two, so it is enough to index each
segment as it is and once per flipped bit: two segments that differ by at most two bits agree
in a variant.  Fewer, wider segments than in the exact-segment scheme keep the keys selective.
Documents meet by an equality shuffle on the variant and each candidate is verified on the
whole signature.  ``groups`` takes as many segments as its radius needs (7 for 20 bits), so it
finds every pair within the radius.

``near_pairs`` and ``linked`` without ``flips`` index a segment once per deleted bit instead,
which bridges one bit: fewer candidates, but complete up to ``2 * segments - 1`` bits only.

Equal signatures are one class.  The classes of a variant are sorted together and compared in
array passes; what leaves a task is not the pairs, but a spanning forest of them and each
class's number of links, so a group of thousands costs no thousands of thousands of rows.  A
variant that more than ``HOT_ROWS`` classes share is cut into blocks, and each pair of blocks
is a task of its own.  Groups are the connected components of the verified pairs.

Defined results: a document without any word (null, empty, only punctuation) has no
signature, is a group of its own and has no links; null ``doc_id`` passes through ungrouped;
a ``doc_id`` must be a whole number, or a string of one (any other is an error); rows that
repeat a ``doc_id`` belong to one group (with other texts, to that of the smallest id and have
its links), and of fully repeated rows one stays; ties go to the smallest ``doc_id``; an empty
table gives an empty result; other columns are not read.  Texts are hashed whole, in pieces of
bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmap import Bitmap
from .common import _FOLD, materialize, mix, scratch, slices, small_batches, span_hashes, text_buffer, word_spans

BITS = 128
SEGMENTS = 6
RADIUS = 20
SHORT = 3
HOT_ROWS = 1 << 14

_LANES = np.zeros(16, np.uint64)  # each bit of a nibble in its own 16-bit lane
for _v in range(16):
    _LANES[_v] = sum(((_v >> _b) & 1) << (16 * _b) for _b in range(4))
_STEP = 2000  # words a lane sum may take: 2000 words of weight at most 32 stay below 65536


def signatures(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low half of each row's SimHash, and whether the row has any word.

    A word of frequency f weighs 1 + floor(log2 f), so that the frequent words that all
    documents of a language share do not decide the bits.
    """
    n = len(offsets) - 1
    starts, ends, rows = word_spans(offsets, data)
    long = ends - starts > SHORT
    long |= np.bincount(rows[long], minlength=n)[rows] == 0
    starts, ends, rows = starts[long], ends[long], rows[long]
    hashes = span_hashes(_FOLD[data], starts, ends)
    hi, lo, any_word = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    if not len(hashes):
        return hi, lo, any_word
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]))
    freq = np.diff(np.append(first, len(hashes)))
    hashes, rows = hashes[first], rows[first]
    weight = 1 + np.minimum(np.log2(freq).astype(np.int64), 31)
    row_first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    place = np.arange(len(rows)) - np.repeat(row_first, np.diff(np.append(row_first, len(rows))))
    cut = np.flatnonzero((place % _STEP) == 0)  # each row starts a piece, long rows have several
    piece_row = rows[cut]
    total = np.zeros(n, np.int64)
    np.add.at(total, piece_row, np.add.reduceat(weight, cut))
    any_word[rows[row_first]] = True
    w = weight.astype(np.uint64)
    for out, h in ((lo, mix(hashes)), (hi, mix(hashes + np.uint64(0xD1B54A32D192ED03)))):
        for nibble in range(16):
            lanes = np.add.reduceat(_LANES[((h >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.intp)] * w, cut)
            for b in range(4):
                ones = np.zeros(n, np.int64)
                np.add.at(ones, piece_row, ((lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64))
                out |= (2 * ones > total).astype(np.uint64) << np.uint64(4 * nibble + b)
    return hi, lo, any_word


@F.arrow_udf(T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))
def _signature(texts: pa.Array) -> pa.Array:
    hi, lo, some = (np.concatenate(x) for x in zip(*(signatures(*text_buffer(part)) for part in slices(texts))))
    return pa.StructArray.from_arrays(
        [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["hi", "lo"], mask=pa.array(~some)
    )


def bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """First bit and end of each segment."""
    at = [round(i * BITS / segments) for i in range(segments + 1)]
    return list(zip(at, at[1:]))


def signature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of the documents that have a signature."""
    signed = docs.select("doc_id", _signature(F.lower("text")).alias("s")).where("doc_id is not null and s is not null")
    return signed.select(F.col("doc_id").cast("bigint"), "s.hi", "s.lo")


#: A variant in one number, from the top: its wildcard bit (or its segment's number), its segment without (or with) that bit, a pair of blocks, and which of the two a row is of.
_SIDE, _BLOCK = 1, 12
_SHIFT = _SIDE + 2 * _BLOCK
_WILD = 7


def complete(radius: int) -> int:
    """The least number of segments of which one differs by at most two bits in any pair within ``radius``."""
    return radius // 3 + 1


def variants(nodes: DataFrame, segments: int = SEGMENTS, flips: bool = False) -> DataFrame:
    """(key, node, hi, lo): each node once for each wildcard bit, or for each segment and each of its bits flipped."""
    width = max(b - a for a, b in bounds(segments))
    assert width + _WILD + _SHIFT <= 63, "more segments are needed"
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for s, (a, b) in enumerate(bounds(segments)):
        for wild in ([None] if flips else []) + list(range(a, b)):
            mask = ((1 << b) - (1 << a)) & ~(0 if flips else 1 << wild)
            tag = (s << width) ^ (0 if wild is None else 1 << (wild - a)) if flips else wild << width
            # A segment's bits in either half, moved to the low end: right, then left where it straddles the halves.
            rows.append((tag, signed(mask >> 64), max(a - 64, 0), max(64 - a, 0) if b > 64 else 0, signed(mask & (1 << 64) - 1), a if a < 64 else 0))
    names = ("tag", "mh", "rh", "lh", "ml", "rl")
    kinds = ("L", "L", "", "", "L", "")
    masks = F.expr(f"array({', '.join('named_struct(' + ', '.join(f"'{n}', {x}{k}" for n, x, k in zip(names, r, kinds)) + ')' for r in rows)})")
    m = nodes.select("node", "hi", "lo", F.explode(masks).alias("m"))
    high = "shiftleft(shiftrightunsigned(hi & m.mh, m.rh), m.lh)"
    return m.select(F.expr(f"m.tag ^ ({high} | shiftrightunsigned(lo & m.ml, m.rl))").alias("key"), "node", "hi", "lo")


class Links:
    """Verified pairs of a task, as a spanning forest of them and the number of links of each node."""

    def __init__(self, forest: bool, hold: int = 1 << 20):
        self.forest, self.hold, self.a, self.b, self.n = forest, hold, [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.a.append(np.minimum(x, y))
        self.b.append(np.maximum(x, y))
        self.n += len(x)

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """(a, b, links): edges with 0 links, and nodes, a = b, with theirs; without ``forest`` every pair."""
        if not self.n or not (last or self.n >= self.hold):
            return
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        self.a, self.b, self.n = [], [], 0
        links = np.zeros(len(a), np.int64)
        if self.forest:
            node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            own = np.bincount(at)
            low, x, y = np.arange(len(node)), at[: len(a)], at[len(a) :]
            while True:  # every node takes the least label next to it, then that label's own
                least = np.minimum(low[x], low[y])
                new = low.copy()
                np.minimum.at(new, x, least)
                np.minimum.at(new, y, least)
                np.minimum.at(new, low[x], least)
                np.minimum.at(new, low[y], least)
                new = new[new]
                if (new == low).all():
                    break
                low = new
            child = np.flatnonzero(low != np.arange(len(node)))
            a, b, links = (np.concatenate(p) for p in ((node[low[child]], node), (node[child], node), (np.zeros(len(child), np.int64), own)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], names=["a", "b", "links"])


_CHUNK = 1 << 17
_LARGE = 64
_BOARD = 1 << 16  # comparisons at a time in a large group


def _segment(hi: np.ndarray, lo: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits ``a`` to ``b`` of each signature, at the low end."""
    at = lo >> np.uint64(a) if a < 64 else hi >> np.uint64(a - 64)
    if a < 64 < b:
        at = at | hi << np.uint64(64 - a)
    return at & np.uint64((1 << b - a) - 1)


def _verify(group: np.ndarray, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, segments: int, radius: int, flips: bool, links: Links) -> Iterator[pa.RecordBatch]:
    """Compare all rows of a group with each other, for whole groups, sorted; ``group`` has the side in its last bit."""
    of = group >> _SIDE
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    end = np.append(first[1:], len(of))
    width = max(b - a for a, b in bounds(segments))

    def flipped(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the first segment that bridges the pair, the variant without the lowest bit in which they differ, or the segment itself if they don't."""
        of, diff, own = np.full(len(i), -1), np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        for s, (a, b) in reversed(list(enumerate(bounds(segments)))):
            d = _segment(hi[i] ^ hi[j], lo[i] ^ lo[j], a, b)
            few = np.bitwise_count(d) <= 2
            of, diff, own = np.where(few, s, of), np.where(few, d, diff), np.where(few, _segment(hi[i], lo[i], a, b), own)
        key = (group[i] >> _SHIFT).astype(np.uint64) & np.uint64((1 << width) - 1)
        lowest = diff & (~diff + np.uint64(1))
        return (of == group[i] >> (_SHIFT + width)) & np.where(diff == 0, key == own, (key & lowest) == 0)

    def deleted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = hi[i] ^ hi[j], lo[i] ^ lo[j]
        shared = np.full(len(i), -1)
        for a, b in reversed(bounds(segments)):
            mask = (1 << b) - (1 << a)
            h, w = x & np.uint64(mask >> 64), y & np.uint64(mask & (1 << 64) - 1)
            bits = np.bitwise_count(h) + np.bitwise_count(w)
            place = np.where(w > 0, _top(w), _top(h) + 64)
            shared = np.where(bits == 0, a, np.where(bits == 1, place, shared))
        return shared == group[i] >> (_SHIFT + width)

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        """Those of the near pairs i, j for which this variant is the first that they share."""
        cross = (group[i] >> _SIDE & (1 << 2 * _BLOCK) - 1) % ((1 << _BLOCK) + 1) != 0  # two blocks: only pairs between them
        ok = (flipped if flips else deleted)(i, j) & (~cross | (group[i] & 1 != group[j] & 1)) & (node[i] != node[j])
        links.add(node[i[ok]], node[j[ok]])

    near = lambda x, y: np.bitwise_count(x) + np.bitwise_count(y) <= radius
    size = end - first
    i = np.flatnonzero(np.repeat((size > 1) & (size <= _LARGE), size))
    until = np.repeat(end, size)
    for step in range(1, _LARGE):
        i = i[i + step < until[i]]
        if not len(i):
            break
        k = i[near(hi[i] ^ hi[i + step], lo[i] ^ lo[i + step])]
        pairs(k, k + step)
    for a, b in zip(first[size > _LARGE].tolist(), end[size > _LARGE].tolist()):
        two = int(group[a] >> _SIDE & (1 << 2 * _BLOCK) - 1) % ((1 << _BLOCK) + 1) != 0
        split = int(np.searchsorted(group[a:b] & 1, 1)) + a
        rows = max(1, _BOARD // (b - a))
        for r in range(a, split, rows):  # a few rows against all after the first of them, or all of the other block
            s, to = split if two else r + 1, min(r + rows, split)
            i, k = np.nonzero(near(hi[r:to, None] ^ hi[s:b], lo[r:to, None] ^ lo[s:b]))
            i, k = i + r, k + s
            if not two:
                i, k = i[k > i], k[k > i]
            if len(k):
                pairs(i, k)
                yield from links.rows(False)


def _top(x: np.ndarray) -> np.ndarray:
    """The place of the one bit of each number."""
    return np.bitwise_count(x - np.uint64(1)).astype(np.int64) % 65


_LINK = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "links")])


def _searcher(segments: int, radius: int, flips: bool, forest: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held = Links(forest), None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "node", "hi", "lo")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) < _CHUNK:
                continue
            of = held[0] >> _SIDE
            cut = int(np.searchsorted(of, of[-1]))  # the last group may go on
            if cut:
                yield from _verify(held[0][:cut], held[1][:cut], held[2][:cut].view(np.uint64), held[3][:cut].view(np.uint64), segments, radius, flips, links)
                yield from links.rows(False)
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from _verify(held[0], held[1], held[2].view(np.uint64), held[3].view(np.uint64), segments, radius, flips, links)
        yield from links.rows(True)

    return search


def linked(nodes: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, hot_rows: int = HOT_ROWS, forest: bool = True, flips: bool = False) -> DataFrame:
    """(a, b, links) of the nodes (node, hi, lo): the pairs within ``radius``, as ``Links`` gives them.

    Which variants are hot is read off one node in 16, which decides how the work is cut and
    nothing else: a cut group has the same pairs as a whole one.
    """
    v = variants(nodes, segments, flips)
    part = variants(nodes.where(F.pmod(F.xxhash64("node", F.lit("hot")), F.lit(16)) == 0), segments, flips)
    counted = part.groupBy("key").agg((F.count(F.lit(1)) * 16).alias("__n")).where(F.col("__n") > hot_rows)
    blocks = F.least(F.ceil(F.col("__n") * 2 / hot_rows), F.lit((1 << _BLOCK) - 1)).cast("int")
    hot = materialize(counted.select(F.col("key").alias("__hot"), blocks.alias("__blocks")), "hot")
    if hot.isEmpty():
        g = v.select(F.shiftleft("key", _SHIFT).alias("g"), "node", "hi", "lo")
    else:
        # The hot keys are at most a few for each ``hot_rows`` rows; Catalyst broadcasts them by their size.
        own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("__n")).cast("bigint")
        each = v.join(hot, F.col("key") == F.col("__hot"), "left").withColumn("__n", F.coalesce("__blocks", F.lit(1)))
        each = each.withColumn("__own", own).withColumn("__with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n").cast("bigint") - 1)))
        pair = F.least("__own", "__with") * (1 << _BLOCK) + F.greatest("__own", "__with")
        side = (F.col("__own") > F.col("__with")).cast("bigint")
        g = each.select((F.shiftleft("key", _SHIFT) + pair * 2 + side).alias("g"), "node", "hi", "lo")
    sorted_ = g.repartition(F.shiftright("g", _SIDE)).sortWithinPartitions("g")
    return sorted_.mapInArrow(_searcher(segments, radius, flips, forest), _LINK)


def near_pairs(nodes: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, hot_rows: int = HOT_ROWS, flips: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of the nodes whose signatures differ in at most ``radius`` bits, each once: for small results."""
    return linked(nodes, segments, radius, hot_rows, forest=False, flips=flips).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating stars.

    Each round links every node's larger neighbours to its smallest one (large star), then
    every node and its smaller neighbours to their smallest (small star), until nothing
    changes.  The rounds are logarithmic in the size of a component, and each is written to
    the shared folder.
    """
    edges, before = materialize(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("m < b").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        kept = large.join(down, "b")
        star = kept.select(F.col("m").alias("a"), "b").union(kept.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = materialize(star.distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, n_links) of each distinct document with a signature, in a written table, from all pairs within ``radius``.

    Equal signatures collapse to one node before the search, so copies by the thousand cost
    as much as one document.
    """
    with scratch(docs.sparkSession):
        with small_batches(docs.sparkSession):
            signed = materialize(signature_table(docs).distinct(), "simhash")
        nodes = materialize(signed.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "nodes")
        found = materialize(linked(nodes, complete(radius), radius, flips=True), "links")
        roots = components(found.where("a <> b").select("a", "b"))
        links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        named = nodes.join(roots, "node", "left").join(links, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("group_id"), F.coalesce("links", F.lit(0)).alias("n"))
        one = signed.join(named, ["hi", "lo"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.min_by("n", F.struct("group_id", "n")).alias("n_links"))
        return materialize(one, "groups", outlives=True)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a document: doc_id, group_id (its smallest doc_id), n_links, is_duplicate.

    ``n_links`` is the number of other signatures within the radius of the document's own;
    equal signatures are of one class and not counted.
    """
    g = groups(docs, radius)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.join(g, "doc_id", "left").select(
        "doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce(F.col("group_id") != F.col("doc_id"), F.lit(False)).alias("is_duplicate"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near duplicates: of each group the smallest doc_id stays."""
    gone = groups(docs).where("group_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    # Only texts that may go meet the list of those that do; the others stay where they are.
    may, own = Bitmap.filter(*Bitmap.write(gone.select(F.col("__gone").alias("a"), F.col("__gone").alias("b")))), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    some = docs.where(may(own, own))
    kept = docs.where(~may(own, own)).unionByName(some.join(gone, some["doc_id"].cast("bigint") == gone["__gone"], "left_anti"))
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    again = materialize(ids.where("__n > 1").select(F.col("doc_id").alias("__again")), "again")
    if again.isEmpty():
        return kept
    of = lambda how: kept.join(again, kept["doc_id"] == again["__again"], how)
    return of("left_anti").unionByName(of("left_semi").dropDuplicates())
