"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in hash order, form blocks of ``BLOCK`` documents.  A source
of weight w releases its block j at slot floor(j / w), due by slot ceil((j + 1) / w); each
slot takes the released block with the earliest deadline (ties: source order).  With weights
that sum to 1 every deadline is met, and at any slot a source is less than one block off its
share.

Weights are whole units of 1/``UNITS``, so the schedule repeats every ``UNITS`` slots: the
driver simulates that one period, and the slot of any block is arithmetic on it.  The mix
ends with the first slot whose block its source no longer has (``in_mix`` is false from
there on): up to it the targets hold.  Sources whose target is below one unit share one
task.  That task, and any source with less than one unit of the scheduled documents, doesn't
end the mix: once it has run out its slots stay vacant and the others go on, their weights
to each other unchanged.

By default the targets are the sources' shares of the documents raised to ``ALPHA`` (the
usual temperature smoothing) and normalised; a mapping from source to weight may be given.

Defined results: a null source is a source of its own; a null ``doc_id`` hashes like a
value; rows that repeat a ``doc_id`` are scheduled each, next to each other; a source that
the given mapping lacks, or gives 0, is not in the mix (null slot); an empty table gives an
empty result; texts are not read, and the stage carries all columns.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_bits, materialize, positive, ranked

BLOCK = 8
UNITS = 1000
ALPHA = 0.7


def order() -> Column:
    return F.xxhash64("doc_id", F.lit("mix"))


def apportion(counts: dict, weights: dict | None = None, units: int = UNITS, alpha: float = ALPHA) -> list[tuple[list, int]]:
    """Tasks (sources, units), units summing to ``units``, by largest remainders; tiny sources pooled."""
    names = sorted((s for s in counts if weights is None or weights.get(s, 0) > 0), key=lambda s: (s is None, str(s)))
    if not names:
        return []
    target = {s: counts[s] ** alpha if weights is None else weights[s] for s in names}
    whole = sum(target.values())
    units = max(units, len(names))
    tiny = [s for s in names if target[s] * units < whole]
    tasks = [[s] for s in names if s not in set(tiny)] + ([tiny] if tiny else [])
    exact = [Fraction(sum(target[s] for s in t)) * units / Fraction(whole) for t in tasks]
    share = [max(1, int(x)) for x in exact]
    by_rest = sorted(range(len(tasks)), key=lambda i: (int(exact[i]) - exact[i], i))
    for k in range(abs(units - sum(share))):
        if sum(share) < units:
            share[by_rest[k % len(tasks)]] += 1
        else:
            share[share.index(max(share))] -= 1
    return list(zip(tasks, share))


def period(shares: list[int]) -> list[list[int]]:
    """The slots of each task's blocks in one period: earliest deadline first among the released."""
    units, slots = sum(shares), [[] for _ in shares]
    release = lambda i, j: j * units // shares[i]
    deadline = lambda i, j: -(-(j + 1) * units // shares[i])
    coming, ready = [(0, i) for i in range(len(shares))], []
    heapq.heapify(coming)
    for t in range(units):
        while coming and coming[0][0] <= t:
            _, i = heapq.heappop(coming)
            heapq.heappush(ready, (deadline(i, len(slots[i])), i))
        due, i = heapq.heappop(ready)
        assert t < due, "a deadline was missed"
        slots[i].append(t)
        heapq.heappush(coming, (release(i, len(slots[i])), i))
    return slots


def _tasks(docs: DataFrame, weights: dict | None, block: int, units: int, alpha: float):
    """Rows (source, task) and (task, slots of a period) for the scheduled sources, the units of a period, the horizon, and the documents of each task and of none."""
    spark = docs.sparkSession
    counts = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}  # a row a source
    tasks = apportion(counts, weights, units, alpha)
    slots = period([u for _, u in tasks]) if tasks else []
    every, held = sum(u for _, u in tasks), [sum(counts[s] for s in sources) for sources, _ in tasks]
    blocks = [-(-h // block) for h in held]
    missing = [own[b % len(own)] + b // len(own) * every for own, b in zip(slots, blocks)]
    ending = [m for m, h, (sources, _) in zip(missing, held, tasks) if len(sources) == 1 and h * every >= sum(held)]
    horizon = min(ending or missing, default=0)
    kind = docs.schema["source"].dataType.simpleString()
    # Written tables have a size that Catalyst knows, so it broadcasts them while they are small.
    task_of = materialize(spark.createDataFrame([(s, i) for i, (sources, _) in enumerate(tasks) for s in sources], f"__s {kind}, __task int"), "tasks")
    slots_of = materialize(spark.createDataFrame(list(enumerate(slots)), "__t int, __slots array<bigint>"), "slots")
    return task_of, slots_of, every, horizon, held, sum(counts.values()) - sum(held)


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, units: int = UNITS, alpha: float = ALPHA, chunk_rows: int = 100_000) -> DataFrame:
    """One row a document: doc_id, source, block, slot, position in the interleaved order, in_mix."""
    task_of, slots_of, every, horizon, held, rest = _tasks(docs, weights, block, units, alpha)
    bits = [chunk_bits(n, chunk_rows) for n in held]
    narrow = docs.select("doc_id", "source")
    keyed = narrow.join(task_of, F.col("source").eqNullSafe(F.col("__s")), "left").select("doc_id", "source", "__task")
    placed = ranked(keyed, "__task", order(), bits, chunk_bits(rest, chunk_rows), "__rank").join(slots_of, F.col("__task") == F.col("__t"), "left")
    nth = F.floor(F.col("__rank") / block).cast("bigint")
    own = F.size("__slots")
    slot = F.when(F.col("__slots").isNotNull(), F.get("__slots", F.pmod(nth, own).cast("int")) + F.floor(nth / own) * every)
    return placed.select(
        "doc_id", "source", F.when(F.col("__slots").isNotNull(), nth).alias("block"), slot.cast("bigint").alias("slot"),
        (slot * block + F.pmod("__rank", F.lit(block))).cast("bigint").alias("position"),
        F.coalesce(slot < horizon, F.lit(False)).alias("in_mix"),
    )


def flagged(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``in_mix`` in place of any column of that name.

    Ranks follow a hash of doc_id, so a task's part of the mix is all hashes below a bound;
    only these bounds, one a source, meet the documents, and no text is shuffled.  Rows that
    tie with the first one beyond the mix are beyond it.
    """
    m = mixed(docs)
    first_out = F.min(F.when(~F.col("in_mix"), positive(order())))
    bound = m.groupBy("source").agg(first_out.alias("__out")).withColumnRenamed("source", "__source")
    bound = materialize(bound, "bounds")  # a row a source, of known size
    kept = docs.join(bound, docs["source"].eqNullSafe(bound["__source"]), "left")
    inside = bound["__out"].isNull() | (positive(F.xxhash64(docs["doc_id"], F.lit("mix"))) < bound["__out"])
    return kept.select(*[docs[c] for c in docs.columns if c != "in_mix"], inside.alias("in_mix"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with their columns."""
    f = flagged(spark, docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source"), sf_dir)
    return f.where("in_mix").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
