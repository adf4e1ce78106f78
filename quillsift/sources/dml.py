"""Changes to a table: a batch of inserts, updates and deletes, applied in order of ``seq``.

Rules, per key: an insert of a live key is refused and takes no id; an update of a key that
is not live is refused likewise; an insert or update whose document is invalid takes an id
but changes nothing else; an update replaces the whole document under a new id; a delete of
an absent key succeeds.  Whether a key is live before a change depends on the changes before
it, so it is a running value over the key's changes: the last valid insert makes it live,
the last delete ends that, and nothing else matters.  Changes with one ``seq`` are taken in
order of operation and content; changes alike in these, too, are the same change twice.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..types import HIDDEN_KEY, TableSchema
from . import documents
from .files import drop_written, written
from .store import Table, write_segment

AUTO = "_auto"
_RESULT = ("seq", "op", "key", "doc_id", "status", "error")


def _prepared(ops: DataFrame, table: Table, meta: dict[str, Any]) -> DataFrame:
    """Typed rows with the generated keys; ``__error`` where a change is refused whatever the table holds."""
    schema = TableSchema.of(meta["fields"])
    body, auto = documents.parse(F.col("body")), (F.col("op") == "insert") & (F.col("key") == AUTO)
    own = F.try_variant_get(body, documents._quoted(schema.key), "variant") if schema.key else F.lit(None).cast("variant")
    own_text = F.try_variant_get(own, "$", "string")
    given = F.coalesce("key", own_text) if schema.key else F.col("key")
    key = F.when(auto | ((F.col("op") == "insert") & given.isNull()), F.uuid()).otherwise(given)
    writes = F.col("op").isin("insert", "update")
    error = (
        F.when(~F.coalesce(F.col("op").isin("insert", "update", "delete"), F.lit(False)), "unknown operation")
        .when(F.col("seq").isNull(), "no sequence number")
        .when(writes & own.isNotNull() & (F.schema_of_variant(own) != "STRING"), "the key is not a string")
        .when(writes & own.isNotNull() & (own_text != F.coalesce("key", own_text)), "the document has another key")
        .when(~auto & (F.col("op") != "insert") & given.isNull(), "no key")
        .when(writes & F.lit(not schema.values), "the table has no fields")
    )
    base = ops.select("seq", "op", "body", key.alias("__key"), error.alias("__error"), F.xxhash64("body").alias("__tie"))
    return documents.from_json(base, schema, carry=("seq", "op", "__key", "__error", "__tie"))


#: Bytes of changes, as written, for each range of ``seq``.
RANGE_BYTES = 32 << 20


def _with_ids(rows: DataFrame, first: int, ranges: int) -> tuple[DataFrame, list[int], int]:
    """The rows without ``__error`` with doc_id, ``first`` and up in order of ``seq``, and ``__p``, their range of ``seq``, written;
    returns where the ranges begin and the number of ids taken.

    Rows, refused ones too, are cut into ranges of ``seq`` and ranked within them; only the sizes and
    beginnings of the ranges come to the driver, so no window sees all rows.
    """
    ranged = written(rows.repartitionByRange(ranges, "seq").withColumn("__p", F.spark_partition_id()), "ranged")
    takes = F.col("__error").isNull()
    found = ranged.groupBy("__p").agg(F.count_if(takes).alias("n"), F.min("seq").alias("begin")).orderBy("__p").collect()  # a row a range
    offsets, begins, total = [], [], 0
    for r in found:
        offsets.append(first + total)
        begins.append(r["begin"])
        total += r["n"]
    rank = F.row_number().over(W.partitionBy("__p").orderBy("seq", HIDDEN_KEY, "__nth"))
    numbered = ranged.where(takes).withColumn("__rank", rank).withColumn("__p", _range_of(begins))
    numbered = written(numbered.withColumn("doc_id", F.get(_longs(offsets), F.col("__p")) + F.col("__rank") - 1).drop("__rank"), "numbered")
    drop_written(ranged)
    return numbered, begins, total


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), F.lit("array<bigint>"))


def _range_of(begins: list[int]) -> Column:
    """Which of the ranges that begin at these numbers, in order, ``seq`` lies in; looked up in two steps, of the root of their number each."""
    if len(begins) < 2:
        return F.lit(0)
    wide = math.isqrt(len(begins) - 1) + 1
    groups = [begins[k : k + wide] for k in range(0, len(begins), wide)]
    last = lambda of: F.greatest(F.size(F.filter(of, lambda b: b <= F.col("seq"))) - 1, F.lit(0))
    at = last(_longs([g[0] for g in groups]))
    return at * wide + last(F.get(F.from_json(F.lit(str(groups)), F.lit("array<array<bigint>>")), at))


def _documents(rows: DataFrame, numbered: DataFrame, begins: list[int], columns: list[str]) -> DataFrame:
    """The rows that have an id, with it, a task a range of ids; each row is moved once, refused ones to the task of their ``seq``."""
    keep = ["__row", "__p", "__kind", "doc_id", *columns]
    given = numbered.select("__row", "__p", "doc_id", F.lit(0).alias("__kind"))
    both = rows.withColumn("__p", _range_of(begins)).withColumn("__kind", F.lit(1)).withColumn("doc_id", F.lit(None).cast("bigint")).select(keep)
    both = both.unionByName(given, allowMissingColumns=True).repartitionById(len(begins), F.col("__p"))
    own = F.lag("doc_id").over(W.partitionBy("__p", "__row").orderBy("__kind"))
    return both.withColumn("doc_id", own).where((F.col("__kind") == 1) & F.col("doc_id").isNotNull()).select("doc_id", *columns)


#: Up to so many changed keys are looked up by value, which the Parquet reader prunes by; more are joined.
FEW_KEYS = 1000


def _held(table: Table, meta: dict[str, Any], legal: DataFrame) -> DataFrame:
    """(key, __old) of the live documents among the keys of some changes."""
    keys = table.live(meta).select(HIDDEN_KEY, F.col("doc_id").alias("__old"))
    few = [r[0] for r in legal.select(HIDDEN_KEY).distinct().limit(FEW_KEYS + 1).collect()]
    if len(few) <= FEW_KEYS:
        return keys.where(F.col(HIDDEN_KEY).isin(few))
    return keys.join(legal.select(HIDDEN_KEY).distinct(), HIDDEN_KEY, "left_semi")


def apply_batch(table: Table, ops: DataFrame, stream: tuple[str, int] | None = None) -> DataFrame:
    """Apply (seq, op, key, body) and publish a version; returns seq, op, key, doc_id, status, error.

    ``op`` is insert, update or delete; ``body`` a JSON object; the key ``_auto``, or none,
    has one generated on insert.  ``stream`` (name, batch number) makes a repeated micro-batch
    change nothing.
    """
    version, meta = table.snapshot()
    if stream and meta.get("streams", {}).get(stream[0], -1) >= stream[1]:
        return table.spark.createDataFrame([], "seq bigint, op string, key string, doc_id bigint, status string, error string")
    fields = [f["name"] for f in meta["fields"] if f["type"] != "primary"]
    rows = _prepared(ops.select(F.col("seq").cast("bigint").alias("seq"), "op", "key", "body"), table, meta)
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "changes")
    # Changes are judged without their documents, which are moved once, when their ids are known.
    legal = rows.where(F.col("__error").isNull()).select("__row", "seq", "op", HIDDEN_KEY, "__valid", "__error", "__tie")
    if meta["segments"]:
        legal = legal.join(_held(table, meta, legal), HIDDEN_KEY, "left")
    else:
        legal = legal.withColumn("__old", F.lit(None).cast("bigint"))

    whole = W.partitionBy(HIDDEN_KEY).orderBy("seq", "op", "__tie")
    before = whole.rowsBetween(W.unboundedPreceding, -1)
    is_insert, is_delete, ok = F.col("op") == "insert", F.col("op") == "delete", F.col("__valid")
    turn = F.when(is_insert & ok, True).when(is_delete, False)
    live = F.coalesce(F.last(turn, ignorenulls=True).over(before), F.col("__old").isNotNull())
    judged = legal.withColumn("__live", live).withColumn("__nth", F.row_number().over(whole)).withColumn(
        "__error",
        F.when(is_insert & F.col("__live"), "the key exists").when((F.col("op") == "update") & ~F.col("__live"), "no such document"),
    )
    judged = written(judged, "judged")
    ranges = max(1, math.ceil(table.files.size(rows._written) / RANGE_BYTES))
    numbered, begins, taken = _with_ids(judged.where(~is_delete), meta["next_doc_id"], ranges)

    # Which id each successful update or delete ends: the last one its key got before, or the table's.
    done = numbered.select("op", HIDDEN_KEY, "__nth", "__valid", "__live", "__old", "doc_id").unionByName(
        judged.where(is_delete).select("op", HIDDEN_KEY, "__nth", "__valid", "__live", "__old", F.lit(None).cast("bigint").alias("doc_id"))
    )
    before = W.partitionBy(HIDDEN_KEY).orderBy("__nth").rowsBetween(W.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("__valid") & ~is_delete, F.col("doc_id")), ignorenulls=True).over(before), F.col("__old"))
    ended = done.withColumn("__ends", held).where(F.col("__live") & (is_delete | ((F.col("op") == "update") & ok)))

    new = dict(meta) | {"next_doc_id": meta["next_doc_id"] + taken}
    if taken:
        path = table.folder("segments")
        writes = rows.where(F.col("op").isin("insert", "update") & F.col("__error").isNull())
        write_segment(_documents(writes, numbered, begins, [HIDDEN_KEY, "__valid", *fields]), path, taken)
        new["segments"] = [*meta["segments"], {"path": path, "start": meta["next_doc_id"], "end": new["next_doc_id"], "fields": meta["fields"]}]
    path = table.folder("tombstones")
    ended.select(F.col("__ends").alias("doc_id")).write.parquet(path)
    if table.spark.read.schema("doc_id bigint").parquet(path).isEmpty():
        table.files.delete(path)
    else:
        new["tombstones"] = [*meta["tombstones"], path]

    invalid = F.when(~ok, "the document is invalid")
    none = F.lit(None).cast("bigint").alias("doc_id")
    outcome = (
        numbered.select("seq", "op", HIDDEN_KEY, "doc_id", invalid.alias("error"))
        .unionByName(judged.where(is_delete | F.col("__error").isNotNull()).select("seq", "op", HIDDEN_KEY, none, F.col("__error").alias("error")))
        .unionByName(rows.where(F.col("__error").isNotNull()).select("seq", "op", HIDDEN_KEY, none, F.col("__error").alias("error")))
    )
    status = F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status")
    outcome = outcome.select("seq", "op", F.col(HIDDEN_KEY).alias("key"), "doc_id", status, "error")
    if stream:  # beside the table, before the batch is published; if it is run again, written again
        new["streams"] = meta.get("streams", {}) | {stream[0]: stream[1]}
        path = f"{table.path}/outcomes/{stream[0]}/batch={stream[1]}"
        outcome.write.mode("overwrite").parquet(path)
        outcome = table.spark.read.schema(outcome.schema).parquet(path)
    else:
        outcome = written(outcome, "outcome")
    table.commit(version, new)
    drop_written(rows, judged, numbered)
    return outcome
