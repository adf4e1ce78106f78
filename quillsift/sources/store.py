"""Databases and tables on a shared file system.

A table is a folder of immutable Parquet segments and a log of small metadata files, of
which the last holds: ``root/db/table/_meta/0000000012.json``.  A commit writes its data
first and then the next metadata file, which must not exist yet; so readers always see a
whole version, a failed job leaves only unreferenced files, and of two writers one fails.

A segment is a range of document ids with the schema it was written under.  Rows are never
changed: a new version of a document is a new row, and superseded or deleted ids are listed
in tombstone folders.  Ids of rejected documents stay taken and carry ``__valid`` false.

Compaction merges segments and their postings, purges superseded rows and forgets the
tombstones of what it merged; ``vacuum`` then deletes files that no recent version names.
Segments have a Bloom filter of their keys, so a lookup by key skips row groups without it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Tokenizer, segmenter_name
from ..operators import compaction, postings
from ..types import HIDDEN_KEY, SENTINEL, FieldSpec, TableSchema
from .files import Files


class VersionTaken(RuntimeError):
    """Another writer has published this version of a table."""


def within(ranges: Iterable[tuple[int, int]]) -> Column:
    """Whether ``doc_id`` lies in one of some half-open ranges."""
    each = [(F.col("doc_id") >= a) & (F.col("doc_id") < b) for a, b in compaction.intervals(list(ranges))]
    return reduce(lambda x, y: x | y, each, F.lit(False))


def write_segment(rows: DataFrame, path: str, n: int) -> None:
    """Few large files in id order, so that reads by id skip row groups by their bounds, and by key by Bloom filters."""
    writer = rows.sortWithinPartitions("doc_id").write
    for option, value in (("enabled", "true"), ("expected.ndv", max(1, min(n, 1_000_000)))):
        writer = writer.option(f"parquet.bloom.filter.{option}#{HIDDEN_KEY}", str(value))
    writer.parquet(path)


def _checked(name: str) -> str:
    if not name or name.startswith((".", "_")) or "/" in name:
        raise ValueError(f"bad name {name!r}")
    return name


class Database:
    """A folder of tables."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, _checked(name), f"{root}/{name}"
        self.files = Files(spark, root)

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def create(self) -> Database:
        if self.exists():
            raise ValueError(f"database {self.name!r} exists")
        self.files.mkdirs(self.path)
        return self

    def drop(self) -> None:
        """Remove the database and all of its tables."""
        if not self.exists():
            raise ValueError(f"no database {self.name!r}")
        self.files.delete(self.path)

    def tables(self) -> list[str]:
        return [t for t in self.files.folders(self.path) if self.files.names(f"{self.path}/{t}/_meta")]

    def create_table(self, name: str, fields) -> Table:
        if not self.exists():
            raise ValueError(f"no database {self.name!r}")
        if name in self.tables():
            raise ValueError(f"table {name!r} exists")
        table = Table(self.spark, self.path, name)
        table.commit(0, {"fields": TableSchema.of(fields).to_json(), "next_doc_id": 0, "segments": [], "tombstones": [], "indexes": []})
        return table

    def table(self, name: str) -> Table:
        if name not in self.tables():
            raise ValueError(f"no table {name!r} in {self.name!r}")
        return Table(self.spark, self.path, name)

    def drop_table(self, name: str) -> None:
        self.files.delete(self.table(name).path)


class Table:
    """A table as of its last version; every read lists the log again."""

    def __init__(self, spark: SparkSession, db_path: str, name: str):
        self.spark, self.name, self.path = spark, _checked(name), f"{db_path}/{name}"
        self.files = Files(spark, db_path)

    # -- versions

    def snapshot(self) -> tuple[int, dict[str, Any]]:
        names = [n for n in self.files.names(f"{self.path}/_meta") if n.endswith(".json")]
        if not names:
            raise ValueError(f"no table {self.name!r}")
        return int(names[-1][:-5]) + 1, self.files.read_json(f"{self.path}/_meta/{names[-1]}")

    def commit(self, version: int, meta: Mapping[str, Any]) -> None:
        """Publish a version; raises VersionTaken if another writer has published it."""
        self.files.mkdirs(f"{self.path}/_meta")
        try:
            self.files.write_new_json(f"{self.path}/_meta/{version:010d}.json", dict(meta))
        except FileExistsError as e:
            raise VersionTaken(f"version {version} of table {self.name!r} exists") from e

    def folder(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    @property
    def schema(self) -> TableSchema:
        return TableSchema.of(self.snapshot()[1]["fields"])

    # -- reading

    def _segment(self, seg: Mapping[str, Any], schema: TableSchema) -> DataFrame:
        """A segment under the current schema; fields it was written without are null."""
        own = TableSchema.of(seg["fields"])
        rows = self.spark.read.schema(own.struct()).parquet(seg["path"])
        same = {f.name for f in own.values if schema.get(f.name) == f}
        fields = [F.col(f.name) if f.name in same else F.lit(None).cast(f.type.spark_type).alias(f.name) for f in schema.values]
        return rows.select("doc_id", HIDDEN_KEY, "__valid", *fields)

    def log(self, meta: Mapping[str, Any] | None = None) -> DataFrame:
        """All rows ever given an id and not yet purged: doc_id, key, whether valid, fields."""
        meta = meta or self.snapshot()[1]
        schema = TableSchema.of(meta["fields"])
        parts = [self._segment(s, schema) for s in meta["segments"]]
        if not parts:
            return self.spark.createDataFrame([], schema.struct())
        return postings.merge(parts)

    def tombstones(self, meta: Mapping[str, Any]) -> DataFrame | None:
        if not meta["tombstones"]:
            return None
        return self.spark.read.schema("doc_id bigint").parquet(*meta["tombstones"])

    def live(self, meta: Mapping[str, Any] | None = None) -> DataFrame:
        """The documents as they stand: doc_id, key and fields (the declared key under its name).

        A field that a document's segment lacks is null, and matches no filter.
        """
        meta = meta or self.snapshot()[1]
        schema, dead = TableSchema.of(meta["fields"]), self.tombstones(meta)
        rows = self.log(meta).where("__valid")
        if dead is not None:
            rows = rows.join(dead, "doc_id", "left_anti")
        rows = rows.withColumn(schema.key, F.col(HIDDEN_KEY)) if schema.key else rows
        return rows.drop("__valid")

    def shown(self, rows: DataFrame) -> DataFrame:
        """Rows as results: absent strings are empty, the hidden key is left as ``key``."""
        schema = self.schema
        fields = [F.coalesce(f.name, F.lit("")).alias(f.name) if f.type.is_string else F.col(f.name) for f in schema.fields]
        extra = [c for c in ("weight", "score", "total") if c in rows.columns]
        return rows.select("doc_id", F.col(HIDDEN_KEY).alias("key"), *fields, *extra)

    def get(self, key: str) -> DataFrame:
        """The live document of a key: one row or none.  The key reaches the Parquet reader, which skips row groups by it."""
        return self.shown(self.live().where(F.col(HIDDEN_KEY) == key))

    def get_by_id(self, doc_id: int) -> DataFrame:
        """The live document of an id; only the segment whose range holds the id is read."""
        meta = self.snapshot()[1]
        meta["segments"] = [s for s in meta["segments"] if s["start"] <= doc_id < s["end"]]
        return self.shown(self.live(meta).where(F.col("doc_id") == doc_id))

    # -- schema changes

    def add_field(self, name: str, kind: str) -> None:
        version, meta = self.snapshot()
        meta["fields"] = TableSchema.of(meta["fields"]).add(FieldSpec(name, kind)).to_json()
        self.commit(version, meta)

    def drop_field(self, name: str) -> None:
        """The field is no longer read; its data goes with the next compaction."""
        version, meta = self.snapshot()
        meta["fields"] = TableSchema.of(meta["fields"]).drop(name).to_json()
        self.commit(version, meta)

    # -- segments

    def compact(self, least: int = 100_000, groups: Sequence[Sequence[int]] | None = None, purge_share: float = 0.3) -> list[list[int]]:
        """Merge neighbouring small segments; returns the groups.  Superseded rows are purged, ids stay.

        ``groups`` are positions of neighbours, by default those of the compaction plan; a
        segment on its own is rewritten if at least ``purge_share`` of its ids are dead.
        Fields a segment lacked are filled with their empty value, so they count as empty,
        not absent, from then on.  Readers of the version before keep its files.
        """
        version, meta = self.snapshot()
        schema, dead, segs = TableSchema.of(meta["fields"]), self.tombstones(meta), meta["segments"]
        sizes = [s["end"] - s["start"] for s in segs]
        groups = [list(g) for g in (compaction.plan(sizes, least) if groups is None else groups)]
        if dead is not None:
            of = F.size(F.filter(F.lit([s["start"] for s in segs]), lambda x: x <= F.col("doc_id"))) - 1
            n_dead = {r["s"]: r["n"] for r in dead.distinct().groupBy(of.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a segment
            merged = {i for g in groups for i in g}
            groups += [[i] for i, n in sorted(n_dead.items()) if i not in merged and n >= purge_share * sizes[i]]
        if not groups:
            return []
        at = {g[0]: g for g in groups}
        merged = {i for g in groups for i in g}
        out, ranges = [], []
        for i, seg in enumerate(segs):
            if i in at:
                rows = postings.merge([self._segment(segs[k], schema) for k in at[i]])
                if dead is not None:
                    rows = rows.join(dead, "doc_id", "left_anti")
                fill = [F.coalesce(f.name, F.lit("" if f.type.is_string else SENTINEL)).alias(f.name) for f in schema.values]
                path, start, end = self.folder("segments"), segs[at[i][0]]["start"], segs[at[i][-1]]["end"]
                write_segment(rows.where("__valid").select("doc_id", HIDDEN_KEY, "__valid", *fill), path, end - start)
                out.append({"path": path, "start": start, "end": end, "fields": schema.to_json()})
                ranges.append((start, end))
            elif i not in merged:
                out.append(seg)
        new = {"segments": out, "tombstones": self._tombstones_outside(dead, ranges), "indexes": self._merged_indexes(meta, dead, ranges)}
        self.commit(version, meta | new)
        return sorted(groups)

    def _tombstones_outside(self, dead: DataFrame | None, ranges: list[tuple[int, int]]) -> list[str]:
        """The tombstones of ids outside of some ranges, written as one folder, or none."""
        if dead is None:
            return []
        path = self.folder("tombstones")
        dead.where(~within(ranges)).distinct().write.parquet(path)
        if self.spark.read.schema("doc_id bigint").parquet(path).isEmpty():
            self.files.delete(path)
            return []
        return [path]

    # -- postings

    def _indexes(self, meta: Mapping[str, Any], segmenter: Tokenizer | None) -> list[dict[str, Any]]:
        """The parts of the index that hold under the current fields and were cut by this segmenter."""
        name = segmenter_name(segmenter)
        return [i for i in meta["indexes"] if i["fields"] == meta["fields"] and i.get("segmenter", segmenter_name(None)) == name]

    def _parts(self, entries: Iterable[Mapping[str, Any]]) -> dict[str, list[tuple[int, int]]]:
        """The folders of some parts of the index, with the ids that the parts name."""
        of: dict[str, list[tuple[int, int]]] = {}
        for i in entries:
            of.setdefault(i["path"], []).append((i["start"], i["end"]))
        return of

    def _merge_postings(self, entries: Iterable[Mapping[str, Any]], dead: DataFrame | None, a: int, b: int, path: str) -> None:
        """Write the postings of the ids from ``a`` to below ``b`` as one folder: bucket by bucket, or, to leave out the dead, in a shuffle."""
        if dead is None:
            of = self._parts(e for e in entries if e["start"] < b and a < e["end"])
            present: dict[int, list[str]] = {}
            for p in of:
                for f in self.files.folders(p):
                    if f.startswith("bucket="):
                        present.setdefault(int(f.removeprefix("bucket=")), []).append(p)
            if present:
                return postings.write_merged(self.spark, [(p, within(ranges) & within([(a, b)])) for p, ranges in of.items()], present, path)
        rows = self._postings(entries).where(within([(a, b)]))
        rows = rows if dead is None else rows.join(dead, "doc_id", "left_anti")
        postings.write(rows.select(*postings.COLUMNS, "cross"), path)

    def _postings(self, entries: Iterable[Mapping[str, Any]]) -> DataFrame:
        """The postings of some parts of the index, packed; of each folder only the ids that its parts name."""
        of = self._parts(entries)
        read = self.spark.read.schema(postings.STORED)
        return postings.merge([read.parquet(p).where(within(ranges)) for p, ranges in of.items()])

    def _merged_indexes(self, meta: Mapping[str, Any], dead: DataFrame | None, ranges: list[tuple[int, int]]) -> list[dict[str, Any]]:
        """The parts of the index with those of each range that they cover merged into one, without dead documents."""
        current = [i for i in meta["indexes"] if i["fields"] == meta["fields"]]
        out = []
        for name in dict.fromkeys(i.get("segmenter", segmenter_name(None)) for i in current):
            own = [i for i in current if i.get("segmenter", segmenter_name(None)) == name]
            spans = compaction.intervals([(i["start"], i["end"]) for i in own])
            new = []
            for a, b in ranges:
                if any(x <= a and b <= y for x, y in spans):
                    path = self.folder("postings")
                    self._merge_postings(own, dead, a, b, path)
                    new.append({"path": path, "start": a, "end": b, "fields": meta["fields"], "segmenter": name})
            out += [i | {"start": a, "end": b} for i in own for a, b in compaction.without(i["start"], i["end"], [(n["start"], n["end"]) for n in new])] + new
        return out

    def build_index(self, segmenter: Tokenizer | None = None) -> int:
        """Write the postings of all segments that have none; returns how many were indexed.

        Each id is in one part of the index only, however segments were merged since.
        """
        version, meta = self.snapshot()
        schema, own = TableSchema.of(meta["fields"]), self._indexes(meta, segmenter)
        done = compaction.intervals([(i["start"], i["end"]) for i in own])
        todo = [s for s in meta["segments"] if not any(a <= s["start"] and s["end"] <= b for a, b in done)]
        if not todo:
            return 0
        rows = postings.merge([self._segment(s, schema) for s in todo]).where("__valid")
        path, name = self.folder("postings"), segmenter_name(segmenter)
        postings.write(postings.packed(rows.drop("__valid", HIDDEN_KEY), schema, segmenter), path)
        others = [i for i in meta["indexes"] if i["fields"] == meta["fields"] and i not in own]
        taken = [(s["start"], s["end"]) for s in todo]
        kept = [i | {"start": a, "end": b} for i in own for a, b in compaction.without(i["start"], i["end"], taken)]
        new = [{"path": path, "start": s["start"], "end": s["end"], "fields": meta["fields"], "segmenter": name} for s in todo]
        self.commit(version, meta | {"indexes": others + kept + new})
        return len(todo)

    def index(self, meta: Mapping[str, Any] | None = None, segmenter: Tokenizer | None = None) -> DataFrame | None:
        """The postings, packed, if those of this segmenter cover every segment under the current fields; else None."""
        meta = meta or self.snapshot()[1]
        have = self._indexes(meta, segmenter)
        covered = compaction.intervals([(i["start"], i["end"]) for i in have])
        if not covered or covered[0][0] > 0 or covered[0][1] < meta["next_doc_id"]:
            return None
        return self._postings(have)

    # -- upkeep

    def vacuum(self, min_age: float = 3600.0) -> list[str]:
        """Delete what no version names that was current in the last ``min_age`` seconds; returns the paths.

        Files that no version names yet, of a write that is under way, are spared as long.
        """
        names = [n for n in self.files.names(f"{self.path}/_meta") if n.endswith(".json")]
        metas = [f"{self.path}/_meta/{n}" for n in names]
        kept = [m for m, after in zip(metas, [*metas[1:], None]) if after is None or self.files.age(after) < min_age]
        named = {x["path"] if isinstance(x, dict) else x for m in kept for k in ("segments", "tombstones", "indexes") for x in self.files.read_json(m)[k]}
        gone = [m for m in metas if m not in kept]
        for kind in ("segments", "tombstones", "postings"):
            folders = [f"{self.path}/{kind}/{f}" for f in self.files.folders(f"{self.path}/{kind}")]
            gone += [f for f in folders if f not in named and self.files.age(f) >= min_age]
        for path in gone:
            self.files.delete(path)
        return gone

    def last_dead(self) -> int | None:
        """The largest id among the tombstones."""
        dead = self.tombstones(self.snapshot()[1])
        return None if dead is None else dead.agg(F.max("doc_id")).first()[0]

    def outcomes(self, stream: str) -> DataFrame:
        """What became of each change of a stream, of the batches that were published: batch, seq, op, key, doc_id, status, error."""
        kind = "seq bigint, op string, key string, doc_id bigint, status string, error string, batch bigint"
        last, path = self.snapshot()[1].get("streams", {}).get(stream, -1), f"{self.path}/outcomes/{stream}"
        if last < 0 or not self.files.exists(path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(path).where(F.col("batch") <= last)

    def status(self) -> DataFrame:
        """One row a segment: its range of ids, rows, live documents and fields."""
        meta = self.snapshot()[1]
        if not meta["segments"]:
            return self.spark.createDataFrame([], "segment int, start bigint, end bigint, n_rows bigint, n_live bigint, fields string")
        dead, parts = self.tombstones(meta), []
        for k, s in enumerate(meta["segments"]):
            rows = self.spark.read.schema(TableSchema.of(s["fields"]).struct()).parquet(s["path"]).select("doc_id", "__valid")
            names = ",".join(f["name"] for f in s["fields"])
            parts.append(rows.select(F.lit(k).alias("segment"), F.lit(s["start"]).cast("bigint").alias("start"), F.lit(s["end"]).cast("bigint").alias("end"), "doc_id", "__valid", F.lit(names).alias("fields")))
        rows = postings.merge(parts)
        if dead is not None:
            rows = rows.join(dead.select("doc_id", F.lit(True).alias("__dead")).distinct(), "doc_id", "left")
        else:
            rows = rows.withColumn("__dead", F.lit(None).cast("boolean"))
        alive = F.col("__valid") & F.col("__dead").isNull()
        return rows.groupBy("segment", "start", "end", "fields").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(alive).alias("n_live"))
