"""The engine: databases, tables, documents and searches below one root folder.

Writes of one table are serial.  Single changes that come from several threads meanwhile wait
in a queue, and who gets the turn applies all of them as one batch, in order.  A batch that
loses its version to another process is judged again on the next.
"""

from __future__ import annotations

import json
import random
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.analysis import Tokenizer
from ..operators import compaction
from ..operators import search as find
from ..operators.search import SearchRequest
from ..sources import dml
from ..sources.files import Files
from ..sources.store import Database, Table, VersionTaken
from ..types import HIDDEN_KEY

_OPS = "seq bigint, op string, key string, body string"
#: Waiting changes that one batch takes at most, and how often a lost version is tried again.
BATCH = 1000
RETRIES = 8


@dataclass
class _Change:
    op: str
    key: str | None
    body: str | None
    outcome: dict[str, Any] | None = None
    error: BaseException | None = None
    done: bool = False


@dataclass
class _Turn:
    """Who may write a table, and what waits for it."""

    lock: threading.RLock = field(default_factory=threading.RLock)
    waiting: deque[_Change] = field(default_factory=deque)


class Engine:
    """All verbs of the engine.  ``with`` closes it; a closed engine refuses work.

    Small segments of a table are merged after ``merge_at`` further ids, whenever over
    ``max_segments`` of them are there, and, with ``merge_at_start``, when the engine starts.
    What no reader of the last ``keep_seconds`` can need is deleted after that.
    """

    def __init__(
        self, spark: SparkSession, root: str, merge_at: int = 100_000, segmenter: Tokenizer | None = None,
        max_segments: int = 16, merge_at_start: bool = True, keep_seconds: float = 3600.0,
    ):
        self.spark, self.root, self.merge_at, self.segmenter = spark, root.rstrip("/"), merge_at, segmenter
        self.max_segments, self.keep_seconds = max_segments, keep_seconds
        self.files = Files(spark, self.root)
        self.files.mkdirs(self.root)
        self.closed, self.streams = False, []
        self._turns: defaultdict[tuple[str, str], _Turn] = defaultdict(_Turn)
        self._guard = threading.Lock()
        if merge_at_start:
            self.merge_all()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Stop the streams and refuse further work; nothing is held in memory between commits."""
        for q in self.streams:
            q.stop()
        self.closed = True

    def _turn(self, db: str, table: str) -> _Turn:
        with self._guard:
            return self._turns[db, table]

    def _db(self, name: str) -> Database:
        if self.closed:
            raise RuntimeError("the engine is closed")
        return Database(self.spark, self.root, name)

    # -- containers

    def databases(self) -> list[str]:
        return self.files.folders(self.root)

    def create_database(self, name: str) -> Database:
        return self._db(name).create()

    def drop_database(self, name: str) -> None:
        self._db(name).drop()

    def create_table(self, db: str, name: str, fields) -> Table:
        return self._db(db).create_table(name, fields)

    def drop_table(self, db: str, name: str) -> None:
        self.table(db, name)
        self._db(db).drop_table(name)

    def table(self, db: str, name: str) -> Table:
        database = self._db(db)
        if not database.exists():
            raise ValueError(f"no database {db!r}")
        return database.table(name)

    def add_field(self, db: str, table: str, name: str, kind: str) -> None:
        t = self.table(db, table)
        self._serial(db, table, lambda: t.add_field(name, kind))

    def drop_field(self, db: str, table: str, name: str) -> None:
        t = self.table(db, table)
        self._serial(db, table, lambda: t.drop_field(name))

    # -- documents

    def _serial(self, db: str, table: str, write: Callable[[], Any]) -> Any:
        """Carry out a write in the table's turn, again if another process took its version."""
        with self._turn(db, table).lock:
            for left in range(RETRIES, -1, -1):
                try:
                    return write()
                except VersionTaken:
                    if not left:
                        raise
                    time.sleep(random.random() * 0.1 * (RETRIES - left + 1))

    def apply(self, db: str, table: str, ops: DataFrame, stream: tuple[str, int] | None = None) -> DataFrame:
        """Apply a batch of changes (seq, op, key, body); see ``sources.dml``."""
        t = self.table(db, table)
        with self._turn(db, table).lock:
            before = t.snapshot()[1]["next_doc_id"]
            out = self._serial(db, table, lambda: dml.apply_batch(t, ops, stream))
            self._upkeep(t, before)
        return out

    def _upkeep(self, t: Table, before: int) -> None:
        """Merge small segments if it is time, and delete what that left behind."""
        meta = t.snapshot()[1]
        sizes = [s["end"] - s["start"] for s in meta["segments"]]
        try:
            if meta["next_doc_id"] // self.merge_at > before // self.merge_at:
                merged = t.compact(self.merge_at)
            elif sum(n < self.merge_at for n in sizes) > self.max_segments:
                group = compaction.recent(sizes)
                merged = t.compact(self.merge_at, [group] if group else [])
            else:
                return
        except VersionTaken:
            return  # another process writes; the next batch tries again
        if merged:
            t.vacuum(self.keep_seconds)

    def _one(self, db: str, table: str, op: str, key: str | None, document: Mapping[str, Any] | None) -> dict[str, Any]:
        self.table(db, table)
        change = _Change(op, key, None if document is None else json.dumps(document, ensure_ascii=False))
        turn = self._turn(db, table)
        turn.waiting.append(change)
        with turn.lock:
            while not change.done:
                batch = [turn.waiting.popleft() for _ in range(min(BATCH, len(turn.waiting)))]
                try:
                    ops = self.spark.createDataFrame([(i, c.op, c.key, c.body) for i, c in enumerate(batch)], _OPS)
                    for r in self.apply(db, table, ops).collect():
                        batch[r["seq"]].outcome = r.asDict()
                except Exception as e:
                    for c in batch:
                        c.error = e
                finally:
                    for c in batch:
                        c.done = True
        if change.error is not None:
            raise change.error
        if change.outcome["status"] != "ok":
            raise ValueError(change.outcome["error"])
        return change.outcome

    def insert(self, db: str, table: str, key: str | None, document: Mapping[str, Any]) -> str:
        """Add a document; returns its key (generated for ``_auto``, or where none is given)."""
        return self._one(db, table, "insert", key, document)["key"]

    def update(self, db: str, table: str, key: str, document: Mapping[str, Any]) -> None:
        """Replace a whole document."""
        self._one(db, table, "update", key, document)

    def delete(self, db: str, table: str, key: str) -> None:
        self._one(db, table, "delete", key, None)

    def get(self, db: str, table: str, key: str) -> dict[str, Any] | None:
        t = self.table(db, table)
        row = t.get(key).first()
        return None if row is None else _document(row.asDict())

    # -- search

    def search(self, db: str, table: str, request: Mapping[str, Any] | SearchRequest, use_index: bool = True) -> DataFrame:
        """The page of a request as rows: doc_id, key, fields, weight, score, total."""
        t = self.table(db, table)
        meta = t.snapshot()[1]
        index = t.index(meta, self.segmenter) if use_index else None
        rows, schema = t.live(meta), t.schema
        names = [HIDDEN_KEY, *[f.name for f in schema.fields]]
        return t.shown(find.search(rows, schema, request, meta["next_doc_id"], names, self.segmenter, index))

    def search_documents(self, request: Mapping[str, Any]) -> dict[str, Any]:
        """A request that names ``database`` and ``table``; its page as documents, and the total."""
        rows = self.search(request["database"], request["table"], request).collect()  # one page
        docs = [_document(r.asDict()) for r in rows]
        return {"docs": docs or None, "total": rows[0]["total"] if rows else 0}

    def status(self) -> list[dict[str, Any]]:
        """Databases, tables, fields and counts."""
        out = []
        for db in self.databases():
            tables = []
            for name in self._db(db).tables():
                t = self.table(db, name)
                segments = [r.asDict() for r in t.status().orderBy("segment").collect()]  # a row a segment
                meta = t.snapshot()[1]
                tables.append({"table": name, "fields": meta["fields"], "next_doc_id": meta["next_doc_id"], "n_live": sum(s["n_live"] for s in segments), "segments": segments})
            out.append({"database": db, "tables": tables})
        return out

    def merge_all(self, least: int | None = None) -> None:
        """Merge the small segments of every table, as at start-up."""
        for db in self.databases():
            for name in self._db(db).tables():
                t = self.table(db, name)
                try:
                    with self._turn(db, name).lock:
                        if t.compact(least or self.merge_at):
                            t.vacuum(self.keep_seconds)
                except VersionTaken:
                    pass  # another process is at it


def _document(row: Mapping[str, Any], hide: Iterable[str] = ("doc_id", "key", "weight", "score", "total")) -> dict[str, Any]:
    return {"key": row["key"], "detail": {k: v for k, v in row.items() if k not in hide}}
