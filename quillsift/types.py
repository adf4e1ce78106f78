"""The document model: field types, field and table schemas, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

#: Numbers that mean "no value" to a filter: the largest long, and -1 (all low 63 bits set).
SENTINEL = (1 << 63) - 1
#: The key of a table that declares none; never shown among a document's fields.
HIDDEN_KEY = "__key"
#: Names the engine keeps for itself in a stored segment.
RESERVED = ("doc_id", "__key", "__valid")


class FieldType(str, Enum):
    """What a field holds and how it can be searched."""

    PRIMARY = "primary"  #: unique string key; point reads, no search
    WHOLE = "whole"  #: string whose whole value is one term
    WORDS = "words"  #: string cut into words, with term frequencies
    LIST = "list"  #: string of ``;``-separated terms
    RUNE = "rune"  #: string whose distinct characters are its terms
    NUMBER = "number"  #: long; filters only
    TIME = "time"  #: epoch seconds; filters only
    PURE = "pure"  #: string that is stored and filtered, never searched

    @property
    def is_string(self) -> bool:
        return self not in (FieldType.NUMBER, FieldType.TIME)

    @property
    def is_searchable(self) -> bool:
        return self in (FieldType.WHOLE, FieldType.WORDS, FieldType.LIST, FieldType.RUNE)

    @property
    def spark_type(self) -> T.DataType:
        return T.StringType() if self.is_string else T.LongType()

    @classmethod
    def of(cls, name: str | FieldType) -> FieldType:
        try:
            return cls(name)
        except ValueError:
            raise ValueError(f"unknown field type {name!r}") from None


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: FieldType

    def __post_init__(self):
        object.__setattr__(self, "type", FieldType.of(self.type))
        if not self.name or self.name in RESERVED:
            raise ValueError(f"a field can't be named {self.name!r}")


@dataclass(frozen=True)
class TableSchema:
    """The fields of a table, in order; at most one is its primary key."""

    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("two fields have the same name")
        if sum(f.type is FieldType.PRIMARY for f in self.fields) > 1:
            raise ValueError("a table has one primary key")

    @classmethod
    def of(cls, fields) -> TableSchema:
        """From pairs (name, type), a mapping name -> type, or dictionaries with ``name`` and ``type``."""
        if isinstance(fields, TableSchema):
            return fields
        pairs = fields.items() if isinstance(fields, dict) else ((f["name"], f["type"]) if isinstance(f, dict) else f for f in fields)
        return cls(tuple(FieldSpec(n, FieldType.of(t)) for n, t in pairs))

    @property
    def key(self) -> str | None:
        return next((f.name for f in self.fields if f.type is FieldType.PRIMARY), None)

    @property
    def values(self) -> tuple[FieldSpec, ...]:
        """All fields but the key."""
        return tuple(f for f in self.fields if f.type is not FieldType.PRIMARY)

    @property
    def searchable(self) -> tuple[FieldSpec, ...]:
        return tuple(f for f in self.fields if f.type.is_searchable)

    def get(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    def add(self, spec: FieldSpec) -> TableSchema:
        if self.get(spec.name):
            raise ValueError(f"field {spec.name!r} exists")
        if spec.type is FieldType.PRIMARY:
            raise ValueError("a table has one primary key, declared when it is created")
        return TableSchema((*self.fields, spec))

    def drop(self, name: str) -> TableSchema:
        spec = self.get(name)
        if spec is None:
            raise ValueError(f"no field {name!r}")
        if spec.type is FieldType.PRIMARY:
            raise ValueError("the primary key can't be dropped")
        return TableSchema(tuple(f for f in self.fields if f.name != name))

    def struct(self) -> T.StructType:
        """The columns of a stored segment."""
        own = [T.StructField("doc_id", T.LongType()), T.StructField(HIDDEN_KEY, T.StringType()), T.StructField("__valid", T.BooleanType())]
        return T.StructType(own + [T.StructField(f.name, f.type.spark_type, metadata={"field_type": f.type.value}) for f in self.values])

    def to_json(self) -> list[dict[str, str]]:
        return [{"name": f.name, "type": f.type.value} for f in self.fields]
