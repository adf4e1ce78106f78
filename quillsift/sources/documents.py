"""JSON documents: reading them into typed fields, and results back to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_epoch, truncate
from ..types import FieldSpec, FieldType, TableSchema


def _quoted(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def typed(body: Column, spec: FieldSpec) -> tuple[Column, Column]:
    """(value, whether it is valid) of one field of a JSON object given as a VARIANT.

    A missing string is empty; a missing number or time, a null, and a value of another kind
    are invalid.  Fractions of numbers are cut off.  Times are strings or epoch seconds.
    """
    path = _quoted(spec.name)
    value = F.try_variant_get(body, path, "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(body, path, "string")
    is_text, missing = kind == "STRING", value.isNull()
    if spec.type.is_string:
        return F.when(is_text, text).when(missing, F.lit("")), F.coalesce(is_text, missing)
    is_number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    number = F.when(kind == "BIGINT", F.try_variant_get(body, path, "bigint")).when(is_number, truncate(F.try_variant_get(body, path, "double")))
    if spec.type is FieldType.TIME:
        number = F.when(is_text, to_epoch(text)).otherwise(number)
    return number, number.isNotNull()


def parse(body: Column) -> Column:
    """A JSON text as a VARIANT; null unless it is an object."""
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def from_json(df: DataFrame, schema: TableSchema, body: str = "body", carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds the fields of JSON documents and ``__valid`` to the ``carry`` columns; unknown keys are ignored."""
    at = df.select(*carry, parse(F.col(body)).alias("__body"))
    pairs = [(f.name, *typed(F.col("__body"), f)) for f in schema.values]
    valid = F.col("__body").isNotNull()
    for _, _, ok in pairs:
        valid = valid & ok
    return at.select(*carry, F.coalesce(valid, F.lit(False)).alias("__valid"), *[v.alias(n) for n, v, _ in pairs])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON documents as (body)."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def to_json(df: DataFrame, columns: list[str] | None = None, pretty: bool = False) -> Column:
    """Each row of ``df`` as a JSON object."""
    options = {"pretty": "true", "ignoreNullFields": "false"} if pretty else {"ignoreNullFields": "false"}
    return F.to_json(F.struct(*(columns or df.columns)), options)
