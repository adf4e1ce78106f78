"""Search: one exact term in one field (or across fields), filters, ranking and a page.

The keyword is looked up as it stands, case and all.  An empty field means all searchable
fields together, an empty keyword all documents.  Hits are ranked by term weight times
inverse document frequency, where the document frequency is the number of hits after all
filters and the corpus is every id ever allocated; ties go to the smaller ``doc_id``.

A search counts the hits, which the scores and the page depend on, when it is built, and the
documents, unless their number is given; the page is then a bounded top-k.  With an index the
page is chosen from ids and weights alone, and only its documents are read in full.  No job
sorts all hits or brings them together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis, scoring
from ..types import FieldType, TableSchema
from . import filters as flt
from . import postings as post

PAGE = 100
#: A page of at most so many documents is read by their ids.
MOST_IDS = 1000


@dataclass(frozen=True)
class SearchRequest:
    field: str = ""
    keyword: str = ""
    filters: tuple[Mapping[str, Any], ...] = ()
    offset: int = 0
    size: int = 0

    @classmethod
    def of(cls, request: Mapping[str, Any] | SearchRequest) -> SearchRequest:
        """From a mapping with ``fieldName``, ``value``, ``filters``, ``offset`` and ``size``."""
        if isinstance(request, SearchRequest):
            return request
        g = request.get
        return cls(g("fieldName") or "", g("value") or "", tuple(g("filters") or ()), int(g("offset") or 0), int(g("size") or 0))


def page_of(offset: int, size: int, total: int) -> tuple[int, int]:
    """The page that is served: one that does not lie wholly within the hits gives the first."""
    if offset < 0 or size <= 0 or offset + size > total:
        return 0, min(total, PAGE)
    return offset, size


def nothing() -> tuple[Column, Column]:
    return F.lit(False), F.lit(0)


def match(kind: FieldType, text: Column, keyword: str, segmenter: analysis.Tokenizer | None = None) -> tuple[Column, Column]:
    """(whether a text has the term, its weight).

    A term is part of its text, so a plain containment test comes first; it is cheap, and
    the Parquet reader gets it.
    """
    has = text.contains(keyword)
    if kind is FieldType.WHOLE:
        return text == keyword, F.lit(0)
    if kind is FieldType.LIST:
        if ";" in keyword:
            return nothing()
        return has & (text != "") & F.array_contains(F.split(text, ";", -1), F.lit(keyword)), F.lit(0)
    if kind is FieldType.RUNE:
        return (has if len(keyword) == 1 else F.lit(False)), F.lit(0)
    if kind is not FieldType.WORDS:
        return nothing()
    if segmenter is not None:
        terms = segmenter(text)
        count = F.size(F.filter(terms, lambda t: t == keyword))
        return has & (count > 0), scoring.weight(count, F.size(terms))
    if not (analysis.is_word(keyword) or analysis.is_sign(keyword)):
        return nothing()
    count = analysis.term_count(text, keyword)
    return has & (count > 0), scoring.weight(count, analysis.word_count(text))


def candidates(docs: DataFrame, schema: TableSchema, request: SearchRequest, segmenter: analysis.Tokenizer | None = None) -> tuple[Column, Column]:
    """(match, weight) of a request on (doc_id, fields...), without an index."""
    if not request.keyword:
        return F.lit(True), F.lit(0)
    if not request.field:
        have = TableSchema(tuple(f for f in schema.searchable if f.name in docs.columns))
        return match(FieldType.WORDS, analysis.cross_field_text(have), request.keyword, segmenter) if have.fields else nothing()
    spec = schema.get(request.field)
    if spec is None:
        raise ValueError(f"no field {request.field!r} to search")
    if not spec.type.is_searchable or request.field not in docs.columns:
        return nothing()
    return match(spec.type, F.col(request.field), request.keyword, segmenter)


def hits(docs: DataFrame, schema: TableSchema, request: SearchRequest, segmenter: analysis.Tokenizer | None = None, index: DataFrame | None = None) -> DataFrame:
    """The documents that match and pass all filters, with their ``weight``."""
    columns = {f.name: F.col(f.name) for f in schema.fields if f.name in docs.columns}
    passing = flt.conjunction(schema, request.filters, columns)
    found, weight = candidates(docs, schema, request, segmenter)
    if index is None or not request.keyword or (request.field and not schema.get(request.field).type.is_searchable):
        return docs.where(passing).where(found).withColumn("weight", weight)
    looked_up = post.lookup(index, request.field or post.CROSS_FIELD, request.keyword)
    return docs.where(passing).join(looked_up, "doc_id")


def scored(found: DataFrame, allocated: int, total: int) -> DataFrame:
    """Adds ``score`` and ``total`` to the hits."""
    if not total:
        return found.withColumn("score", F.lit(0).cast("bigint")).withColumn("total", F.lit(0).cast("bigint"))
    score = scoring.score(F.col("weight"), F.lit(allocated), F.lit(total))
    return found.withColumn("score", score).withColumn("total", F.lit(total).cast("bigint"))


def search(docs: DataFrame, schema: TableSchema, request: Mapping[str, Any] | SearchRequest, allocated: int | None = None,
           columns: Iterable[str] | None = None, segmenter: analysis.Tokenizer | None = None, index: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """The page of a request: ``columns`` (all fields by default), weight, score and total, in order.

    ``docs`` are the live documents.  ``allocated`` is the number of ids ever given out, by
    default the number of documents.  With ``everything`` all hits come back, ranked, unpaged.
    """
    request = SearchRequest.of(request)
    found = hits(docs, schema, request, segmenter, index)
    by_index = index is not None and bool(request.keyword) and not everything
    keep = list(columns) if columns is not None else [f.name for f in schema.fields if f.name in docs.columns and f.name != "doc_id"]
    keep = list(dict.fromkeys(["doc_id", *keep]))
    total = found.count()
    allocated = docs.count() if allocated is None else allocated
    if by_index:
        offset, size = page_of(request.offset, request.size, total)
        page = scored(found.select("doc_id", "weight"), max(allocated, 1), total).orderBy(F.desc("score"), "doc_id").offset(offset).limit(size)
        if size <= MOST_IDS:  # its ids reach the Parquet reader
            rows = page.collect()
            page = docs.sparkSession.createDataFrame(rows, page.schema)
            docs = docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
        return docs.select(*keep).join(page, "doc_id").select(*keep, "weight", "score", "total").orderBy(F.desc("score"), "doc_id")
    ranked = scored(found.select(*keep, "weight"), max(allocated, 1), total)
    if everything:
        return ranked
    offset, size = page_of(request.offset, request.size, total)
    return ranked.orderBy(F.desc("score"), "doc_id").offset(offset).limit(size)


def idf(allocated: int, total: int) -> float:
    """The driver's own value of the inverse document frequency, for tests and reports."""
    return math.log10(allocated / total) if total else 0.0
