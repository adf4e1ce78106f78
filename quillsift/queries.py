"""The engine's operators as registered queries over the driver's tables, with their SQL.

Every query reads its whole tables.  A limit stands only where a page is what is asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis, scalars
from .operators import compaction, filters, ordered, postings, search
from .plans.engine import Engine
from .plans.routes import route
from .sources import documents as docs_json
from .sources.files import Files, work_dir, written
from .streaming.ingest import changes, ingest
from .types import SENTINEL, TableSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Driver tables as document tables: the column that numbers the documents, and the fields.
TABLES = {
    "documents": ("doc_id", {"text": "words", "lang": "whole", "source": "whole", "n_chars": "number"}),
    "part": ("p_partkey", {"p_name": "words", "p_brand": "whole", "p_type": "whole", "p_size": "number"}),
    "customer": ("c_custkey", {"c_name": "whole", "c_mktsegment": "whole", "c_nationkey": "number"}),
    "events": ("event_id", {"event_type": "whole", "user_id": "number", "ts": "time", "props": "pure"}),
    "orders": ("o_orderkey", {"o_orderstatus": "whole", "o_custkey": "number", "o_orderdate": "time", "o_orderpriority": "whole"}),
    "benchmark": ("item_id", {"text": "words"}),
}


def schema_of(table: str) -> TableSchema:
    return TableSchema.of(TABLES[table][1])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table as (doc_id, fields): times in epoch seconds, numbers as long."""
    key, fields = TABLES[table]
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")

    def column(name: str, kind: str):
        if kind == "time":
            return F.unix_seconds(F.col(name).cast("timestamp")).alias(name)
        return (F.col(name).cast("bigint") if kind == "number" else F.col(name)).alias(name)

    return t.select(F.col(key).cast("bigint").alias("doc_id"), *[column(n, k) for n, k in fields.items()])


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_MARKS = ", ".join(_quote(m) for m in analysis.MARKS)


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]'), lambda t: t NOT IN ({_MARKS}))"


def search_sql(table: str, tokens: str, keyword: str, where: str = "true", columns: str = "", page: tuple[int, int] | None = None) -> str:
    """The ranked hits of a term, over whole tables, by lists of tokens."""
    key = TABLES[table][0]
    cols = f", {columns}" if columns else ""
    limit = f"ORDER BY score DESC, doc_id LIMIT {page[1]} OFFSET {page[0]}" if page else ""
    return f"""
WITH toks AS (SELECT {key} AS doc_id{cols}, {tokens} AS ts FROM {table} WHERE {where}),
hit AS (SELECT * EXCLUDE (ts), len(ts) AS n, len(list_filter(ts, lambda t: t = {_quote(keyword)})) AS c FROM toks),
weighed AS (SELECT * EXCLUDE (n, c), trunc((c::FLOAT / n::FLOAT) * 10000::FLOAT)::INT AS weight FROM hit WHERE c > 0),
counted AS (SELECT *, (SELECT count(*) FROM weighed) AS total, (SELECT count(*) FROM {table}) AS allocated FROM weighed)
SELECT * EXCLUDE (allocated), CAST(floor(weight / 10000::DOUBLE * log10(allocated::DOUBLE / total::DOUBLE) * 1000::DOUBLE) AS BIGINT) AS score
FROM counted {limit}
"""


def flat_sql(table: str, where: str, columns: str) -> str:
    """Hits of weight 0 (whole values, lists, characters, all documents)."""
    key = TABLES[table][0]
    return f"""
WITH hit AS (SELECT {key} AS doc_id{", " + columns if columns else ""} FROM {table} WHERE {where})
SELECT *, 0 AS weight, CAST(0 AS BIGINT) AS score, (SELECT count(*) FROM hit) AS total FROM hit
"""


# -- search

_FLAGSHIP = {
    "fieldName": "text", "value": "the", "offset": 0, "size": 10,
    "filters": [{"field": "lang", "type": "=", "str": "en"}, {"field": "n_chars", "type": "between", "begin": 500, "end": 5000}],
}


@query(search_sql("documents", tokens_sql("text"), "the", "lang = 'en' AND n_chars BETWEEN 500 AND 5000", "lang, n_chars", (0, 10)))
def search_words_topk(spark, sf_dir):
    """The flagship: best ten English documents of middling length for a word."""
    return search.search(load(spark, sf_dir, "documents"), schema_of("documents"), _FLAGSHIP, columns=["lang", "n_chars"])


@query(search_sql("documents", tokens_sql("text"), "the", "true", "lang"))
def search_words_all(spark, sf_dir):
    return search.search(load(spark, sf_dir, "documents"), schema_of("documents"), {"fieldName": "text", "value": "the"}, columns=["lang"], everything=True)


@query(search_sql("documents", tokens_sql("text"), "\n", "true", "source"))
def search_sign(spark, sf_dir):
    """A single sign that is not a mark is a term: here the line break."""
    return search.search(load(spark, sf_dir, "documents"), schema_of("documents"), {"fieldName": "text", "value": "\n"}, columns=["source"], everything=True)


@query(search_sql("documents", tokens_sql("concat_ws('。', text, lang, source)"), "en", "true", "lang"))
def search_cross_field(spark, sf_dir):
    """An empty field name searches all string fields together."""
    return search.search(load(spark, sf_dir, "documents"), schema_of("documents"), {"value": "en"}, columns=["lang"], everything=True)


@query(flat_sql("customer", "c_mktsegment = 'BUILDING'", "c_name"))
def search_whole_exact(spark, sf_dir):
    request = {"fieldName": "c_mktsegment", "value": "BUILDING"}
    return search.search(load(spark, sf_dir, "customer"), schema_of("customer"), request, columns=["c_name"], everything=True)


@query(flat_sql("documents", "true", "lang"))
def search_empty_keyword(spark, sf_dir):
    return search.search(load(spark, sf_dir, "documents"), schema_of("documents"), {"fieldName": "text"}, columns=["lang"], everything=True)


def _empty(name: str, table: str, request: dict) -> None:
    def run(spark, sf_dir):
        return search.search(load(spark, sf_dir, table), schema_of(table), request, columns=[], everything=True)

    QUERIES[name] = run
    SQL[name] = flat_sql(table, "false", "")


_empty("search_no_match", "documents", {"fieldName": "text", "value": "qqqqzzzz"})
_empty("search_on_number_field", "events", {"fieldName": "user_id", "value": "8"})
_empty("search_on_pure_field", "events", {"fieldName": "props", "value": '{"k": 69}'})
_empty("search_multiword_is_one_term", "documents", {"fieldName": "text", "value": "the the"})


@query(flat_sql("part", "list_contains(string_split(replace(p_name, ' ', ';'), ';'), 'ring')", "p_name"))
def search_list(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("doc_id", "p_name", F.translate("p_name", " ", ";").alias("tags"))
    return search.search(parts, TableSchema.of({"p_name": "pure", "tags": "list"}), {"fieldName": "tags", "value": "ring"}, columns=["p_name"], everything=True)


@query(flat_sql("part", "contains(p_name, 'g')", "p_name"))
def search_rune(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("doc_id", "p_name")
    return search.search(parts, TableSchema.of({"p_name": "rune"}), {"fieldName": "p_name", "value": "g"}, columns=["p_name"], everything=True)


@query(search_sql("documents", tokens_sql("text"), "de", "true", ""))
def search_by_index(spark, sf_dir):
    """The same search answered from stored postings."""
    docs, schema = load(spark, sf_dir, "documents"), schema_of("documents")
    path = f"{work_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings.write(postings.packed(docs, schema), path)
    index = spark.read.parquet(path)
    return search.search(docs, schema, {"fieldName": "text", "value": "de"}, columns=[], index=index, everything=True)


# -- pages


def _page(name: str, offset: int, size: int, sql_page: str) -> None:
    def run(spark, sf_dir):
        request = {"fieldName": "text", "value": "la", "offset": offset, "size": size}
        return search.search(load(spark, sf_dir, "documents"), schema_of("documents"), request, columns=[])

    QUERIES[name] = run
    SQL[name] = f"SELECT * FROM ({search_sql('documents', tokens_sql('text'), 'la')}) ORDER BY score DESC, doc_id {sql_page}"


_page("page_in_range", 5, 7, "LIMIT 7 OFFSET 5")
_page("page_past_end_gives_first", 1 << 40, 10, "LIMIT 100")
_page("page_default", 0, 0, "LIMIT 100")


# -- filters


def _filter(name: str, table: str, f: dict, sql: str, columns: str) -> None:
    def run(spark, sf_dir):
        return search.search(load(spark, sf_dir, table), schema_of(table), {"filters": [f]}, columns=columns.split(", "), everything=True)

    QUERIES[f"filter_{name}"] = run
    SQL[f"filter_{name}"] = flat_sql(table, sql, columns)


_SIZE, _BRAND = "CAST(p_size AS BIGINT) AS p_size", "p_brand"
for _name, _f, _sql in (
    ("eq_num", {"type": "=", "int": 11}, "p_size = 11"),
    ("neq_num", {"type": "!=", "int": 11}, "p_size <> 11"),
    ("gt_inclusive", {"type": ">", "int": 40}, "p_size >= 40"),
    ("lt_inclusive", {"type": "<", "int": 11}, "p_size <= 11"),
    ("between", {"type": "between", "begin": 11, "end": 22}, "p_size BETWEEN 11 AND 22"),
    ("in_num", {"type": "in", "iranges": [1, 11, 50]}, "p_size IN (1, 11, 50)"),
    ("not_in_num", {"type": "not in", "iranges": [1, 11, 50]}, "p_size NOT IN (1, 11, 50)"),
    ("in_nothing", {"type": "in", "iranges": []}, "false"),
    ("not_in_nothing", {"type": "not in", "iranges": []}, "true"),
    ("unknown_type", {"type": "like", "str": "x"}, "false"),
):
    _filter(_name, "part", {"field": "p_size", **_f}, _sql, "p_name")
for _name, _f, _sql in (
    ("eq_str", {"type": "=", "str": "Brand#17"}, "p_brand = 'Brand#17'"),
    ("neq_str", {"type": "!=", "str": "Brand#17"}, "p_brand <> 'Brand#17'"),
    ("prefix", {"type": "prefix", "str": "Brand#1"}, "starts_with(p_brand, 'Brand#1')"),
    ("suffix", {"type": "suffix", "str": "7"}, "suffix(p_brand, '7')"),
    ("contain", {"type": "contain", "str": "#2"}, "contains(p_brand, '#2')"),
    ("in_str", {"type": "in", "sranges": ["Brand#2", "Brand#17"]}, "p_brand IN ('Brand#2', 'Brand#17')"),
    ("not_in_str", {"type": "not in", "sranges": ["Brand#2", "Brand#17"]}, "p_brand NOT IN ('Brand#2', 'Brand#17')"),
):
    _filter(_name, "part", {"field": "p_brand", **_f}, _sql, "p_brand")
_filter("time_between", "events", {"field": "ts", "type": "between", "begin": 1704672000, "end": 1705276800}, "floor(epoch(ts)) BETWEEN 1704672000 AND 1705276800", "event_type")
_filter("pure_contain", "events", {"field": "props", "type": "contain", "str": "6"}, "contains(props, '6')", "event_type")


@query(flat_sql("part", "p_size >= 11 AND p_size <= 40 AND p_type = 'ECONOMY' AND starts_with(p_brand, 'Brand#1')", "p_brand, p_type"))
def filter_conjunction(spark, sf_dir):
    fs = [{"field": "p_size", "type": ">", "int": 11}, {"field": "p_size", "type": "<", "int": 40}, {"field": "p_type", "type": "=", "str": "ECONOMY"}, {"field": "p_brand", "type": "prefix", "str": "Brand#1"}]
    return search.search(load(spark, sf_dir, "part"), schema_of("part"), {"filters": fs}, columns=["p_brand", "p_type"], everything=True)


@query(f"""
WITH v(x) AS (VALUES (-1::BIGINT), (0::BIGINT), (-2::BIGINT), (7::BIGINT), ({SENTINEL}::BIGINT), ((-9223372036854775808)::BIGINT))
SELECT x, (x & {SENTINEL}) <> {SENTINEL} AND x = -1 AS eq, (x & {SENTINEL}) <> {SENTINEL} AND x <> 7 AS neq,
       (x & {SENTINEL}) <> {SENTINEL} AND x >= -2 AS gt, NOT ((x & {SENTINEL}) <> {SENTINEL} AND x IN (-1, 7)) AS not_in FROM v
""")
def filter_sentinels(spark, sf_dir):
    """-1 and the largest long count as no value."""
    schema = TableSchema.of({"x": "number"})
    v = spark.createDataFrame([(x,) for x in (-1, 0, -2, 7, SENTINEL, -SENTINEL - 1)], "x bigint")
    of = lambda **f: filters.conjunction(schema, [{"field": "x", **f}], {"x": F.col("x")})
    return v.select("x", of(type="=", int=-1).alias("eq"), of(type="!=", int=7).alias("neq"), of(type=">", int=-2).alias("gt"), of(type="not in", iranges=[-1, 7]).alias("not_in"))


# -- tokenizers and postings


def _tokens(name: str, terms, sql: str) -> None:
    def run(spark, sf_dir):
        return load(spark, sf_dir, "part").select("doc_id", F.explode(terms(F.col("p_name"))).alias("term"))

    QUERIES[name] = run
    SQL[name] = f"SELECT p_partkey AS doc_id, unnest({sql}) AS term FROM part"


_tokens("tokens_rune", analysis.runes, "list_distinct(string_split(p_name, ''))")
_tokens("tokens_list", lambda c: analysis.semicolon_list(F.translate(c, " ", ";")), "list_distinct(string_split(replace(p_name, ' ', ';'), ';'))")
_tokens("tokens_whole", analysis.whole, "[p_name]")


@query(f"SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents")
def tokens_words(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(analysis.words(F.col("text"))).alias("term"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]')) AS n_all, len(" + tokens_sql("text") + ") AS n_terms FROM documents")
def token_marks(spark, sf_dir):
    """How many tokens, and how many without marks."""
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.size(analysis.all_tokens(text)).cast("bigint").alias("n_all"), F.size(analysis.drop_marks(analysis.all_tokens(text))).cast("bigint").alias("n_terms"))


def _postings_sql() -> str:
    part = lambda field, ts: f"SELECT doc_id, {_quote(field)} AS field, unnest({ts}) AS term FROM documents"
    words = " UNION ALL ".join(part(f, tokens_sql(t)) for f, t in (("text", "text"), (postings.CROSS_FIELD, "concat_ws('。', text, lang, source)")))
    counted = f"SELECT field, term, doc_id, count(*) AS c FROM ({words}) GROUP BY field, term, doc_id"
    weighed = f"SELECT field, term, doc_id, trunc((c::FLOAT / (sum(c) OVER (PARTITION BY field, doc_id))::FLOAT) * 10000::FLOAT)::INT AS weight FROM ({counted})"
    return f"{weighed} UNION ALL SELECT 'lang', lang, doc_id, 0 FROM documents UNION ALL SELECT 'source', source, doc_id, 0 FROM documents"


def _postings(spark, sf_dir):
    return postings.build(load(spark, sf_dir, "documents"), schema_of("documents")).drop("bucket")


@query(_postings_sql())
def postings_build(spark, sf_dir):
    """Every posting of every field, and of all fields together."""
    return _postings(spark, sf_dir)


@query(f"SELECT field, min(term) AS first_term, max(term) AS last_term, count(DISTINCT term) AS n_terms FROM ({_postings_sql()}) GROUP BY field")
def term_dictionary(spark, sf_dir):
    return _postings(spark, sf_dir).groupBy("field").agg(F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.count_distinct("term").alias("n_terms"))


@query(f"SELECT min(term) AS term FROM ({_postings_sql()}) WHERE field = 'text'")
def term_first(spark, sf_dir):
    return postings.first_term(_postings(spark, sf_dir), "text")


@query(f"SELECT min(term) AS term FROM ({_postings_sql()}) WHERE field = 'text' AND term > 'the'")
def term_next(spark, sf_dir):
    return postings.next_term(_postings(spark, sf_dir), "text", "the")


@query(f"SELECT field, term, count(*) AS n_docs, CAST(sum(weight) AS BIGINT) AS sum_weight FROM ({_postings_sql()}) GROUP BY field, term")
def term_counts(spark, sf_dir):
    return postings.term_counts(_postings(spark, sf_dir))


@query(f"""
SELECT field, term, doc_id // {postings.CHUNK} AS part, string_agg(doc_id || ':' || weight, ' ' ORDER BY doc_id) AS postings
FROM ({_postings_sql()}) GROUP BY field, term, part
""")
def term_walk(spark, sf_dir):
    """Every term with its postings in order, a range of ids at a time, as text."""
    line = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["weight"])), " ")
    packed = postings.packed(load(spark, sf_dir, "documents"), schema_of("documents"))
    return postings.walk(packed).select("field", "term", "part", line.alias("postings"))


@query(f"""
WITH p AS ({_postings_sql()}), a AS (SELECT doc_id, weight FROM p WHERE field = 'text' AND term = 'the'),
b AS (SELECT doc_id, weight FROM p WHERE field = 'text' AND term = 'of')
SELECT a.doc_id, CAST(a.weight + floor(b.weight * log10((SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM b)::DOUBLE)) AS BIGINT) AS weight
FROM a JOIN b ON a.doc_id = b.doc_id
""")
def postings_intersect(spark, sf_dir):
    """Documents with two terms: an extension of single-term search."""
    docs = load(spark, sf_dir, "documents")
    p = written(postings.build(docs, schema_of("documents"), cross_field=False), "postings")
    a, b = postings.lookup(p, "text", "the"), postings.lookup(p, "text", "of")
    return postings.intersect(a, b, docs.count(), b.count())


# -- scalars


@query("""
SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_text, CAST(epoch(o_orderdate) AS BIGINT) AS as_seconds,
       CAST(epoch(o_orderdate::DATE) AS BIGINT) AS as_day, CAST(trunc(o_totalprice) AS BIGINT) AS as_long FROM orders
""")
def scalar_functions(spark, sf_dir):
    """Times to text and back, and numbers without their fraction."""
    o = load(spark, sf_dir, "orders").select("doc_id", "o_orderdate").join(
        spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice"), "doc_id"
    )
    text = scalars.from_epoch(F.col("o_orderdate"))
    return o.select("doc_id", text.alias("as_text"), scalars.to_epoch(text).alias("as_seconds"), scalars.to_epoch(F.substring(text, 1, 10)).alias("as_day"), scalars.truncate(F.col("o_totalprice")).alias("as_long"))


@query("SELECT o_orderkey AS doc_id, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders WHERE o_orderkey = 77")
def get_by_docid(spark, sf_dir):
    """A point read; the predicate reaches the Parquet reader."""
    o = load(spark, sf_dir, "orders").where("doc_id = 77")
    return o.select("doc_id", "o_orderstatus", scalars.from_epoch(F.col("o_orderdate")).alias("o_orderdate"))


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars})::VARCHAR AS json FROM documents")
def json_sink(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return t.select("doc_id", docs_json.to_json(t).alias("json"))


# -- tables: changes, segments, schema changes, compaction, streams


def _engine(spark: SparkSession, **settings) -> Engine:
    engine = Engine(spark, f"{work_dir(spark)}/engine-{uuid.uuid4().hex}", **settings)
    engine.create_database("db")
    engine.create_table("db", "docs", {"id": "primary", **TABLES["documents"][1]})
    return engine


def _inserts(docs: DataFrame, op: str = "insert", **replaced) -> DataFrame:
    body = F.to_json(F.struct(*[replaced.get(c, F.col(c)).alias(c) for c in TABLES["documents"][1]]))
    return docs.select(F.col("doc_id").alias("seq"), F.lit(op).alias("op"), F.col("doc_id").cast("string").alias("key"), body.alias("body"))


def _labelled(spark, sf_dir, where: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels.where(where), "doc_id", "left_semi")


def _after(ops: DataFrame, by: int) -> DataFrame:
    return ops.withColumn("seq", F.col("seq") + by)


_STEP = 1 << 40


def _log(spark, sf_dir) -> DataFrame:
    """Insert all documents, update the good ones, delete the toxic ones, insert all again: one log."""
    docs = load(spark, sf_dir, "documents")
    good, toxic = _labelled(spark, sf_dir, "quality = 1"), _labelled(spark, sf_dir, "toxic = 1")
    deletes = toxic.select(F.col("doc_id").alias("seq"), F.lit("delete").alias("op"), F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("string").alias("body"))
    parts = [_inserts(docs), _after(_inserts(good, "update", source=F.lit("good")), _STEP), _after(deletes, 2 * _STEP), _after(_inserts(docs, source=F.lit("again")), 3 * _STEP)]
    return postings.merge(parts)


_GOOD = "(SELECT doc_id FROM labels WHERE quality = 1)"
_TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS key, lang, n_chars,
       CASE WHEN doc_id IN {_TOXIC} THEN 'again' WHEN doc_id IN {_GOOD} THEN 'good' ELSE source END AS source FROM documents
""")
def changes_live_view(spark, sf_dir):
    """The table after a log of inserts, updates, deletes and re-inserts."""
    engine = _engine(spark)
    engine.apply("db", "docs", _log(spark, sf_dir))
    t = engine.table("db", "docs")
    return t.shown(t.live()).select("key", "lang", "n_chars", "source")


@query(f"""
SELECT op, status, error, count(*) AS n, count(*) FILTER (took) AS n_ids FROM (
  SELECT 'insert' AS op, 'ok' AS status, NULL AS error, true AS took FROM documents
  UNION ALL SELECT 'update', 'ok', NULL, true FROM documents WHERE doc_id IN {_GOOD}
  UNION ALL SELECT 'delete', 'ok', NULL, false FROM documents WHERE doc_id IN {_TOXIC}
  UNION ALL SELECT 'insert', CASE WHEN doc_id IN {_TOXIC} THEN 'ok' ELSE 'failed' END, CASE WHEN doc_id IN {_TOXIC} THEN NULL ELSE 'the key exists' END, doc_id IN {_TOXIC} FROM documents
) GROUP BY op, status, error
""")
def changes_outcomes(spark, sf_dir):
    """What became of each change of the log."""
    out = _engine(spark).apply("db", "docs", _log(spark, sf_dir))
    return out.groupBy("op", "status", "error").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("n_ids"))


@query(f"""
SELECT count(*) AS n_live, (SELECT count(*) FROM documents) + (SELECT count(*) FROM documents WHERE doc_id IN {_TOXIC}) AS allocated
FROM documents WHERE doc_id NOT IN {_TOXIC}
""")
def changes_invalid_take_ids(spark, sf_dir):
    """Deletes, then inserts without the number: refused, yet their ids stay taken."""
    engine, toxic = _engine(spark), _labelled(spark, sf_dir, "toxic = 1")
    engine.apply("db", "docs", _inserts(load(spark, sf_dir, "documents")))
    deletes = _inserts(toxic, "delete").withColumn("body", F.lit(None).cast("string"))
    bad = _after(_inserts(toxic).withColumn("body", F.lit('{"text": "x"}')), _STEP)
    engine.apply("db", "docs", deletes.unionByName(bad))
    t = engine.table("db", "docs")
    return t.live().agg(F.count(F.lit(1)).alias("n_live")).select("n_live", F.lit(t.snapshot()[1]["next_doc_id"]).cast("bigint").alias("allocated"))


#: Queries about segments say themselves when those are merged, however large the tables are.
_UNMERGED = {"merge_at": 1 << 60, "max_segments": 1 << 60}


def _by_language(spark, sf_dir) -> Engine:
    engine, docs = _engine(spark, **_UNMERGED), load(spark, sf_dir, "documents")
    for lang in [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]:  # a segment a language
        engine.apply("db", "docs", _inserts(docs.where(F.col("lang") == lang)))
    return engine


@query("""
SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS segment, CAST(sum(n) OVER (ORDER BY lang) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY lang) AS BIGINT) AS "end",
       n AS n_rows, n AS n_live, 'id,text,lang,source,n_chars' AS fields FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
""")
def table_status(spark, sf_dir):
    return _by_language(spark, sf_dir).table("db", "docs").status()


_SEGMENTED = f"SELECT CAST(doc_id AS VARCHAR) AS key, weight, score, total FROM ({search_sql('documents', tokens_sql('text'), 'the', 'true', '')})"


@query(_SEGMENTED)
def segments_search(spark, sf_dir):
    """A search over several segments, before compaction, ranked as over one."""
    engine = _by_language(spark, sf_dir)
    t = engine.table("db", "docs")
    meta = t.snapshot()[1]
    found = search.search(t.live(meta), t.schema, {"fieldName": "text", "value": "the"}, meta["next_doc_id"], ["__key"], everything=True)
    return found.select(F.col("__key").alias("key"), "weight", "score", "total")


@query(_SEGMENTED)
def compacted_search_by_index(spark, sf_dir):
    """All segments merged and indexed; the hits come from the postings."""
    engine = _by_language(spark, sf_dir)
    t = engine.table("db", "docs")
    t.compact(1 << 60)
    t.build_index()
    meta = t.snapshot()[1]
    index = t.index(meta)
    found = search.search(t.live(meta), t.schema, {"fieldName": "text", "value": "the"}, meta["next_doc_id"], ["__key"], index=index, everything=True)
    return found.select(F.col("__key").alias("key"), "weight", "score", "total")


@query("SELECT 0 AS group_no, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS segment FROM (SELECT DISTINCT lang FROM documents)")
def compaction_plan(spark, sf_dir):
    """Groups of small neighbouring segments, one segment a language."""
    engine = _by_language(spark, sf_dir)
    segs = engine.table("db", "docs").snapshot()[1]["segments"]
    groups = compaction.plan([s["end"] - s["start"] for s in segs], 1 << 40)
    return spark.createDataFrame([(g, i) for g, members in enumerate(groups) for i in members], "group_no int, segment int")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, lang, '' AS topic FROM documents UNION ALL SELECT 'b' || item_id, 'xx', 'benchmark' FROM benchmark")
def schema_evolution(spark, sf_dir):
    """A field added between two segments; the older documents show it as empty."""
    engine = _engine(spark)
    engine.apply("db", "docs", _inserts(load(spark, sf_dir, "documents")))
    engine.add_field("db", "docs", "topic", "whole")
    engine.drop_field("db", "docs", "source")
    more = load(spark, sf_dir, "benchmark")
    body = F.to_json(F.struct("text", F.lit("xx").alias("lang"), F.length("text").alias("n_chars"), F.lit("benchmark").alias("topic")))
    engine.apply("db", "docs", more.select(F.col("doc_id").alias("seq"), F.lit("insert").alias("op"), F.concat(F.lit("b"), "doc_id").alias("key"), body.alias("body")))
    t = engine.table("db", "docs")
    return t.shown(t.live()).select("key", "lang", "topic")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, lang, n_chars FROM documents")
def stream_ingestion(spark, sf_dir):
    """Documents as a stream of JSON changes, applied in micro-batches."""
    engine = _engine(spark)
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    _inserts(load(spark, sf_dir, "documents")).write.json(f"{folder}/in")
    stream = changes(spark, f"{folder}/in", max_files=4)
    ingest(engine, "db", "docs", stream, f"{folder}/checkpoint", f"q{uuid.uuid4().hex}", available_now=True).awaitTermination()
    t = engine.table("db", "docs")
    return t.shown(t.live()).select("key", "lang", "n_chars")


@query(_SEGMENTED)
def index_after_recompaction(spark, sf_dir):
    """Indexed a segment at a time, merged with its postings, and indexed again: each hit once."""
    engine, docs = _engine(spark, **_UNMERGED), load(spark, sf_dir, "documents")
    t = engine.table("db", "docs")
    for lang in [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]:
        engine.apply("db", "docs", _inserts(docs.where(F.col("lang") == lang)))
        t.build_index()
    t.compact(1 << 60)
    t.build_index()
    meta = t.snapshot()[1]
    found = search.search(t.live(meta), t.schema, {"fieldName": "text", "value": "the"}, meta["next_doc_id"], ["__key"], index=t.index(meta), everything=True)
    return found.select(F.col("__key").alias("key"), "weight", "score", "total")


def _deletes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("seq"), F.lit("delete").alias("op"), F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("string").alias("body"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS key, lang, n_chars FROM documents WHERE doc_id NOT IN {_TOXIC}")
def vacuum_keeps_live(spark, sf_dir):
    """Segments merged, dead rows purged, all older versions deleted: the live documents stay."""
    engine = _by_language(spark, sf_dir)
    engine.apply("db", "docs", _deletes(_labelled(spark, sf_dir, "toxic = 1")))
    t = engine.table("db", "docs")
    t.compact(1 << 60)
    t.vacuum(0)
    return t.shown(t.live()).select("key", "lang", "n_chars")


@query(f"SELECT max(r) AS last_dead FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE doc_id IN {_TOXIC}")
def last_dead_id(spark, sf_dir):
    """The largest id among the tombstones."""
    engine = _engine(spark)
    engine.apply("db", "docs", _inserts(load(spark, sf_dir, "documents")))
    engine.apply("db", "docs", _deletes(_labelled(spark, sf_dir, "toxic = 1")))
    return spark.createDataFrame([(engine.table("db", "docs").last_dead(),)], "last_dead bigint")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, lang, source, n_chars, text FROM documents WHERE doc_id IN (7, 77)")
def get_by_pk(spark, sf_dir):
    """Documents by key; one that is absent gives no row."""
    engine = _engine(spark)
    engine.apply("db", "docs", _inserts(load(spark, sf_dir, "documents")))
    t = engine.table("db", "docs")
    return postings.merge([t.get(k) for k in ("7", "77", "nobody")]).select("key", "lang", "source", "n_chars", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, r AS doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r = 77")
def get_by_id(spark, sf_dir):
    """A document by the id that the table gave it; only its segment is read."""
    engine = _engine(spark)
    engine.apply("db", "docs", _inserts(load(spark, sf_dir, "documents")))
    return engine.table("db", "docs").get_by_id(77).select("key", "doc_id", "lang")


@query(f"""
SELECT status, error, count(*) AS n FROM (
  SELECT 'ok' AS status, NULL AS error FROM documents
  UNION ALL SELECT 'failed', 'the key exists' FROM documents WHERE doc_id IN {_GOOD}
  UNION ALL SELECT 'failed', 'the document is invalid' FROM documents WHERE doc_id IN {_TOXIC}
) GROUP BY status, error
""")
def stream_outcomes(spark, sf_dir):
    """What became of each change of a stream: good documents are inserted twice, toxic ones once more under new keys without their fields."""
    engine, name = _engine(spark), f"q{uuid.uuid4().hex}"
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    bad = _inserts(_labelled(spark, sf_dir, "toxic = 1")).withColumn("key", F.concat(F.lit("x"), "key")).withColumn("body", F.lit("{}"))
    for k, part in enumerate((_inserts(load(spark, sf_dir, "documents")), _after(_inserts(_labelled(spark, sf_dir, "quality = 1")), _STEP), _after(bad, 2 * _STEP))):
        part.write.json(f"{folder}/in/{k}")
    files = Files(spark, folder)
    n_files = [sum(n.endswith(".json") for n in files.names(f"{folder}/in/{k}")) for k in range(3)]
    stream = changes(spark, f"{folder}/in/*", max_files=max(1, *n_files))  # as many batches at any size; each file is cut into tasks
    ingest(engine, "db", "docs", stream, f"{folder}/checkpoint", name, available_now=True).awaitTermination()
    return engine.table("db", "docs").outcomes(name).groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('a', 't', 'id:primary,text:words'), ('a', 'u', 'n:number')) AS v(db, name, fields)")
def ddl_catalogue(spark, sf_dir):
    """Databases and tables made and dropped; what is left, with its fields."""
    engine = Engine(spark, f"{work_dir(spark)}/engine-{uuid.uuid4().hex}")
    for db in ("a", "b"):
        engine.create_database(db)
        for name, fields in (("t", {"id": "primary", "text": "words"}), ("u", {"n": "number"}), ("v", {"n": "time"})):
            engine.create_table(db, name, fields)
    engine.drop_table("a", "v")
    engine.drop_database("b")
    left = [(d["database"], t["table"], ",".join(f"{f['name']}:{f['type']}" for f in t["fields"])) for d in engine.status() for t in d["tables"]]
    return spark.createDataFrame(left, "db string, name string, fields string")


@query("""
SELECT * FROM (VALUES (0, 'no field'), (1, '> needs a number'), (2, 'prefix needs a string'), (3, 'in needs a list'), (4, 'not in needs a list'), (5, ''), (6, ''), (7, '')) AS v(n, refusal)
""")
def filter_refusals(spark, sf_dir):
    """Filters that can't apply to their field are refused before anything runs; an empty list and an unknown type are not."""
    bad = [
        {"field": "nope", "type": "="}, {"field": "p_brand", "type": ">", "int": 1}, {"field": "p_size", "type": "prefix", "str": "1"}, {"field": "p_size", "type": "in"},
        {"field": "p_brand", "type": "not in"}, {"field": "p_size", "type": "in", "iranges": []}, {"field": "p_brand", "type": "like"}, {"field": "p_brand", "type": "=", "str": "x"},
    ]
    out = []
    for n, f in enumerate(bad):
        try:
            filters.validate(schema_of("part"), [f])
            out.append((n, ""))
        except ValueError as e:
            said = str(e)
            out.append((n, next(s for s in ("no field", "> needs a number", "prefix needs a string", "not in needs a list", "in needs a list") if said.startswith(s))))
    return spark.createDataFrame(out, "n int, refusal string")


@query(flat_sql("part", "false", ""))
def filter_absent_field(spark, sf_dir):
    """A field that the data lacks matches nothing, not even an empty exclusion."""
    request = {"filters": [{"field": "p_size", "type": "not in", "iranges": []}]}
    return search.search(load(spark, sf_dir, "part").drop("p_size"), schema_of("part"), request, columns=[], everything=True)


@query("""
SELECT * FROM (VALUES
  (0, 'POST /d', 200, 0), (1, 'POST /d', 200, 1), (2, 'POST /d/t', 200, 0), (3, 'POST /d/t/1', 200, 0), (4, 'POST /d/t/1', 200, 1), (5, 'PUT /d/t/1', 200, 0), (6, 'PUT /d/t/2', 200, 1),
  (7, 'GET /d/t/1', 200, 0), (8, 'PATCH /d/t', 200, 0), (9, 'PATCH /d/t', 200, 0), (10, 'PATCH /d/t', 200, 2), (11, 'GET /_search', 200, 0), (12, 'GET /_status', 200, -1),
  (13, 'DELETE /d/t/1', 200, 0), (14, 'DELETE /d/t/1', 200, 0), (15, 'DELETE /d/t', 200, 0), (16, 'DELETE /d', 200, 0), (17, 'DELETE /d', 200, 1), (18, 'GET /a/b/c/d', 404, 2), (19, 'HEAD /d', 501, 2)
) AS v(step, request, status, code)
""")
def routes_session(spark, sf_dir):
    """A session of requests by method and path: the status and code of each reply (-1 where there is no envelope)."""
    engine = Engine(spark, f"{work_dir(spark)}/engine-{uuid.uuid4().hex}")
    doc, fields = {"about": "hello world"}, [{"name": "id", "type": "primary"}, {"name": "about", "type": "words"}]
    change = lambda kind, **f: {"type": kind, "field": f}
    session = [
        ("POST", "/d", None), ("POST", "/d", None), ("POST", "/d/t", fields), ("POST", "/d/t/1", doc), ("POST", "/d/t/1", doc), ("PUT", "/d/t/1", doc), ("PUT", "/d/t/2", doc), ("GET", "/d/t/1", None),
        ("PATCH", "/d/t", change("addField", name="x", type="whole")), ("PATCH", "/d/t", change("delField", name="x")), ("PATCH", "/d/t", change("else", name="x")),
        ("GET", "/_search", {"database": "d", "table": "t", "fieldName": "about", "value": "hello"}), ("GET", "/_status", None), ("DELETE", "/d/t/1", None), ("DELETE", "/d/t/1", None),
        ("DELETE", "/d/t", None), ("DELETE", "/d", None), ("DELETE", "/d", None), ("GET", "/a/b/c/d", None), ("HEAD", "/d", None),
    ]
    out = []
    for step, (method, path, body) in enumerate(session):
        status, reply = route(engine, method, path, None if body is None else json.dumps(body))
        out.append((step, f"{method} {path}", status, reply["code"] if isinstance(reply, dict) else -1))
    return spark.createDataFrame(out, "step int, request string, status int, code int")


# -- ordered maps and bits


@query("SELECT event_type AS tree, CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS BIGINT) * 2 AS value FROM events GROUP BY event_type, user_id")
def counters(spark, sf_dir):
    """Counters by name and key, raised twice by all events."""
    steps = load(spark, sf_dir, "events").select(F.col("event_type").alias("tree"), F.col("user_id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("value"))
    return ordered.increment(ordered.increment(steps.where("false"), steps), steps)


_MAP = "(SELECT event_type AS tree, CAST(user_id AS VARCHAR) AS key, max(event_id) AS value FROM events GROUP BY event_type, user_id)"


@query(f"""
WITH m AS {_MAP} SELECT 'first' AS what, min(key) AS key, arg_min(value, key) AS value FROM m WHERE tree = 'click'
UNION ALL SELECT 'after', min(key), arg_min(value, key) FROM m WHERE tree = 'click' AND key > '5'
UNION ALL SELECT 'get', key, value FROM m WHERE tree = 'click' AND key = (SELECT max(key) FROM m WHERE tree = 'click')
""")
def ordered_map(spark, sf_dir):
    """The last event of each user by type, as ordered maps: the first key, the next one, a lookup."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("tree"), F.col("user_id").cast("string").alias("key"), F.col("doc_id").alias("value"), F.col("doc_id").alias("seq"))
    rows = written(ordered.put(e.where("seq < 0").drop("seq"), e), "map")
    last = rows.where("tree = 'click'").agg(F.max("key")).first()[0]
    parts = {"first": ordered.first(rows, "click"), "after": ordered.after(rows, "click", "5"), "get": ordered.get(rows, "click", last)}
    return postings.merge([p.select(F.lit(what).alias("what"), "key", "value") for what, p in parts.items()])


@query("""
SELECT o_orderkey AS doc_id, ((o_orderkey >> 3) & 1) = 1 AS bit_3, o_orderkey | 32 AS with_5, o_orderkey & ~(32::BIGINT) AS without_5 FROM orders
""")
def bit_functions(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("doc_id")
    at = F.lit(5)
    return o.select("doc_id", scalars.bit_test(F.col("doc_id"), F.lit(3)).alias("bit_3"), scalars.bit_set(F.col("doc_id"), at).alias("with_5"), scalars.bit_clear(F.col("doc_id"), at).alias("without_5"))
