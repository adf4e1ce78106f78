"""Inverted index as a table of postings: build, look up, walk, merge and intersect.

A posting is (bucket, field, term, doc_id, weight).  The cross-field index is the field
``#all``.  Buckets are hashes of the term; stored postings are partitioned by bucket and
sorted within it, so a lookup reads one bucket and skips row groups by term.

Packed postings have a column ``cross`` as well: the weight of the same term and document in
``#all``, which then has no row of its own.  So what is moved, sorted and stored is about half.
All functions here take either kind; ``unpacked`` gives the plain one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, scoring
from ..types import FieldType, TableSchema

CROSS_FIELD = "#all"
BUCKETS = 64
CHUNK = 100_000
COLUMNS = ("bucket", "field", "term", "doc_id", "weight")
STORED = "field string, term string, doc_id bigint, weight int, cross int, bucket int"
#: Partitions of a walk for each of the session's shuffle partitions.
WALK_TASKS = 4
#: Buckets that one job merges.
MERGED_AT_ONCE = 8
#: Up to so many words outside of the one field of words are looked up one by one for each term.
FEW_WORDS = 32


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(name: str, kind: FieldType, others: Column | None = None, when: Column | None = None) -> list[tuple[str, Column]]:
    """Steps, as (column, expression), from the terms in ``t_name`` to entries (field, term, weight, cross) in ``e_name``.

    Repeats are counted in the row: sorted, the end of each run of equal terms is kept.  ``others``
    are the few words that the cross-field text has besides; where they are given (not null), the
    entries carry its weights.  ``when``: the rows that have entries at all.
    """
    t, s, ends = F.col(f"t_{name}"), F.col(f"s_{name}"), F.col(f"r_{name}")
    none = F.lit(None).cast("int")
    entry = lambda term, weight, cross=none, field=name: F.named_struct(F.lit("field"), F.lit(field), F.lit("term"), term, F.lit("weight"), weight, F.lit("cross"), cross)
    if kind is not FieldType.WORDS:
        return [("", F.lit(None)), ("", F.lit(None)), (f"e_{name}", F.transform(t, lambda x: entry(x, F.lit(0))))]
    t = t if when is None else F.when(when, t).otherwise(F.array().cast("array<string>"))
    last = F.transform(s, lambda x, i: F.when((i + 1 == F.size(s)) | (x != F.get(s, i + 1)), i + 1))
    n = lambda end, k: end - F.when(k > 0, F.get(ends, k - 1)).otherwise(0)
    steps = [(f"s_{name}", F.sort_array(t)), (f"r_{name}", F.filter(last, lambda e: e.isNotNull()))]
    if others is None:
        return [*steps, (f"e_{name}", F.transform(ends, lambda e, k: entry(F.get(s, e - 1), scoring.weight(n(e, k), F.size(s)))))]
    size, few = F.size(s) + F.size(others), others.isNotNull()
    more = lambda term: F.when(F.array_contains(others, term), F.size(F.filter(others, lambda o: o == term))).otherwise(0)

    def both(e: Column, k: Column) -> Column:
        term = F.get(s, e - 1)
        return entry(term, scoring.weight(n(e, k), F.size(s)), F.when(few, scoring.weight(n(e, k) + more(term), size)))

    only = F.filter(F.array_distinct(others), lambda o: ~F.array_contains(s, o))
    alone = F.transform(only, lambda o: entry(o, scoring.weight(more(o), size), none, CROSS_FIELD))
    return [*steps, (f"e_{name}", F.concat(F.transform(ends, both), F.coalesce(alone, F.array().cast(_ENTRIES))))]


_ENTRIES = "array<struct<field:string,term:string,weight:int,cross:int>>"


def packed(docs: DataFrame, schema: TableSchema, segmenter: analysis.Tokenizer | None = None, cross_field: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The postings of all searchable fields of (doc_id, fields...), packed.

    All terms of a document are in its row, so they are counted there and nothing is
    shuffled.  Texts are cut once: the marks between the fields of the cross-field text are
    no terms, so its terms are those of the fields one after the other.  (A segmenter that is
    given sees the whole cross-field text.)  With one field of words and few words outside of
    it, the terms are also sorted and counted once.
    """
    have = [f for f in schema.searchable if f.name in set(docs.columns)]
    if not have:
        return docs.sparkSession.createDataFrame([], STORED).select(*COLUMNS, "cross")
    at = docs.select("doc_id", *[analysis.terms_of(f.type, F.col(f.name), segmenter).alias(f"t_{f.name}") for f in have], *[F.col(f.name).alias(f"c_{f.name}") for f in have])
    columns = {f.name: F.col(f"c_{f.name}") for f in have}
    of_words = [f.name for f in have if f.type is FieldType.WORDS]
    steps = {f.name: _counted(f.name, f.type) for f in have}
    keep = ["doc_id", *[f"t_{f.name}" for f in have]]
    if cross_field and segmenter is None:
        words = {f.name: F.col(f"t_{f.name}") if f.type is FieldType.WORDS else analysis.words(columns[f.name]) for f in have}
        many = None
        if len(of_words) == 1:
            rest = [w for n, w in words.items() if n != of_words[0]]
            at = at.withColumn("__o", F.concat(F.array().cast("array<string>"), *rest))
            at = at.withColumn("__others", F.when(F.size("__o") <= FEW_WORDS, F.col("__o")))
            many = F.col("__others").isNull()
            steps[of_words[0]] = _counted(of_words[0], FieldType.WORDS, F.col("__others"))
            words = {"": F.col("__o"), of_words[0]: words[of_words[0]]}
            keep.append("__others")
        all_words = F.concat(*words.values())
        at = at.withColumn(f"t_{CROSS_FIELD}", all_words if many is None else F.when(many, all_words))
        steps[CROSS_FIELD] = _counted(CROSS_FIELD, FieldType.WORDS, when=many)
        keep.append(f"t_{CROSS_FIELD}")
    elif cross_field:
        at = at.withColumn(f"t_{CROSS_FIELD}", segmenter(analysis.cross_field_text(TableSchema(tuple(have)), columns)))
        steps[CROSS_FIELD] = _counted(CROSS_FIELD, FieldType.WORDS)
        keep.append(f"t_{CROSS_FIELD}")
    at = at.select(*keep)
    for k in range(3):
        at = at.select(*at.columns, *[e.alias(c) for c, e in (s[k] for s in steps.values()) if c])
    rows = at.select("doc_id", F.inline(F.concat(*[F.col(f"e_{n}") for n in steps])))
    return rows.select(bucket_of(F.col("term"), buckets).alias("bucket"), "field", "term", "doc_id", "weight", "cross")


def unpacked(postings: DataFrame) -> DataFrame:
    """Packed postings as plain ones."""
    if "cross" not in postings.columns:
        return postings
    one = lambda field, weight: F.named_struct(F.lit("field"), field, F.lit("weight"), weight)
    own, cross = one(F.col("field"), F.col("weight")), one(F.lit(CROSS_FIELD), F.col("cross"))
    rest = [c for c in postings.columns if c not in ("field", "weight", "cross")]
    rows = postings.select(*rest, F.inline(F.when(F.col("cross").isNull(), F.array(own)).otherwise(F.array(own, cross))))
    return rows.select(*[c for c in postings.columns if c != "cross"])


def build(docs: DataFrame, schema: TableSchema, segmenter: analysis.Tokenizer | None = None, cross_field: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """As ``packed``, plain: a row for each posting."""
    return unpacked(packed(docs, schema, segmenter, cross_field, buckets))


def spread_of(spark: SparkSession, buckets: int = BUCKETS) -> int:
    """Over how many tasks a bucket is spread, so that there are at least as many tasks as the session's shuffle partitions."""
    return -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)


def _store(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.sortWithinPartitions("bucket", "field", "term", "doc_id").write.mode(mode).partitionBy("bucket").parquet(path)


def write(postings: DataFrame, path: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> None:
    """Store postings by bucket, sorted for lookups.

    Each task has a part of one bucket, by a hash of the document, so that neither a bucket
    nor a hot term is one task's, and no task happens to get several.
    """
    spread = spread_of(postings.sparkSession, buckets)
    task = (F.col("bucket") * spread + F.pmod(F.xxhash64("doc_id"), F.lit(spread))).cast("int")
    _store(postings.repartitionById(buckets * spread, task), path, mode)


def write_merged(spark: SparkSession, parts: list[tuple[str, Column]], present: dict[int, list[str]], path: str) -> None:
    """Store stored postings (folder, rows that count) as one, bucket by bucket, so nothing is shuffled.

    ``present``: the folders that have each bucket.  A bucket's files are read by as many tasks as ``write`` spreads it over.
    """
    of, spread = dict(parts), spread_of(spark)
    reader = spark.read.schema(STORED.removesuffix(", bucket int"))
    frames = []
    for bucket, folders in sorted(present.items()):
        rows = reader.parquet(*[f"{p}/bucket={bucket}" for p in folders])
        own = [F.contains(F.col("_metadata.file_path"), F.lit(p.rsplit("/", 1)[1])) & of[p] for p in folders]
        frames.append(rows.where(reduce(lambda x, y: x | y, own)).coalesce(spread).withColumn("bucket", F.lit(bucket)))
    for k in range(0, len(frames), MERGED_AT_ONCE):  # plans of all buckets together take Spark long
        _store(merge(frames[k : k + MERGED_AT_ONCE]), path, "append")


def lookup(postings: DataFrame, field: str, term: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, weight) of one term; the keyword is a term as it stands."""
    found, own, weight = postings.where(F.col("term") == term), F.col("field") == field, F.col("weight")
    if "bucket" in postings.columns:
        found = found.where(F.col("bucket") == bucket_of(F.lit(term), buckets))
    if field == CROSS_FIELD and "cross" in postings.columns:
        own, weight = own | F.col("cross").isNotNull(), F.when(own, weight).otherwise(F.col("cross")).alias("weight")
    return found.where(own).select("doc_id", weight)


def first_term(postings: DataFrame, field: str) -> DataFrame:
    """The least term of a field, in byte order."""
    return unpacked(postings).where(F.col("field") == field).agg(F.min("term").alias("term"))


def next_term(postings: DataFrame, field: str, term: str) -> DataFrame:
    """The least term after ``term``."""
    return unpacked(postings).where((F.col("field") == field) & (F.col("term") > term)).agg(F.min("term").alias("term"))


def walk(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per field, term and ``part``, a range of ``chunk`` ids, the postings in order of doc_id; so a frequent term has many rows.

    Postings are moved first, into small partitions, and gathered there: gathered before, the
    terms of a task are so many that all of its postings would be sorted, and spilled.
    """
    part = F.floor(F.col("doc_id") / chunk).cast("bigint").alias("part")
    n = WALK_TASKS * int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = unpacked(postings.drop("bucket").withColumn("part", part).repartition(n, "term", "part"))
    return rows.groupBy("field", "term", "part").agg(F.sort_array(F.collect_list(F.struct("doc_id", "weight"))).alias("postings"))


def term_counts(postings: DataFrame) -> DataFrame:
    """Per field and term the number of documents and the sum of weights."""
    return unpacked(postings).groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("weight").alias("sum_weight"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Postings of several segments as one; their doc_ids are disjoint, so no term is merged twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intersect(hits: DataFrame, more: DataFrame, allocated: int, more_hits: int) -> DataFrame:
    """Documents in both hit lists; the second term adds its scaled weight to the first's.

    An extension for queries of two terms: ``more_hits`` is the length of the second list.
    """
    idf = F.log10(F.lit(float(allocated)) / F.lit(float(max(more_hits, 1))))
    second = more.select("doc_id", F.col("weight").alias("__w"))
    return hits.join(second, "doc_id").select("doc_id", (F.col("weight") + F.floor(F.col("__w") * idf)).cast("bigint").alias("weight"))
