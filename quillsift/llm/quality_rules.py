"""Quality rules by distribution divergence.

Each document gets two histograms: its characters by class, and its words by the common
words of its language (all other words in one last bin).  Both are compared with the
reference of the language by the Jensen-Shannon distance (base 2, from 0 to 1); a document
whose two distances sum to more than ``MAX_DISTANCE`` is rejected.  The reference is, bin by
bin, the median share over all documents of the language that pass the length guards, so
junk below half of a language leaves no trace in it.  Sampling noise alone puts a text of n
words at an expected divergence of (bins - 1) / (8 n ln 2) from its own source; that much is
taken off the word divergence, so that length does not decide.

Short documents have no reliable histogram, so below ``MIN_CHARS`` characters or
``MIN_WORDS`` words they are kept unjudged; so are the documents of a language with fewer
than ``MIN_REFERENCE`` judged ones.

The medians are exact, over shares in thousandths, so an aggregate holds at most 1001
counters a bin.  The references are a few dozen numbers a language; all else is local to a
row, so scoring needs no shuffle.

Defined results: null and empty texts have no characters and are kept as short; a null
language is a language of its own; a language without a word list is judged by characters
alone (its word distance is 0); repeated rows are judged alike and each counts; nothing
depends on ``doc_id``, which may be null; an empty table gives an empty result; other
columns are carried by the stage and not read.  Histograms cover whole texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_CHARS = 200
MIN_WORDS = 40
MIN_REFERENCE = 20
MAX_DISTANCE = 0.34

#: Common function words by language, as any grammar lists them; all lists have one length.
WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in a is that for it as was with be by on not he his at this are or from but have an they which you".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui".split(),
}
BINS = len(WORDS["en"])
#: Characters of each class are removed in turn, so each pattern scans what the ones before left.
CLASSES = [r"\p{Ll}+", r"[ \t\r\n]+", r"\p{Lu}+", r"[.,;:!?'""()-]+", r"[0-9]+", r"\p{L}+"]


def class_counts(text: Column) -> list[Column]:
    """Lower case, blanks, upper case, plain punctuation, digits, other letters, anything else."""
    rest, out = text, []
    for pattern in CLASSES:
        less = F.regexp_replace(rest, pattern, "")
        out.append(F.length(rest) - F.length(less))
        rest = less
    return [*out, F.length(rest)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def common_words(words: Column) -> Column:
    return F.filter(words, lambda w: w.isin(sorted({w for ws in WORDS.values() for w in ws})))


def histograms(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` and chars (bins), words (bins), n_chars, n_words of each document.

    Each step is a projection of its own whose result is read more than once, so Catalyst
    keeps it and the words are split once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*carry, F.col("lang").alias("__lang"), F.length(text).alias("__nc"), F.array(*class_counts(text)).alias("__c"), words_of(text).alias("__ws"))
    keep = [c for c in a.columns if c != "__ws"]
    a = a.select(*keep, F.size("__ws").alias("__nw"), common_words(F.col("__ws")).alias("__cs"))
    keep.append("__nw")
    lists = F.create_map(*[x for k, ws in WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    known = F.element_at(lists, F.coalesce("__lang", F.lit("")))
    each = F.transform(known, lambda w: F.size("__cs") - F.size(F.array_remove("__cs", w)))
    a = a.select(*keep, F.coalesce(each, F.array_repeat(F.lit(0), BINS)).alias("__each"))
    rest = F.col("__nw") - F.aggregate("__each", F.lit(0), lambda x, y: x + y)
    return a.select(*keep, F.concat("__each", F.array(rest)).alias("__w"))


def _long(n_chars: str, n_words: str) -> Column:
    return (F.col(n_chars) >= MIN_CHARS) & (F.col(n_words) >= MIN_WORDS)


def references(hists: DataFrame) -> DataFrame:
    """One row a language: the median shares of its judged documents in thousandths, and their number."""

    def medians(c: str, n: int, total: str) -> Column:
        return F.array(*[F.median(F.floor(F.col(c)[i] * 1000 / F.col(total))).cast("double") for i in range(n)])

    found = hists.where(_long("__nc", "__nw")).groupBy("__lang").agg(
        F.count(F.lit(1)).alias("__n"), medians("__c", len(CLASSES) + 1, "__nc").alias("__rc"), medians("__w", BINS + 1, "__nw").alias("__rw")
    )
    return materialize(found.where(F.col("__n") >= MIN_REFERENCE).withColumnRenamed("__lang", "__rl"), "references")


def js_divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence of two arrays taken as histograms; 0 where one of them is empty."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    ta, tb = total(a), total(b)

    def term(x: Column, y: Column) -> Column:
        p, q = x / ta, y / tb
        m = (p + q) / 2
        half = lambda r: F.when(r > 0, r * F.log2(r / m)).otherwise(F.lit(0.0))
        return (half(p) + half(q)) / 2

    divergence = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)
    return F.when((ta > 0) & (tb > 0), divergence).otherwise(F.lit(0.0))


def scored(hists: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds __cd and __wd, the distances (null where unjudged).  Catalyst broadcasts the references by their size."""
    j = hists.join(refs, F.col("__lang").eqNullSafe(F.col("__rl")), "left")
    judged = _long("__nc", "__nw") & F.col("__n").isNotNull()
    bins = F.size(F.filter("__rw", lambda x: x > 0))
    noise = (bins - 1) / (F.col("__nw") * (8 * math.log(2)))
    distance = lambda d: F.when(judged, F.round(F.sqrt(F.greatest(d, F.lit(0.0))), 6))
    return j.withColumn("__cd", distance(js_divergence(F.col("__c"), F.col("__rc")))).withColumn(
        "__wd", distance(js_divergence(F.col("__w"), F.col("__rw")) - noise)
    )


def _kept() -> Column:
    return F.coalesce(F.col("__cd") + F.col("__wd") <= MAX_DISTANCE, F.lit(True))


def judged(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, n_words, both distances (null if unjudged), reason, keep."""
    hists = materialize(histograms(docs, [F.col("doc_id").alias("__id")]), "histograms")
    s = scored(hists, references(hists))
    reason = F.when(~_long("__nc", "__nw"), "short").when(F.col("__n").isNull(), "no reference").when(_kept(), "near").otherwise("far")
    return s.select(
        F.col("__id").alias("doc_id"), F.col("__lang").alias("lang"), F.col("__nw").alias("n_words"),
        F.col("__cd").alias("char_distance"), F.col("__wd").alias("word_distance"), reason.alias("reason"), _kept().alias("keep"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass.  Histograms are taken again rather than joined, which would shuffle the texts, or written beside them."""
    refs = references(histograms(docs, []))
    return scored(histograms(docs, [F.struct(*docs.columns).alias("__r")]), refs).where(_kept()).select("__r.*")


def _sql() -> str:
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    every = ", ".join(quote(w) for w in sorted({w for ws in WORDS.values() for w in ws}))
    lists = " ".join(f"WHEN {quote(k)} THEN [{', '.join(map(quote, ws))}]" for k, ws in WORDS.items())
    rest, classes = "t", []
    for p in CLASSES:
        less = f"regexp_replace({rest}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
        classes.append(f"length({rest}) - length({less})")
        rest = less
    classes.append(f"length({rest})")
    share = lambda a: f"{a}[i] / list_sum({a})"
    half = lambda a, b: f"CASE WHEN {a}[i] > 0 THEN {share(a)} * log2({share(a)} / (({share(a)} + {share(b)}) / 2)) ELSE 0.0 END"
    jsd = lambda a, b: (
        f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
        f"({half(a, b)} + {half(b, a)}) / 2)) ELSE 0.0 END"
    )
    ref = lambda c, n, total: "[" + ", ".join(f"median(floor({c}[{i + 1}] * 1000 / {total}))" for i in range(n)) + "]"
    noise = f"(len(list_filter(rw, lambda x: x > 0)) - 1) / (nw * {8 * math.log(2)!r}::DOUBLE)"
    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda w: w <> '') AS ws,
         CASE lang {lists} ELSE list_transform(range({BINS}), lambda i: '') END AS known
  FROM documents
), common AS (
  SELECT *, list_filter(ws, lambda w: w IN ({every})) AS cs FROM base
), counts AS (
  SELECT doc_id, lang, length(t) AS nc, len(ws) AS nw, [{', '.join(classes)}] AS c,
         list_transform(known, lambda k: len(list_filter(cs, lambda w: w = k))) AS w0
  FROM common
), hist AS (
  SELECT doc_id, lang, nc, nw, c, list_append(w0, nw - coalesce(list_sum(w0), 0)) AS w FROM counts
), refs AS (
  SELECT lang AS rl, count(*) AS n, {ref('c', len(CLASSES) + 1, 'nc')} AS rc, {ref('w', BINS + 1, 'nw')} AS rw
  FROM hist WHERE nc >= {MIN_CHARS} AND nw >= {MIN_WORDS} GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}
), dist AS (
  SELECT h.*, r.n, CASE WHEN nc >= {MIN_CHARS} AND nw >= {MIN_WORDS} AND n IS NOT NULL THEN round(sqrt(greatest({jsd('c', 'rc')}, 0.0)), 6) END AS cd,
         CASE WHEN nc >= {MIN_CHARS} AND nw >= {MIN_WORDS} AND n IS NOT NULL THEN round(sqrt(greatest({jsd('w', 'rw')} - {noise}, 0.0)), 6) END AS wd
  FROM hist h LEFT JOIN refs r ON h.lang IS NOT DISTINCT FROM r.rl
)
SELECT doc_id, lang, CAST(nw AS INTEGER) AS n_words, cd AS char_distance, wd AS word_distance,
       CASE WHEN nc < {MIN_CHARS} OR nw < {MIN_WORDS} THEN 'short' WHEN n IS NULL THEN 'no reference'
            WHEN cd + wd <= {MAX_DISTANCE}::DOUBLE THEN 'near' ELSE 'far' END AS reason,
       coalesce(cd + wd <= {MAX_DISTANCE}::DOUBLE, true) AS keep
FROM dist
"""


SQL = _sql()
