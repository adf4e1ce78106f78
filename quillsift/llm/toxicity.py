"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Texts are lower-cased and folded one character to one: homoglyphs to their Latin letter,
digits and signs that stand for letters (0 3 4 5 7 8, and inside a word @ $ ! |) to the
letter, and l, i and 1 to one class.  The lexicon is folded the same way and matched by one
automaton at word bounds; entries ending in ``*`` match the start of a word.  The longest
match at a place counts, unless it lies in an exception phrase ("trash can").  The score of
a document is the sum of the weights of its matches per ``PER_WORDS`` words, with at least
``LEAST_WORDS`` words, and it is toxic from ``THRESHOLD`` on.

The lexicon is a curated list, and, where the ``labels`` table has toxic documents, the
words that set them apart: those whose G2 statistic is at least ``MIN_G2`` and whose rate in
toxic documents is at least ``MIN_RATIO`` times that in others.  They are mined from at most
``LABELLED_ROWS`` labelled documents of either kind, the first by a hash of doc_id, so their
number is bounded by the words of that sample; none is left out.  Scoring covers all
documents, whole texts.

Defined results: null and empty texts score 0; documents without labels and a null
``doc_id`` are scored alike; repeated rows get equal scores, and weigh once in mining; null
labels are no labels; empty tables give an empty result or the curated lexicon alone; other
columns are not read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices

PER_WORDS = 100
LEAST_WORDS = 40
THRESHOLD = 1.0
LABELLED_ROWS = 4000
MIN_G2 = 15.0
MIN_RATIO = 50.0

CURATED = {
    "idiot": 2, "idiots": 2, "idiotic": 2, "moron": 2, "morons": 2, "moronic": 2, "imbecile": 2, "stupid": 1.5, "dumbass": 2.5,
    "loser": 1.5, "losers": 1.5, "clown": 1, "clowns": 1, "scum": 2.5, "scumbag": 2.5, "trash": 1, "garbage": 1, "worthless": 1.5,
    "pathetic": 1.5, "disgusting": 1.5, "vermin": 2, "filth": 1.5, "subhuman": 3, "retard": 3, "bastard": 2, "bitch": 2.5,
    "asshole": 3, "shithead": 3, "bullshit": 1.5, "fuck": 2.5, "fucking": 2.5, "fucker": 3, "whore": 2.5, "slut": 2.5, "cunt": 3,
    "dickhead": 3, "wanker": 2.5, "kill yourself": 4, "drop dead": 2, "shut up": 1, "go to hell": 2,
    "arschloch": 3, "vollidiot": 2.5, "dummkopf": 1.5, "schlampe": 2.5, "hurensohn": 3, "wichser": 3, "abschaum": 2.5,
    "connard": 3, "salope": 3, "imbécile": 2, "abruti": 2, "crétin": 2, "ordure": 1.5, "enculé": 3,
    "idiota": 2, "imbécil": 2, "estúpido": 1.5, "estúpida": 1.5, "gilipollas": 2.5, "cabrón": 2.5, "puta": 2.5, "mierda": 2, "basura": 1,
}
EXCEPTIONS = [
    "trash can", "trash cans", "trash bin", "trash bag", "take out the trash", "white trash bag", "garbage can", "garbage truck",
    "garbage collection", "garbage collector", "garbage disposal", "clown fish", "circus clown", "class clown", "sore loser",
    "idiot proof", "idiot box", "stupid easy", "the idiot by dostoevsky", "puta madre de dios", "basura espacial",
]

_HOMOGLYPHS = dict(zip("аеорсухіѕјһԁӏѵԛԝкмтвнοαρεικυχτνηωɑɡıⅼ", "aeopcyxisjhdlvqwkmtbhoapeikuxtvnwagil"))
_FOLD = {ord(k): v for k, v in (_HOMOGLYPHS | dict(zip("0134578l", "oieastbi"))).items()}
_FOLD |= {ord(k): "i" for k, v in _HOMOGLYPHS.items() if v == "l"} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF4C: "i"}
_SIGNS = regex.compile(r"(?<=\w)[@$!|](?=\w)")
_SIGN = {"@": "a", "$": "s", "!": "i", "|": "i"}
_WORD = regex.compile(r"\w+")


def fold(text: str) -> str:
    """The text in lower case with look-alikes folded, character by character."""
    lower = text.lower()
    if len(lower) != len(text):  # rare letters grow when lowered; each keeps its first character
        lower = "".join(c.lower()[0] for c in text)
    return _SIGNS.sub(lambda m: _SIGN[m[0]], lower.translate(_FOLD))


class Matcher:
    """The automaton over the folded lexicon and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[float, bool, bool]] = {}
        for word, weight in sorted(lexicon.items()):
            key = fold(word.rstrip("*"))
            if key and (key not in entries or weight > entries[key][0]):
                entries[key] = (weight, word.endswith("*"), False)
        for phrase in exceptions:
            entries[fold(phrase)] = (0.0, False, True)
        for key, (weight, stem, exception) in entries.items():
            self.automaton.add_word(key, (len(key), weight, stem, exception))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count, in order; the folded text is matched."""
        if self.empty or not text:
            return []
        n, found, spared = len(text), [], []
        for last, (size, weight, stem, exception) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            if (start and (text[start - 1].isalnum() or text[start - 1] == "_")) or (
                not stem and end < n and (text[end].isalnum() or text[end] == "_")
            ):
                continue
            (spared if exception else found).append((start, end, weight))
        if not found:
            return []
        found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _ in spared)]
        out: list[tuple[int, int, float]] = []
        for f in sorted(found, key=lambda f: (f[0], -f[1])):
            if not out or f[0] >= out[-1][1]:
                out.append(f)
        return out


def score(matcher: Matcher, text: str | None) -> tuple[float, int]:
    """Score and number of matches of a text."""
    if not text:
        return 0.0, 0
    found = matcher.matches(fold(text))
    if not found:
        return 0.0, 0
    words = max(LEAST_WORDS, sum(1 for _ in _WORD.finditer(text)))
    return round(sum(w for _, _, w in found) * PER_WORDS / words, 6), len(found)


_SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.IntegerType())])
_built: dict[int, Matcher] = {}


def _scorer(lexicon: dict[str, float]):
    key = hash(tuple(sorted(lexicon.items())))

    @F.arrow_udf(_SCORE)
    def scored(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = Matcher(lexicon, EXCEPTIONS)
        got = [score(_built[key], t) for part in slices(texts) for t in part.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int32())], names=["score", "n_matches"]
        )

    return scored


def _g2(k: Column, n: Column, rest: Column, rest_n: Column) -> Column:
    """Dunning's log-likelihood ratio for k of n against rest of rest_n."""
    pooled = (k + rest) / (n + rest_n)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))
    return 2 * (part(k, n * pooled) + part(n - k, n * (1 - pooled)) + part(rest, rest_n * pooled) + part(rest_n - rest, rest_n * (1 - pooled)))


def mine(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> dict[str, float]:
    """Words of the labelled toxic documents, with the logarithm of their rate ratio as weight."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    first = lambda bad: known.where(F.col("bad") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = first(True).unionByName(first(False))  # at most 2 * rows ids
    small = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("bad", "text").distinct()
    small = materialize(small, "labelled")
    totals = {r["bad"]: r["count"] for r in small.groupBy("bad").count().collect()}
    n, rest_n = totals.get(True, 0), totals.get(False, 0)
    if not n or not rest_n:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{4,}"), 0))
    terms = small.select("bad", F.explode(words).alias("term"))
    counted = terms.groupBy("term").agg(F.count_if("bad").alias("k"), F.count_if(~F.col("bad")).alias("r"))
    ratio = ((F.col("k") + 0.5) / (n + 1)) / ((F.col("r") + 0.5) / (rest_n + 1))
    g2 = _g2(F.col("k").cast("double"), F.lit(float(n)), F.col("r").cast("double"), F.lit(float(rest_n)))
    apart = counted.where(F.col("k") * rest_n > F.col("r") * n).where((g2 >= MIN_G2) & (ratio >= MIN_RATIO))
    weight = F.round(F.least(F.log10(ratio), F.lit(2.0)), 3).alias("weight")
    return {r["term"]: r["weight"] for r in apart.select("term", weight).orderBy("term").collect()}


def toxicity(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, score, n_matches, toxic."""
    lexicon = dict(CURATED)
    for term, weight in (mine(docs, labels) if labels is not None else {}).items():
        lexicon[term] = max(weight, lexicon.get(term, 0.0))
    s = docs.select("doc_id", _scorer(lexicon)("text").alias("s"))
    return s.select("doc_id", "s.score", "s.n_matches", (F.col("s.score") >= threshold).alias("toxic"))
