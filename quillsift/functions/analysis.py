"""Text analysis as column expressions.

A tokenizer maps a string column to an array of terms.  ``words`` yields the runs of letters
and digits and every other character on its own, without the marks in ``MARKS``; case is
kept.  ``term_count`` and ``word_count`` give the numbers a search needs without building
that array.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import FieldType, TableSchema

#: Marks that are never terms.
MARKS = " .。,，\\、;；:：?？!！\"“”()（）《》-—~#$%&`^+=【】"
#: Between the fields of a document in its cross-field text; itself a mark.
JOINT = "。"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"
_MARK_CLASS = "".join("\\" + c if c in "\\^-[]&~#" else c for c in MARKS)
_WORD = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{_MARK_CLASS}]"

Tokenizer = Callable[[Column], Column]


def whole(text: Column) -> Column:
    """The value itself; an empty value has no term."""
    return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


def semicolon_list(text: Column) -> Column:
    """The distinct parts between semicolons, empty ones too; an empty value has no term."""
    return F.when(text != "", F.array_distinct(F.split(text, ";", -1))).otherwise(F.array().cast("array<string>"))


def runes(text: Column) -> Column:
    """The distinct characters, marks included."""
    return F.when(text != "", F.array_distinct(F.split(text, ""))).otherwise(F.array().cast("array<string>"))


def drop_marks(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(MARKS)))


def words(text: Column) -> Column:
    """The terms of a text in order, repeats included."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def all_tokens(text: Column) -> Column:
    """As ``words``, marks included."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def segmenter_name(segmenter: Tokenizer | None) -> str:
    """What an index remembers of the segmenter that cut it; alike for two of the same kind and dictionary."""
    if segmenter is None:
        return "words"
    return getattr(segmenter, "name", None) or f"{segmenter.__module__}.{segmenter.__qualname__}"


def _named(segmenter: Tokenizer, kind: str, *parts) -> Tokenizer:
    segmenter.name = f"{kind}:{hashlib.sha256(repr(parts).encode()).hexdigest()[:16]}"
    return segmenter


TOKENIZERS: dict[FieldType, Tokenizer] = {
    FieldType.WHOLE: whole, FieldType.LIST: semicolon_list, FieldType.RUNE: runes, FieldType.WORDS: words,
}


def terms_of(kind: FieldType, text: Column, segmenter: Tokenizer | None = None) -> Column:
    return (segmenter or words)(text) if kind is FieldType.WORDS else TOKENIZERS[kind](text)


def dictionary_segmenter(dictionary: Iterable[str], overlapping: bool = False) -> Tokenizer:
    """A tokenizer that also cuts runs of letters by a dictionary, for scripts without spaces.

    At each place the longest entry is taken; a character that starts none joins the
    characters before it that start none.  With ``overlapping``, entries inside a longer one
    are terms as well.  The dictionary is shipped with the plan.
    """
    entries = frozenset(d for d in dictionary if d)
    longest = max(map(len, entries), default=1)
    token = re.compile(r"[^\W_]+|[\W_]", re.S)
    marks = frozenset(MARKS)

    def cut(run: str) -> list[str]:
        out, loose, at = [], "", 0
        while at < len(run):
            size = next((k for k in range(min(longest, len(run) - at), 0, -1) if run[at : at + k] in entries), 0)
            if not size:
                loose += run[at]
                at += 1
                continue
            if loose:
                out.append(loose)
                loose = ""
            found = run[at : at + size]
            if overlapping:
                out += [found[i : i + k] for k in range(1, size) for i in range(size - k + 1) if found[i : i + k] in entries]
            out.append(found)
            at += size
        return out + ([loose] if loose else [])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [w for t in token.findall(s or "") if t not in marks for w in (cut(t) if t.isalnum() and not t.isascii() else [t])])

    return _named(lambda text: segment(text), "dictionary", sorted(entries), overlapping)


@dataclass(frozen=True)
class StateModel:
    """Log probabilities of a character's place in a word: B(egin), M(iddle), E(nd), S(ingle)."""

    start: Mapping[str, float]
    step: Mapping[str, Mapping[str, float]]
    emit: Mapping[str, Mapping[str, float]]
    unseen: float = -20.0

    def cut(self, run: str) -> list[str]:
        """The words of the most probable states (Viterbi)."""
        if not run:
            return []
        emit = lambda s, c: self.emit.get(s, {}).get(c, self.unseen)
        best = {s: (self.start.get(s, -math.inf) + emit(s, run[0]), s) for s in "BMES"}
        for c in run[1:]:
            best = {
                s: max((p + self.step.get(path[-1], {}).get(s, -math.inf) + emit(s, c), path + s) for p, path in best.values()) for s in "BMES"
            }
        states = max(best[s] for s in "ES")[1]
        out, word = [], ""
        for c, s in zip(run, states):
            word += c
            if s in "ES":
                out.append(word)
                word = ""
        return out + ([word] if word else [])


def probable_cut(run: str, weights: Mapping[str, float], longest: int, least: float, states: StateModel | None = None) -> list[str]:
    """The cut of a run into dictionary words with the largest sum of log weights; unknown characters between go to ``states``, or stay together."""
    n = len(run)
    best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
    for i in range(n - 1, -1, -1):
        ends = [j for j in range(i + 1, min(n, i + longest) + 1) if run[i:j] in weights] or [i + 1]
        best[i] = max((weights.get(run[i:j], least) + best[j][0], j) for j in ends)
    out, loose, i = [], "", 0
    while i <= n:
        word = run[i : best[i][1]] if i < n else ""
        if i < n and word not in weights:
            loose += word
        else:
            out += (states.cut(loose) if states else [loose]) if loose else []
            out += [word] if word else []
            loose = ""
        i = best[i][1] if i < n else n + 1
    return out


def probability_segmenter(frequencies: Mapping[str, float], states: StateModel | None = None) -> Tokenizer:
    """A tokenizer that cuts runs of letters outside ASCII into the most probable sequence of dictionary words.

    ``states`` finds words that the dictionary lacks.  Both are given, none is shipped.
    """
    total = sum(frequencies.values()) or 1.0
    weights = {w: math.log(f / total) for w, f in frequencies.items() if w and f > 0}
    longest, least = max(map(len, weights), default=1), math.log(0.5 / total)
    token, marks = re.compile(r"[^\W_]+|[\W_]", re.S), frozenset(MARKS)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segment(texts: pd.Series) -> pd.Series:
        cut = lambda t: probable_cut(t, weights, longest, least, states) if t.isalnum() and not t.isascii() else [t]
        return texts.map(lambda s: [w for t in token.findall(s or "") if t not in marks for w in cut(t)])

    return _named(lambda text: segment(text), "probability", sorted(weights.items()), states)


def is_word(keyword: str) -> bool:
    """Whether a keyword can be a run of letters and digits."""
    return bool(keyword) and all(unicodedata.category(c)[0] in "LN" for c in keyword)


def is_sign(keyword: str) -> bool:
    """Whether a keyword is a single character that is a term on its own."""
    return len(keyword) == 1 and not is_word(keyword) and keyword not in MARKS


def word_count(text: Column) -> Column:
    """Number of terms of a text by ``words``."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0))


def term_count(text: Column, keyword: str) -> Column:
    """How often ``keyword`` is a term of a text by ``words``."""
    if is_word(keyword):
        pattern = rf"(?<![\p{{L}}\p{{N}}])\Q{keyword}\E(?![\p{{L}}\p{{N}}])"
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    if is_sign(keyword):
        return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit(""))), F.lit(0))
    return F.lit(0)


def cross_field_text(schema: TableSchema, columns: dict[str, Column] | None = None) -> Column:
    """All searchable fields of a document as one text; missing ones are left out."""
    return F.concat_ws(JOINT, *[(columns or {}).get(f.name, F.col(f.name)) for f in schema.searchable])
