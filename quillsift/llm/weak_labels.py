"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or abstain on every document.  Their votes overlap
and err, so expectation-maximisation estimates, from how often they agree, each labeller's
accuracy on good and on bad documents (of the votes it casts; abstaining says nothing) and
the share of good ones.  It needs only
the counts of the vote patterns (at most 3^9 of them, over all documents), which fit the
driver.  Each pattern thus has a posterior probability of being good.

The posteriors label the training rows of a linear scorer over hashed features: the words,
the shapes of blank-separated tokens, and repeats of the word before, each as a share of the
tokens.  It is fitted by logistic regression on about ``TRAIN_ROWS`` documents, those whose
hashed doc_id falls below a bound, and scores all documents; one is kept from
``THRESHOLD`` on.

Defined results: a document without tokens (null, empty, blank) has score 0 and is not kept;
a null ``doc_id`` is scored, and is never a training row; repeated rows vote each; in an
empty table, or one without training rows, the score is the posterior; other columns are not
read.  Votes, posteriors and scores cover whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix, positive, slices, span_hashes, text_buffer, word_hashes
from .quality_rules import common_words

TRAIN_ROWS = 4000
DIMENSIONS = 1 << 14
THRESHOLD = 0.5

GOOD, BAD, ABSTAIN = 2, 0, 1
LABELLERS = ("upper case", "symbols", "separators", "distinct words", "repeats", "common words", "letters", "runs of signs", "near repeats")


def votes(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` and code: the votes of all labellers as digits to base 3."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    a = docs.select(
        *carry, F.length(text).alias("__n"), gone(r"\p{L}+").alias("__letters"), gone(r"\p{Lu}+").alias("__upper"),
        gone(r"[#$%&*|@~^<>{}\[\]\\_=+]+").alias("__symbols"), F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")).alias("__runs"), gone(r"\s+").alias("__blanks"), gone(r"[|\t;]+").alias("__bars"),
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("__ws"),
    )
    keep = [c for c in a.columns if c != "__ws"]
    a = a.select(
        *keep, F.size("__ws").alias("__nw"), F.size(F.array_distinct("__ws")).alias("__kinds"), F.size(common_words(F.col("__ws"))).alias("__common"),
        F.size(F.filter("__ws", lambda w, i: (i > 0) & (w == F.get(F.col("__ws"), i - 1)))).alias("__again"),
        F.size(F.filter("__ws", lambda w, i: (i > 1) & (w == F.get(F.col("__ws"), i - 2)))).alias("__near"),
    )
    c = F.col

    def vote(bad: Column, good: Column, needs: Column) -> Column:
        return F.when(~needs, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    each = [
        vote(c("__upper") > 0.5 * c("__letters"), c("__upper") < 0.15 * c("__letters"), c("__letters") >= 40),
        vote(c("__symbols") > 0.03 * c("__n"), c("__symbols") < 0.003 * c("__n"), c("__n") >= 100),
        vote(c("__bars") > 0.1 * c("__nw"), c("__bars") == 0, c("__nw") >= 20),
        vote(F.ln("__kinds") < 0.7 * F.ln("__nw"), F.ln("__kinds") > 0.8 * F.ln("__nw"), c("__nw") >= 30),  # as new words get rarer with length
        vote(c("__again") > 0.1 * c("__nw"), c("__again") < 0.01 * c("__nw"), c("__nw") >= 30),
        vote(c("__common") < 0.1 * c("__nw"), c("__common") > 0.2 * c("__nw"), c("__nw") >= 30),
        vote(c("__letters") < 0.85 * (c("__n") - c("__blanks")), c("__letters") > 0.92 * (c("__n") - c("__blanks")), c("__n") >= 100),
        vote(c("__runs") > 0.1 * c("__nw"), c("__runs") < 0.02 * c("__nw"), c("__nw") >= 20),
        vote(c("__near") > 0.15 * c("__nw"), c("__near") < 0.05 * c("__nw"), c("__nw") >= 30),
    ]
    code = F.lit(0)
    for v in each:
        code = code * 3 + v
    rest = [x for x in keep if not x.startswith("__")]
    return a.select(*rest, code.cast("int").alias("code"))


def patterns(codes: np.ndarray, m: int = len(LABELLERS)) -> np.ndarray:
    """The votes of each code, a row a code."""
    return codes[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3


def fit_labellers(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, accuracies[class, labeller] and the shares of the classes, by EM.

    It starts from the majority, which also decides which class is the good one.
    """
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    cast = np.maximum(bad.sum(axis=1) + good.sum(axis=1), 1)
    post = np.clip(0.5 + (good.sum(axis=1) - 2 * bad.sum(axis=1)) / (2 * cast), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        right = np.stack([weight[0] @ bad, weight[1] @ good]) + 1
        accuracy = right / (right + np.stack([weight[0] @ good, weight[1] @ bad]) + 1)
        log_bad = np.log(share[0]) + bad @ np.log(accuracy[0]) + good @ np.log(1 - accuracy[0])
        log_good = np.log(share[1]) + good @ np.log(accuracy[1]) + bad @ np.log(1 - accuracy[1])
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
    return post, accuracy, share


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91], _SHAPE[48:58] = 65, 48
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def token_features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of every token.

    A token's shape is the runs of its character classes: ``Hello!!`` has the shape ``Aa!``.
    """
    hashes, rows = word_hashes(offsets, data)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    size = np.uint64(DIMENSIONS - 1)
    buckets = [(hashes % size).astype(np.int64) + 1]
    owners = [rows]
    buckets.append(np.zeros(int(again.sum()), np.int64))  # bucket 0: repeats
    owners.append(rows[again])
    if len(data):
        starts = np.zeros(len(data), bool)
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        shape, blank = _SHAPE[data], _BLANK[data]
        first = np.concatenate([[True], shape[1:] != shape[:-1]]) | starts
        row_of = np.searchsorted(offsets, np.flatnonzero(first & ~blank), "right") - 1
        opens = np.concatenate([[True], blank[:-1]]) | starts
        kept = first & ~blank
        at = np.flatnonzero(kept)
        begin = np.flatnonzero(opens[at])  # a token's first character always starts a run
        end = np.append(begin[1:], len(at))
        shapes = mix(span_hashes(shape[at], begin, end) + np.uint64(1))
        buckets.append((shapes % size).astype(np.int64) + 1)
        owners.append(row_of[begin])
    return np.concatenate(buckets), np.concatenate(owners)


def tokens_of(offsets: np.ndarray, buckets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Features of each row: words, repeats and shapes."""
    return np.bincount(rows, minlength=len(offsets) - 1)


_FEATURES = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType()))])


@F.arrow_udf(_FEATURES)
def _features(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_features_of(part) for part in slices(texts)])


def _features_of(texts: pa.Array) -> pa.Array:
    offsets, data = text_buffer(texts)
    buckets, rows = token_features(offsets, data)
    n = np.maximum(tokens_of(offsets, buckets, rows), 1)
    both, count = np.unique(rows * DIMENSIONS + buckets, return_counts=True)
    row = both // DIMENSIONS
    at = pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32())
    share = (count / n[row]).astype(np.float32)
    lists = [pa.ListArray.from_arrays(at, pa.array((both % DIMENSIONS).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(share))]
    return pa.StructArray.from_arrays(lists, names=["bucket", "share"])


def fit_scorer(buckets: list, shares: list, labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels (Adam, slight L2)."""
    sizes = np.array([len(b) for b in buckets])
    at, value = np.concatenate(buckets).astype(np.int64), np.concatenate(shares).astype(np.float64) * 10
    row = np.repeat(np.arange(len(sizes)), sizes)
    w, m, v = (np.zeros(DIMENSIONS + 1) for _ in range(3))
    balance = np.where(labels >= 0.5, 0.5 / max((labels >= 0.5).mean(), 1e-3), 0.5 / max((labels < 0.5).mean(), 1e-3))
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[at], len(sizes)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * balance / len(sizes)
        g = np.append(np.bincount(at, value * error[row], DIMENSIONS), error.sum()) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w[:-1] *= 10
    return w


def linear_scores(offsets: np.ndarray, data: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The probability of good of each row; 0 without tokens."""
    buckets, rows = token_features(offsets, data)
    n = tokens_of(offsets, buckets, rows)
    z = np.bincount(rows, weights[buckets], len(offsets) - 1) / np.maximum(n, 1) + weights[-1]
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def _scorer(weights: np.ndarray):
    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.round(np.concatenate([linear_scores(*text_buffer(part), weights) for part in slices(texts)]), 6))

    return scored


def _posterior(every: np.ndarray):
    @F.arrow_udf(T.DoubleType())
    def posterior(codes: pa.Array) -> pa.Array:
        return pa.array(every[codes.to_numpy(zero_copy_only=False)])

    return posterior


def labelled(codes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Posterior of every vote code, the labellers' accuracies, and the number of documents."""
    found = codes.groupBy("code").count().collect()  # at most 3^9 rows
    codes = np.array([r["code"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], float)
    post, accuracy, _ = fit_labellers(patterns(codes), counts)
    every = np.full(3 ** len(LABELLERS), 0.5)
    every[codes] = np.round(post, 6)
    return every, accuracy, int(counts.sum())


def fitted(voted: DataFrame, every: np.ndarray, n: int, train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """The scorer's weights, from the training rows of (doc_id, text, code); None if there are none."""
    bound = ((1 << 63) - 1) * min(train_rows, n) // max(n, 1)
    sample = voted.where(F.col("doc_id").isNotNull() & (positive(F.xxhash64("doc_id", F.lit("train"))) <= bound))
    rows = sample.select("doc_id", "code", _features("text").alias("f")).select("doc_id", "code", "f.bucket", "f.share").collect()  # about train_rows
    rows = sorted((r for r in rows if r["bucket"]), key=lambda r: (r["doc_id"], r["code"], r["bucket"], r["share"]))
    return fit_scorer([r["bucket"] for r in rows], [r["share"] for r in rows], every[[r["code"] for r in rows]]) if rows else None


def classified(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, posterior, score, keep.

    The texts are written once beside their votes, so that each pass after that reads the votes.
    """
    voted = materialize(votes(docs, [F.col("doc_id"), F.col("text")]), "votes")
    every, _, n = labelled(voted)
    posterior, weights = _posterior(every)("code"), fitted(voted, every, n, train_rows)
    if weights is not None:
        score = _scorer(weights)("text")
    else:
        score = F.when(F.trim("text") != "", posterior).otherwise(F.lit(0.0))
    s = voted.select("doc_id", posterior.alias("posterior"), score.alias("score"))
    return s.select("doc_id", "posterior", "score", (F.col("score") >= threshold).alias("keep"))
