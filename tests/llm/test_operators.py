"""The corpus operators against plain versions, round trips and held-out labels."""

import base64
import bz2
import gzip
import lzma
import random
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from quillsift.llm import common, cuckoo, html_extract, line_dedup, mixing, packing, queries, quality_rules, secrets, simhash, toxicity, weak_labels

from . import brute, plain


# -- quality rules


def test_divergence_by_hand(spark):
    df = spark.createDataFrame([([1, 0], [0, 1], [1, 1], [0, 0])], "a array<int>, b array<int>, c array<int>, z array<int>")
    d = lambda x, y: quality_rules.js_divergence(F.col(x), F.col(y))
    got = df.select(d("a", "b"), d("a", "a"), d("a", "c"), d("a", "z")).first()
    assert [round(x, 6) for x in got] == [1.0, 0.0, 0.311278, 0.0]


def test_junk_goes_and_clean_documents_stay(spark, sf_dir):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    assert got[got.quality == 1].keep.mean() > 0.98 and got[got.quality == 0].keep.mean() < 0.2


# -- exact dedup


def test_cuckoo_index_against_a_dictionary():
    rng, index, live = random.Random(1), cuckoo.CuckooIndex(4), {}
    keys = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(3000)]
    for step in range(20000):
        key = rng.choice(keys)
        assert index.holder(*key) == live.get(key)
        if key in live and rng.random() < 0.5:
            assert index.delete(*key)
            del live[key]
        elif key not in live:
            index.insert(*key, step)
            live[key] = step
        else:
            assert index.holder(*key) is not None
    assert index.size == len(live) and index.buckets > 4
    assert not index.delete(1, 1)


def test_cuckoo_keeps_keys_of_one_fingerprint():
    index = cuckoo.CuckooIndex(4)
    for i in range(8):  # as many as two buckets hold
        index.insert(i << 40, 7, i)
    assert [index.holder(i << 40, 7) for i in range(8)] == list(range(8))


def test_replayed_log_with_deletions(spark):
    log = [(1, 0, "x", False), (2, 1, "x", False), (9, 2, "x", True), (3, 3, "x", False), (9, 4, "y", True), (4, 5, "y", False), (5, 6, None, False)]
    got = cuckoo.replay(spark.createDataFrame(log, "id bigint, seq bigint, text string, removal boolean")).collect()
    assert sorted((r["outcome"], r["id"], r["holder"]) for r in got) == [
        ("absent", 9, 9), ("deleted", 9, 1), ("duplicate", 2, 1), ("inserted", 1, 1), ("inserted", 3, 3), ("inserted", 4, 4),
    ]


# -- quality classifier


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth, accuracy = rng.random(20000) < 0.7, np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    right = rng.random((20000, 5)) < accuracy
    votes = np.where(right == truth[:, None], weak_labels.GOOD, weak_labels.BAD)
    votes[rng.random((20000, 5)) < 0.3] = weak_labels.ABSTAIN
    found, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, got, share = weak_labels.fit_labellers(found, counts.astype(float))
    assert np.abs(got.mean(axis=0) - accuracy).max() < 0.03 and abs(share[1] - 0.7) < 0.03
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.93


def test_votes_posteriors_and_scores_equal_plain_ones(spark, sf_dir):
    """The query: votes and EM by plain versions; scores, from the weights it fits, one document at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codes = {i: plain.votes(t) for i, t in texts.items()}
    voted = weak_labels.votes(docs, [F.col("doc_id"), F.col("text")])
    assert {r["doc_id"]: r["code"] for r in voted.collect()} == codes
    post = plain.posteriors(list(codes.values()))
    every, _, n = weak_labels.labelled(voted)
    weights = weak_labels.fitted(voted, every, n)
    import pyarrow as pa

    for r in queries.op3_quality_classifier(spark, sf_dir).collect():
        i = r["doc_id"]
        assert abs(r["posterior"] - post[codes[i]]) < 2e-6
        bucket, _ = weak_labels.token_features(*common.text_buffer(pa.array([texts[i]])))
        z = sum(weights[b] for b in bucket.tolist()) / max(len(bucket), 1) + weights[-1]
        assert abs(r["score"] - (1 / (1 + np.exp(-z)) if len(bucket) else 0)) < 2e-6 and r["keep"] == (r["score"] >= weak_labels.THRESHOLD)


def test_long_documents_are_voted_on(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20] * 300))]
    got = {r["doc_id"]: r["code"] // 3**5 % 3 for r in weak_labels.votes(spark.createDataFrame(rows, "doc_id bigint, text string"), [F.col("doc_id")]).collect()}
    assert got == {1: weak_labels.GOOD, 2: weak_labels.BAD}


def test_classifier_on_held_out_labels(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    assert (got.keep == (got.quality == 1)).mean() > 0.97


def test_scores_do_not_depend_on_batches():
    texts = ["Hello!! hello world", "", "a a a", "Über 3 x"]
    w = np.random.default_rng(0).normal(size=weak_labels.DIMENSIONS + 1)
    import pyarrow as pa

    whole = weak_labels.linear_scores(*common.text_buffer(pa.array(texts)), w)
    single = [weak_labels.linear_scores(*common.text_buffer(pa.array([t])), w)[0] for t in texts]
    assert np.allclose(whole, single) and whole[1] == 0


# -- line dedup


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 50000).astype(np.uint64))
    mph = line_dedup.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))
    assert len(line_dedup.PerfectHash.build(keys[:0]).slots(keys)) == len(keys)
    strangers = mph.slots(keys + np.uint64(1))
    assert strangers.max() < len(keys)


@pytest.mark.parametrize("pass_bytes", [1 << 30, 2000])
def test_lines_in_one_pass_or_many(spark, sf_dir, pass_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = queries.op4_line_dedup(spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    got = line_dedup.deduped_lines(docs, pass_bytes=pass_bytes).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want)


def test_repeated_and_null_ids_in_one_pass_or_many(spark):
    a, b, c = (f"Line {x} that is long enough to be counted." for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\nshort\n{c}"), (2, f"{c}\n{b}\nx\n{a}\nend"), (2, f"{c}\n{b}\nx\n{a}\nend"), (2, None), (None, f"{a}\n{c}"), (None, b), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda r: tuple((x is None, x) for x in r)
    one, many = (sorted((tuple(r) for r in line_dedup.deduped_lines(docs, pass_bytes=n).collect()), key=key) for n in (1 << 30, 20))
    assert many == one and (None, f"{a}\n{c}", 2, 0, True) in many and (2, f"{c}\nx\nend", 3, 2, True) in many


def test_stage_keeps_documents_with_short_lines_of_their_own(spark):
    head = "A license header that many files share."
    rows = [
        (1, f"{head}\nroses are red"), (2, f"{head}\nRoses are red \nviolets are blue"), (3, f"{head}\nviolets are blue\n"), (4, f"{head}\n \t\r\n"),
        (5, f"{head}\nsugar is sweet\n{head}"), (5, f"{head}\nroses are red"), (None, head),
    ]
    got = line_dedup.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == [(0, head), (1, rows[0][1]), (2, "Roses are red \nviolets are blue"), (5, "sugar is sweet")]
    kept = line_dedup.deduped_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(kept) == len(rows) and sorted(((r["doc_id"] or 0), r["text"]) for r in kept if r["keep"]) == sorted(((r["doc_id"] or 0), r["text"]) for r in got)


# -- SimHash


def _signed(x):
    return [v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (1 << 64) - 1)]


def test_variants_cover_all_close_signatures(spark):
    rng = random.Random(4)
    rows, pairs = [], set()
    for k in range(120):
        base = rng.getrandbits(simhash.BITS)
        flips = rng.sample(range(simhash.BITS), k % 12)  # up to 2 * segments - 1: all must be found
        for i, x in enumerate((base, base ^ sum(1 << f for f in flips))):
            rows.append((2 * k + i, *_signed(x)))
        pairs.add((2 * k, 2 * k + 1))
    got = simhash.near_pairs(spark.createDataFrame(rows, "node bigint, hi bigint, lo bigint"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(pairs)  # each once


def test_recall_at_14_bits(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        base = rng.getrandbits(simhash.BITS)
        for i, x in enumerate((base, base ^ sum(1 << f for f in rng.sample(range(simhash.BITS), 14)))):
            rows.append((2 * k + i, *_signed(x)))
    assert simhash.near_pairs(spark.createDataFrame(rows, "node bigint, hi bigint, lo bigint")).count() >= 0.9 * 1500


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 64])
def test_pairs_links_and_forest_of_large_groups(spark, hot_rows):
    """Groups of three, and one of hundreds that share variants: whole, and cut into blocks."""
    rng, all_ = random.Random(7), []
    for size in [3] * 100 + [300]:
        base = rng.getrandbits(simhash.BITS)
        all_ += [base ^ sum(1 << f for f in rng.sample(range(simhash.BITS), rng.randrange(12))) for _ in range(size)]
    want = {
        (i, j) for i in range(len(all_)) for j in range(i + 1, len(all_)) if (all_[i] ^ all_[j]).bit_count() <= simhash.RADIUS
        and min(((all_[i] ^ all_[j]) >> a & (1 << b - a) - 1).bit_count() for a, b in simhash.bounds()) <= 1
    }
    nodes = spark.createDataFrame([(i, *_signed(x)) for i, x in enumerate(all_)], "node bigint, hi bigint, lo bigint")
    got = [tuple(r) for r in simhash.near_pairs(nodes, hot_rows=hot_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links, edges = {}, []
    for a, b, n in simhash.linked(nodes, hot_rows=hot_rows).collect():
        if a == b:
            links[a] = links.get(a, 0) + n
        else:
            edges.append((a, b))
    assert links == {i: sum(i in p for p in want) for i in {x for p in want for x in p}}
    assert len(edges) < len(want) and _roots(len(all_), edges) == _roots(len(all_), want)


def _roots(n, edges):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 64])
def test_flips_find_every_pair_within_the_radius(spark, hot_rows):
    """Pairs at every distance up to and beyond the radius, and a group of hundreds: all of them, each once, by links and by forest."""
    rng, all_ = random.Random(12), []
    for k in range(600):
        base = rng.getrandbits(simhash.BITS)
        all_ += [base, base ^ sum(1 << f for f in rng.sample(range(simhash.BITS), k % (simhash.RADIUS + 3)))]
    base = rng.getrandbits(simhash.BITS)
    all_ += [base ^ sum(1 << f for f in rng.sample(range(simhash.BITS), rng.randrange(12))) for _ in range(300)]
    all_ = list(dict.fromkeys(all_))
    want = {(i, j) for i in range(len(all_)) for j in range(i + 1, len(all_)) if (all_[i] ^ all_[j]).bit_count() <= simhash.RADIUS}
    nodes = spark.createDataFrame([(i, *_signed(x)) for i, x in enumerate(all_)], "node bigint, hi bigint, lo bigint")
    segments = simhash.complete(simhash.RADIUS)
    got = [tuple(r) for r in simhash.near_pairs(nodes, segments, hot_rows=hot_rows, flips=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links, edges = {}, []
    for a, b, n in simhash.linked(nodes, segments, hot_rows=hot_rows, flips=True).collect():
        if a == b:
            links[a] = links.get(a, 0) + n
        else:
            edges.append((a, b))
    assert links == {i: sum(i in p for p in want) for i in {x for p in want for x in p}}
    assert len(edges) < len(want) and _roots(len(all_), edges) == _roots(len(all_), want)


def test_signatures_bit_by_bit():
    import pyarrow as pa

    text = "a rose is a rose is a rose " * 3 + " ".join(f"word{i}" for i in range(5000))
    offsets, data = common.text_buffer(pa.array([text, "x", "it is so"]))
    hi, lo, some = simhash.signatures(offsets, data)
    hashes, rows = common.word_hashes(*common.text_buffer(pa.array([" ".join(w for w in text.split() if len(w) > simhash.SHORT)])))
    words, freq = np.unique(hashes, return_counts=True)
    weight = 1 + np.log2(freq).astype(int)
    low = common.mix(words)
    total = weight.sum()
    want = sum(1 << b for b in range(64) if 2 * int((((low >> np.uint64(b)) & np.uint64(1)).astype(int) * weight).sum()) > total)
    assert int(lo[0]) == want and some.all() and lo[1] == common.mix(common.word_hashes(*common.text_buffer(pa.array(["x"])))[0])[0]


def test_slices_cover_all_rows():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "", "b" * 100, "c"])
    parts = [p.to_pylist() for p in common.slices(texts.slice(1), 12)]
    assert sum(parts, []) == texts.to_pylist()[1:] and len(parts) == 3
    assert [len(p) for p in common.slices(texts.slice(0, 0))] == [0]


def test_groups_against_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = brute.near_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: r["group_id"] for r in queries.op5_simhash_dedup(spark, d).collect()}
    same = sum(got[i] == want[i] for i in want if want[i] != i)
    assert same >= 0.9 * sum(want[i] != i for i in want) and all(got[i] == i for i in want if want[i] == i)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[901] == 900


# -- toxicity


def test_folding_and_exceptions():
    m = toxicity.Matcher({"idiot": 2.0, "trash": 1.0, "slug*": 1.0, "idiot savant": 3.0}, ["trash can"])
    count = lambda t: len(m.matches(toxicity.fold(t)))
    for hit in ("IDIOT", "1d10t", "іdіоt", "idi0t!", "an idiot.", "ｉｄｉｏｔ", "trash", "sluggish", "idiot savant"):
        assert count(hit) == 1, hit
    for clean in ("idiots", "xidiot", "trash can", "my TRASH CAN.", "", "unslug", "1d10ts"):
        assert count(clean) == 0, clean
    assert count("trash can trash") == 1
    assert len(toxicity.fold("İstanbul ŉ")) == len("İstanbul ŉ")


def test_matches_equal_a_plain_search():
    rng = random.Random(8)
    lexicon = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) + rng.choice(["", "*"]): 1.0 for _ in range(6)}
    m = toxicity.Matcher(lexicon, [])
    folded = {toxicity.fold(k.rstrip("*")): k.endswith("*") for k in sorted(lexicon)}
    entries = {}
    for k in sorted(lexicon):
        entries.setdefault(toxicity.fold(k.rstrip("*")), k.endswith("*"))
    for _ in range(300):
        text = toxicity.fold("".join(rng.choice("ab  ") for _ in range(20)))
        spans = []
        for a in range(len(text)):
            for e, stem in entries.items():
                b = a + len(e)
                if text.startswith(e, a) and (a == 0 or text[a - 1] == " ") and (stem or b == len(text) or text[b] == " "):
                    spans.append((a, b))
        want, end = [], 0
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= end:
                want.append((a, b))
                end = b
        assert [x[:2] for x in m.matches(text)] == want
    assert folded.keys() == entries.keys()


def test_toxicity_query_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/labels.parquet").dropna(subset=["toxic"])
    both = docs.merge(labels, on="doc_id")
    terms = plain.mined([(t, b == 1) for t, b in zip(both.text, both.toxic)])
    lexicon = dict(toxicity.CURATED)
    for t, w in terms.items():
        lexicon[t] = max(w, lexicon.get(t, 0.0))
    want = {i: plain.toxic_score(t, lexicon) for i, t in zip(docs.doc_id, docs.text)}
    got = queries.op6_toxicity(spark, d).collect()
    assert {r["doc_id"]: (r["score"], r["n_matches"]) for r in got} == want
    assert all(r["toxic"] == (r["score"] >= toxicity.THRESHOLD) for r in got) and sum(n > 0 for _, n in want.values()) > 50


def test_toxic_documents_are_caught(spark):
    """Few labels: English rests on the curated list.  Many labels: the other languages' words are mined."""
    for sf, lang in (("sf0.01", "en"), ("sf0.1", None)):
        d = f"/root/testdata/{sf}"
        labels = pd.read_parquet(f"{d}/labels.parquet").merge(pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id", "lang"]), on="doc_id")
        labels = labels if lang is None else labels[labels.lang == lang]
        got = queries.op6_toxicity(spark, d).toPandas().merge(labels, on="doc_id", suffixes=("", "_label"))
        assert got[got.toxic_label == 1].toxic.mean() > 0.85 and got[got.toxic_label == 0].toxic.mean() < 0.02


# -- secrets

SECRET = "AKIA" + "Q7ZX" * 4
LAYERS = {
    "url": lambda s: quote(s, safe="").replace("A", "%41"), "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "base64>gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), "base64>zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    "base64>bzip2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(), "base64>xz": lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
    "base64>zstd": lambda s: base64.b64encode(zstandard.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_layers_map_back(outer, inner):
    coded = LAYERS[outer](f"key is {LAYERS[inner](f'see {SECRET} here')} ok")
    text = f"some text {coded} more text"
    found = [f for f in secrets.scan(text) if f[0] == "aws access key"]
    assert found, (outer, inner)
    _, path, depth, start, end, preview, _ = found[0]
    assert depth == 2 and path == f"{outer}>{inner}" and preview == "AKIA"
    assert text.index(coded) <= start < end <= text.index(coded) + len(coded)
    if outer == "url" and inner == "url":
        assert secrets._unquote(secrets._unquote(text[start:end])[0])[0] == SECRET


def test_cycles_bombs_and_clean_texts(monkeypatch):
    assert [f[:3] for f in secrets.scan(SECRET)] == [("aws access key", "", 0)] and secrets.scan(SECRET)[0][3:5] == (0, len(SECRET))
    assert secrets.scan(None) == secrets.scan("") == secrets.scan("The quick brown fox, 100% sure; C:\\users\\x") == []
    deep = SECRET
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert secrets.scan(deep)[0][2] == 12
    monkeypatch.setattr(secrets, "MAX_LAYER", 1000)
    assert [f[0] for f in secrets.scan(LAYERS["base64>gzip"]("x" * 5000))] == ["oversized layer"]
    assert len(secrets.scan("%25" * 30000)) == 0


@pytest.mark.parametrize("lead", ["data=", "a/b?x=", "KEY==", "x " + "A" * 20 + "="])
@pytest.mark.parametrize("codec", ["base64", "base64>gzip", "base64>xz"])
def test_coded_text_after_an_equals_sign(lead, codec):
    text = f"{lead}{LAYERS[codec](f'see {SECRET} here')} ok"
    assert ("aws access key", codec, 1) in [f[:3] for f in secrets.scan(text)]


@pytest.mark.parametrize("lead", ["a/", "x-", "name_", "path/to/", "one-two_", "A/b-C_d/"])
@pytest.mark.parametrize("tail", [" ok", "/end", "-x", "_"])
@pytest.mark.parametrize("codec", ["base64", "base64>gzip", "base64>zstd"])
def test_coded_text_in_paths_and_names(lead, tail, codec):
    coded = LAYERS[codec](f"see? {SECRET} here")
    text = f"{lead}{coded}{tail}"
    found = [f for f in secrets.scan(text) if f[:3] == ("aws access key", codec, 1)]
    assert found and len(lead) <= found[0][3] < found[0][4] <= len(text) - (0 if ">" in codec else len(tail))


def test_runs_with_many_separators_take_linear_time():
    import time

    began = time.process_time()
    for run in ("AbCd-" * 100000, base64.b64encode(b"some words, and more ").decode().rstrip("=") + "_" + "A-b_" * 100000 + "\x7f", "YWFh/" * 100000):
        secrets.scan(run)
    assert time.process_time() - began < 20


def test_a_bomb_is_scanned_in_bounded_time_and_memory():
    import time
    import tracemalloc

    for data in (bytes(15 << 20), b"x" * (15 << 20), b"word " * (3 << 20)):
        coded = base64.b64encode(gzip.compress(data + b" " + SECRET.encode())).decode()
        assert len(coded) < 100_000
        began = time.process_time()
        found = [f[0] for f in secrets.scan(coded)]
        assert time.process_time() - began < 15 and (found == ["aws access key"] or not any(data))
    tracemalloc.start()
    secrets.scan(base64.b64encode(gzip.compress(b"word " * (3 << 20))).decode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_scan_equals_a_plain_scanner(spark):
    """On the table, and on secrets under up to three random layers among words and paths."""
    d = "/root/testdata/sf0.01"
    texts = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id").text
    got: dict = {i: set() for i in texts.index}
    for r in queries.op7_secret_scan(spark, d).collect():
        got[r["doc_id"]].add((r["rule"], r["digest"]))
    for i, t in texts.items():
        assert plain.secrets_in(t) == got[i], i
    rng = random.Random(12)
    for _ in range(150):
        inner = f"{rng.choice(['see ', 'api_key=', 'x/'])}{SECRET if rng.random() < 0.6 else 'q7Zx0PmL2vTk9'} end?"
        for _ in range(rng.randrange(4)):
            inner = f"{rng.choice(['say ', 'a/', 'k=', 'x-'])}{LAYERS[rng.choice(list(LAYERS))](inner)}{rng.choice([' ok', '/z', ''])}"
        assert plain.secrets_in(inner) <= {(f[0], f[6]) for f in secrets.scan(inner)}, inner


@pytest.mark.parametrize("codec", ["url", "unicode"])
def test_escapes_far_apart_in_one_coded_run(codec):
    escape = (lambda s: quote(s, safe="")) if codec == "url" else (lambda s: s.replace("/", "\\u002f"))
    for payload in (b"ab?" + b"a" * 300 + f" {SECRET} ".encode() + b"b" * 300 + b"ab?", gzip.compress(bytes(random.Random(1).choices(range(32, 127), k=900)) + f" {SECRET} ".encode())):
        coded = escape(base64.b64encode(payload).decode())
        assert coded.count("%2F" if codec == "url" else "\\u002f") > 0
        text = f"x {coded} y"
        found = [f for f in secrets.scan(text) if f[0] == "aws access key"]
        assert found and text.index(coded) <= found[0][3] < found[0][4] <= text.index(coded) + len(coded)


def test_an_escaped_value_is_read_with_its_name():
    for value in ("%71w8Zk3Lp0Xv5Tn", "\\x71w8Zk3Lp0Xv5Tn", "%FF", "%E2%82%AC"):
        text = f"é password = {value}" if len(value) > 12 else f"{value} é password = %71w8Zk3Lp0Xv5Tn"
        found = [f for f in secrets.scan(text) if f[0] == "assigned secret" and f[5] == "qw8Z"]
        assert [text[f[3] : f[4]][-15:] for f in found] == [text[-15:]] and found[0][3] == text.index("71w") - (1 if "%71" in text else 2)


def test_spans_of_escapes():
    text, spans = secrets._unquote("a%41%C3%A9%FFb%2Fé")
    assert text == "aAé\ufffdb/é" and [spans.of(i, i + 1) for i in range(7)] == [(0, 1), (1, 4), (4, 10), (10, 13), (13, 14), (14, 17), (17, 18)]
    assert max(f[2] for f in secrets.scan("%" + "25" * 30000 + "41KIA" + SECRET[4:])) == secrets.CHAIN + 2
    assert max(f[2] for f in secrets.scan("\\" + "x5c" * 30000 + "x41KIA" + SECRET[4:])) == secrets.CHAIN + 2


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress, zlib.compress])
def test_all_members_and_chunks_are_scanned(monkeypatch, pack):
    rules = lambda data: {f[0] for f in secrets.scan(base64.b64encode(data).decode())}
    assert rules(pack(b"nothing here ") + pack(f"see {SECRET} here".encode())) == {"aws access key"}
    assert rules(pack(b"nothing here ") + b"\0" * 8 + pack(f"see {SECRET} here".encode())) == {"aws access key"}
    assert rules(pack(b"nothing here ") + f" see {SECRET} here".encode()) == {"aws access key"}
    monkeypatch.setattr(secrets, "MAX_LAYER", 1000)
    nested = base64.b64encode(f"see {SECRET} here".encode()).decode()
    for at in range(940, 1010):  # over the end of the first chunk
        for secret in (SECRET, nested):
            assert rules(pack(("é word" * 200).encode()[: 7 * (at // 7)] + b"." * (at % 7) + f" {secret} ".encode() + "é word ".encode() * 400)) == {"aws access key", "oversized layer"}


def test_a_large_layer_is_scanned_to_its_end():
    data = gzip.compress(b"word " * (5 << 20) + SECRET.encode())  # 25 MB
    assert [f[0] for f in secrets.scan(base64.b64encode(data).decode())] == ["oversized layer", "aws access key"]


# -- packing


def test_packing_equals_a_scan_of_all_windows(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([1, 2, 3, 5, 8, 13, 21, 25, 50, 53, 160])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for chunk in (1 << 20, 7):
        got = {(r["doc_id"], r["piece"]): (r["n_tokens"], r["window_id"], r["window_offset"]) for r in packing.packed(docs, 50, chunk).collect()}
        cut = [(i, k, n) for i, t in rows for k, n in brute.pieces_of(i, t, 50)]
        order = spark.createDataFrame(cut, "doc_id bigint, piece bigint, n bigint").select("doc_id", "piece", "n", common.positive(F.xxhash64("doc_id", "piece")).alias("h")).collect()
        want = brute.best_fit([(r["n"], r["h"], (r["doc_id"], r["piece"])) for r in order], 50)
        assert {k: v[1:] for k, v in got.items()} == want


# -- HTML


def test_main_text_is_kept():
    body = "".join(f"<p>Sentence number {i} of the story goes on for a while, as stories do.</p>" for i in range(8))
    page = f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><ul>{'<li><a href=x>Link</a></li>' * 20}</ul>{body}<!-- c --><div></div><div></div><div></div><p>&copy; 2020</p></body></html>"
    text = html_extract.extract(page)
    assert text.count("\n") == 7 and text.startswith("Sentence number 0") and "Link" not in text and "2020" not in text and "var x" not in text


def test_entities_and_lines():
    assert html_extract.lines_of("<p>a&amp;b&nbsp;c<br>d<b>e</b>\nf") == ["", "a&b c", "de f"]


BODY = "".join(f"<p>Sentence number {i} of the story goes on for a while, as stories do.</p>" for i in range(8))


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title>{}</html>", "<html><head><title>T</title><body>{}</body></html>", "<body><form action=x>{}</form></body>", "<body><form>{}",
        "<body><nav><ul><li><a href=x>Link</a></li></ul>{}</body>", "<nav><a>Link</a><article>{}</article><nav><a>Link</a></nav>", "<aside>{}", "<select><option>One{}",
        "<svg><g>{}", "<noscript>{}", "<body>{}<footer>&copy; 2020 Some Company, all rights reserved.</footer></body>", "<footer><article>{}</article><footer>&copy; 2020.</footer>",
    ],
)
def test_text_after_an_open_element_or_in_a_form_is_kept(page):
    text = html_extract.extract(page.format(BODY))
    assert text.count("Sentence number") == 8 and "2020" not in text


def test_many_open_elements_take_linear_time():
    for tag in ("<svg>", "<head>", "<nav>", "<footer>", "<template>", "<!-- x -->"):
        assert html_extract.extract(tag * 100000) == ""


GOLDEN = [
    (f"<html><body><div><a>Home</a><a>News</a></div>{BODY}<div><a>Next</a></div></body></html>", 8),
    (f"<table><tr><td><ul>{'<li>Item</li>' * 12}</ul></td><td>{BODY}</td></tr></table>", 8),
    (f"{BODY[: BODY.index('<p>Sentence number 4')]}{'<div><a>Related</a></div>' * 6}{BODY[BODY.index('<p>Sentence number 4') :]}", 8),
    (f"<div>{'<span>word</span> ' * 40}</div><p>Short.</p>", 0), (f"<pre>{'x ' * 60}</pre>", 0),
    ("<ul>" + "<li>Menu entry</li>" * 50 + "</ul>", 0), ("Plain text without any markup that is long enough to be kept as the main text of a page.", 0),
]


@pytest.mark.parametrize("page, n", GOLDEN)
def test_golden_pages(page, n):
    text = html_extract.extract(page)
    assert text.count("Sentence number") == n and not any(w in text for w in ("Home", "News", "Next", "Item", "Menu", "Related"))
    assert text == plain.main_text(page)


def test_pages_equal_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    raw = pd.read_parquet(f"{d}/pages.parquet").set_index("page_id").html
    got = queries.op9_html_extraction(spark, d).toPandas().set_index("page_id").text
    assert {i: plain.main_text(p) for i, p in raw.items()} == got.to_dict()


def test_pages_of_the_table(spark, sf_dir):
    got = queries.op9_html_extraction(spark, sf_dir).toPandas()
    raw = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id").html
    assert len(got) == len(raw) and (got.n_chars > 0).mean() > 0.5
    assert not got.text.str.contains("<script|</p>|track\\(", regex=True).any()
    assert all(t == html_extract.extract(raw[i]) for i, t in zip(got.page_id, got.text))


# -- mixing


@pytest.mark.parametrize("weights", [None, {"web": 5, "books": 3, "code": 2}, {"web": 1}])
def test_mix_equals_the_simulated_schedule(spark, weights):
    rng = random.Random(10)
    rows = [(i, rng.choice(["web"] * 6 + ["books"] * 3 + ["code"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", common.positive(mixing.order()).alias("h")).collect()}
    use = [(s, order[i], i) for i, s in rows if weights is None or s in weights]
    want = brute.interleave(use, weights)
    for chunk in (1 << 20, 100):
        got = {r["doc_id"]: (r["slot"], r["in_mix"]) for r in mixing.mixed(docs, weights, chunk_rows=chunk).collect()}
        assert {i: got[i] for i in want} == want and all(got[i] == (None, False) for i in got if i not in want)


def test_lag_is_below_one_block():
    for shares in ([500, 300, 200], [997, 1, 1, 1], [334, 333, 333], [1], [7, 3]):
        slots, total = mixing.period(shares), sum(shares)
        assert sorted(t for s in slots for t in s) == list(range(total))
        for own, u in zip(slots, shares):
            done = np.cumsum(np.isin(np.arange(total), own))
            assert np.abs(done - np.arange(1, total + 1) * u / total).max() < 1


def test_tiny_sources_share_a_task():
    tasks = mixing.apportion({"a": 10**9, "b": 1, None: 1, "c": 10**8}, units=100)
    assert (["b", None], 1) in [(s, u) for s, u in tasks] and sum(u for _, u in tasks) == 100


@pytest.mark.parametrize(("n_hot", "n_few", "units"), [(20000, 1, 1000), (2000, 20, 100)])
def test_a_stray_source_does_not_end_the_mix(spark, n_hot, n_few, units):
    docs = spark.range(n_hot + n_few).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n_hot, F.lit("hot")).alias("source"))
    got = mixing.mixed(docs, units=units).toPandas()
    assert got.in_mix.all() and got.position.is_unique
