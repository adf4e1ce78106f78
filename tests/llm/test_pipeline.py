"""The pipeline against the plain versions of its stages, and on awkward documents."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from quillsift.llm import common, line_dedup, mixing, packing, quality_rules, simhash

from . import brute
from .awkward import documents, empty


def plain(spark, docs: pd.DataFrame) -> set:
    con = duckdb.connect()
    con.register("documents", docs)
    kept = con.execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE keep").df()
    docs = docs[docs.doc_id.isin(kept.doc_id)]
    left = pd.DataFrame(brute.line_stage(list(zip(docs.doc_id, docs.text))), columns=["doc_id", "text"])
    docs = docs.drop(columns="text").merge(left, on="doc_id")
    groups = brute.near_groups(list(zip(docs.doc_id, docs.text)))
    docs = docs[[groups[i] == i for i in docs.doc_id]]
    ids = spark.createDataFrame([(int(i),) for i in docs.doc_id], "doc_id bigint")
    order = {r["doc_id"]: r["h"] for r in ids.select("doc_id", common.positive(mixing.order()).alias("h")).collect()}
    mix = brute.interleave([(s, order[i], i) for i, s in zip(docs.doc_id, docs.source)])
    docs = docs[[mix[i][1] for i in docs.doc_id]]
    cut = [(int(i), k, n) for i, t in zip(docs.doc_id, docs.text) for k, n in brute.pieces_of(i, t, packing.CAPACITY)]
    rows = spark.createDataFrame(cut, "doc_id bigint, piece bigint, n bigint").select("doc_id", "piece", "n", common.positive(F.xxhash64("doc_id", "piece")).alias("h")).collect()
    at = brute.best_fit([(r["n"], r["h"], (r["doc_id"], r["piece"])) for r in rows], packing.CAPACITY)
    return {(i, k, n, *at[i, k]) for i, k, n in cut}


def test_run_equals_the_plain_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    rows = [(r["doc_id"], r["piece"], r["n_tokens"], r["window_id"], r["window_offset"]) for r in got]
    assert len(set(rows)) == len(rows)
    assert set(rows) == plain(spark, pd.read_parquet(f"{sf_dir}/documents.parquet"))


def test_near_copies_are_left_to_their_stage_and_go(spark):
    """No document that is kept after the third stage has a near copy by its whole text; nearly all planted copies go."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lined = line_dedup.stage(spark, docs, d).cache()
    kept = simhash.stage(spark, lined, d).toPandas()
    groups = brute.near_groups(list(zip(kept.doc_id, kept.text)))
    assert sum(groups[i] != i for i in groups) <= 0.01 * len(kept)
    whole = simhash.near_duplicates(docs).toPandas()
    copies = set(whole[whole.is_duplicate].doc_id)
    assert len(copies & set(kept.doc_id)) <= 0.1 * len(copies)


def test_line_stage_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    want = sorted(brute.line_stage([tuple(r) for r in docs.collect()]))
    for pass_bytes in (line_dedup.PASS_BYTES, 20000):
        assert sorted(tuple(r) for r in line_dedup.stage(spark, docs, d, pass_bytes).collect()) == want


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.STAGES[2][0] == "SimHash near-dedup"


def test_awkward_and_empty_documents(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    empty(spark).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []


def test_no_near_copy_within_the_radius_stays(spark):
    """The third stage keeps the smallest document of each group of all pairs of signatures, and no other."""
    d = "/root/testdata/sf0.01"
    lined = line_dedup.stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).cache()
    groups = brute.near_groups([tuple(r) for r in lined.select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in simhash.stage(spark, lined, d).collect()} == {i for i in groups if groups[i] == i}


def test_documents_beyond_the_mix_are_packed_behind_it(spark, tmp_path):
    """A small source that runs out ends the mix, but no document is left out; the mix is packed as if it were alone."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1 + i * 7 % 90)), "en", "hot" if i >= 40 else "few") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == {r[0] for r in rows}
    mix = brute.interleave([(r["source"], r["h"], r["doc_id"]) for r in spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").select("source", "doc_id", common.positive(mixing.order()).alias("h")).collect()])
    inside = {i for i in mix if mix[i][1]}
    assert set(got[got.in_mix].doc_id) == inside and 0 < len(inside) < len(rows)
    hashes = {r["doc_id"]: r["h"] for r in spark.range(3000).select(F.col("id").alias("doc_id"), common.positive(F.xxhash64("id", F.lit(0).cast("bigint"))).alias("h")).collect()}
    windows = 0
    for part in (got[got.in_mix], got[~got.in_mix]):
        want = brute.best_fit([(n, hashes[i], i) for i, n in zip(part.doc_id, part.n_tokens)], packing.CAPACITY)
        assert {i: (w - windows, o) for i, w, o in zip(part.doc_id, part.window_id, part.window_offset)} == want
        windows = part.window_id.max() + 1
