"""Unit tests of types, functions and operators on small inputs."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions import analysis, scalars, scoring
from quillsift.operators import compaction, filters, postings, search
from quillsift.types import SENTINEL, FieldSpec, FieldType, TableSchema

USERS = TableSchema.of({"user_id": "primary", "user_name": "whole", "user_age": "number", "user_desc": "words"})
DICTIONARY = "喜欢 美食 旅游 电影 游泳 文艺 养生 打仗 书法 秋香 天安门 太阳 火红 北京 张三 李四 也".split()


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        (0, "10001", "张三", 20, "喜欢美食,也喜欢旅游"), (1, "10002", "李四", 15, "喜欢电影,也喜欢美食"), (2, "10003", "王二麻", 30, "喜欢养生, 也喜欢文艺"),
        (3, "10004", "爱新觉罗", 69, "喜欢美食, 更喜欢打仗"), (4, "10005", "李世民", 50, "喜欢秋香和美食"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, user_id string, user_name string, user_age bigint, user_desc string")


def keys(df):
    return [r["user_id"] for r in df.collect()]


def find(users, **request):
    return search.search(users, USERS, request, segmenter=analysis.dictionary_segmenter(DICTIONARY))


def test_dictionary_words_with_filters(users):
    between = [{"field": "user_age", "type": "between", "begin": 18, "end": 22}]
    assert keys(find(users, fieldName="user_desc", value="美食", filters=between)) == ["10001"]
    prefix = [{"field": "user_name", "type": "prefix", "str": "李"}]
    assert sorted(keys(find(users, fieldName="user_desc", value="美食", filters=prefix))) == ["10002", "10005"]
    assert keys(find(users, fieldName="user_desc", value="喜")) == []


def test_cross_field_finds_names_and_descriptions(spark):
    rows = [(0, "张三", "喜欢游泳,也喜欢美食"), (1, "李四", "李四喜欢美食,也喜欢文艺"), (2, "王二", "喜欢张三")]
    docs = spark.createDataFrame(rows, "doc_id bigint, user_name string, user_desc string")
    schema = TableSchema.of({"user_name": "whole", "user_desc": "words"})
    got = search.search(docs, schema, {"value": "张三"}, segmenter=analysis.dictionary_segmenter(DICTIONARY))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_overlapping_cuts(spark):
    seg = analysis.dictionary_segmenter(["北京", "天安", "天安门", "安门"], overlapping=True)
    assert spark.createDataFrame([("我爱北京天安门 ok",)], "t string").select(seg(F.col("t"))).first()[0] == ["我爱", "北京", "天安", "安门", "天安门", "ok"]


@pytest.mark.parametrize(
    ("tokenizer", "text", "want"),
    [
        (analysis.runes, "我爱a,a", ["我", "爱", "a", ","]), (analysis.semicolon_list, "a;;b;a", ["a", "", "b"]), (analysis.whole, "a b", ["a b"]),
        (analysis.words, "Hello, world! x_y\n(1)", ["Hello", "world", "x", "_", "y", "\n", "1"]), (analysis.words, "-—。\\^&", []),
        (analysis.words, "", []), (analysis.words, None, []), (analysis.whole, "", []), (analysis.semicolon_list, "", []), (analysis.runes, "", []),
    ],
)
def test_tokenizers(spark, tokenizer, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tokenizer(F.col("t"))).first()[0] == want


def test_counts_equal_lists(spark):
    texts = ["a b a-a aa 1a a", "the\nthe _ the_the éa a", "", None, "***", ". .", "日本a日本 日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kw in ("a", "the", "_", "\n", "*", "日本", "1a", ".", "a b", "日本a日本"):
        got = df.select(analysis.term_count(F.col("t"), kw).alias("c"), analysis.word_count(F.col("t")).alias("n"), analysis.words(F.col("t")).alias("ws")).collect()
        for r in got:
            assert (r["c"], r["n"]) == (r["ws"].count(kw), len(r["ws"])), kw


def test_weight_is_single_precision(spark):
    pairs = [(c, t) for t in range(1, 120) for c in range(1, t + 1)]
    got = spark.createDataFrame(pairs, "c int, t int").select(scoring.weight(F.col("c"), F.col("t")).alias("w")).toPandas()["w"].to_numpy()
    c, t = (np.array(x, np.float32) for x in zip(*pairs))
    assert (got == (c / t * np.float32(10000)).astype(np.int64)).all()
    assert got[pairs.index((39, 50))] == 7799


def test_scores_are_cut_and_zero_where_all_match(spark):
    got = spark.createDataFrame([(1250, 1000, 453), (10000, 7, 7)], "w int, n bigint, d bigint").select(scoring.score(F.col("w"), F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in got] == [42, 0]


def test_times_and_numbers(spark):
    texts = ["2019-05-11", "2019-05-11 08:30:00", "", "x", "2019-5-1", "2019-02-30", "2019-05-11T08:30:00", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.to_epoch(F.col("t"))).collect()
    assert [r[0] for r in got] == [1557532800, 1557563400, None, None, None, None, None, None]
    got = spark.createDataFrame([(2.9,), (-2.9,), (1e30,)], "x double").select(scalars.truncate(F.col("x"))).collect()
    assert [r[0] for r in got] == [2, -2, None]
    assert spark.range(1).select(scalars.from_epoch(F.lit(1570665661))).first()[0] == "2019-10-10 00:01:01"


def test_filters_refuse_what_they_cannot_do():
    bad = [
        {"field": "nope", "type": "=", "str": "x"}, {"field": "user_name", "type": ">", "int": 1}, {"field": "user_age", "type": "prefix", "str": "1"},
        {"field": "user_age", "type": "in"}, {"field": "user_name", "type": "not in"},
    ]
    for f in bad:
        with pytest.raises(ValueError):
            filters.validate(USERS, [f])
    filters.validate(USERS, [{"field": "user_age", "type": "in", "iranges": []}, {"field": "user_name", "type": "like"}, {"field": "user_id", "type": "=", "str": "1"}])


def test_absent_field_matches_nothing(spark):
    df = spark.createDataFrame([(1, 5)], "doc_id bigint, x bigint")
    schema = TableSchema.of({"x": "number", "y": "number"})
    assert df.where(filters.conjunction(schema, [{"field": "y", "type": "not in", "iranges": []}], {"x": F.col("x")})).count() == 0
    assert df.where(filters.conjunction(schema, [{"field": "x", "type": "between", "begin": 5, "end": 5}], {"x": F.col("x")})).count() == 1


@pytest.mark.parametrize(
    ("request_", "want"),
    [((0, 10, 15), (0, 10)), ((10, 10, 15), (0, 15)), ((5, 10, 15), (5, 10)), ((-1, 5, 300), (0, 100)), ((0, 0, 7), (0, 7)), ((1 << 31, 1, 300), (0, 100)), ((0, 200, 300), (0, 200))],
)
def test_pages(request_, want):
    assert search.page_of(*request_) == want


def test_ties_go_to_the_smaller_id_and_all_match_scores_zero(spark):
    docs = spark.createDataFrame([(i, "a b") for i in (3, 1, 2)], "doc_id bigint, t string")
    got = search.search(docs, TableSchema.of({"t": "words"}), {"fieldName": "t", "value": "a"}).collect()
    assert [(r["doc_id"], r["weight"], r["score"], r["total"]) for r in got] == [(1, 5000, 0, 3), (2, 5000, 0, 3), (3, 5000, 0, 3)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, t string")
    assert search.search(docs, TableSchema.of({"t": "words"}), {"fieldName": "t", "value": "a"}).count() == 0
    assert postings.build(docs, TableSchema.of({"t": "words"})).count() == 0


def test_unknown_field_is_an_error(users):
    with pytest.raises(ValueError):
        search.search(users, USERS, {"fieldName": "nope", "value": "x"})


def test_list_postings_by_content(spark):
    lists = ["c;f", "a;c", "f;a", "b;d", "d;c", "b;c", "c;e", "a;e", "c;a"]
    docs = spark.createDataFrame(list(enumerate(lists)), "doc_id bigint, t string")
    schema = TableSchema.of({"t": "list"})
    parts = [postings.build(docs.where(f"doc_id between {a} and {a + 2}"), schema, cross_field=False) for a in (0, 3, 6)]
    walked = {r["term"]: [p["doc_id"] for p in r["postings"]] for r in postings.walk(postings.merge(parts)).collect()}
    assert walked == {"a": [1, 2, 7, 8], "b": [3, 5], "c": [0, 1, 4, 5, 6, 8], "d": [3, 4], "e": [6, 7], "f": [0, 2]}


def test_first_and_next_term(spark):
    docs = spark.createDataFrame([(0, "b a é Z")], "doc_id bigint, t string")
    p = postings.build(docs, TableSchema.of({"t": "words"}))
    assert postings.first_term(p, "t").first()[0] == "Z"
    assert [postings.next_term(p, "t", t).first()[0] for t in ("Z", "a", "b", "é")] == ["a", "b", "é", None]


def test_stored_postings_prune_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(0, "b a a"), (1, "a")], "doc_id bigint, t string")
    postings.write(postings.build(docs, TableSchema.of({"t": "words"})), str(tmp_path / "p"))
    found = postings.lookup(spark.read.parquet(str(tmp_path / "p")), "t", "a")
    assert sorted(map(tuple, found.collect())) == [(0, 6666), (1, 10000)]
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_compaction_groups():
    assert compaction.plan([10, 10], 5) == []
    assert compaction.plan([10, 2, 2, 2, 1], 4) == [[1, 2], [3, 4]]
    assert compaction.plan([2, 2, 2, 1, 1, 2], 4) == [[0, 1], [2, 3, 4]]
    assert compaction.plan([], 4) == [] and compaction.plan([1], 4) == []


def test_recent_segments_and_ranges():
    assert compaction.recent([]) == compaction.recent([5]) == compaction.recent([100, 1]) == []
    assert compaction.recent([1, 1, 1]) == [0, 1, 2] and compaction.recent([81, 16, 1, 1, 1, 1]) == [1, 2, 3, 4, 5]
    assert compaction.intervals([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]
    assert compaction.without(0, 10, [(2, 3), (5, 20)]) == [(0, 2), (3, 5)] and compaction.without(0, 2, [(0, 2)]) == [] and compaction.without(0, 2, []) == [(0, 2)]


def test_postings_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(0, "b a a。a", "x;y;x", "ab", "a b"), (1, None, "", None, "q"), (2, "", None, "é", None)], "doc_id bigint, t string, l string, r string, w string")
    schema = TableSchema.of({"t": "words", "l": "list", "r": "rune", "w": "whole"})
    built = postings.build(docs, schema)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["doc_id"], r["field"], r["term"], r["weight"]) for r in built.collect())
    want = [(0, "t", "a", 7500), (0, "t", "b", 2500), (0, "l", "x", 0), (0, "l", "y", 0), (0, "r", "a", 0), (0, "r", "b", 0), (0, "w", "a b", 0), (1, "w", "q", 0), (2, "r", "é", 0)]
    # The terms of all fields together: b a a a, x y x, ab, a b.
    want += [(0, "#all", t, int(np.float32(n) / np.float32(10) * np.float32(10000))) for t, n in (("a", 4), ("b", 2), ("x", 2), ("y", 1), ("ab", 1))] + [(1, "#all", "q", 10000), (2, "#all", "é", 10000)]
    assert got == sorted(want)
    by_segmenter = postings.build(docs, schema, analysis.words)
    assert sorted((r["doc_id"], r["field"], r["term"], r["weight"]) for r in by_segmenter.collect()) == got


def test_walked_postings_come_in_parts(spark):
    p = postings.build(spark.createDataFrame([(i, "a") for i in range(10)], "doc_id bigint, t string"), TableSchema.of({"t": "words"}), cross_field=False)
    assert sorted((r["part"], [x["doc_id"] for x in r["postings"]]) for r in postings.walk(p, 4).collect()) == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]


def test_probable_cuts(spark):
    import math
    from itertools import product

    seg = analysis.probability_segmenter({"北京": 50, "天安门": 30, "天安": 1, "门": 5, "我": 100, "爱": 80, "大学": 40, "北京大学": 20, "大学生": 10, "生": 5})
    got = spark.createDataFrame([("我爱北京天安门 ok",), ("北京大学生活",), (None,)], "t string").select(seg(F.col("t"))).collect()
    assert [r[0] for r in got] == [["我", "爱", "北京", "天安门", "ok"], ["北京", "大学生", "活"], []]
    weights = {"a": -3.0, "ab": -4.0, "abc": -7.0, "bc": -2.5, "c": -3.0, "ca": -3.5}

    def best(run):  # over all cuts
        out = []
        for bits in product((0, 1), repeat=len(run) - 1):
            words, w = [], run[0]
            for c, b in zip(run[1:], bits):
                if b:
                    words.append(w)
                    w = c
                else:
                    w += c
            words.append(w)
            if all(x in weights or len(x) == 1 for x in words):
                out.append((sum(weights.get(x, -9.0) for x in words), words))
        return max(out)[0]

    for run in ("abcabc", "aabca", "cab", "abcab"):
        cut = analysis.probable_cut(run, weights, 3, -9.0)
        assert "".join(cut) == run and math.isclose(sum(weights.get(x, -9.0 * len(x)) for x in cut), best(run))
    states = analysis.StateModel({"B": -0.5, "S": -1.0}, {"B": {"E": -0.2, "M": -2.0}, "M": {"E": -0.5, "M": -1.0}, "E": {"B": -0.7, "S": -0.7}, "S": {"B": -0.7, "S": -0.7}}, {"B": {"小": -1.0}, "E": {"明": -1.0}, "S": {"去": -1.0}})
    assert states.cut("小明去") == ["小明", "去"] and states.cut("") == []
    assert analysis.probable_cut("我爱小明去", {"我": -1.0, "爱": -1.0}, 1, -9.0, states) == ["我", "爱", "小明", "去"]


def test_bits(spark):
    at = F.col("i")
    got = spark.createDataFrame([(5, 0), (5, 1), (-1, 63), (0, 63), (7, 64), (None, 1)], "x bigint, i int").select(scalars.bit_test(F.col("x"), at), scalars.bit_set(F.col("x"), at), scalars.bit_clear(F.col("x"), at)).collect()
    assert [tuple(r) for r in got] == [(True, 5, 4), (False, 7, 5), (True, -1, SENTINEL), (False, -SENTINEL - 1, 0), (None, None, None), (None, None, None)]


def test_ordered_maps(spark):
    from quillsift.operators import ordered

    rows = spark.createDataFrame([("t", "b", 1), ("t", "a", 2), ("u", "0", 9)], "tree string, key string, value bigint")
    up = spark.createDataFrame([("t", "b", 5, 1), ("t", "b", 6, 2), ("t", "c", 7, 1)], "tree string, key string, value bigint, seq bigint")
    new = ordered.put(rows, up)
    assert sorted(map(tuple, new.collect())) == [("t", "a", 2), ("t", "b", 6), ("t", "c", 7), ("u", "0", 9)]
    assert tuple(ordered.first(new, "t").first()) == ("a", 2) and tuple(ordered.after(new, "t", "a").first()) == ("b", 6) and ordered.after(new, "t", "c").first() is None
    assert ordered.get(new, "t", "z").first() is None and sorted(map(tuple, ordered.increment(new, rows).where("key = 'b'").collect())) == [("t", "b", 7)]


def test_schemas():
    with pytest.raises(ValueError):
        TableSchema.of({"a": "primary", "b": "primary"})
    with pytest.raises(ValueError):
        TableSchema.of([("a", "float")])
    with pytest.raises(ValueError):
        USERS.drop("user_id")
    with pytest.raises(ValueError):
        USERS.add(FieldSpec("user_age", FieldType.NUMBER))
    with pytest.raises(ValueError):
        FieldSpec("doc_id", "number")
    assert USERS.drop("user_age").add(FieldSpec("user_age", FieldType.TIME)).get("user_age").type is FieldType.TIME
    assert SENTINEL == 9223372036854775807


@pytest.mark.parametrize("fields", [{"t": "words", "a": "whole", "b": "list"}, {"t": "words", "u": "words", "a": "whole"}, {"t": "words"}, {"a": "whole"}])
def test_packed_postings_hold_the_cross_field_in_the_row(spark, fields):
    """Few and many words outside of the field of words, shared with it or not, and none; against counts by Python."""
    docs = [
        {"t": "x y x", "u": "x z", "a": "x", "b": "y;q;y"}, {"t": "", "u": "", "a": "w x w", "b": ""}, {"t": None, "u": None, "a": None, "b": None},
        {"t": "x k3 k3 y", "u": "y", "a": " ".join(f"k{i % 40}" for i in range(60)), "b": ";".join(f"k{i}" for i in range(9))}, {"t": "é-é", "u": "x", "a": "é", "b": "é"},
    ]
    rows = spark.createDataFrame([(i, *[d[f] for f in fields]) for i, d in enumerate(docs)], "doc_id bigint, " + ", ".join(f"{f} string" for f in fields))
    words = lambda s: re.findall(r"\w+", s or "")
    want = []
    for i, d in enumerate(docs):
        of = {f: {"words": words(d[f]), "whole": [d[f]] if d[f] else [], "list": list(dict.fromkeys(d[f].split(";"))) if d[f] else []}[k] for f, k in fields.items()}
        for f, terms in (of | {postings.CROSS_FIELD: [w for f in fields for w in words(d[f])]}).items():
            weighed = f == postings.CROSS_FIELD or fields[f] == "words"
            want += [(f, t, i, int(np.float32(np.float32(n) / np.float32(len(terms))) * np.float32(10000)) if weighed else 0) for t, n in Counter(terms).items()]
    p = postings.packed(rows, TableSchema.of(fields))
    got = [(r["field"], r["term"], r["doc_id"], r["weight"]) for r in postings.unpacked(p).collect()]
    assert sorted(got) == sorted(want)
    for term in ("x", "y", "é", "k3"):
        found = sorted(tuple(r) for r in postings.lookup(p, postings.CROSS_FIELD, term).collect())
        assert found == sorted((i, w) for f, t, i, w in want if f == postings.CROSS_FIELD and t == term)
    if list(fields) == ["t", "a", "b"]:
        assert p.where("field = '#all' and term in ('x', 'y') and doc_id in (0, 4)").isEmpty()


def test_a_walk_moves_postings_before_it_gathers_them(spark):
    p = postings.packed(spark.createDataFrame([(1, "a b")], "doc_id bigint, t string"), TableSchema.of({"t": "words"}))
    plan = postings.walk(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Aggregate" in plan.split("Exchange ")[0] and "Aggregate" not in plan.split("Exchange ")[1]


def test_each_task_that_stores_postings_has_a_part_of_one_bucket(spark, tmp_path):
    """So no task gets several buckets by chance: as many files as tasks, however many partitions the session has."""
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    try:
        rows = spark.range(20000).selectExpr("cast(id % 64 as int) as bucket", "'t' as field", "'x' as term", "id as doc_id", "0 as weight")
        postings.write(rows, str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(r["count"] for r in stored.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count().collect())[0] > 100
    assert len(list((tmp_path / "p").glob("bucket=*/*.parquet"))) == stored.select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct().count() == 128
