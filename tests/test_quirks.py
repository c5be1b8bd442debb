"""The quirks of the survey, by number: what is kept, and what is put right and how."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import arrays, text
from loomtext.operators import chunking, context, folds, match, metrics, search
from loomtext.sources import settings, store


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def ranked(spark, items):
    return spark.createDataFrame([("q", x, r, float(s)) for r, (x, s) in enumerate(items, 1)], "q string, d string, rank int, score double")


def test_q1_q2_alternation_depends_on_chunks_and_ties_go_by_key(spark):
    t = spark.createDataFrame([(1, "abcde")], "id int, t string")
    k = spark.createDataFrame([("abcd",), ("cde",)], "key string")
    found = lambda n: sorted(r.key for r in match.alternation(t, k, "id", "t", n).collect())
    assert found(2) == ["abcd"] and found(1) == ["abcd", "cde"]
    tie = spark.createDataFrame([("bcd",), ("abc",)], "key string")
    assert [r.key for r in match.alternation(t, tie, "id", "t", 2).collect()] == ["abc"]


def test_q3_majority_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 4), ("k", "b", 3), ("k", None, 0)], "key string, cat string, pos int")
    assert match.majority(rows, "key", "cat", "pos").first().cat == "b"


def test_q4_q6_first_lookup_wins_and_missing_passages_are_empty(spark):
    rows = spark.createDataFrame([("a", "b"), ("x", "b"), ("x", "y")], "h string, m string")
    lookup = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert [r.out for r in match.coalesced_lookup(rows, lookup, ["h", "m"], "v", "out").orderBy("h", "m").collect()] == [1, 2, None]
    assert one(spark, text.norm_text(F.lit(None).cast("string"))).c0 == ""


def test_q7_quota_moves_rows_and_the_audit_tells(spark):
    rows = folds.quota(spark.range(12).select("id", F.lit(1).alias("g")), "id", 3, 3, 5, "s")
    leaks = folds.leaking_groups(rows, "g", "fold").collect()
    assert len(leaks) == 1 and leaks[0].fold_count == 5 and leaks[0].sample_count == 12


def test_q8_balancing_moves_whole_groups_after_the_quota(spark):
    rows = spark.createDataFrame([(g, 0, True) for g in (1, 1, 2, 3)], "g int, fold int, hit boolean")
    got = folds.least_loaded(rows, "g", "fold", F.col("hit"), 2)
    assert folds.leaking_groups(got, "g", "fold").count() == 0 and {r.fold for r in got.collect()} == {1}  # counts are not decremented


def test_q9_equal_scores_of_a_window_are_one(spark):
    assert {r.score for r in search.minmax([ranked(spark, [("a", 3), ("b", 3)])], "q", "d", 2, [1.0]).collect()} == {1.0}


def test_q10_q18_settings_have_real_defaults_and_later_ones_win():
    config = {"a": {"x": 1, "y": 2}, "b": {"x": 3}, "n": 5}
    assert settings.flattened(config) == {"x": 3, "y": 2} and settings.flattened(config, ["b", "a", "c"]) == {"x": 1, "y": 2}
    assert settings.chosen({"x": 3, "y": 2}, {"x": "z"}) == {"z": 3} and settings.chosen({"x": 3}, ["x"]) == {"x": 3}
    with pytest.raises(KeyError):
        settings.chosen({}, ["x"])
    v = {"on": settings.Variable("ON", bool, False), "n": settings.Variable("N", int, 7), "url": settings.Variable("URL", required=True)}
    assert settings.from_environment(v, {"ON": "TRUE", "URL": "u"}) == {"on": True, "n": 7, "url": "u"}
    assert settings.from_environment(v, {"ON": "yes", "URL": "u", "N": "2"}) == {"on": False, "n": 2, "url": "u"}
    with pytest.raises(KeyError):
        settings.from_environment(v, {})


def test_q11_drafts_merge_by_a_function_of_their_own(spark):
    drafts = F.array(F.lit("Answer: 2"), F.lit(""), F.lit("Answer: 9"))
    got = one(spark, text.best_draft(drafts, 5), text.joined_drafts(drafts))
    assert got.c0 == "2" and got.c1 == "[DRAFT 1]\nAnswer: 2\n\n[DRAFT 3]\nAnswer: 9"


def test_q13_tombstones_by_parent_count_unless_compatible(spark):
    log = spark.createDataFrame([("c1", "p", 1, None, None), (None, "p", 2, None, True), ("c2", "p", 3, None, None)], "k string, p string, seq int, _deleted boolean, _deleted_by_parent boolean")
    live = lambda compat: sorted(r.k for r in store.replay(log, "k", "seq", parent="p", compat=compat).collect())
    assert live(False) == ["c2"] and live(True) == ["c1", "c2"]


def test_q14_simhash_of_a_blank_text_is_0(spark):
    got = one(spark, arrays.simhash(F.lit(" \n")), arrays.simhash(F.lit("조선 후기 유서")))
    assert got.c0 == 0 and got.c1 == 7626834996947716239


def test_q15_contents_count_once_by_their_text(spark):
    rows = spark.createDataFrame([("q", 1, 1, "same", 0.5), ("q", 2, 1, "same", 0.9), ("q", 2, 2, "other", 0.1)], "q string, g int, rank int, c string, score double")
    assert [r.c for r in context.global_top(rows, "q", "g", "c", 5).orderBy("position").collect()] == ["same", "other"]


def test_q16_values_of_the_service_win(spark):
    m = lambda **kv: F.create_map(*(F.lit(x) for p in kv.items() for x in p))
    got = one(spark, arrays.merged_maps(m(rank="1", a="x"), m(rank="2")), arrays.merged_maps(F.lit(None).cast("map<string,string>"), m(b="y")), arrays.merged_maps(m(a="x"), F.lit(None).cast("map<string,string>")))
    assert (got.c0, got.c1, got.c2) == ({"a": "x", "rank": "2"}, {"b": "y"}, {"a": "x"})


def test_q17_hosts_have_no_user_part(spark):
    got = one(spark, text.host(F.lit("http://user:pw@host.org:80/x")), text.in_domains(F.lit("http://a.go.kr@evil.com/"), ["go.kr"]))
    assert got.c0 == "host.org" and got.c1 is False


def test_q20_a_question_without_documents_has_an_empty_context(spark):
    rows = spark.createDataFrame([("k", 1, None, None), ("k", 2, "q", "c")], "k string, o int, q string, c string")
    assert context.packed(rows.where("o = 9").unionByName(rows), "k", "o", "q", "c", 40).first().context in ("", "#### q\n - c\n")
    assert context.packed(rows.where("o = 1"), "k", "o", "q", "c", 40).first().context == ""


def test_q21_q22_models_compare_by_one_function_and_by_row(spark):
    got = one(spark, metrics.correct(F.lit("3"), F.lit(3.0).cast("int")), metrics.correct(F.lit(None).cast("int"), F.lit(1)), metrics.correct(F.lit("x"), F.lit("x")))
    assert (got.c0, got.c1, got.c2) == (True, False, False)


def test_q23_zero_vectors_are_never_found(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r.query_id, r.vec_id) for r in search.knn(v, q, 3).collect()] == [(2, 2)]
    assert one(spark, arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).c0 is None


def test_q24_q26_subjects_may_be_null_and_requests_have_a_number_of_their_own(spark):
    got = one(spark, context.coerced_subject(F.lit(None).cast("string")), context.requests_of(F.lit('[{"query":"a","top_k":2},{"query":"b"}]')))
    assert got.c0 == "general" and [(r["query"], r["top_k"]) for r in got.c1] == [("a", 2), ("b", 5)]


def test_q25_decoders_disagree_on_failure(spark):
    low = F.array(*[F.lit(float("-inf"))] * 5)
    got = one(spark, arrays.argmax_label(low), text.stated_answer(F.lit("no answer"), 5))
    assert (got.c0, got.c1) == ("1", "0")


def test_q28_pieces_may_begin_with_a_separator(spark):
    long = ". ".join(f"sentence {i} of a rather long paragraph" for i in range(200))
    rows = spark.createDataFrame([(0, "t", long)], "index long, topic string, content string")
    parents, children = chunking.hierarchy(rows, "index", "topic", "content")
    assert any(r.content.startswith(". ") or r.content.startswith("sentence") for r in parents.collect()) and children.count() > parents.count()


def test_strict_zip_and_labels(spark):
    pair = arrays.zipped(F.array(F.lit(1), F.lit(2)), F.col("b"), "x", "y")
    assert [tuple(r) for r in spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("b")).select(pair.alias("p")).first().p] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="different lengths"):
        spark.range(1).select(F.array(F.lit("a")).alias("b")).select(pair.alias("p")).collect()
    got = one(spark, arrays.label_index(F.lit("t\n<think>\n\n</think>\n\n 4 ")), arrays.label_index(F.lit("6")), arrays.mean_of(F.array(F.lit(1.0), F.lit(None), F.lit(2.0))), arrays.mean_of(F.array().cast("array<double>")))
    assert (got.c0, got.c1, got.c2, got.c3) == (3, None, 1.5, None)
    assert text.suffix_replaced("a.csv/b.csv") == "a.score.csv/b.score.csv"


def test_merges_by_name(spark):
    rows = spark.createDataFrame([("q", 1, 1, "a", 0.5)], "q string, g int, rank int, c string, score double")
    assert context.merged("global_top", rows, "q", "g", "c", 1).count() == 1
    with pytest.raises(ValueError, match="no merge"):
        context.merged("other", rows, "q", "g", "c", 1)
