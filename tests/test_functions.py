import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import arrays, text
from loomtext.operators import chunking, context, features, folds


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_norm_text(spark):
    r = one(spark, a=text.norm_text(F.lit("한국 史-Aé  9　가?\nz")), b=text.norm_text(F.lit("한국 史-Aé  9　가?\nz"), True), c=text.norm_text(F.lit(None).cast("string")), d=text.norm_text(F.lit("!!!")))
    assert tuple(r) == ("한국A9가z", "한국 A 9 가 z", "", "")
    again = one(spark, a=text.norm_text(text.norm_text(F.lit(" a-b 한 "))))
    assert again.a == "ab한"


def test_question_split_and_anchors(spark):
    q, p = text.question_and_passage(F.lit(" 옳은 것은? 지문 본문 "))
    q2, p2 = text.question_and_passage(F.lit("질문만"))
    assert tuple(one(spark, q=q, p=p, q2=q2, p2=p2)) == ("옳은 것은?", "지문 본문", "질문만", "")
    for given, expected in (("abcdefghij", ("abcd", "defg", "ghij")), ("abcdefghi", ("abcd", "cdef", "fghi")), ("abc", ("abc", "abc", "abc"))):
        assert tuple(one(spark, **dict(zip("hmt", text.anchors(F.lit(given), 4), strict=True)))) == expected


@pytest.mark.parametrize(("said", "expected"), [("Answer: 2 ... 정답 : 4", "4"), ("정답: 7", "0"), ("no", "0"), ("ANSWER:03", "3"), (None, "0")])
def test_stated_answer(spark, said, expected):
    assert one(spark, a=text.stated_answer(F.lit(said).cast("string"), 5)).a == expected


def test_drafts(spark):
    drafts = F.array(F.lit("Answer: 2"), F.lit(""), F.lit("Answer: 9"))
    r = one(spark, best=text.best_draft(drafts, 5), all=text.joined_drafts(drafts))
    assert r.best == "2" and r.all == "[DRAFT 1]\nAnswer: 2\n\n[DRAFT 3]\nAnswer: 9"


def test_moved_one_hot_argmax(spark):
    r = one(spark, m=arrays.moved(F.array(*map(F.lit, "abcde")), F.lit(2), F.lit(5)), h=arrays.one_hot(F.lit("2"), F.lit(3)), z=arrays.one_hot(F.lit("x"), F.lit(3)), a=arrays.argmax_label(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    assert r.m == ["a", "c", "d", "e", "b"] and r.h == [0, 1, 0] and r.z == [0, 0, 0] and r.a == "2"
    # Q25: all -infinity decodes to the first choice, a stated answer that is missing to "0"
    assert one(spark, a=arrays.argmax_label(arrays.choice_logprobs(F.create_map(F.lit("9"), F.lit(0.0)), 3))).a == "1"


def test_softmax_subsequence_masks(spark):
    ids = F.array(*map(F.lit, [5, 1, 2, 3]))
    r = one(spark, p=arrays.softmax(F.array(F.lit(0.0), F.lit(math.log(3)))), e=arrays.subsequence_end(ids, F.array(F.lit(1), F.lit(2))), n=arrays.subsequence_end(ids, F.array(F.lit(9))), m=arrays.masked_labels(ids, F.lit(2), F.lit(6)))
    assert [round(x, 9) for x in r.p] == [0.25, 0.75] and r.e == 3 and r.n == 0 and r.m == [-100, -100, 2, 3, -100, -100]


def test_simhash_q14(spark):
    r = one(spark, a=arrays.simhash(F.lit("조선 후기 유서")), b=arrays.simhash(F.lit("조선 후기 서학")), z=arrays.simhash(F.lit("  ")))
    assert (r.a, r.b, r.z) == (7626834996947716239, 2325533228289448088, 0)
    assert one(spark, s=features.simhash_similarity(F.lit("조선 후기 유서"), F.lit("조선 후기 서학"))).s == 0.703125


def test_cosine_q23(spark):
    r = one(spark, a=arrays.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))), z=arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert abs(r.a - 1) < 1e-12 and r.z is None


def test_quality_and_domains_q17(spark):
    r = one(
        spark, short=text.quality_ok(F.lit("한국의 역사는 매우 오래되었습니다.")), good=text.quality_ok(F.lit("한국의 역사 " * 10)), none=text.quality_ok(F.lit(None).cast("string")),
        a=text.in_domains(F.lit("https://www.history.go.kr/page"), ["history.go.kr"]), b=text.in_domains(F.lit("https://db.history.go.kr:80/page"), ["history.go.kr"]),
        c=text.in_domains(F.lit("https://evil.com"), ["history.go.kr"]), e=text.in_domains(F.lit("https://history.go.kr:pw@evil.com/"), ["history.go.kr"]), n=text.in_domains(F.lit(None).cast("string"), []),
    )
    assert tuple(r) == (False, True, False, True, True, False, False, False)


def test_shorter_than(spark):
    r = one(spark, none=text.shorter_than([F.lit(None).cast("string")], 600), less=text.shorter_than([F.lit("x" * 599)], 600), same=text.shorter_than([F.lit("x" * 600)], 600))
    assert tuple(r) == (True, True, False)


def test_null_tokens_tags_and_misc(spark):
    tags = text.combination_tags(F.lit("ㄱ. 하나 ㄴ. 둘 셋"))
    r = one(spark, n=text.null_tokens(F.lit(" NULL ")), k=text.null_tokens(F.lit(" a ")), c=text.expanded_choice(F.lit("ㄱ, ㄴ"), tags), i=text.trailing_int(F.lit("3_1_12")), b=text.human_bytes(F.lit(1536)), p=text.render("{a}%s{b}", {"a": F.lit("x")}))
    assert tuple(r) == (None, "a", "하나, 둘 셋", 12, "1.5 KB", "x%s{b}")


def test_requests_and_subject(spark):
    r = one(spark, q=context.requests_of(F.lit('[{"query": "a"}, {"top_k": 3}]')), bad=context.requests_of(F.lit("?")), s=context.coerced_subject(F.lit("x")), w=context.web_score(F.lit(0.0), F.lit(0.4)))
    assert [tuple(x) for x in r.q] == [("a", 5), ("", 3)] and r.bad == [] and r.s == "general" and r.w == 0.4


def test_split_text():
    assert chunking.split_text("aaaa bbbb cccc", 10, 0, (" ", ""), "end") == ["aaaa bbbb", "cccc"]
    assert chunking.split_text("aaaa bbbb cccc", 10, 5, (" ", ""), "end") == ["aaaa bbbb", "bbbb cccc"]
    long = "x" * 30
    assert chunking.split_text(long, 10, 2, (" ", ""), "end") == ["x" * 10, "x" * 10, "x" * 10, "x" * 6]
    assert chunking.split_text(long, 10, 2, ("\n",), "start") == [long]  # no separator applies: longer than asked for
    assert chunking.split_text("a. b", 3, 0, (". ",), "start") == ["a", ". b"]  # Q28
    assert chunking.split_text("", 10, 2, (" ", ""), "end") == []


def test_quantile_bins(spark):
    edges = [1.0, 2.0, 3.0, 4.0]
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (4.0,), (None,)], "x double").select(folds.quantile_bin(F.col("x"), edges).alias("b")).collect()
    assert [r.b for r in rows] == [0, 0, 1, 2, None]


def test_trimmed_is_what_python_strips(spark):
    from loomtext.functions.text import WHITE, trimmed

    assert set(WHITE) == {chr(c) for c in range(0x11000) if chr(c).isspace()}
    texts = [None, "", "  a b ", *(f"{w}x{w}y{w}{w}" for w in WHITE), WHITE]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", trimmed(F.col("x")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: x and x.strip() for i, x in enumerate(texts)}


def plain_chunks(text, size, overlap, separators, keep):
    """The same chunks by places in the text: runs between separators, gathered by their ends."""

    def runs(a, b, sep):
        if not sep:
            cuts = list(range(a, b))
        else:
            cuts = [a] + [a + (m.end() if keep == "end" else m.start()) for m in re.finditer(re.escape(sep), text[a:b])]
        return [(x, y) for x, y in zip(cuts, [*cuts[1:], b]) if y > x]

    def gather(spans):
        first = 0
        for k, (a, b) in enumerate(spans):
            if k > first and b - spans[first][0] > size:
                yield spans[first][0], spans[k - 1][1]
                while first < k and (spans[k - 1][1] - spans[first][0] > overlap or b - spans[first][0] > size):
                    first += 1
        if spans:
            yield spans[first][0], spans[-1][1]

    def cut(a, b, seps):
        k = 0
        while k < len(seps) - 1 and seps[k] and seps[k] not in text[a:b]:
            k += 1
        held = []
        for x, y in runs(a, b, seps[k]):
            if y - x < size:
                held.append((x, y))
                continue
            yield from gather(held)
            held = []
            yield from cut(x, y, seps[k + 1 :]) if seps[k + 1 :] else [(x, y)]
        yield from gather(held)

    return [c for a, b in cut(0, len(text), separators) if (c := text[a:b].strip())]


def test_chunks_equal_a_plain_version_over_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(4)
    texts = [r.text or "" for r in rows] + ["".join(rng.choice(["\n\n", "\n", ". ", "? ", " ", "ab", "x" * rng.randint(1, 500)]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for level in (chunking.PARENT, chunking.CHILD, (40, 15, ("\n", " ", ""), "start")):
        for x in texts:
            assert chunking.split_text(x, *level) == plain_chunks(x, *level)


def test_simhash_of_whole_texts_is_that_of_the_expression(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \t", "a", "a b", "조선 후기\x0b유서\x0c\r\n\x1c b c　d", "x " * 70_000] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    monkeypatch.setattr(arrays, "HASHES", 5)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", arrays.simhash(F.col("t")).alias("a"), arrays.simhash_of_texts(F.col("t")).alias("b")).collect()
    assert len(got) == len(texts) and [r.b for r in got] == [r.a for r in got]
    distinct = " ".join(map(str, range(40_000)))  # more distinct words than are counted at once
    assert one(spark, a=arrays.simhash(F.lit(distinct)) - arrays.simhash_of_texts(F.lit(distinct))).a == 0


def test_hamming_pairs_are_ranged_from_stored_hashes(spark, monkeypatch):
    from loomtext.plans import catalogue_sources as plans

    seen, real = [], plans.readers.numbered_rows
    monkeypatch.setattr(plans.readers, "numbered_rows", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    plans.hamming_pairs(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "text" not in seen[0]


def test_hierarchy_in_one_pass_that_gives_rows_away_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", " \n "] + ["".join(rng.choice(["\n\n", "\n", ". ", "? ", " ", "ab", "x" * rng.randint(1, 500)]) for _ in range(rng.randint(0, 400))) for _ in range(20)]
    expected = [(f"{i}_{p}_{c}", f"{i}_{p}", "t", x) for i, t in enumerate(texts) for p, parent in enumerate(chunking.split_text(t or "", *chunking.PARENT)) for c, x in enumerate(chunking.split_text(parent, *chunking.CHILD))]
    monkeypatch.setattr(chunking, "PIECE", 1000)
    rows = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "a long, b string, c string")
    parents, children = chunking.hierarchy(rows, "a", "b", "c")
    assert sorted(tuple(r)[:4] for r in children.collect()) == sorted(expected)
    assert sorted(tuple(r) for r in parents.collect()) == sorted((f"{i}_{p}", "t", x) for i, t in enumerate(texts) for p, x in enumerate(chunking.split_text(t or "", *chunking.PARENT)))
    assert children._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_documents_are_normalised_once_for_anchors(spark):
    from loomtext.plans import catalogue

    plan = catalogue.provenance_coalesced(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # anchors are stored by then
