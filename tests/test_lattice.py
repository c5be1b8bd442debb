"""The analyser: particles by hand, all segmentations of random strings, whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import lattice

KOREAN = lattice.Dictionary.of(
    [("학교", "N", 2.0), ("학", "N", 4.0), ("교", "N", 4.0), ("에서", "J", 1.0), ("에", "J", 1.0), ("서", "V", 3.0), ("는", "J", 1.0), ("은", "J", 1.0), ("나", "NP", 2.0), ("나는", "V", 4.0), ("날", "V", 3.0), ("조선", "N", 2.0), ("조선왕조", "N", 3.0), ("왕조", "N", 2.0), ("의", "J", 1.0), ("역사", "N", 2.0), ("가", "J", 1.0), ("가", "V", 2.5), ("간다", "V", 2.0)],
    follows={("", "J"): 5.0, ("J", "J"): 0.5, ("N", "J"): -0.5, ("NP", "J"): -0.5, ("V", "J"): 2.0},
)


@pytest.mark.parametrize(("run", "expected"), [
    ("학교에서는", [("학교", "N"), ("에서", "J"), ("는", "J")]),
    ("나는", [("나", "NP"), ("는", "J")]),
    ("조선왕조의", [("조선왕조", "N"), ("의", "J")]),
    ("역사가", [("역사", "N"), ("가", "J")]),
    ("가", [("가", "V")]),
    ("갸갸는", [("갸갸", "UNK"), ("는", "J")]),
    ("간다", [("간다", "V")]),
])
def test_particles(run, expected):
    assert lattice.analysed(run, KOREAN, KOREAN.longest) == expected


def every_way(run, d, before=""):
    if not run:
        yield ()
        return
    for n in range(1, len(run) + 1):
        words = list(d.words.get(run[:n], ())) + ([(lattice.UNKNOWN, d.unknown[0] + d.unknown[1] * n)] if before != lattice.UNKNOWN else [])
        for tag, cost in words:
            for rest in every_way(run[n:], d, tag):
                yield ((run[:n], tag, cost + d.follows.get((before, tag), 0.0)), *rest)


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_of_all_segmentations(seed):
    rng = random.Random(seed)
    entries = [("".join(rng.choice("가나다") for _ in range(rng.randint(1, 3))), rng.choice("NJV"), rng.randint(1, 9) / 2) for _ in range(14)]
    d = lattice.Dictionary.of(entries, {(a, b): rng.randint(-2, 4) / 2 for a in ["", *"NJV", "UNK"] for b in "NJV"}, (2.0, 1.5))
    for _ in range(60):
        run = "".join(rng.choice("가나다라") for _ in range(rng.randint(1, 7)))
        def order(way):
            at, tags, begins = 0, [t for _, t, _ in way], []
            for form, *_ in way:
                begins.append(at)
                at += len(form)
            turns = [begins[-1], tags[-1]] + [x for k in range(len(way) - 2, -1, -1) for x in (tags[k], begins[k])]
            return (round(sum(c for *_, c in way), 9), len(way), turns)

        best = min(every_way(run, d), key=order)
        assert lattice.analysed(run, d, d.longest) == [(f, t) for f, t, _ in best], run


def test_a_long_run_takes_time_in_proportion():
    assert lattice.analysed("갸" * 100_000 + "는", KOREAN, KOREAN.longest) == [("갸" * 100_000, "UNK"), ("는", "J")]


def test_whole_texts(spark):
    long = "학교에서는 " * 5000
    df = spark.createDataFrame([(1, "나는 학교에서는 KBS2를 간다!", (1,)), (2, None, None), (3, "", None), (4, long, None), (1, "갸" * 100, None)], "id long, text string, `a.b` struct<`c-d`:int>")
    out = lattice.morphemes(df, "text", KOREAN, ["id", "a.b"])
    got = {(r.id, len(r.morphemes)): r for r in out.collect()}
    assert [tuple(m) for m in got[1, 8].morphemes] == [("나", "NP"), ("는", "J"), ("학교", "N"), ("에서", "J"), ("는", "J"), ("kbs2", "SL"), ("를", "UNK"), ("간다", "V")]
    assert (2, 0) in got and (3, 0) in got and (4, 15_000) in got and (1, 1) in got
    assert out.where("id = 4").select(F.size(lattice.terms(F.col("morphemes"), "J", "UNK")).alias("n")).first().n == 5000


def test_counts_are_those_of_the_morphemes(spark):
    d = lattice.Dictionary.of([("가", "J", 1.0), ("가나", "N", 2.5), ("나", "N", 1.5), ("나다", "V", 3.0)], {("N", "J"): -0.5})
    rows = [(1, "가나다 가나다 abc 가 abc 12"), (2, None), (3, ""), (3, "나다나 라라 나다나"), (4, "가나가나 " * 50)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    for other in (lattice.OTHER, ""):
        whole = lattice.morphemes(df, "text", d, ["id"], other=other).collect()
        for a, b in zip(whole, lattice.counted(df, "text", d, ["id"], other=other).collect(), strict=True):
            own = {}
            for m in a.morphemes:
                own[m.form, m.tag] = own.get((m.form, m.tag), 0) + 1
            assert (a.id, own) == (b.id, {(m.form, m.tag): m.n for m in b.counts}) and len(own) == len(b.counts)
