"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells of source, language and topic. A cell's weight is its number of tokens; raking scales the cells
until the shares of sources, of languages and of topics are those asked for, in turn and again, until no share is off by
more than a tolerance. A document's chance is its cell's factor on the scale that makes the expected sample so many tokens, at
most 1; what a capped cell can't give, the others give in proportion. Values that aren't named share one margin, so there are
at most (sources + 1) * (languages + 1) * topics cells, whatever the corpus: all cells are one array, the sweeps are one
expression over it, and the table of chances is broadcast.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.shared import column, others, stored

#: What values that aren't named count as.
OTHER = "(other)"
#: Marks of a topic in a lower-cased text, first match wins; texts without any have the last topic. Patterns that begin with a
#: letter of their own are found much faster than alternatives in one pattern.
TOPICS = {
    "legal": ("license", "licence", "copyright", "all rights reserved"),
    "contact": ("@[a-z0-9]", "[0-9]{3}-[0-9]{4}"),
    "markup": ("[|#$%&*][|#$%&* ]",),
}
PLAIN = "plain"


@dataclass(frozen=True)
class Targets:
    """Shares of the margins (scaled to sum to one over the values that occur; 0 leaves a value out), the part of all tokens to sample, the most sweeps, and by how much a share may be off."""

    source: Mapping[str, float]
    lang: Mapping[str, float]
    topic: Mapping[str, float]
    other: float = 0.05
    part: float = 0.5
    sweeps: int = 400
    tolerance: float = 1e-12
    seed: str = "mix"
    topics: Mapping[str, Sequence[str]] = field(default_factory=lambda: TOPICS)


def margin(column: str, shares: Mapping[str, float]) -> F.Column:
    """The value, or OTHER where it is null or not named."""
    return F.when(F.col(column).isin(list(shares)), F.col(column)).otherwise(OTHER)


def share_of(column: str, shares: Mapping[str, float], other: float) -> F.Column:
    return reduce(lambda c, x: c.when(F.col(column) == x[0], F.lit(float(x[1]))), shares.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(float(other)))


def topic_of(lower, topics: Mapping[str, Sequence[str]]) -> F.Column:
    of = lambda marks: reduce(F.Column.__or__, (lower.rlike(m) for m in marks))
    return reduce(lambda c, x: c.when(of(x[1]), x[0]), topics.items(), F.when(lower.isNull(), PLAIN)).otherwise(PLAIN)


def tokens_of(text) -> F.Column:
    """Words, and one for the document itself, so that an empty one has a weight too."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")) + 1).cast("double")


def celled(docs: DataFrame, t: Targets) -> DataFrame:
    """The rows with c_source, c_lang, c_topic and tokens."""
    docs = docs.withColumn("__lower", F.lower("text"))
    return docs.withColumns({"c_source": margin("source", t.source), "c_lang": margin("lang", t.lang), "c_topic": topic_of(F.col("__lower"), t.topics), "tokens": tokens_of(F.col("text"))}).drop("__lower")


def by_value(cells: F.Column, place: str, n: int) -> F.Column:
    """The cells of each of the n values of a margin."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.filter(cells, lambda c: c[place] == i))


def total(cells: F.Column, weight) -> F.Column:
    return F.aggregate(cells, F.lit(0.0), lambda sofar, c: sofar + weight(c))


def fitted(t: Targets) -> F.Column:
    """From column `cells` (array of s, l, t, w: places of the values and tokens): factors a, b, c of the values of each margin, and `off`, the largest error of a share after the last sweep."""
    sizes = {"s": len(t.source) + 1, "l": len(t.lang) + 1, "t": len({*t.topics, PLAIN})}
    lists = {k: F.col(f"by_{k}") for k in sizes}
    goal = {k: F.col(f"goal_{k}") for k in sizes}
    ones = {k: F.array_repeat(F.lit(1.0), n) for k, n in sizes.items()}

    def swept(place: str, weight) -> F.Column:
        have = F.transform(lists[place], lambda cells: total(cells, weight))
        return F.zip_with(goal[place], have, lambda g, h: F.when(h > 0, g / h).otherwise(0.0))

    def step(state: F.Column, _) -> F.Column:
        def again(one) -> F.Column:
            a = swept("s", lambda c: c["w"] * F.get(one["b"], c["l"]) * F.get(one["c"], c["t"]))
            return F.transform(F.array(F.struct(a.alias("a"), one["b"].alias("b"), one["c"].alias("c"))), second)[0]

        def second(one) -> F.Column:
            b = swept("l", lambda c: c["w"] * F.get(one["a"], c["s"]) * F.get(one["c"], c["t"]))
            return F.transform(F.array(F.struct(one["a"].alias("a"), b.alias("b"), one["c"].alias("c"))), third)[0]

        def third(one) -> F.Column:
            c = swept("t", lambda c: c["w"] * F.get(one["a"], c["s"]) * F.get(one["b"], c["l"]))
            return F.transform(F.array(F.struct(one["a"].alias("a"), one["b"].alias("b"), c.alias("c"))), errors)[0]

        def errors(one) -> F.Column:
            whole = lambda c: c["w"] * F.get(one["a"], c["s"]) * F.get(one["b"], c["l"]) * F.get(one["c"], c["t"])
            off = [F.array_max(F.zip_with(F.transform(lists[k], lambda cells: total(cells, whole)), goal[k], lambda h, g: F.abs(h - g))) for k in sizes]
            return F.struct(one["a"].alias("a"), one["b"].alias("b"), one["c"].alias("c"), F.greatest(*off).alias("off"))

        return F.when(state["off"] <= t.tolerance, state).otherwise(again(state))

    start = F.struct(ones["s"].alias("a"), ones["l"].alias("b"), ones["t"].alias("c"), F.lit(1e9).alias("off"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(t.sweeps)), start, step)


def raked(cells: DataFrame, t: Targets) -> DataFrame:
    """Cells (c_source, c_lang, c_topic, tokens) with `weight` after the sweeps (shares of all), `off` and `chance`. One row, then one partition: bounded by the targets."""
    names = {"s": [*t.source, OTHER], "l": [*t.lang, OTHER], "t": list(dict.fromkeys([*t.topics, PLAIN]))}
    shares = {"s": [*t.source.values(), t.other], "l": [*t.lang.values(), t.other], "t": [t.topic.get(k, t.other) for k in names["t"]]}
    columns = {"s": "c_source", "l": "c_lang", "t": "c_topic"}
    place = lambda k: (F.array_position(F.array(*map(F.lit, names[k])), F.col(columns[k])) - 1).cast("int").alias(k)
    one = cells.select(*(place(k) for k in names), F.col("tokens").alias("w")).agg(F.array_sort(F.collect_list(F.struct("s", "l", "t", "w"))).alias("cells"))
    for k, values in names.items():
        one = one.withColumn(f"by_{k}", by_value(F.col("cells"), k, len(values)))
        # shares of values that occur, scaled to sum to one
        given = F.zip_with(F.array(*(F.lit(float(x)) for x in shares[k])), F.col(f"by_{k}"), lambda g, here: F.when(F.size(here) > 0, g).otherwise(0.0))
        one = one.withColumn("given", given).withColumn("sum", F.aggregate("given", F.lit(0.0), lambda x, g: x + g))
        one = one.withColumn(f"goal_{k}", F.transform("given", lambda g: F.when(F.col("sum") > 0, g / F.col("sum")).otherwise(0.0))).drop("given", "sum")
    # shares, not tokens, so that no factor grows with the corpus
    one = one.withColumn("total", total(F.col("cells"), lambda c: c["w"])).withColumn("fit", fitted(t))
    rows = one.select("total", "fit", F.explode("cells").alias("cell"))
    weight = F.col("cell.w") * F.get("fit.a", "cell.s") * F.get("fit.b", "cell.l") * F.get("fit.c", "cell.t")
    back = [F.get(F.array(*map(F.lit, names[k])), F.col(f"cell.{k}")).alias(columns[k]) for k in names]
    rows = rows.select(*back, F.col("cell.w").alias("tokens"), weight.alias("weight"), (F.col("total") * t.part).alias("goal"), F.col("fit.off").alias("off"))
    # the scale at which the capped chances give the tokens asked for
    rows = rows.withColumn("factor", F.col("weight") / F.col("tokens"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("factor"), "c_source", "c_lang", "c_topic")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # if all cells before this one are capped, the rest is scaled by this; the first row where its own cell isn't capped tells
    rows = rows.withColumn("scale", F.when(after > 0, (F.col("goal") - before) / after))
    fits = F.when((F.col("scale") >= 0) & (F.col("scale") * F.col("factor") <= 1), F.struct((-F.col("factor")).alias("f"), "scale"))
    rows = rows.withColumn("scale", F.coalesce(F.min(fits).over(Window.partitionBy(F.lit(1)))["scale"], F.lit(1e300)))
    return rows.withColumn("chance", F.least(F.lit(1.0), F.col("scale") * F.col("factor"))).select("c_source", "c_lang", "c_topic", "tokens", "weight", "off", "chance")


def draw(doc_id: F.Column, seed: str) -> F.Column:
    """A number from 0 to 1 that depends on the id alone: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)


def sampled(docs: DataFrame, t: Targets, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The rows of docs (those `columns`; None: all) with c_source, c_lang, c_topic, tokens, chance and `taken` (draw < chance).

    Null or unnamed sources and languages are one value, OTHER; a null text is an empty one (one token, topic PLAIN). Rows
    that repeat an id share its draw, and count as often as they stand. A value with share 0 is left out. An empty table gives
    an empty one. Columns of docs that have the name of an added one (in any case) are replaced; `prefix` goes before the added names.
    Texts are read once: what is kept is stored with its cell. Margins that no weights can meet (they contradict each other
    or what occurs) are met as nearly as the last sweep has them, with a warning.
    """
    keys = ["c_source", "c_lang", "c_topic"]
    kept = others(docs.columns if columns is None else columns, *(prefix + k for k in (*keys, "tokens", "chance", "taken")))
    own = [column(c).alias(f"k{i}") for i, c in enumerate(kept)]
    cells = celled(docs.select("doc_id", "text", "source", "lang", *own), t)
    rows = stored(cells.select(*(f"k{i}" for i in range(len(kept))), draw(F.col("doc_id"), t.seed).alias("draw"), *keys, "tokens"))
    chances = stored(raked(rows.groupBy(keys).agg(F.sum("tokens").alias("tokens")), t))
    off = chances.agg(F.max("off")).first()[0]
    if off is not None and off > max(t.tolerance, 1e-6):
        warnings.warn(f"the margins asked for contradict each other or the corpus: a share is off by {off:.3g}", stacklevel=2)
    rows = rows.join(F.broadcast(chances.select(*keys, "chance")), keys)
    added = [*(F.col(k).alias(prefix + k) for k in (*keys, "tokens", "chance")), (F.col("draw") < F.col("chance")).alias(prefix + "taken")]
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), *added)


def oracle(t: Targets, table: str = "documents", sweeps: int = 40) -> str:
    """The same in DuckDB SQL, with a fixed number of sweeps that is enough for the targets of the query."""
    listed = lambda shares: ", ".join(f"'{v}'" for v in shares)
    case = lambda c, shares: "CASE " + " ".join(f"WHEN {c} = '{v}' THEN {float(s)!r}" for v, s in shares.items()) + f" ELSE {float(t.other)!r} END"
    topic = "CASE " + " ".join(f"WHEN {' OR '.join(f"regexp_matches(lower(text), '{p}')" for p in marks)} THEN '{k}'" for k, marks in t.topics.items()) + f" ELSE '{PLAIN}' END"
    steps = [
        f"""d AS (SELECT *, CASE WHEN source IN ({listed(t.source)}) THEN source ELSE '{OTHER}' END AS c_source, CASE WHEN lang IN ({listed(t.lang)}) THEN lang ELSE '{OTHER}' END AS c_lang,
            {topic} AS c_topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) + 1 AS DOUBLE) AS tokens FROM {table})""",
        "c0 AS (SELECT c_source, c_lang, c_topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
    ]
    for c, shares in (("c_source", t.source), ("c_lang", t.lang), ("c_topic", t.topic)):
        steps.append(f"m_{c} AS (SELECT {c}, s / sum(s) OVER () AS t FROM (SELECT DISTINCT {c}, {case(c, shares)} AS s FROM c0))")
    steps.append("w0 AS MATERIALIZED (SELECT c0.*, a.t AS t_c_source, b.t AS t_c_lang, c.t AS t_c_topic, sum(tokens) OVER () AS total, tokens AS w FROM c0 JOIN m_c_source a USING (c_source) JOIN m_c_lang b USING (c_lang) JOIN m_c_topic c USING (c_topic))")
    n = 0
    for _ in range(sweeps):
        for c in ("c_source", "c_lang", "c_topic"):
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * t_{c} * total / nullif(sum(w) OVER (PARTITION BY {c}), 0), 0) AS w) FROM w{n})")
            n += 1
    steps += [
        f"f AS (SELECT *, w / tokens AS factor, total * {t.part!r} AS goal FROM w{n})",
        """g AS (SELECT *, (goal - coalesce(sum(tokens) OVER (ORDER BY factor DESC, c_source, c_lang, c_topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(w) OVER (ORDER BY factor DESC, c_source, c_lang, c_topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale FROM f)""",
        "s AS (SELECT coalesce((SELECT scale FROM g WHERE scale >= 0 AND scale * factor <= 1 ORDER BY factor DESC, scale LIMIT 1), 1e300) AS scale)",
        f"""mixed AS (SELECT d.*, least(1.0, s.scale * g.factor) AS chance, CAST(('0x' || substr(md5('{t.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / {float(16**13)!r} AS draw
            FROM d JOIN g USING (c_source, c_lang, c_topic) CROSS JOIN s)""",
    ]
    return "WITH " + ",\n".join(steps)
