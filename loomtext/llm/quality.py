"""Quality by hierarchical empirical Bayes.

A classifier on a text's form gives every document the probability of being good. Hosts and their paths have posteriors of
their own: the mean over their documents, drawn towards the level above (path to host, host to all) the more, the fewer
documents there are and the less sites differ; how much follows from the data by moments: of hosts around the mean of
all, of paths around that of their host. A document's own evidence is then read under the prior of its path instead of
the global one; that prior comes from the other documents only, so nothing counts twice.

The tables here have no addresses: `source` stands for the host and `lang` for the path within it (both are parameters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.linear import fit
from loomtext.llm.shared import carried, column, held_out, others, stored
from loomtext.llm.textbatch import Texts, slices
from loomtext.llm.toxicity import chosen_labels

#: Bins of each measure of a text's form.
BINS = 12
THRESHOLD = 0.5
MEASURES = 12


def form(texts: Texts) -> np.ndarray:
    """MEASURES numbers for each text: size, words, kinds of characters, and how much repeats."""
    b, n = texts.buf, len(texts)
    size = np.maximum(texts.sizes, 1)
    lower, upper, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    beyond, stop = b >= 128, np.isin(b, np.frombuffer(b".,;:?", np.uint8))
    symbol = (b > 32) & ~(lower | upper | digit | beyond | stop)
    begins, ends, first = texts.words
    words = np.diff(first)
    some = np.maximum(words, 1)
    doc, h = texts.word_doc, texts.word_hashes
    order = np.lexsort((h, doc))
    sh, sd = h[order], doc[order]
    fresh = np.append(True, (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])) if len(sh) else np.zeros(0, bool)
    run = np.diff(np.append(np.flatnonzero(fresh), len(sh)))
    most = np.zeros(n)
    np.maximum.at(most, sd[fresh], run)
    again = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, bool)
    loud = np.isin(b[ends - 1], np.frombuffer(b"!#$%&*|@^~", np.uint8)) if len(ends) else np.zeros(0, bool)
    per_word = lambda x: np.bincount(doc[x], minlength=n)[:n] / some
    return np.stack(
        [
            np.log1p(words),
            np.minimum(texts.sizes / some, 50),
            texts.total(upper) / size,
            texts.total(digit) / size,
            texts.total(symbol) / size,
            texts.total(stop) / some,
            texts.total(beyond) / size,
            np.bincount(sd[fresh], minlength=n)[:n] / some,
            most / some,
            per_word(again),
            per_word(loud),
            per_word(ends - begins == 1),
        ],
        axis=1,
    )


@dataclass
class Model:
    #: Inner edges of the bins of each measure, weights of the bins, bias.
    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], "right") + k * BINS for k in range(MEASURES)], 1)

    def logit(self, texts: Texts) -> np.ndarray:
        return self.bias + self.weights[self.bins(form(texts))].sum(1)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From the rows of `labels` (doc_id, quality) that aren't held out, at most toxicity.ROWS of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            x = form(texts)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), MEASURES).cast(pa.list_(pa.float64()))], ["label", "form"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen_labels(labels, "quality")), "doc_id").select("label", "text").mapInArrow(read, "label int, form array<double>").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = rows.column("form").combine_chunks().flatten().to_numpy().reshape(-1, MEASURES) if len(y) else np.zeros((0, MEASURES))
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T if len(y) else np.zeros((MEASURES, BINS - 1))
    # the outer hundredths have bins of their own, as junk is rare
    if len(y):
        edges[:, 0], edges[:, -1] = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
        edges.sort(axis=1)
    model = Model(edges, np.zeros(MEASURES * BINS), 0.0)
    at = model.bins(x)
    model.weights, model.bias = fit(np.repeat(np.arange(len(y)), MEASURES), at.ravel(), np.ones(at.size), y, MEASURES * BINS, penalty=1.0, steps=500)
    return model


def evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs with `own`, the classifier's log-odds of each text (null counts as empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part, texts in slices(batches):
            yield part, [pa.array(shared.value.logit(texts))]

    return carried(docs, others(docs.columns, "own"), {"text": column(text)}, "own double", work)


def logit(p: F.Column) -> F.Column:
    return F.log(p / (1 - p))


def chance(log_odds: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-log_odds))


def strength(groups: DataFrame, centre: F.Column, above: str | None) -> float:
    """How many documents the level above counts as, from groups (n, s, s2): by the variance of their means around `centre` beyond what chance gives (method of moments). `above`: the column of the groups that centres are means of (None: one for all)."""
    n, s, s2 = F.col("n"), F.col("s"), F.col("s2")
    rows = groups.select("n", (n * F.pow(s / n - centre, 2)).alias("between"), (s2 - s * s / n).alias("within"), (n * centre * (1 - centre)).alias("most"), F.col(above).alias("above") if above else F.lit(0).alias("above"))
    per = rows.groupBy("above").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("between").alias("between"), F.sum("within").alias("within"), F.sum("most").alias("most"), F.count("*").alias("k"))
    r = per.agg(F.sum("n"), F.sum(F.col("squares") / F.col("n")), F.sum("between"), F.sum("within"), F.sum("most"), F.sum("k"), F.count("*")).first()
    total, squares, between, within, most, k, centres = (float(x or 0) for x in r)
    if k <= centres or total <= k:
        return 1e3
    spread = (between - (k - centres) * within / (total - k)) / max(total - squares, 1e-9)
    return float(np.clip(most / total / spread - 1 if spread > 0 else 1e4, 1, 1e4))


def posteriors(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Per (host, path): n and s, documents and summed chances of the path, n_host and s_host of its host, and host_posterior and path_posterior; then the prior of all and how many documents it counts as for a host, and the host's for a path. From rows (host, path, own), all by grouped sums, which are partial before the shuffle."""
    p = chance(F.col("own"))
    paths = stored(rows.select("host", "path", p.alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")))
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    prior = float(np.clip((total[0] or 0) / total[1], 1e-4, 1 - 1e-4)) if total[1] else 0.5
    # stored, so that Spark knows its size and broadcasts it where it is small, instead of shuffling texts
    both = stored(paths.join(hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host")), "host"))
    of_host = strength(hosts, F.lit(prior), None)
    of_path = strength(both, F.col("s_host") / F.col("n_host"), "host")
    levels = {"prior": prior, "of_host": of_host, "of_path": of_path}
    host, path = drawn(levels, F.struct("n", "s", "n_host", "s_host"), F.lit(0), F.lit(0.0))
    return both.select("host", "path", "n", "s", "n_host", "s_host", host.alias("host_posterior"), path.alias("path_posterior")), levels


def drawn(levels: dict[str, float], sums: F.Column, less_n: F.Column, less_s: F.Column) -> tuple[F.Column, F.Column]:
    """The posteriors of host and path from sums (n, s, n_host, s_host), without so many documents of this summed chance."""
    host = (sums["s_host"] - less_s + levels["of_host"] * levels["prior"]) / (sums["n_host"] - less_n + levels["of_host"])
    path = (sums["s"] - less_s + levels["of_path"] * host) / (sums["n"] - less_n + levels["of_path"])
    return tuple(F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)) for x in (host, path))


def read_under(rows: DataFrame, paths: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Rows (host, path, own, ...) with host_posterior, path_posterior (both without the row itself), doc_score and score instead of these three."""
    kept = [c for c in rows.columns if c not in ("host", "path", "own")]
    rows = rows.join(paths.select("host", "path", F.struct("n", "s", "n_host", "s_host").alias("sums")), ["host", "path"]).withColumn("p", chance(F.col("own")))
    host, path = drawn(levels, F.col("sums"), F.lit(1), F.col("p"))
    rows = rows.select(*kept, "own", F.col("p").alias("doc_score"), host.alias("host_posterior"), path.alias("path_posterior"))
    shift = logit(F.col("path_posterior")) - float(np.log(levels["prior"] / (1 - levels["prior"])))
    return rows.withColumn("score", chance(F.col("own") + shift)).drop("own")


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The rows of docs (those `columns`; None: all) with host_posterior, path_posterior, doc_score (text alone) and score (under the prior of the path).

    Null hosts and paths make a group of their own (''). A repeated row counts as often as it stands, and each has its
    result. An empty or null text is judged by its form like any other. Columns of docs that have the name of an added one (in any case) are
    replaced; `prefix` goes before the added names. What is kept is stored with the classifier's evidence, so texts are read once for it.
    """
    model = learn(docs, labels)
    results = ("host_posterior", "path_posterior", "doc_score", "score")
    kept = others(docs.columns if columns is None else columns, *(prefix + c for c in results))
    keys = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (host, path)]
    names = [f"k{i}" for i in range(len(kept))]
    text = names[kept.index("text")] if "text" in kept else "text"
    rows = docs.select(keys[0].alias("host"), keys[1].alias("path"), *(column(c).alias(k) for c, k in zip(kept, names, strict=True)), *(["text"] if text == "text" else []))
    rows = stored(evidence(rows, model, text).select("host", "path", *names, "own"))
    paths, levels = posteriors(rows)
    found = read_under(rows, paths, levels)
    return found.select(*(F.col(k).alias(c) for k, c in zip(names, kept, strict=True)), *(F.col(c).alias(prefix + c) for c in results))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, doc_score, host_posterior, path_posterior, score, predicted (1: good, score >= threshold). As scored() has it; other columns play no part."""
    out = scored(docs, labels, columns=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "doc_score", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
