"""Toxicity by weak supervision.

Terms (words, and beginnings of words) that go with the toxic label in training rows make lexicons. Each lexicon is a
voter that fires where a text has a term of it; patterns (shouting, exclamation marks, symbols) are voters too. Every row of
the corpus that isn't held out is voted on, labelled or not; what the voters say together is a small number (a bit for each),
so the whole corpus is counted by it. A generative model of these counts, fitted by expectation maximisation without any
label, estimates how often each voter fires in either class and how far voters repeat each other given the class, and
gives each combination of votes a posterior. Labels only choose the terms and say which class is the toxic one. A linear
classifier over terms and patterns is trained on the posteriors, and scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.linear import fit, sigmoid
from loomtext.llm.minhash import TIMES, XORS, shingles
from loomtext.llm.shared import carried, held_out, others, stored
from loomtext.llm.textbatch import NOT_LETTER, Texts, mix, slices

#: Labelled rows that terms are chosen from, at most, and further rows that the classifier is fitted on, at most (each time
#: those with the smallest hashes of their ids); terms of all lexicons, at most.
ROWS, TERMS = 20_000, 4096
#: Buckets that terms are hashed to, and the beginnings of words that count as terms, in bytes.
BUCKETS, STEMS = 1 << 26, (3, 4, 5, 6, 7, 8)
#: Entries of the table that most terms are told not to be chosen by.
SIEVE = 1 << 20
#: Lexicons: the terms of words that begin with the same bytes are in one, so that a word and its beginnings are one voice.
FAMILIES, FAMILY = 8, 3
#: Added to the kind of a term that a text has more than once.
AGAIN = 8
#: A term is taken if so many toxic training texts have it, and this share of all that have it is toxic.
SUPPORT, PRECISION = 3, 0.85
THRESHOLD = 0.3
#: From which share of a text's bytes on each pattern fires: upper case, exclamation marks, symbols. A text with so many terms has many.
LIMITS, MANY = (0.3, 0.02, 0.1), 4
#: Voters: the lexicons; terms that a text says again; many terms of any lexicon; the patterns.
VOTERS = FAMILIES + 2 + len(LIMITS)
U = np.uint64


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, kind) of each term of each text, one entry for every time it occurs. Kinds: 0 words, then the beginnings of longer words. A term's lowest bits are its family: words that begin with the same FAMILY bytes are of one."""
    words = Texts(texts.buf, texts.offsets, gaps=NOT_LETTER)
    begins, ends, _ = words.words
    family = mix(words.hashes(begins, np.minimum(begins + FAMILY, ends))) % U(FAMILIES)
    docs, found, kinds = [], [], []
    for kind, n in enumerate((None, *STEMS)):
        at = np.flatnonzero(ends - begins > n) if n else np.arange(len(begins))
        h = words.hashes(begins[at], begins[at] + n if n else ends[at])
        docs.append(words.word_doc[at])
        found.append((mix(h + U(kind)) % U(BUCKETS // FAMILIES) * U(FAMILIES) + family[at]).astype(np.int64))
        kinds.append(np.full(len(at), kind, np.int64))
    return np.concatenate(docs), np.concatenate(found), np.concatenate(kinds)


def codes_of(doc: np.ndarray, term: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the distinct terms of each text; a term that occurs again has a second code, which says so."""
    pair, n = np.unique((doc * BUCKETS + term) * 16 + kind, return_counts=True)
    pair = np.sort(np.concatenate([pair, pair[n > 1] + AGAIN]))
    return pair // (16 * BUCKETS), pair % (16 * BUCKETS)


def patterns(texts: Texts) -> np.ndarray:
    """Shares of upper case, exclamation marks and symbols among the bytes of each text."""
    size = np.maximum(texts.sizes, 1)
    b = texts.buf
    symbol = np.isin(b, np.frombuffer(b"#$%&*@^~|<>{}[]\\_=+", np.uint8))
    return np.stack([texts.total((b >= 65) & (b <= 90)), texts.total(b == 33), texts.total(symbol)], 1) / size[:, None]


def loud(texts: Texts) -> np.ndarray:
    """Which patterns fire on each text."""
    return patterns(texts) > np.array(LIMITS)


@dataclass
class Lexicon:
    #: Codes of the chosen terms in order.
    codes: np.ndarray

    def __post_init__(self):
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[self.codes // 16 % SIEVE] = True

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(text, place among the codes) of the chosen terms that each text has."""
        doc, term, kind = terms(texts)
        hit = self.sieve[term % SIEVE]
        doc, code = codes_of(doc[hit], term[hit], kind[hit])
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        mine = self.codes[at] == code
        return doc[mine], at[mine]

    def votes(self, doc: np.ndarray, term: np.ndarray, fires: np.ndarray) -> np.ndarray:
        """Of each text, a number with a bit for each voter that fires."""
        n = len(fires)
        code = self.codes[term]
        all_votes = [np.bincount(doc[code // 16 % FAMILIES == k], minlength=n) > 0 for k in range(FAMILIES)]
        all_votes += [np.bincount(doc[code % 16 >= AGAIN], minlength=n) > 0, np.bincount(doc, minlength=n) >= MANY, *fires.T]
        return sum(v.astype(np.int64) << k for k, v in enumerate(all_votes))


@dataclass
class Model:
    lexicon: Lexicon
    #: Of the terms, then of the patterns.
    weights: np.ndarray
    bias: float

    def score(self, texts: Texts) -> np.ndarray:
        doc, term = self.lexicon.hits(texts)
        n = len(self.lexicon.codes)
        return sigmoid(self.bias + np.bincount(doc, self.weights[term], len(texts)) + loud(texts) @ self.weights[n:])


def chosen_labels(labels: DataFrame, label: str, most: int = ROWS) -> DataFrame:
    """doc_id and label of the labelled rows that aren't held out; of more than `most` those with the smallest hashes. A document with several labels has its largest. Bounded (320 kB at 20,000), so it is broadcast and no other row's text is shuffled."""
    own = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return own.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)


def lexicon(rows: DataFrame) -> tuple[Lexicon, float]:
    """The terms that go with the toxic label, and the share of toxic rows, from rows (doc_id, label, text).

    Copies would make any word of theirs look like a cause, so a row counts as 1 / n where n rows share a minimum of their
    shingles, on the mean of two such minima. No row is left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            doc, code = codes_of(*terms(texts))
            own = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            h, bounds = shingles(texts, 3)
            least = np.zeros((2, len(texts)), U)
            has = np.flatnonzero(np.diff(bounds))
            for k in range(2):
                least[k, has] = np.minimum.reduceat((h ^ XORS[40 + k]) * TIMES[40 + k], bounds[has]) if len(has) else 0
            columns = [part.column("label"), *(pa.array(x.view(np.int64)) for x in least), pa.ListArray.from_arrays(pa.array(own), pa.array(code.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "one", "two", "terms"])

    rows = stored(rows.select("label", "text").mapInArrow(read, "label int, one long, two long, terms array<int>"))
    weight = F.lit(0.0)
    for key in ("one", "two"):  # as many rows as `rows` has at most, of two numbers: bounded
        rows = rows.join(F.broadcast(rows.groupBy(key).agg(F.count("*").alias(f"n_{key}"))), key)
        weight += 0.5 / F.col(f"n_{key}")
    rows = rows.withColumn("w", weight)
    share, whole, n_bad, n_all = (x or 0 for x in rows.agg(F.sum(F.col("w") * F.col("label")), F.sum("w"), F.sum("label"), F.count("*")).first())
    base = (share + 1) / (whole + 2)
    if not n_bad or n_bad == n_all:
        return Lexicon(np.zeros(0, np.int64)), base
    bad, n = F.col("bad"), F.col("n")
    per = rows.select("label", "w", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.col("w") * F.col("label")).alias("bad"), F.sum("w").alias("n")).where(n >= SUPPORT - 1e-6)
    rate = share / whole
    gain = bad * F.log(F.greatest(bad, F.lit(1e-9)) / (n * rate)) + (n - bad) * F.log(F.greatest(n - bad, F.lit(1e-9)) / (n * (1 - rate)))
    least_gain = float(np.log(max(per.count(), 3))) - 1
    chosen = per.where((bad >= SUPPORT - 1e-6) & (bad >= PRECISION * n)).withColumn("gain", F.round(gain, 9)).where(F.col("gain") > least_gain).orderBy(F.desc("gain"), "term").limit(TERMS).collect()
    return Lexicon(np.array(sorted(r["term"] for r in chosen), np.int64)), base


def voted(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Per row: doc_id, votes (a bit for each voter), terms (places of its terms), loud (which patterns fire, as bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            doc, term = shared.value.hits(texts)
            fires = loud(texts)
            own = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            votes = shared.value.votes(doc, term, fires)
            columns = [part.column("doc_id"), pa.array(votes), pa.ListArray.from_arrays(pa.array(own), pa.array(term.astype(np.int32))), pa.array(fires @ (1 << np.arange(len(LIMITS))))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "votes", "terms", "loud"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, votes long, terms array<int>, loud long")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of docs that aren't held out and those of `labels` (doc_id, toxic) that aren't either.

    Without labelled rows of both classes, or terms that tell them apart, the model scores everything by the share of toxic rows.
    """
    own = chosen_labels(labels, "toxic")
    lex, base = lexicon(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"))
    if not len(lex.codes):
        return Model(lex, np.zeros(len(LIMITS)), float(np.log(base / (1 - base))))
    rows = stored(voted(docs.where(~held_out(F.col("doc_id"))), lex))
    counts = rows.groupBy("votes").count().orderBy("votes").toArrow()  # at most 2 ** VOTERS rows, whatever the corpus
    patterns_, n = counts.column("votes").to_numpy(), counts.column("count").to_numpy()
    fired = (patterns_[:, None] >> np.arange(FAMILIES + 2) & 1).sum(1)
    found = label_model(patterns_, n, VOTERS, np.where(fired >= 2, 0.95, np.where(fired == 1, 0.3, 0.01)))
    # two bounded samples: the labelled rows, and as many others
    columns = ["votes", "terms", "loud"]
    labelled = rows.join(F.broadcast(own), "doc_id").select(*columns, "label")
    others = rows.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "votes", "terms").limit(ROWS).select(*columns, F.lit(None).cast("int").alias("label"))
    sample = labelled.unionByName(others).toArrow().combine_chunks()
    posterior = found.posterior[np.searchsorted(patterns_, sample.column("votes").to_numpy())]
    gold = sample.column("label").to_numpy(zero_copy_only=False)
    if posterior[gold == 1].mean() < posterior[gold == 0].mean():
        posterior = 1 - posterior
    lists = sample.column("terms").combine_chunks()
    fires = (sample.column("loud").to_numpy()[:, None] >> np.arange(len(LIMITS))) & 1
    row, which = np.nonzero(fires)
    row = np.concatenate([np.repeat(np.arange(len(fires)), lists.value_lengths().to_numpy()), row])
    column = np.concatenate([lists.flatten().to_numpy(), which + len(lex.codes)])
    weights, bias = fit(row, column, np.ones(len(row)), posterior, len(lex.codes) + len(LIMITS), penalty=0.3, steps=400)
    return Model(lex, weights, bias)


@dataclass
class LabelModel:
    #: Of each combination of votes; of each voter how often it fires in the toxic and in the other class, and how much it counts.
    posterior: np.ndarray
    fires: np.ndarray
    weight: np.ndarray


def label_model(patterns: np.ndarray, counts: np.ndarray, n_voters: int, start: np.ndarray, rounds: int = 60) -> LabelModel:
    """Fits the votes of the corpus, given as distinct combinations (bits) and how often each occurs, from posteriors to begin with.

    A voter fires with a probability of its own in each class, and both firing and silence are evidence. Voters that agree
    beyond what the class explains count less: a voter's evidence is divided by one plus the squares of its positive
    correlations with others, given the class (a voter that repeats another exactly halves both).
    """
    fired = ((patterns[:, None] >> np.arange(n_voters)) & 1).astype(float)
    p, weight = start.astype(float), np.full(n_voters, 0.3)
    rates = np.zeros((n_voters, 2))
    for k in range(rounds):
        evidence = np.log((counts * p).sum() + 1) - np.log((counts * (1 - p)).sum() + 1)
        for c, mass in enumerate((counts * p, counts * (1 - p))):
            rates[:, c] = (mass @ fired + 0.5) / (mass.sum() + 1)
        one, zero = rates.T
        evidence = evidence + fired @ (weight * np.log(one / zero)) + (1 - fired) @ (weight * np.log((1 - one) / (1 - zero)))
        p = sigmoid(evidence)
        if k % 5 == 4:
            corr = np.zeros((n_voters, n_voters))
            for mass in (counts * p, counts * (1 - p)):
                centred = (fired - mass @ fired / max(mass.sum(), 1e-9)) * np.sqrt(mass)[:, None]
                cov = centred.T @ centred
                size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                varies = size > 1e-5
                corr += 0.5 * cov / size[:, None] / size[None, :] * varies[:, None] * varies[None, :]
            corr = np.maximum(corr, 0)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + (corr**2).sum(1))
    return LabelModel(p, rates, weight)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of docs with a column `name` (0 to 1, higher: toxic likelier), which replaces one that docs has (in any case). Null and empty texts have the score of a text without terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part, texts in slices(batches):
            yield part, [pa.array(shared.value.score(texts))]

    return carried(docs, others(docs.columns, name), {"text": F.col("text")}, f"`{name}` double", work)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= threshold).

    A null text counts as empty; rows that repeat are scored alike, each of them, and count as often as they stand. A row
    without doc_id isn't held out and has no label. An empty table gives an empty one. Other columns play no part.
    """
    rows = scored(docs.select("doc_id", "text"), learn(docs, labels)).drop("text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
