"""A morphological analyser: the cheapest way through the lattice of all dictionary words in a run of letters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.batches import carried

#: Runs that are looked up in the dictionary, and runs that are tokens as they stand.
HANGUL, OTHER = "가-힣", "0-9a-z"
#: The tag of what isn't in the dictionary, and of runs that aren't looked up.
UNKNOWN, PLAIN = "UNK", "SL"
#: Distinct runs whose analysis a worker remembers, at most; longer runs than LONG are not remembered.
MEMO, LONG = 200_000, 64
#: Costs are rounded to 9 digits; those that differ by more than this stay apart.
NEAR = 1e-8


@dataclass(frozen=True)
class Dictionary:
    """Words with a tag and a cost, costs of one tag after another (0 if not named), and the costs of an unknown stretch: for it, and for each letter. It goes to every task: some megabytes, whatever the texts."""

    words: dict[str, tuple[tuple[str, float], ...]]
    follows: dict[tuple[str, str], float] = field(default_factory=dict)
    unknown: tuple[float, float] = (6.0, 4.0)

    @classmethod
    def of(cls, entries: Iterable[tuple[str, str, float]], follows: dict[tuple[str, str], float] | None = None, unknown: tuple[float, float] = (6.0, 4.0)) -> Dictionary:
        words: dict[str, dict[str, float]] = {}
        for form, tag, cost in entries:
            if form:
                own = words.setdefault(form, {})
                own[tag] = min(cost, own.get(tag, cost))
        return cls({w: tuple(sorted(t.items())) for w, t in words.items()}, follows or {}, unknown)

    @cached_property
    def heads(self) -> dict[str, tuple[tuple[str, float], ...]]:
        """The words, and what they begin with (with no tags, where that is no word): where nothing goes on, no longer word is looked up."""
        return {**{w[:n]: () for w in self.words for n in range(1, len(w))}, **self.words}

    @property
    def longest(self) -> int:
        return max(map(len, self.words), default=0)


@lru_cache(65_536)
def rounded(cost: float) -> float:
    """Sums of the same costs come again and again, and rounding takes longer than all else."""
    return round(cost, 9)


def analysed(run: str, d: Dictionary, longest: int) -> list[tuple[str, str]]:
    """(form, tag) of the cheapest way through; of equally cheap ones that with fewer words, then (from the right) that with the longer word, then by tag.

    A way is known by where it ends and its last tag, as costs depend on neighbours only. An unknown stretch is one word, of any length, so
    two never follow each other. Time grows with the length of the run.
    """
    start, letter = d.unknown
    heads, follows = d.heads, d.follows
    # of each place and last tag: (cost, words, where the last word begins, the tag before it)
    best: list[dict[str, tuple[float, int, int, str]]] = [{} for _ in range(len(run) + 1)]
    best[0][""] = (0.0, 0, 0, "")
    for at in range(len(run)):
        ends, least, here = [], float("inf"), best[at]
        for to in range(at + 1, min(at + longest, len(run)) + 1):
            entries = heads.get(run[at:to])
            if entries is None:
                break
            for tag, own in entries:
                ends.append((best[to], tag, own))
        if not follows:  # where no tag matters to the next, words only follow the cheapest ways to this place
            for way in here.values():
                if way[0] + NEAR < least:
                    least = way[0] + NEAR
        for before, (cost, words, begin, earlier) in here.items():
            if cost < least:
                for ways, tag, own in ends:
                    full, old = cost + own + (follows.get((before, tag), 0.0) if follows else 0.0), ways.get(tag)
                    if old is None or full < old[0] + NEAR and (rounded(full), words + 1, at, before) < old:
                        ways[tag] = (rounded(full), words + 1, at, before)
            if before == UNKNOWN:
                full, words, place, last = cost + letter, words, begin, earlier
            else:
                full, words, place, last = cost + start + letter + (follows.get((before, UNKNOWN), 0.0) if follows else 0.0), words + 1, at, before
            old = best[at + 1].get(UNKNOWN)
            if old is None or full < old[0] + NEAR and (rounded(full), words, place, last) < old:
                best[at + 1][UNKNOWN] = (rounded(full), words, place, last)
    tag, at, out = min(best[-1], key=lambda t: (best[-1][t][:3], t)), len(run), []
    while at:
        _, _, begin, before = best[at][tag]
        out.append((run[begin:at], tag))
        at, tag = begin, before
    return out[::-1]


def remembering(d: Dictionary) -> Callable[[str], list[tuple[str, str]]]:
    """analysed() for many runs, most of which come again."""
    memo: dict[str, list[tuple[str, str]]] = {}
    longest = d.longest

    def of(run: str) -> list[tuple[str, str]]:
        if (found := memo.get(run)) is None:
            found = analysed(run, d, longest)
            if len(run) <= LONG:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[run] = found
        return found

    return of


def pattern(letters: str, other: str) -> re.Pattern[str]:
    return re.compile(f"([{letters}]+)|" + (f"([{other}]+)" if other else "((?!))"))


def morphemes(df: DataFrame, text: str, d: Dictionary, keep: list[str], letters: str = HANGUL, other: str = OTHER, out: str = "morphemes") -> DataFrame:
    """The columns `keep` and `out`: array of (form, tag) of each whole text, lower-cased. Runs of `letters` go through the dictionary, runs of `other` are tokens; a null text has none."""
    shared = df.sparkSession.sparkContext.broadcast(d)
    runs = pattern(letters, other)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        analyse = remembering(shared.value)
        for batch in batches:
            bounds, forms, tags = [0], [], []
            for text in batch.column("text"):
                for run, token in runs.findall((text.as_py() or "").lower()):
                    found = analyse(run) if run else [(token, PLAIN)]
                    forms += [f for f, _ in found]
                    tags += [t for _, t in found]
                bounds.append(len(forms))
            pairs = pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(tags, pa.string())], ["form", "tag"])
            yield batch, [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)]

    return carried(df, keep, {"text": F.col(text)}, f"`{out}` array<struct<form:string,tag:string>>", work)


def counted(df: DataFrame, text: str, d: Dictionary, keep: list[str], letters: str = HANGUL, other: str = OTHER, out: str = "counts") -> DataFrame:
    """The columns `keep` and `out`: array of (form, tag, n), each form and tag of morphemes() once, with how often the text has it."""
    shared = df.sparkSession.sparkContext.broadcast(d)
    runs = pattern(letters, other)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        analyse = remembering(shared.value)
        for batch in batches:
            bounds, forms, tags, counts = [0], [], [], []
            for text in batch.column("text"):
                own: dict[tuple[str, str], int] = {}
                for (run, token), n in Counter(runs.findall((text.as_py() or "").lower())).items():
                    for m in analyse(run) if run else [(token, PLAIN)]:
                        own[m] = own.get(m, 0) + n
                forms += [f for f, _ in own]
                tags += [t for _, t in own]
                counts += own.values()
                bounds.append(len(forms))
            rows = pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(tags, pa.string()), pa.array(counts, pa.int64())], ["form", "tag", "n"])
            yield batch, [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)]

    return carried(df, keep, {"text": F.col(text)}, f"`{out}` array<struct<form:string,tag:string,n:bigint>>", work)


def terms(morphemes: Column, *without: str) -> Column:
    """The forms, without those of some tags (particles, endings): what an index is made of."""
    kept = F.filter(morphemes, lambda m: ~m["tag"].isin(*without)) if without else morphemes
    return F.transform(kept, lambda m: m["form"])
