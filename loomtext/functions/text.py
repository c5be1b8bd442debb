"""String functions, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
NULL_TOKENS = ("null", "NULL", "None", "")
#: Fixed value: white space as Python knows it, beyond ASCII too.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def norm_text(c: Column, keep_spaces: bool = False) -> Column:
    """Letters (ASCII and Hangul) and digits only; null gives an empty text. With `keep_spaces`, runs of anything else become one space."""
    c = F.coalesce(c, F.lit(""))
    if not keep_spaces:
        return F.regexp_replace(c, "[^0-9A-Za-z가-힣]", "")
    return F.trim(F.regexp_replace(c, "[^0-9A-Za-z가-힣]+", " "))


def question_and_passage(c: Column) -> tuple[Column, Column]:
    """Split after the first question mark; without one all is question. Null gives two empty texts."""
    c = F.coalesce(c, F.lit(""))
    at = F.instr(c, "?")
    return trimmed(F.when(at > 0, F.left(c, at)).otherwise(c)), trimmed(F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(F.lit("")))


def anchors(c: Column, size: int) -> tuple[Column, Column, Column]:
    """Head, middle and tail of `size` characters (all of a shorter text)."""
    start = F.greatest(F.lit(0), F.floor(F.length(c) / 2).cast("int") - size // 2)
    return F.left(c, F.lit(size)), F.substring(c, start + 1, F.lit(size)), F.right(c, F.lit(size))


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def for_embedding(c: Column, most: int = 2500) -> Column:
    """Line ends as spaces, then the first `most` characters."""
    return F.left(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(most))


def numbered(choices: Column, form: str = "{i} - {c}", separator: str = "\n") -> Column:
    """Choices with their 1-based numbers, in one text."""
    before, _, rest = form.partition("{i}")
    between, _, after = rest.partition("{c}")
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(between), c, F.lit(after))), separator)


def choice_range(choices: Column) -> Column:
    """1, 2, ..., n"""
    n = F.size(choices)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string")), ", ")).otherwise("")


def block(c: Column, before: str, after: str) -> Column:
    """The text between two marks, nothing where it is empty or null."""
    return F.when(F.length(c) > 0, F.concat(F.lit(before), c, F.lit(after))).otherwise("")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """The template with {name} replaced by columns (null as empty). Only names in `values` are replaced, so other braces and % stay."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def without_think_tags(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "(?i)</?think>", ""))


def stated_answer(c: Column, n: Column | int) -> Column:
    """The number of the last `Answer:` or `정답:`; "0" without one, or outside 1..n."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)(?:Answer|정답)\s*:\s*(\d+)"), F.lit(1)), F.lit(-1))
    number = last.try_cast("bigint")
    return F.when(number.between(1, n), number.cast("string")).otherwise("0")


def best_draft(drafts: Column, n: Column | int) -> Column:
    """The answer of the last draft that states a valid one, else "0"."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(drafts, lambda d: stated_answer(d, n)), lambda a: a != "0"), F.lit(-1)), F.lit("0"))


def joined_drafts(drafts: Column) -> Column:
    """[DRAFT i] and its text; empty drafts are left out, numbers stay."""
    marked = F.transform(drafts, lambda d, i: F.when(F.length(d) > 0, F.concat(F.lit("[DRAFT "), (i + 1).cast("string"), F.lit("]\n"), d)))
    return F.array_join(F.array_compact(marked), "\n\n")


#: What tokens are made of.
TOKEN_LETTERS = "0-9a-z가-힣"


def tokens(c: Column, keep: str = TOKEN_LETTERS) -> Column:
    """Lower-case runs of the kept characters. Stands in for a morphological analyser."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{keep}]+"), F.lit(0))


def null_tokens(c: Column) -> Column:
    """Null for texts that stand for a missing value; others without outer white space."""
    return F.when(trimmed(c).isin(*NULL_TOKENS), None).otherwise(trimmed(c))


def mapped(c: Column, values: Mapping[str, str]) -> Column:
    """The value that stands for this one; others stay."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), c), c)


def input_length(passage: Column, question: Column, choices: Column) -> Column:
    """Characters of passage, question and all choices; missing ones count as empty."""
    some = lambda c: F.coalesce(F.length(c), F.lit(0))
    return some(passage) + some(question) + F.coalesce(F.aggregate(choices, F.lit(0), lambda s, x: s + some(x)), F.lit(0))


def any_of(c: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of these."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))


#: Words of questions that ask for what is not so.
NEGATIVE = ("않은", "못한", "없는", "틀린", "아닌", "적절하지", "부합하지", "어긋나는", "거리가 먼", "타당하지", "옳지 않은", "일치하지")


def asks_negative(c: Column) -> Column:
    """Whether a question asks for what is not so; null is no such question."""
    return any_of(F.coalesce(c, F.lit("")), NEGATIVE)


def suffix_replaced(path: str, old: str = ".csv", new: str = ".score.csv") -> str:
    """The path with every occurrence replaced, not the last one only."""
    return path.replace(old, new)


def as_json(*columns: str) -> Column:
    """These columns as one JSON text, nested ones too; null fields are left out."""
    return F.to_json(F.struct(*columns))


def trailing_int(c: Column) -> Column:
    """The number after the last underscore, else 0."""
    return F.coalesce(F.substring_index(c, "_", -1).try_cast("int"), F.lit(0))


def host(url: Column) -> Column:
    """Host of a url in lower case, without user, password and port; null where it isn't one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below one. No domains: true; an empty or missing url: false."""
    h = host(F.coalesce(url, F.lit("")))
    if not domains:
        return F.length(F.coalesce(url, F.lit(""))) > 0
    return (h != "") & F.exists(F.array(*(F.lit(d.lower()) for d in domains)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def human_bytes(n: Column) -> Column:
    """1536 as 1.5 KB."""
    out = F.concat(F.format_number(n / 1024**4, 1), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def html_title_and_body(html: Column, tag: str = "b") -> tuple[Column, Column]:
    """Text of the first element of this kind, and all text without it; no title gives null for both."""
    plain = lambda c: trimmed(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " "), r"\s+", " "))
    title = plain(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))
    has = F.length(title) > 0
    return F.when(has, title), F.when(has, trimmed(F.replace(plain(html), title, F.lit(""))))


def quality_ok(c: Column, least: int = 50, most: int = 5000, ratio: float = 0.1, script: str = "가-힣") -> Column:
    """Not null or empty, of fitting length, with at most 5 control characters among the first 200 and enough letters of the script."""
    n = F.length(c)
    control = F.regexp_count(F.left(c, F.lit(200)), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    ok = n.between(least, most) & (control <= 5) & (F.regexp_count(c, F.lit(f"[{script}]")) >= ratio * n)
    return F.coalesce(ok & (n > 0), F.lit(False))


def shorter_than(parts: Sequence[Column], most: int) -> Column:
    """Whether all texts together are shorter than `most` characters; true where one is missing."""
    total = sum((F.length(trimmed(p)) for p in parts[1:]), F.length(trimmed(parts[0])))
    return F.coalesce(total < most, F.lit(True))


def combination_tags(c: Column) -> Column:
    """Texts after ㄱ, ㄴ, ㄷ, ㄹ up to the next such tag, as a map."""
    tag = lambda t: trimmed(F.regexp_extract(c, rf"(?s){t}\s*[.|:\])]\s*(.*?)(?=[ㄱ-ㅎ]\s*[.|:\])]|$)", 1))
    return F.map_from_arrays(F.array(*map(F.lit, "ㄱㄴㄷㄹ")), F.array(*(tag(t) for t in "ㄱㄴㄷㄹ")))


def has_combination(c: Column) -> Column:
    return c.rlike(r"[ㄱ-ㅎ]\s*[.|:\])]")


def expanded_choice(choice: Column, tags: Column) -> Column:
    """A choice like `ㄱ, ㄴ` with the tags replaced by their texts."""
    for t in "ㄱㄴㄷㄹ":
        choice = F.replace(choice, F.lit(t), F.coalesce(F.try_element_at(tags, F.lit(t)), F.lit(t)))
    return choice


def lexical(c: Column) -> dict[str, Column]:
    """words per sentence, paragraphs, type-token ratio, by white space and .!? (no morphology here)."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    sentences = F.greatest(F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: F.trim(s) != "")), F.lit(1))
    n = F.size(words)
    return {
        "words_per_sentence": n / sentences,
        "paragraphs": F.size(F.filter(F.split(c, r"\n+"), lambda p: F.trim(p) != "")),
        "ttr": F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(0.0),
    }
