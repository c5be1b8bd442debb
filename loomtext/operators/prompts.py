"""Prompts and chat messages as columns. Templates are ours; a registry keeps them by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import block, choice_range, numbered, render


@dataclass(frozen=True)
class Template:
    system: str
    user: str
    with_context: bool = False


_ASK = "{passage}\n\n{question}\n{plus}{choices}\n\nAnswer with one of {range}."
TEMPLATES = {
    "v1": Template("You answer multiple-choice questions.", _ASK),
    "v2": Template("You answer multiple-choice questions. Choose one of {range}.", _ASK),
    "v3": Template("You answer multiple-choice questions. Rely on the passage only. Choose one of {range}.", _ASK),
    "v4": Template("You answer multiple-choice questions. Rule out wrong choices, then choose one of {range}.", _ASK),
    "v5": Template("You answer multiple-choice questions. Find the sentence that decides, then choose one of {range}.", _ASK),
    "v6": Template("You answer multiple-choice questions with a number of {range} and nothing else.", _ASK),
    "v8": Template("You answer multiple-choice questions with {count} choices from the passage. Reply with one of {range} and nothing else.", _ASK),
    "v9": Template("You answer multiple-choice questions. Prefer the passage to the references. Choose one of {range}.", "{context}\n" + _ASK, True),
    "v7": Template("You answer multiple-choice questions from the passage and the references.", "{context}\n" + _ASK, True),
    "v10": Template("Think step by step, then end with `Answer: n`, n one of {range}.", "{context}\n" + _ASK, True),
}


def template(name: str) -> Template:
    """An unknown name gives v1."""
    return TEMPLATES.get(name, TEMPLATES["v1"])


def messages(name: str, passage: Column, question: Column, choices: Column, plus: Column | None = None, context: Column | None = None, answer: Column | None = None) -> Column:
    """array<struct<role, content>>: system, user, and assistant if an answer is given."""
    t = template(name)
    context = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    values = {
        "passage": passage,
        "question": question,
        "plus": block(plus, "<보기>\n", "\n</보기>\n") if plus is not None else F.lit(""),
        "choices": numbered(choices),
        "range": choice_range(choices),
        "count": F.coalesce(F.size(choices), F.lit(0)),
        "context": F.when(F.length(context) > 0, F.concat(F.lit("\n"), context)).otherwise(""),
    }
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    out = [message("system", render(t.system, values)), message("user", render(t.user, values))]
    if answer is not None:
        out.append(message("assistant", answer.cast("string")))
    return F.array(*out)


def chat_text(items: Column, start: str = "<|im_start|>", end: str = "<|im_end|>\n") -> Column:
    """All messages in one text, each between marks with its role."""
    return F.array_join(F.transform(items, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end))), "")


def rerank_query(question: Column, choices: Column, passage: Column, most: int = 2500, passage_most: int = 600) -> Column:
    """Question, numbered choices and the beginning of the passage."""
    return F.left(F.concat_ws("\n", question, numbered(choices, "({i}) {c}", " "), F.left(passage, F.lit(passage_most))), F.lit(most))
