"""Prompt columns: (prefix, text) pairs for a scorer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailsplit.functions.text import strip

# Fixed prompt wording: scores are comparable only with exactly these strings.
NLI_PLAIN = ("Premise: ", " Hypothesis:")
NLI_BY_LABEL = {
    "contradiction": " This hypothesis is a contradiction:",
    "entailment": " This hypothesis is entailed:",
    None: " This hypothesis is neutral:",
}
QA = ("Passage: ", " Ask a question about the passage:")


def sql_prompt(query: Column, prefix: str = "", table_name: Column | None = None,
               space_after_prefix: bool = False) -> tuple[Column, Column]:
    """Prefix, with the database name and a colon if given, and the trimmed question."""
    head = F.lit(prefix) if table_name is None else F.concat(F.lit(prefix), table_name, F.lit(":"))
    body = strip(query)
    return head, F.concat(F.lit(" "), body) if space_after_prefix else body


def nli_prompt(premise: Column, hypothesis: Column, label: Column | None = None) -> tuple[Column, Column]:
    """Premise prompt; with ``label`` the prompt names the class."""
    if label is None:
        tail: Column = F.lit(NLI_PLAIN[1])
    else:
        named = {k: v for k, v in NLI_BY_LABEL.items() if k is not None}
        tail = F.lit(NLI_BY_LABEL[None])
        for name, words in named.items():
            tail = F.when(label == F.lit(name), F.lit(words)).otherwise(tail)
    return F.concat(F.lit(NLI_PLAIN[0]), premise, tail), F.concat(F.lit(" "), hypothesis)


def qa_prompt(passage: Column, question: Column) -> tuple[Column, Column]:
    """Passage prompt and the question."""
    return F.concat(F.lit(QA[0]), passage, F.lit(QA[1])), F.concat(F.lit(" "), question)


def batch_text(text: Column, prefix: Column | None = None, space: bool = False, begin: str = "",
               end: str = "") -> tuple[Column, Column]:
    """(prefix, text) as handed to the scorer, wrapped in begin and end marks.

    Without a prefix the prefix column is empty and both marks go around the text.
    """
    body = F.concat(F.lit(" "), text) if space else text
    if prefix is None:
        return F.lit(""), F.concat(F.lit(begin), body, F.lit(end))
    return F.concat(F.lit(begin), prefix), F.concat(body, F.lit(end))


def seq2seq_text(source: Column, target: Column, prefix: str = "", target_prefix: str | None = None,
                 begin: str = "", end: str = "") -> tuple[Column, Column]:
    """Source with its task prefix (and, for a left-to-right model, the target prefix) and ended target."""
    parts = [F.lit(begin + prefix), source]
    if target_prefix is not None:
        parts.append(F.lit(" " + target_prefix))
    return F.concat(*parts), F.concat(target, F.lit(end))
