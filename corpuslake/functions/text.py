"""Column expressions over texts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence: what ends in full stops, marks or line ends, with them.
SENTENCE = r"[^.!?\n]+[.!?\n]*"
PROMPT = "Answer the question from the context alone. Say so if it does not hold the answer.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0))).cast("long")


def word_windows(text: Column, size: int) -> Column:
    """Windows of ``size`` words each (the last may hold fewer), with the white space around them."""
    words = F.regexp_extract_all(text, F.lit(r"[ \t\r\n\f\x0B]*[^ \t\r\n\f\x0B]+[ \t\r\n\f\x0B]*"), F.lit(0))
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / size).cast("int"), F.lit(0))), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), "")
    )
    # A lambda's argument is computed once, where a column would be for each window.
    return F.transform(F.array(words), cut)[0]


def bounded_sentences(text: Column, size: int) -> Column:
    """Sentences of a text; those of more than ``size`` words come in windows of so many."""
    return F.flatten(F.transform(sentences(text), lambda s: F.when(count_tokens(s) <= size, F.array(s)).otherwise(word_windows(s, size))))


def sanitized(path: Column) -> Column:
    """Base name with all but letters, digits, ``-``, ``_`` and ``.`` replaced by ``_``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[^\p{L}\p{N}_\-.]", "_")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def store_name(model: Column) -> Column:
    return F.translate(model, "/-", "__")


def preview(text: Column, n: int = 500) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def metric_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def score_text(value: Column) -> Column:
    """A score with four places; ``N/A`` for one that is missing."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "N/A").otherwise(F.format_string("%.4f", value.cast("double")))


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    """The template with both parts filled in; parts that look like placeholders stay as they are."""
    before, _, rest = template.partition("{context}")
    between, _, after = rest.partition("{question}")
    return F.concat(F.lit(before), context, F.lit(between), question, F.lit(after))
