"""Text preparation of items: normalization, digests, features, content checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blocks import block_similarity

OPTION_JSON = "array<struct<label:string,text:string>>"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def fold_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def normalize_text(text: Column, compatibility: bool = True) -> Column:
    """NFKC, one kind of newline, no trailing `Answer:`, single spaces. Works on whole texts."""
    t = nfkc(text) if compatibility else text
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"(^|\n)Answer:\s*$", "")
    return fold_space(t)


def preview(text: Column, limit: int = 180) -> Column:
    compact = fold_space(text)
    return F.when(F.length(compact) <= limit, compact).otherwise(
        F.concat(F.substring(compact, 1, limit - 1), F.lit("…")))


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def option_lines(options_json: Column) -> Column:
    """JSON options to the labelled option block, one line each."""
    options = F.from_json(options_json, OPTION_JSON)
    return F.array_join(F.transform(
        options, lambda o: F.concat(o["label"], F.lit(". "), F.regexp_replace(o["text"], r"\nAnswer:\s*$", ""))), "\n")


def content_match_status(question: Column, options_json: Column, problem: Column, minimum: float = 0.75) -> Column:
    """Class of a (target, problem) pair after normalization.

    Exact text, else the same option block with a similar stem, else a prefix
    variant, else no match. The edit distance is computed only when the cheap
    suffix test holds.
    """
    block = option_lines(options_json)
    target = normalize_text(F.concat(question, F.lit("\n"), block), False)
    seen = normalize_text(problem, False)
    tail = normalize_text(block, False)
    longest = F.greatest(F.length(target), F.length(seen))
    similarity = 1.0 - F.levenshtein(target, seen) / longest
    return (F.when(target == seen, "normalized_exact")
            .when(F.endswith(seen, tail), F.when(similarity >= minimum, "variant_same_options").otherwise("no_match"))
            .when(F.startswith(target, seen) | F.startswith(seen, target), "prefix_variant")
            .otherwise("no_match"))


# The wording of sentence problems.
SENTENCE_HEAD = "Choose the right option for a given sentence:\n"
OPTION_HEADS = ("Option 1: ", "Option 2: ")
BLANK = "_"


def sentence_template_status(question: Column, problem: Column, compatibility: bool = True) -> Column:
    """Class of a (question, problem) pair of the kind "fill the blank with one of two options".

    The last paragraph of the question has to be the sentence up to its blank with an option
    (blank_prefix), or a beginning of the whole sentence with an option in every blank (other_blank).
    """
    text = F.regexp_replace(nfkc(problem) if compatibility else problem, "\r\n", "\n")
    lines = F.split(F.substr(text, F.lit(len(SENTENCE_HEAD) + 1)), "\n")
    n = F.size(lines)
    sentence = F.array_join(F.slice(lines, 1, F.greatest(n - 2, F.lit(0))), "\n")
    ends = [F.get(lines, n - 2), F.get(lines, n - 1)]
    formed = F.startswith(text, F.lit(SENTENCE_HEAD)) & (n >= 3) & F.startswith(ends[0], F.lit(OPTION_HEADS[0])) & F.startswith(ends[1], F.lit(OPTION_HEADS[1]))
    options = [F.substr(e, F.lit(len(h) + 1)) for e, h in zip(ends, OPTION_HEADS, strict=True)]
    said = normalize_text(F.element_at(F.split(question, "\n\n"), -1), compatibility)
    begun = [normalize_text(F.concat(F.substring_index(sentence, BLANK, 1), o), compatibility) for o in options]
    filled = [normalize_text(F.replace(sentence, F.lit(BLANK), o), compatibility) for o in options]
    return (F.when(~formed, "other_template")
            .when((said == begun[0]) | (said == begun[1]), "blank_prefix")
            .when(F.startswith(filled[0], said) | F.startswith(filled[1], said), "other_blank")
            .otherwise("no_match"))


def block_match_status(question: Column, options_json: Column, problem: Column, minimum: float = 0.75) -> Column:
    """Status and similarity of a pair as by `content_match_status`, with similarity by matching blocks of the whole texts."""
    block = option_lines(options_json)
    target, seen = normalize_text(F.concat(question, F.lit("\n"), block)), normalize_text(problem)
    same, tail = target == seen, F.endswith(seen, normalize_text(block))
    likeness = F.when(same, 1.0).otherwise(block_similarity(F.when(tail & ~same, target), seen))
    return F.struct(F.when(same, "normalized_exact").when(tail & (likeness >= minimum), "variant_same_options").otherwise("no_match").alias("status"),
                    likeness.alias("similarity"))


# All space separators of Unicode, which SQL's trim takes off; Spark's takes off the plain space alone.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def source_family(source: Column) -> Column:
    low = F.lower(trimmed(source))
    return (F.when(low.startswith("ori"), "ori").when(low.startswith("stemez"), "stemez")
            .when(low.startswith("theoremqa"), "theoremQA").otherwise("unknown"))


def item_text(question: Column, options: Column) -> Column:
    """Question and non-blank options, one per line; no options (null) leave the question."""
    kept = F.filter(F.transform(options, trimmed), lambda o: o != "")
    return F.array_join(F.concat(F.array(trimmed(question)), F.coalesce(kept, F.array().cast("array<string>"))), "\n")


def question_text_join(items: DataFrame, texts: DataFrame, keys: Sequence[str], max_chars: int | None = None) -> DataFrame:
    """Text of each item with a status: found, missing or repeated key in the text table."""
    keys = list(keys)
    one = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.min("text").alias("_t"))
    t = F.col("_t") if max_chars is None else F.substring("_t", 1, max_chars)
    return items.join(one, keys, "left").withColumn("text", t).withColumn(
        "status", F.when(F.col("_c").isNull(), "missing").when(F.col("_c") > 1, "repeated").otherwise("found")).drop("_c", "_t")
