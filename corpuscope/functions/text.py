"""Column expressions on text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from corpuscope.fixed_values import DESCRIPTION_WORDS, KEYWORDS, TOPIC_KEYWORDS, TRANSCRIPT_WORDS
from corpuscope.functions.scalars import literal_map

# White space as Python's str.split() and \s see it: the Unicode property plus four separators.
# Java's plain \s is ASCII only.
SPACE = r"(?U)[\s\x1c-\x1f]"
NON_SPACE = r"(?U)[^\s\x1c-\x1f]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def words(col: Column) -> Column:
    """White-space separated words; NULL or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), f"{SPACE}+"), "")


def word_count(col: Column) -> Column:
    """Words of a text, 0 for NULL or blank; counts matches without building the words."""
    return F.coalesce(_count_words(col), F.lit(0))


def truncate_words(col: Column, limit: int) -> Column:
    """The first ``limit`` words joined by blanks; splitting stops there."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), f"^{SPACE}+", "")
    parts = F.slice(F.split(text, f"{SPACE}+", limit + 1), 1, limit)
    return F.array_join(F.array_remove(parts, ""), " ")


def clean_text(col: Column) -> Column:
    """Drop ``[...]`` marks within a line, squeeze white space, trim; NULL gives ''."""
    text = F.coalesce(col, F.lit(""))
    unmarked = F.when(text.contains("["), F.regexp_replace(text, r"\[[^\n]*?\]", "")).otherwise(text)
    return F.trim(F.regexp_replace(unmarked, f"{SPACE}+", " "))


def not_contains(col: Column, needle: str) -> Column:
    """True where ``needle`` does not occur; NULL text is kept."""
    return ~F.coalesce(col.contains(needle), F.lit(False))


def tag_count(col: Column) -> Column:
    """Elements of a comma list; NULL counts 0, 'N/A' counts 1."""
    return F.when(col.isNull(), 0).otherwise(F.size(F.split(col, ",")))


def split_trim(col: Column) -> Column:
    return F.transform(F.split(col, ","), lambda k: strip(k))


def topics_of(col: Column, topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> Column:
    """Sorted distinct topics of a comma list of keywords; no topic gives an empty array."""
    by_keyword: dict[str, list[str]] = {}
    for topic, keywords in topics.items():
        for keyword in keywords:
            by_keyword.setdefault(keyword, []).append(topic)
    lookup = literal_map(by_keyword)
    empty = F.array().cast("array<string>")
    found = F.transform(split_trim(col), lambda k: F.coalesce(F.try_element_at(lookup, k), empty))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(found))), empty)


PROMPT_TEMPLATE = (
    "Decide whether the video described below is instructional and covers at least one keyword of the list.\n"
    "Answer 1 if it does, otherwise 0. News, advertising and legal commentary do not count.\n"
    "Title: %s\nDescription: %s\nTranscript: %s\nKeywords: "
)


def build_prompt(
    title: Column, description: Column, transcript: Column,
    keywords: Sequence[str] = tuple(KEYWORDS), template: str = PROMPT_TEMPLATE,
    description_words: int = DESCRIPTION_WORDS, transcript_words: int = TRANSCRIPT_WORDS,
) -> Column:
    """Labelling prompt; ``template`` has three ``%s`` and is followed by the keyword list."""
    listing = "[" + ", ".join(f'"{k}"' for k in keywords) + "]"
    return F.concat(
        F.format_string(
            template, F.coalesce(title, F.lit("")),
            truncate_words(description, description_words), truncate_words(transcript, transcript_words),
        ),
        F.lit(listing),
    )


def parse_label(reply: Column) -> Column:
    """Integer label of a reply, NULL when the reply is not an integer."""
    return strip(reply).try_cast("int")


def transcript_type(is_generated: Column, translated_from: Column) -> Column:
    source = F.when(is_generated, "auto-generated").otherwise("creator-uploaded")
    return F.when(
        translated_from.isNotNull(), F.concat(source, F.lit(" (Translated from "), translated_from, F.lit(")"))
    ).otherwise(source)


def sentence_count(col: Column) -> Column:
    """Runs of closing punctuation that end a word; text without any is one sentence."""
    return F.greatest(F.lit(1), F.regexp_count(col, F.lit(r"[.!?]+(\s|$)")))


def _count_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(f"{NON_SPACE}+"))


def syllable_count(col: Column) -> Column:
    """Vowel groups per word, at least one for each word.

    No vowel group spans a blank, so the groups of the whole text plus its vowel-free
    words give the sum over words without splitting the text.
    """
    groups = F.regexp_count(col, F.lit("[aeiouyAEIOUY]+"))
    with_vowel = F.regexp_count(col, F.lit(r"(?U)[aeiouyAEIOUY][^\s\x1c-\x1f]*+"))
    return groups + _count_words(col) - with_vowel


def char_count(col: Column) -> Column:
    return F.length(col) - F.regexp_count(col, F.lit(SPACE))


# The word count occurs several times below, outside any condition, so that Spark evaluates it once.

def readability_fk(col: Column) -> Column:
    """Flesch-Kincaid grade: 0.39 W/S + 11.8 Syl/W - 15.59; empty text gives NULL."""
    n = _count_words(col).cast("double")
    return 0.39 * n / sentence_count(col) + F.try_divide(11.8 * syllable_count(col), n) - 15.59


def readability_ari(col: Column) -> Column:
    """Automated readability index: 4.71 C/W + 0.5 W/S - 21.43; empty text gives NULL."""
    n = _count_words(col).cast("double")
    return F.try_divide(4.71 * char_count(col), n) + 0.5 * n / sentence_count(col) - 21.43
