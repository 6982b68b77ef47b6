"""Text columns: cleaning, boilerplate, searchable text, analysis, quoting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Every Unicode white-space character, so that all engines split alike.
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Fixed values. A word is letters, marks, digits and underscores, joined inside by an
# apostrophe or a full stop.
TERM = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
# Fixed values. Scripts written without spaces: each ideograph and each hiragana sign is a word of
# its own, and so is a run of katakana. Longer words than this are cut, in code points.
ALONE = r"([\p{IsHan}\p{IsHiragana}]\p{M}*|[\p{IsKatakana}\x{30fc}\x{ff70}][\p{IsKatakana}\x{30fc}\x{ff70}\x{ff9e}\x{ff9f}\p{M}]*)"
LONGEST_TERM = 255

# Fixed values. Edit comments that say nothing about the page.
BOILERPLATE = [
    r"(?i)use american english",
    r"(?i)use british english",
    r"(?i)\[\[mos:",
    r"(?i)added .+ template",
    r"(?i)categor(?:y|ies) added",
    r"^/\*.*\*/$",
    r"(?i)^revert(?:ed|ing)?(?:$|[^\p{L}\p{N}_])",
    r"(?i)^undid revision(?:$|[^\p{L}\p{N}_])",
]

# Title, stored comment, summary and body limits, in code points.
TITLE_LIMIT = 512
TITLE_KEY_LIMIT = 191
COMMENT_LIMIT = 2000
SUMMARY_LIMIT = 1000
BODY_SUMMARY_LIMIT = 800
BODY_COMMENT_LIMIT = 400

BODY_SEPARATOR = " — "


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Trim, and turn each run of white space into one space; null becomes empty."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITESPACE}+", " ")
    return F.trim(spaced)


def words(text: Column) -> Column:
    """White-space separated words, in order, without empty ones."""
    return F.filter(F.split(text, f"{WHITESPACE}+"), lambda word: word != "")


def is_boilerplate(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{pattern})" for pattern in BOILERPLATE))


def clean_comment(comment: Column) -> Column:
    """The squeezed comment, or an empty string when it is boilerplate."""
    return let(
        squeeze(comment),
        lambda text: F.when(is_boilerplate(text), F.lit("")).otherwise(text),
    )


def cut(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def searchable_text(title: Column, summary: Column, comment: Column) -> Column:
    """Text given to the vector model: the title twice, then the summary, or failing that
    the cleaned comment."""
    name = strip(F.coalesce(title, F.lit("")))
    lead = none_if_empty(squeeze(summary))
    note = none_if_empty(clean_comment(comment))
    head = F.when(name != "", F.concat_ws(" ", name, name))
    body = F.coalesce(cut(lead, BODY_SUMMARY_LIMIT), cut(note, BODY_COMMENT_LIMIT))
    return strip(F.concat_ws(BODY_SEPARATOR, head, body))


def analyse(text: Column) -> Column:
    """Lower-cased terms in order, repeats kept."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ALONE, " $1 ")

    def pieces(term: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(term), F.lit(LONGEST_TERM))
        return F.transform(starts, lambda at: term.substr(at, F.lit(LONGEST_TERM)))

    return let(
        F.regexp_extract_all(spaced, F.lit(TERM), F.lit(0)),
        lambda terms: F.when(
            F.exists(terms, lambda term: F.length(term) > LONGEST_TERM), F.flatten(F.transform(terms, pieces))
        ).otherwise(terms),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_lengths(values: Column, name: str, count: str) -> Column:
    """Distinct values of an array with their counts, in value order, without a shuffle.

    Sorting brings equal values together; a run starts where a value differs from the one
    before it.
    """

    def measured(ordered: Column, begin: Column) -> Column:
        return F.transform(
            begin,
            lambda i, at: F.struct(
                F.get(ordered, i - 1).alias(name),
                (F.coalesce(F.get(begin, at + 1), F.size(ordered) + 1) - i).alias(count),
            ),
        )

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )
        return F.when(F.size(ordered) > 0, let(starts, lambda begin: measured(ordered, begin)))

    return let(F.sort_array(values), runs)


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes, or double when it holds only single ones."""
    double = text.contains("'") & ~text.contains('"')
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single_body = F.replace(body, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), single_body, F.lit("'"))
    )
