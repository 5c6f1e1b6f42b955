"""Whether figures and quotes stand in a text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: words too common to tell what a claim is about.
STOP_WORDS = ("the", "was", "were", "is", "are", "in", "of", "for", "and", "a", "an", "to", "at", "on", "by", "with", "year", "over", "million", "billion", "thousand", "fiscal", "quarter", "grew", "growth", "had", "we", "our")
#: Fixed: turns that an agent run may take.
BASE_TURNS, TURNS_PER_CLAIM, MOST_TURNS = 6, 0.5, 30


def norm(text: Column) -> Column:
    """Lower case, with everything but a-z, 0-9 and spaces as spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " ")


def squeezed(text: Column) -> Column:
    """``norm`` with single spaces between words."""
    return F.trim(F.regexp_replace(norm(text), " +", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d]", "")


def digit_forms(raw: Column) -> Column:
    """The digit strings a figure may stand for: all digits, without zero decimals, and the integer part."""
    raw = F.coalesce(raw, F.lit(""))
    forms = F.array(digits(raw), digits(F.regexp_replace(raw, r"\.0+\b", "")), F.when(raw.contains("."), digits(F.substring_index(raw, ".", 1))).otherwise(""))
    return F.array_distinct(F.filter(forms, lambda f: f != ""))


def figure_retrievable(raw: Column, content_digits: Column, whole_numbers: Column | None = None) -> Column:
    """Whether some digit form is a substring of the digits of the content; with ``whole_numbers``, an array, one of its elements."""
    if whole_numbers is not None:
        return F.arrays_overlap(digit_forms(raw), whole_numbers)
    return F.exists(digit_forms(raw), lambda f: F.contains(content_digits, f))


def quote_retrievable(quote: Column, content_words: Column, min_words: int = 3) -> Column:
    """Whether the quote, of ``min_words`` words or more, stands in squeezed content."""
    return (F.size(words(quote)) >= min_words) & F.contains(content_words, squeezed(quote))


def claim_terms(text: Column) -> Column:
    """The distinct telling words of a claim."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)))


def relevant(claim_text: Column, quote: Column, found: Column, titles: Column) -> Column:
    """Whether any telling word of the claim stands in the finding; true where there is none."""
    terms = claim_terms(claim_text)
    hay = norm(F.concat_ws(" ", F.coalesce(quote, F.lit("")), F.coalesce(found, F.lit("")), titles))
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(hay, t))


def turn_budget(n_claims: Column) -> Column:
    return F.least(F.lit(MOST_TURNS), BASE_TURNS + F.floor(n_claims * TURNS_PER_CLAIM).cast("int"))
