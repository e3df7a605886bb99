"""Text functions, all of them JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words and the token pattern.
STOPWORDS = ("a", "an", "the", "and", "or", "but", "if", "because", "as", "of", "at", "by", "for", "with", "about", "to", "in", "on", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "these", "those")
TOKEN = r"[a-z0-9][a-z0-9\-']*"
# The words of the rule router.
COMPARISON = ("compare", "comparison", "both", "differ", "similar", "versus", "vs.", "unlike")
CONJUNCTIONS = ("and", "or", "which", "whom")
#: Asks a chat model for a question's label; any wording that yields one of the three words will do.
PROMPT = (
    "You judge how hard it is to retrieve what a question needs.  Reply with one word only.\n"
    "Say easy when a plain vector search would list every needed document among its first three, medium when a better "
    "search would have them among its first ten, and hard when neither is likely.\n\n%s"
)


def raw_tokens(text: Column) -> Column:
    """All tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens of more than one character that are no stop words."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def first_words(text: Column, n: int = 48) -> Column:
    """The first n white-space words, joined by single spaces."""
    # what lies behind them is not divided: text may begin with an empty word
    return F.array_join(F.slice(F.filter(F.slice(F.split(text, r"\s+", n + 2), 1, n + 1), lambda w: w != ""), 1, n), " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a word occurs anywhere in the text, inside other words too."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def entity_count(text: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_count(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"))


def parsed_label(answer: Column) -> Column:
    """The first of easy, medium, hard that stands as a word in the answer, else null."""
    return F.nullif(F.regexp_extract(F.lower(answer), r"\b(easy|medium|hard)\b", 1), F.lit(""))


def label_or_easy(answer: Column) -> Column:
    return F.coalesce(parsed_label(answer), F.lit("easy"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def prompt(question: Column) -> Column:
    return F.format_string(PROMPT, F.coalesce(question, F.lit("")))


def hash16(text: Column) -> Column:
    """A number from 0 to 65535 from the first four hexadecimal digits of the md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("bigint")


def padded_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}%06d", number.cast("bigint"))


def scaled(score: Column) -> Column:
    """A score in whole billionths, so that order and equality do not hang on the order of a sum."""
    return F.round(score * 1e9).cast("bigint")


def sentence_bucket(n: Column) -> Column:
    """3+ for three supporting sentences and more, else 2; null where their number is not known."""
    return F.when(n >= 3, "3+").when(n.isNotNull(), "2")


def positive_probability(negative: Column, positive: Column) -> Column:
    """Softmax of two logits, for the positive class."""
    return 1 / (1 + F.exp(negative.cast("double") - positive.cast("double")))
