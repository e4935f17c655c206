"""Text scalars as columns: tokens, sentences, normal forms and text checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
METRIC_WORD = r"[\p{L}\p{N}_\x{0400}-\x{04ff}]+"
#: Words that metrics leave out, by language.
STOP_WORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "how", "i", "in", "is", "it", "my", "of", "on", "the", "to", "with", "you", "your"],
    "ru": ["а", "без", "в", "вы", "для", "и", "из", "как", "к", "ли", "мой", "на", "не", "о", "по", "с", "у", "что", "это", "я"],
}
#: Patterns that the text checks look for.
API_ERRORS = ["api_quota_exceeded", "rate_limit", "quota", "api key", "authentication", "permission denied", "access denied", "forbidden", "429", "503", "timeout"]
REFUSALS = [
    "safety",
    "refusal",
    "policy",
    "violation",
    "content policy",
    "cannot answer",
    "not appropriate",
    "harmful",
    "offensive",
    "unsafe",
    "sensitive",
    "inappropriate",
    "not allowed",
    "prohibited",
    "restrict",
]
CUT_SHORT = [r"\.\.\.$", r"\[TRUNCATED\]", r"…$", r"\[...\]$"]
TRAILING_MARK = r"(?i)(?:\.\.\.|…|\[TRUNCATED\]|\[\.\.\.\])$"
#: White space as Python has it, as characters and as ranges of a character class.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Lower-cased word tokens of a text (null: none), for retrieval: nothing is left out."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def metric_words(text: Column) -> Column:
    """Lower-cased tokens of a text, stop words among them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(METRIC_WORD), F.lit(0))


def metric_tokens(text: Column, language: Column) -> Column:
    """Lower-cased tokens of a text without its language's stop words; other or null languages have none."""
    found = metric_words(text)
    without = lambda stop: F.filter(found, lambda w: ~w.isin(stop))
    kept = {code: without(stop) for code, stop in STOP_WORDS.items()}
    return F.when(language == "en", kept["en"]).when(language == "ru", kept["ru"]).otherwise(found)


def sentences(text: Column) -> Column:
    """Stripped sentences that aren't empty: text is split after . ! ? and white space, and at line ends."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?])[{SPACE}]+|[\r\n]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def distinct_tokens(text: Column, language: Column) -> Column:
    """The different metric_tokens() of a text."""
    found = metric_words(text)
    kept = {code: F.array_except(found, F.lit(stop)) for code, stop in STOP_WORDS.items()}
    return F.when(language == "en", kept["en"]).when(language == "ru", kept["ru"]).otherwise(F.array_distinct(found))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def runs(text: Column) -> Column:
    """The runs of other characters than white space. Plain splitting at one sign: patterns of so many signs are slow."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def normal_form(text: Column) -> Column:
    """Lower case, stripped, white space collapsed: the key of equal contents."""
    return F.array_join(runs(F.lower(F.coalesce(text, F.lit("")))), " ")


def blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space."""
    return ~F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def ends_marked(text: Column) -> Column:
    """Whether a text ends with a mark of truncation, white space aside."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(11)).rlike(TRAILING_MARK)


def word_count(text: Column) -> Column:
    """The fallback token counter: runs of non-space characters, one at least."""
    return F.greatest(F.lit(1), F.size(runs(F.coalesce(text, F.lit("")))))


def readable(text: Column) -> Column:
    """Whether over 0.7 of the characters are word characters, white space or plain punctuation."""
    kept = F.length(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{SPACE}.,!?;:'\"()\-\x{{0400}}-\x{{04ff}}]", ""))
    return F.coalesce(kept / F.nullif(F.length(text), F.lit(0)) > 0.7, F.lit(False))


def cut_short(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(CUT_SHORT)), F.lit(False))


def api_error(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(API_ERRORS)), F.lit(False))


def refusal(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(REFUSALS)), F.lit(False))
