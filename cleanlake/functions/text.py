"""Text cleaning as column expressions; all of them work on whole values and stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space, digits and word characters in the Unicode sense
WS = r"(?U)\s"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

# fixed values: patterns
URL_RE = r"http\S+|www\S+|https\S+"
EMAIL_RE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_RE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
HTML_RE = r"<[^<>]*>"

# fixed values: words skipped by the keyword report
COMMON_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
]

# fixed values: contractions and their long forms
CONTRACTIONS = {
    "won't": "will not", "can't": "cannot", "shan't": "shall not", "let's": "let us", "n't": " not", "'re": " are",
    "'ve": " have", "'ll": " will", "'m": " am", "it's": "it is", "that's": "that is", "he's": "he is", "she's": "she is",
}

# fixed values: frequent function words per language
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "as", "his", "on", "be", "at", "by"],
    "fr": ["le", "la", "les", "et", "des", "du", "une", "est", "dans", "que", "pour", "qui", "sur", "pas", "avec"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von", "auf", "dem", "sich"],
    "es": ["el", "los", "las", "y", "del", "una", "es", "que", "por", "con", "para", "se", "su", "como", "más"],
}


def strip(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "^(?U)\\s+", ""), "(?U)\\s+$", "")


def collapse_spaces(x: Column) -> Column:
    return F.regexp_replace(x, WS + "+", " ")


def standardize_ws(x: Column) -> Column:
    return F.trim(collapse_spaces(x))


def lower(x: Column) -> Column:
    return F.lower(x)


def upper(x: Column) -> Column:
    return F.upper(x)


def title(x: Column) -> Column:
    """Upper case at the start and after each blank; other white space does not count."""
    return F.initcap(x)


def sentence(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))


def remove_numbers(x: Column) -> Column:
    return F.regexp_replace(x, DIGIT + "+", "")


def remove_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s]", "")


def remove_special(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^a-zA-Z0-9\s]", "")


def remove_urls(x: Column) -> Column:
    return F.regexp_replace(x, URL_RE, "")


def remove_emails(x: Column) -> Column:
    return F.regexp_replace(x, EMAIL_RE, "")


def remove_phones(x: Column) -> Column:
    return F.regexp_replace(x, PHONE_RE, "")


def remove_html(x: Column) -> Column:
    return F.regexp_replace(x, HTML_RE, "")


def words(x: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(x, WS + "+"), lambda w: w != "")


def unique_words(x: Column) -> Column:
    return F.array_join(F.array_distinct(words(x)), " ")


def custom_regex(x: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(x, pattern, replacement)


def line_breaks(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n|\r|\n", " ")


def fix_quotes(x: Column) -> Column:
    return F.translate(x, "’“”", "'\"\"")


def remove_stopwords(x: Column, stop: list[str] | None = None) -> Column:
    return F.array_join(F.filter(words(x), lambda w: ~F.lower(w).isin(stop or COMMON_WORDS)), " ")


def expand_contractions(x: Column) -> Column:
    """Longest first; whole words only at the start of a word, endings anywhere. Any case is matched and the long form is lower case."""
    order = sorted(CONTRACTIONS, key=lambda k: (-len(k), k))
    start = lambda k: "" if k.startswith("'") or k == "n't" else r"(?<![\p{L}])"
    return reduce(lambda acc, k: F.regexp_replace(acc, "(?i)" + start(k) + k + r"(?![\p{L}])", CONTRACTIONS[k]), order, x)


def char_words(x: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"({WORD}+)"), F.lit(1))


def readability(x: Column) -> Column:
    """Flesch reading ease from sentence ends, words and vowel groups."""
    n_words = F.regexp_count(x, F.lit(WORD + "+")).cast("double")
    sentences = F.greatest(F.regexp_count(x, F.lit("[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(x, F.lit("[aeiouyAEIOUY]+")), F.lit(1))
    return F.when(n_words > 0, F.lit(206.835) - F.lit(1.015) * n_words / sentences - F.lit(84.6) * syllables / n_words)


def language_shares(x: Column, lexicon: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Occurrences of each language's function words."""
    low = F.lower(x)
    return {k: F.regexp_count(low, F.lit(r"(?<![\p{L}])(" + "|".join(v) + r")(?![\p{L}])")) for k, v in (lexicon or LANGUAGE_WORDS).items()}


def language(x: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Language with most function words; ties by code, none found -> null."""
    scores = language_shares(x, lexicon)
    best = F.array_max(F.array(*[F.struct(s.alias("n"), (-F.lit(i)).alias("rank"), F.lit(k).alias("code")) for i, (k, s) in enumerate(sorted(scores.items()))]))
    return F.when(best["n"] > 0, best["code"])


OPERATIONS = {
    "lowercase": lower, "uppercase": upper, "title": title, "sentence": sentence, "strip": strip, "collapse_spaces": collapse_spaces,
    "remove_extra_spaces": standardize_ws, "remove_numbers": remove_numbers, "remove_punctuation": remove_punctuation,
    "remove_special_chars": remove_special, "remove_urls": remove_urls, "remove_emails": remove_emails, "remove_phones": remove_phones,
    "remove_html": remove_html, "unique_words": unique_words, "line_breaks": line_breaks, "fix_quotes": fix_quotes,
    "remove_stopwords": remove_stopwords, "expand_contractions": expand_contractions,
}


def chain(x: Column, operations: list[str]) -> Column:
    return reduce(lambda acc, op: OPERATIONS[op](acc), operations, x)
