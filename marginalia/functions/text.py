"""Words, tokens and languages of a text column. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What counts as a word, a word of a chunk, and a token of a chunk
WORD = r"https?://\S+|[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*"
TECHNICAL = r"^https?://|_|[\p{Nd}²³¹⁰-⁹₀-₉]"
CHUNK_WORD = r"[\p{L}\p{N}_]+"
CHUNK_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
DELIMITERS = r"(!?)(\[\[|\]\]|`{1,3}|\*\*|__|[*_#])"
LANGUAGES = ("russian", "english", "mixed_or_other", "unknown")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def words(text: Column) -> Column:
    """Natural words: no URLs, no identifiers with underscores, no word with a digit."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(TECHNICAL))


def language(word: Column) -> Column:
    """russian, english, mixed_or_other or unknown, by the alphabets in a word."""
    low = F.lower(word)
    cyrillic, latin = low.rlike("[а-я]"), low.rlike("[a-z]")
    return F.when(~word.rlike(r"\p{L}"), "unknown").when(cyrillic & latin, "mixed_or_other").when(cyrillic, "russian").when(latin, "english").otherwise("mixed_or_other")


_OTHER = r"_:\p{Nd}²³¹⁰-⁹₀-₉"  # what no natural word holds; a URL has a colon


def word_line(text: Column) -> Column:
    """All words of a text in lower case, technical ones too, parted by single spaces: a line that regular expressions count words in."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " "))


def _count(line: Column, none_of: str, one_of: str = "") -> Column:
    """Words of a line without a character of ``none_of`` and, where given, with one of ``one_of``."""
    ahead = f"(?=[^ {one_of}]*[{one_of}])" if one_of else ""
    return F.regexp_count(line, F.lit(f"(?<![^ ]){ahead}[^ {none_of}]++(?![^ ])")).cast("long")


def natural_word_count(text: Column) -> Column:
    return _count(word_line(text), _OTHER)


def language_counts(line: Column) -> list[Column]:
    """word_count and four columns of counts by language over a ``word_line``."""
    every, counts = _count(line, _OTHER), [_count(line, _OTHER + "a-z", "а-я"), _count(line, _OTHER + "а-я", "a-z"), _count(line, _OTHER + r"\p{L}")]
    russian, english, unknown = counts
    named = dict(zip(LANGUAGES, (russian, english, every - russian - english - unknown, unknown)))
    return [every.alias("word_count")] + [c.alias(f"{k}_word_count") for k, c in named.items()]


def analysis_text(text: Column) -> Column:
    """The text without Markdown delimiters."""
    return F.regexp_replace(text, DELIMITERS, "")


def chunk_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CHUNK_WORD)).cast("long")


def chunk_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CHUNK_TOKEN)).cast("long")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the stripped characters, rounded up; 0 for blank text."""
    return F.ceil(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def safe_ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)
