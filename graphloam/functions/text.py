"""Text functions: lines, hashes, similarity, matches, words. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_PREFIX = "sha256-v2:"


def lines(text: Column) -> Column:
    """Lines of a text; a newline at the end gives an empty last line."""
    return F.split(text, "\r?\n", -1)


def hash_text(text: Column) -> Column:
    """The content hash: line ends made equal, nothing trimmed, 12 hex digits."""
    return F.concat(F.lit(HASH_PREFIX), F.substring(F.sha2(F.encode(F.regexp_replace(text, "\r\n", "\n"), "utf-8"), 256), 1, 12))


def slice_lines(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive; what is out of range is left out."""
    first = F.greatest(start, F.lit(1))
    return F.slice(all_lines, first, F.greatest(F.least(end, F.size(all_lines)) - first + 1, F.lit(0)))


def hash_range(all_lines: Column, start: Column, end: Column) -> Column:
    return hash_text(F.array_join(slice_lines(all_lines, start, end), "\n"))


def trimmed_lines(text: Column) -> Column:
    """Lines without blanks at their ends, empty ones left out."""
    return F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """The edit distance up to ``most``; most + 1 beyond."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of edit similarity and containment (0.5 and half the length ratio), ignoring case."""
    x, y = F.lower(a), F.lower(b)
    longest, shortest = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    edits = 1 - F.levenshtein(x, y) / F.greatest(longest, F.lit(1))
    within = F.when((shortest > 0) & (F.contains(x, y) | F.contains(y, x)), 0.5 + 0.5 * shortest / longest).otherwise(0.0)
    return F.greatest(edits, within).cast("double")


def size_similarity(a: Column, b: Column) -> Column:
    return (1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))).cast("double")


def combined_similarity(name: Column, size: Column) -> Column:
    return 0.65 * name + 0.35 * size


def literal_match(line: Column, needle: str, ignore_case: bool = False) -> Column:
    """struct(start, length) of the first occurrence, in UTF-16 units from 0; null if there is none."""
    hay, pin = (F.lower(line), F.lit(needle.lower())) if ignore_case else (line, F.lit(needle))
    at = F.locate(needle.lower() if ignore_case else needle, hay)
    return F.when(at > 0, F.struct(utf16_length(F.substring(hay, F.lit(1), at - 1)).alias("start"), utf16_length(pin).alias("length")))


def regex_match(line: Column, pattern: str) -> Column:
    """struct(start, length) of the first match; length and start null for a match of no width."""
    at, hit = F.regexp_instr(line, F.lit(pattern)), F.regexp_substr(line, F.lit(pattern))
    wide = F.length(hit) > 0
    return F.when(line.rlike(pattern), F.struct(F.when(wide, utf16_length(F.substring(line, F.lit(1), at - 1))).alias("start"), F.when(wide, utf16_length(hit)).alias("length")))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits for each character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def mask(value: Column) -> Column:
    """A hint of a value: at most 4 characters and at most a quarter of it."""
    return F.concat(F.substring(value, F.lit(1), F.least(F.lit(4), F.floor(F.length(value) / 4)).cast("int")), F.lit("…"))


# Parts and whole words that stand for a value which is not there.
PLACEHOLDER_PARTS = (
    "xxx", "changeme", "change_me", "change-me", "your", "example", "placeholder", "dummy", "sample", "redacted", "todo", "fixme", "replace",
    "insert", "<", ">", "${", "{{", "%(", "process.env", "environ", "getenv", "***", "...", "…",
)
PLACEHOLDER_WORDS = ("password", "secret", "pass", "admin", "root", "postgres")


def is_placeholder(value: Column) -> Column:
    """Whether a value only stands for one: a placeholder word, a part of one, or one character over and over."""
    low = F.lower(value)
    return low.isin(*PLACEHOLDER_WORDS) | F.exists(F.array(*[F.lit(p) for p in PLACEHOLDER_PARTS]), lambda p: F.contains(low, p)) | value.rlike(r"^(.)\1*$")


def looks_secret(value: Column) -> Column:
    """Whether a literal could be a real key: 8 to 200 characters, two kinds of them, entropy of 3 bits.

    Blanks, URLs, variables, placeholders and names of lower-case words with separators do not count.
    """
    without = lambda chars: F.length(F.translate(value, chars, "")) < F.length(value)
    small, capital, digit = (without("".join(chr(c) for c in range(ord(a), ord(z) + 1))) for a, z in ("az", "AZ", "09"))
    mark = value.rlike(r"[^\w./-]")
    kinds = small.cast("int") + capital.cast("int") + digit.cast("int") + mark.cast("int")
    # words joined by single separators: nothing but small letters and digits between them, and at least two of them
    words = F.split(value, "[-._:/]")
    joined = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike("^[a-z0-9]+$"))
    elsewhere = value.rlike(r"\s") | value.startswith("$") | value.contains("://")
    # what costs most is asked last
    return F.length(value).between(8, 200) & (kinds >= 2) & ~(elsewhere | joined | is_placeholder(value)) & (entropy(value) >= 3)


def identifier_words(name: Column) -> Column:
    """The words of an identifier: camelCase and snake_case taken apart, lower case."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(apart, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


# Words that carry no content.
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the their then this to was were which with".split()


def stem(word: Column) -> Column:
    """A word without the common English endings."""
    return F.regexp_replace(F.regexp_replace(word, "(?:ies)$", "y"), "(?<=[a-z]{3})(?:ing|ed|es|s)$", "")


def content_words(text: Column) -> Column:
    """Distinct stems of the words that are not stop words, in order of first use."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9']+"), 0)
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), lambda w: stem(w)))


def sentences(text: Column) -> Column:
    """Sentences by their closing marks, blanks trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def overlap(a: Column, b: Column) -> Column:
    """Shared content words by the smaller set."""
    return (F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))).cast("double")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def occurrences(text: Column, needle: Column) -> Column:
    """How often a text occurs in another, blanks collapsed in both, not overlapping."""
    hay, pin = collapse_blanks(text), collapse_blanks(needle)
    return F.when(F.length(pin) > 0, ((F.length(hay) - F.length(F.replace(hay, pin, F.lit("")))) / F.length(pin)).cast("int")).otherwise(0)
