"""Scalar text semantics as column expressions, all on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Parts of a mixed-case identifier; needs lookahead, so it has no RE2 form.
CAMEL = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|_|$)|[A-Z]?[a-z]+|[0-9]+"

# Words that carry no evidence in a query, and those of them that are program concepts all the same.
STOPWORDS = frozenset(
    """a an the and or but if then else for while of in on at to from by with without
    what which who whom whose when where why how is are was were be been being do
    does did done have has had having can could should would may might must will
    shall this that these those it its as not no yes into about over under again
    value values return returns get set use used using exactly exact configured""".split()
)
CODE_WORDS = frozenset("value values return returns get set use used using exactly exact configured".split())
FUNCTION_WORDS = STOPWORDS - CODE_WORDS


def product_tokens(text: Column) -> Column:
    """Estimate of one text: a quarter of its code points, 1 at least (an empty text is 1)."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def context_tokens(chars: Column, passages: Column) -> Column:
    """Estimate of several passages joined by two characters each: 0 for none."""
    joined = F.greatest(F.lit(1), F.floor((chars + 2 * (passages - 1)) / 4))
    return F.when(passages > 0, joined).otherwise(0).cast("long")


def legacy_tokens(text: Column) -> Column:
    """The older estimate: code points over 3.8, 1 at least, 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(3.8)))).cast("long")


def physical_lines(text: Column) -> Column:
    """Lines by CR LF, CR or LF only; one empty line at the end is no line."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def words(text: Column) -> Column:
    """Runs of Unicode letters, numbers and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _fold_table() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and their bases."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics: what the index compares."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def folded_words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def analyzed_terms(text: Column) -> Column:
    """Every word in lower case, followed by its parts (at underscores and case changes) where it has more than one."""

    def of_piece(piece: Column) -> Column:
        parts = F.regexp_extract_all(piece, F.lit(CAMEL), F.lit(0))
        return F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(F.array(F.lower(piece)))

    def of_word(word: Column) -> Column:
        whole, pieces = F.lower(word), F.flatten(F.transform(F.split(word, "_"), of_piece))
        kept = F.filter(pieces, lambda p: (p != "") & (p != whole))
        return F.when(F.size(pieces) > 1, F.concat(F.array(whole), kept)).otherwise(F.array(whole))

    return F.flatten(F.transform(words(text), of_word))


def explicit_literals(query: Column) -> Column:
    """Back-ticked names in lower case, dotted ones followed by their components, first occurrences in order."""
    found = F.regexp_extract_all(query, F.lit(r"(?<!`)`([\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*)`(?!`)"), F.lit(1))
    split = F.transform(found, lambda x: F.when(x.contains("."), F.concat(F.array(x), F.split(x, r"\."))).otherwise(F.array(x)))
    return F.array_distinct(F.transform(F.flatten(split), F.lower))


def lexical_terms(query: Column) -> Column:
    """Query terms: analysed terms that are no function words and longer than one character, and all explicit literals."""
    explicit, function = explicit_literals(query), F.array(*map(F.lit, sorted(FUNCTION_WORDS)))
    kept = F.filter(analyzed_terms(query), lambda t: ((F.length(t) > 1) & ~F.array_contains(function, t)) | F.array_contains(explicit, t))
    return F.array_distinct(F.concat(kept, explicit))


def whole_terms(query: Column) -> Column:
    """Query terms before identifiers are taken apart."""
    explicit, function = explicit_literals(query), F.array(*map(F.lit, sorted(FUNCTION_WORDS)))
    lowered = F.transform(words(query), F.lower)
    kept = F.filter(lowered, lambda t: ((F.length(t) > 1) & ~F.array_contains(function, t)) | F.array_contains(explicit, t))
    return F.array_distinct(F.concat(kept, explicit))


def content_terms(query: Column) -> Column:
    """Terms that coverage is measured by: lower-cased words, parts at underscores and between letters and digits, over two
    characters, no function words. Lower-casing comes first, so case changes do not part words here."""
    tokens = words(F.lower(query))
    at_underscores = F.flatten(F.transform(tokens, lambda t: F.when(t.contains("_"), F.filter(F.split(t, "_"), lambda p: F.length(p) > 2)).otherwise(F.array().cast("array<string>"))))

    def runs(token: Column) -> Column:
        parts = F.regexp_extract_all(token, F.lit(r"[a-z]+|[0-9]+"), F.lit(0))
        return F.when(F.size(parts) > 1, F.filter(parts, lambda p: F.length(p) > 2)).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(tokens, at_underscores, F.flatten(F.transform(tokens, runs))))
    function = F.array(*map(F.lit, sorted(FUNCTION_WORDS)))
    return F.filter(every, lambda t: (F.length(t) > 2) & ~F.array_contains(function, t))


def identifier_candidates(query: Column) -> Column:
    """Names that a query may be about: ASCII identifiers of three characters or more, dotted ones with their components."""
    found = F.regexp_extract_all(query, F.lit(r"[A-Za-z_][A-Za-z0-9_.]{2,}"), F.lit(0))
    split = F.transform(found, lambda x: F.when(x.contains("."), F.concat(F.array(x), F.filter(F.split(x, r"\."), lambda p: F.length(p) > 2))).otherwise(F.array(x)))
    return F.array_distinct(F.flatten(split))


def short_hash(value: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)
