"""Code tokens, lines, identities and citations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Breaks of lines, with their ends kept.
_BREAKS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029"
LINE = rf"[^{_BREAKS}]*(?:\r\n|[{_BREAKS}])|[^{_BREAKS}]+\z"
# Tokens and identities depend on these.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
BOUNDARY = "(?<=[a-z0-9])(?=[A-Z])"
POINT_NAMESPACE = "0de7d8c3591048bbbd81cc78732cc1ad"
SEPARATOR = "\x1f"


def lines(text: Column) -> Column:
    """The lines of a text with their line ends; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def code_tokens(text: Column) -> Column:
    """Identifiers and numbers in lower case, each followed by its snake_case and camelCase components that differ from it."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def parts(word: Column) -> Column:
        split = F.split(F.lower(F.translate(F.regexp_replace(word, BOUNDARY, " "), "_", " ")), " +")
        several = F.concat(F.array(F.lower(word)), F.filter(split, lambda x: (x != "") & (x != F.lower(word))))
        return F.when(word.contains("_") | word.rlike(BOUNDARY), several).otherwise(F.array(F.lower(word)))

    # most texts have no word of several parts: then no word is looked at alone
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.regexp_extract_all(F.translate(text, letters, letters.lower()), F.lit(TOKEN), F.lit(0))
    return F.when(has_parts(text), F.flatten(F.transform(words, parts))).otherwise(plain)


def has_parts(text: Column) -> Column:
    """Whether words of the text may have several components."""
    return text.contains("_") | text.rlike("[a-z0-9][A-Z]")


def searchable_text(path: Column, symbol: Column, content: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", some(path), some(symbol), some(content))


def chunk_id(repository: Column, path: Column, start: Column, end: Column, symbol: Column, kind: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, repository, path, start.cast("string"), end.cast("string"), F.coalesce(symbol, F.lit("")), kind, content), 256)


def point_id(chunk: Column) -> Column:
    """The name-based UUID (version 5) of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(chunk, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def repository_id(url: Column) -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.sha2(url, 256), 1, 16))


def cited_ids(answer: Column, known: Column) -> Column:
    """The known ids that an answer cites as [id], each once, in order of first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.array_contains(known, x)))


def without_unknown_citations(answer: Column, known: Column) -> Column:
    """The answer without markers of unknown ids, in one pass: what removal joins is not looked at again."""
    between = F.split(answer, r"\[\d+\]", -1)
    ids = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    kept = F.transform(ids, lambda x: F.when(F.array_contains(known, x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(""))
    return F.array_join(F.zip_with(between, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
