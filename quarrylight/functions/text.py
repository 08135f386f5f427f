"""Column expressions on text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of white space of any kind, no-break spaces included.
BLANKS = r"[\p{IsWhite_Space}\x1c-\x1f]+"

#: Namespace of DNS names in RFC 4122, a fixed value.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def squash(c: Column) -> Column:
    """Any run of white space becomes one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def fold(c: Column) -> Column:
    """Key form of a typed name: case and surplus blanks do not count."""
    return F.lower(squash(c))


def words(c: Column) -> Column:
    """Lexical terms: lower-cased runs without white space; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"(\S+)"), F.lit(1)), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def token_count(c: Column) -> Column:
    """Pieces of the default counter: word runs and single marks."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\w+|[^\w\s]")), F.lit(0))


def token_list(c: Column) -> Column:
    """The pieces in order, each with the blanks before it: joined they are the text up to its last piece."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"(\s*(?:\w+|[^\w\s]))"), F.lit(1)), F.array().cast("array<string>"))


def token_head(c: Column, budget: int) -> Column:
    """The text up to the end of its piece number ``budget``."""
    return F.array_join(F.slice(token_list(c), 1, budget), "")


def token_pages(c: Column, budget: int) -> Column:
    """Pages of at most ``budget`` pieces; each is a part of the text as it stands."""
    toks = token_list(c)
    n = F.size(toks)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(budget))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.regexp_replace(F.array_join(F.slice(toks, s + 1, F.lit(budget)), ""), r"^\s+", ""))


def overlap_tail(c: Column, n: int) -> Column:
    """The last ``n`` words, joined by blanks."""
    w = F.coalesce(F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1)), F.array().cast("array<string>"))
    return F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), F.lit(n)), " ")


def uuid5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
