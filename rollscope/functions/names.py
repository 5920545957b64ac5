"""Name rules as column expressions; Catalyst inlines them, so no name passes through Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rollscope.constants import DISPLAY_NAMES, MALE, NO_FIRST, NO_LAST, UNREADABLE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends (trim() takes plain blanks only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column | str) -> Column:
    return F.lower(strip(c))


def tokens(c: Column | str) -> Column:
    """Tokens between white space, none empty; null gives null."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda t: t != "")


def is_predictable(c: Column | str) -> Column:
    """Letters only, an ASCII one among them, three or more; combining signs are not letters."""
    c = _col(c)
    return c.rlike(r"^\p{L}+$") & c.rlike("(?i)[a-z]") & (F.length(c) > 2)


def is_corpus_name(c: Column | str) -> Column:
    return is_predictable(F.lower(_col(c)))


def is_ascii_name(c: Column | str) -> Column:
    return _col(c).rlike("^[A-Za-z]+$") & (F.length(_col(c)) > 2)


def is_full_name(c: Column | str) -> Column:
    """Letters, white space, apostrophes and hyphens; null is false."""
    return F.coalesce(_col(c).rlike(r"^[a-zA-Z\s'-]+$"), F.lit(False))


def last_name_fallback(name: Column | str, relative: Column | str) -> Column:
    """The last token of the name, or else of the relative's name, if there is more than one; else LNU."""
    own = tokens(F.coalesce(_col(name), F.lit(NO_FIRST)))
    other = tokens(F.coalesce(_col(relative), F.lit(NO_FIRST)))
    last = lambda t: F.element_at(t, -1)
    return F.when(F.size(own) > 1, last(own)).when(F.size(other) > 1, last(other)).otherwise(F.lit(NO_LAST))


def full_name(name: Column | str, relative: Column | str) -> Column:
    """First token and last name; a null name is FNU LNU; a blank one, which has no token, gives null."""
    own = tokens(F.coalesce(_col(name), F.lit(f"{NO_FIRST} {NO_LAST}")))
    other = tokens(F.coalesce(_col(relative), F.lit(NO_LAST)))
    last = (
        F.when(F.size(own) > 1, F.element_at(own, -1))
        .when(F.size(other) > 1, F.element_at(other, -1))
        .otherwise(F.lit(NO_LAST))
    )
    return F.when(F.size(own) > 0, F.concat_ws(" ", F.get(own, F.lit(0)), last))


def last_name_household(name: Column | str, relative: Column | str) -> Column:
    """The last token both names share as their last, if each has several and it has over two letters."""
    own, other = tokens(name), tokens(relative)
    last = F.element_at(own, -1)
    agree = (F.size(own) > 1) & (F.size(other) > 1) & (last == F.element_at(other, -1)) & (F.length(last) > 2)
    return F.when(agree, last)


def last_name_shared(name: Column | str, relative: Column | str) -> Column:
    """The first token of the name that is also in the relative's, lower-cased, of three letters or more."""
    shared = F.lower(F.get(F.array_intersect(tokens(name), tokens(relative)), F.lit(0)))
    return F.when(F.length(shared) >= 3, shared)


def clean_language(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "hindi .including.*", "hindi")


def state_display_name(c: Column | str) -> Column:
    """The printed name of an abbreviated state; others are capitalised."""
    capital = F.concat(F.upper(F.substring(_col(c), 1, 1)), F.lower(F.substring(_col(c), 2, 1 << 20)))
    names = F.create_map(*(F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, capital), capital)


def sex_code(c: Column | str) -> Column:
    """0 male, 1 any other readable entry, null for unreadable ones and null."""
    c = _col(c)
    return F.when(c.isin(MALE), 0).when(c != UNREADABLE, 1)


def char_ngrams(c: Column | str, n: int) -> Column:
    """Character n-grams in order; an empty array for shorter strings."""
    c = _col(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, grams).when(c.isNotNull(), F.array().cast("array<string>"))


def ngram_index(grams: Column | str, vocabulary: Column) -> Column:
    """Index of each n-gram in the vocabulary; missing ones get 0, as the first entry does."""
    return F.transform(_col(grams), lambda g: F.greatest(F.array_position(vocabulary, g).cast("int") - 1, F.lit(0)))


def char_codes(c: Column | str, alphabet: str, on_unknown: str = "null") -> Column:
    """1-based letter numbers. `on_unknown`: 'null' gives null for the whole name, 'last' the last letter's number."""
    letters = F.filter(F.split(_col(c), ""), lambda x: x != "")
    known = F.transform(letters, lambda x: F.position(x, F.lit(alphabet)))
    if on_unknown == "last":
        return F.transform(known, lambda i: F.when(i == 0, len(alphabet)).otherwise(i))
    return F.when(~F.exists(known, lambda i: i == 0), known)


def pad_codes(codes: Column | str, length: int) -> Column:
    """Right-padded with 0."""
    codes = _col(codes)
    return F.concat(codes, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(codes), F.lit(0))))


def one_hot_name(c: Column | str, alphabet: str) -> Column:
    """A 0/1 row a letter; an unknown letter marks the last place."""
    codes = char_codes(c, alphabet, on_unknown="last")
    places = F.sequence(F.lit(1), F.lit(len(alphabet)))
    return F.transform(codes, lambda i: F.transform(places, lambda j: (i == j).cast("int")))


def top_languages(*columns: Column | str) -> Column:
    """The non-null languages of a row as a list."""
    return F.array_compact(F.array(*(_col(c) for c in columns)))


def parse_transliteration(c: Column | str) -> Column:
    """A JSON object of source to transliteration as a map; malformed text gives null."""
    return F.from_json(_col(c), "map<string,string>")
