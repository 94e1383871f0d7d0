"""Text predicates, normalisers, tokenisers and string similarity, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(v: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(v, r"^\s+|\s+$", "")


def keep_value(v: Column) -> Column:
    """Values of three bytes or more."""
    return F.octet_length(trimmed(v)) > 2


def is_numeric(v: Column) -> Column:
    """Digits, with a fraction at most; no sign, comma or exponent."""
    return v.rlike(r"^\d+(\.\d+)?$")


def is_text(v: Column) -> Column:
    return v.rlike("[a-zA-Z]{2,}")


def parses_as_number(v: Column) -> Column:
    return v.try_cast("double").isNotNull()


def words_from_line(v: Column) -> Column:
    """Lower-cased, cut at every character but letters and blanks; empty pieces stay."""
    return F.split(F.lower(v), "[^a-z ]", -1)


def get_words(v: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(v), "[^a-z]+", " "), " "), lambda w: F.length(w) >= 3)


def entity_words(v: Column) -> Column:
    """The words of an entity's name, without what stands in parentheses."""
    bare = F.lower(F.translate(F.regexp_replace(v, r"\([^)]*\)", ""), "_", " "))
    return F.filter(F.transform(F.split(bare, " "), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) >= 3)


def normalised(v: Column) -> Column:
    """Without blanks and punctuation at the ends, lower-cased."""
    return F.lower(F.regexp_replace(trimmed(v), r"^\p{P}+|\p{P}+$", ""))


def tokens(v: Column, most: int | None = 5) -> Column:
    """The normalised tokens of a value; null for a value of more than so many."""
    parts = F.split(normalised(v), " ")
    out = F.filter(F.transform(parts, normalised), lambda w: F.length(w) > 0)
    return out if most is None else F.when(F.size(parts) <= most, out)


def web_transform(v: Column) -> Column:
    """As normalised, without parentheses."""
    return normalised(F.translate(v, "()", ""))


def web_tokens(v: Column) -> Column:
    """The parts of a value between underscores, each transformed; empty ones go."""
    return F.filter(F.transform(F.split(v, "_"), web_transform), lambda w: F.length(w) > 0)


def column_id(path: Column, index: Column) -> Column:
    """A column's id: the file's name without folders and ending, and the column's place."""
    return F.concat(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.lit("_c"), index.cast("string"))


def parsed_column_id(id: Column) -> tuple[Column, Column]:
    """Table and place of a column's id; null where it is none."""
    t = F.regexp_extract(id, r"^(.*)_c(\d+)$", 1)
    return F.nullif(t, F.lit("")), F.regexp_extract(id, r"^(.*)_c(\d+)$", 2).try_cast("bigint")


def cell_entity(html: Column) -> Column:
    """The name behind the first link's last slash, or the empty string."""
    return F.coalesce(F.regexp_extract(html, r'<a href="[^"]*/([^"/]*)"', 1), F.lit(""))


def bigrams(v: Column) -> Column:
    """Byte bigrams of the lower-cased value, as four hexadecimal digits."""
    hexed = F.hex(F.encode(F.lower(v), "utf-8"))
    n = F.octet_length(F.lower(v))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.substring(hexed, i * 2 + 1, 4))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice b's bigrams that a has, over the bigrams of both; null if neither has any."""
    x, y = bigrams(a), bigrams(b)
    return F.try_divide(2.0 * F.size(F.filter(y, lambda g: F.array_contains(x, g))), F.size(x) + F.size(y))


def hash32(v: Column, part: int = 0) -> Column:
    """An unsigned 32-bit hash: the hexadecimal digits 8 * part and on of md5."""
    return F.conv(F.substring(F.md5(v), 8 * part + 1, 8), 16, 10).cast("bigint")


def edit_steps(a: Column, b: Column) -> Column:
    """Edits between two arrays of names, letter case aside, by a row of the distance matrix at a time."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(above: Column, x: Column) -> Column:
        start = F.array(F.element_at(above, 1) + 1)

        def cell(done: Column, j: Column) -> Column:
            change = F.when(F.lower(F.element_at(b, j)) == F.lower(x), 0).otherwise(1)
            return F.concat(done, F.array(F.least(F.element_at(done, -1) + 1, F.element_at(above, j + 1) + 1, F.element_at(above, j) + change)))

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.size(b)), start, cell)).otherwise(start)

    return F.element_at(F.aggregate(a, first, row), -1)
