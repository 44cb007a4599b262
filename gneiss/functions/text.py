"""Text rules as column expressions: normal forms, bounded labels, code lists, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def _special_capitals() -> dict[str, str]:
    """Characters whose capital by upper() is not the one character of Unicode 15's simple mapping, with that character."""
    longer = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}
    newer = ["\u019b", "\u0264", "\u1c8a", "\ua7cd", "\ua7db", *map(chr, range(0x10D70, 0x10D86))]
    return longer | {"ß": "ẞ"} | dict(zip(newer, newer))


CAPITALS = _special_capitals()


def upper_by_character(x: Column) -> Column:
    """Upper case that keeps the number of characters, as SQL engines with simple case mapping give it: ŉ stays, ß is ẞ, ᾳ is ᾼ."""
    keys, values = "".join(CAPITALS), "".join(CAPITALS.values())
    one = lambda c: F.when(c.isin(*CAPITALS), F.translate(c, keys, values)).otherwise(F.upper(c))
    return F.array_join(F.transform(F.split(x, ""), one), "")


def protocol_label(x: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normal_text(x: Column) -> Column:
    """ASCII white space collapsed to single spaces, none at the ends, ASCII upper case."""
    return ascii_upper(F.regexp_replace(F.regexp_replace(x, r"[ \t\n\r\f]+", " "), "^ | $", ""))


def normal_list(x: Column, separator: str = r"\\") -> Column:
    """The values of a separated list in normal form, empty ones dropped, sorted, each once."""
    values = F.transform(F.split(x, separator), normal_text)
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v != "")))


def lists_conflict(a: Column, b: Column, separator: str = r"\\") -> Column:
    """Whether two lists differ; an empty side conflicts with nothing."""
    left, right = normal_list(a, separator), normal_list(b, separator)
    return F.coalesce((F.size(left) > 0) & (F.size(right) > 0) & (left != right), F.lit(False))


def contains_any(x: Column, needles: list[str]) -> Column:
    """Whether the ASCII-lower-cased text contains any needle; spaces in needles count."""
    # one pattern, so that the text is lowered once a row and not once a needle
    return ascii_lower(F.coalesce(x, F.lit(""))).rlike("|".join(rf"\Q{n}\E" for n in needles)) if needles else F.lit(False)


def has_token(x: Column, tokens: list[str]) -> Column:
    """Whether any token stands between characters other than ASCII letters and digits."""
    return F.arrays_overlap(F.split(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]"), F.array(*map(F.lit, tokens)))


def cut_bytes(x: Column, limit: int) -> Column:
    """At most `limit` bytes of UTF-8, cut between characters."""
    raw = F.encode(x, "UTF-8")
    # a character of which only a part fits has 1 to 3 bytes before the cut
    fits = [F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(4)]
    return F.when(F.length(raw) <= limit, x).otherwise(F.coalesce(*fits))


def bounded_label(x: Column, limit: int = 64) -> Column:
    """The text if it can be no personal data, else null.

    Collapsed text of 1 to `limit` letters, digits and " ._+-()/", without addresses, paths, tokens of a
    person's data, or runs of seven digits and more.
    """
    text = F.trim(F.regexp_replace(x, r"\s+", " "))
    fine = F.length(text).between(1, limit) & text.rlike(r"^[A-Za-z0-9 ._+()/-]+$")
    unsafe = text.rlike(r"(?i)://|www\.|@|^/|/.*/|\.\.") | text.rlike(r"(?i)(^|[^a-z])(name|patient|dob|mrn|ssn|id)[^a-z]?") | text.rlike("[0-9]{7}")
    return F.when(fine & ~unsafe, text)


def code_list(x: Column, allowed: list[str], separator: str = r"\\") -> Column:
    """The allowed codes of a separated list in order of first sight, joined by a backslash; null if none."""
    codes = F.array_distinct(F.filter(F.transform(F.split(x, separator), normal_text), lambda v: v.isin(allowed)))
    return F.when(F.size(codes) > 0, F.concat_ws("\\", codes))


def first_match(x: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose needle the ASCII-lower-cased text contains."""
    low, result = ascii_lower(x), None
    for needle, value in rules:
        hit = low.contains(needle)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result.otherwise(otherwise) if otherwise is not None else result


def version_key(x: Column) -> Column:
    """A struct that sorts semantic versions: numbers, then releases above pre-releases; null if none."""
    pattern = r"^(\d{1,9})\.(\d{1,9})\.(\d{1,9})(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
    part = lambda k: F.regexp_extract(x, pattern, k)
    numbers = [part(k).cast("int").alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(x.rlike(pattern), F.struct(*numbers, F.when(part(4) == "", 1).otherwise(0).alias("release"), part(4).alias("pre")))


def unquoted_tag(x: Column) -> Column:
    return F.regexp_replace(x, '^"|"$', "")


def human_label(x: Column, most: int) -> Column:
    """Collapsed text of 2 to `most` characters, else null."""
    text = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(F.length(text).between(2, most), text)


def mail_address(x: Column) -> Column:
    """The address in lower case if it is one, else null."""
    low = F.lower(F.trim(x))
    return F.when((F.length(low) <= 254) & low.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), low)


def table_cell(x: Column) -> Column:
    """Tabs and line ends as spaces, for tab-separated files."""
    return F.translate(x, "\t\r\n", "   ")
