"""Normal forms of names and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that become a dot, and full-width forms that become plain ones.
SEPARATORS = "·ㆍ∙•‧･"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
_INNERMOST = r"\([^()]*\)"


def name_norm(name: Column) -> Column:
    """Separators to dots, full-width forms to plain ones, no white space, round brackets, single inner dots."""
    dotted = F.translate(name, SEPARATORS, "." * len(SEPARATORS))
    plain = F.translate(F.regexp_replace(dotted, "　", " "), WIDE, PLAIN)
    tight = F.regexp_replace(plain, r"\s+", "")
    return F.regexp_replace(F.regexp_replace(F.translate(tight, "[]", "()"), r"\.+", "."), r"^\.|\.$", "")


def name_key(name: Column, station: bool = False) -> Column:
    """The key that names are matched by: no bracketed parts, no dots, lower case, and no final 역 of a station's longer name."""
    key = F.regexp_replace(name_norm(name), _INNERMOST, "")
    # Nested brackets go from the inside out, as often as there are opening ones left.
    left = F.sequence(F.lit(1), F.length(F.regexp_replace(key, r"[^(]", "")))
    key = F.when(F.contains(key, F.lit("(")), F.aggregate(left, key, lambda k, _: F.regexp_replace(k, _INNERMOST, ""))).otherwise(key)
    key = F.lower(F.regexp_replace(key, r"\.", ""))
    if station:
        key = F.when((F.length(key) >= 3) & key.endswith("역"), F.regexp_replace(key, "역$", "")).otherwise(key)
    return key


def compatible(a: Column, b: Column) -> Column:
    """Equal keys, or one that begins with the other where that has three characters or more."""
    return (a == b) | ((F.length(b) >= 3) & F.startswith(a, b)) | ((F.length(a) >= 3) & F.startswith(b, a))


def parts_key(norm: Column) -> Column:
    """The sorted tokens between dots, where there are two or more and all have two characters or more; else null."""
    parts = F.filter(F.split(norm, r"\."), lambda x: x != "")
    ok = (F.size(parts) >= 2) & F.forall(parts, lambda x: F.length(x) >= 2)
    return F.when(ok, F.array_join(F.array_sort(parts), "."))


def match_level(wanted: Column, key: Column, aliases: Column, wanted_parts: Column, parts: Column) -> Column:
    """How well a name fits: 0 key, 1 alias, 2 the same parts, 3 a common beginning of four characters; null if not at all."""
    begins = (F.least(F.length(wanted), F.length(key)) >= 4) & (F.startswith(key, wanted) | F.startswith(wanted, key))
    return F.when(wanted == key, 0).when(F.array_contains(aliases, wanted), 1).when(wanted_parts == parts, 2).when(begins, 3)


def natural_key(name: Column) -> Column:
    """Sorts runs of digits by value and before text: 9-1, 10, 380, M7."""
    pieces = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct((~p.rlike(r"^\d")).cast("int").alias("text"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"), p.alias("piece")))


def padded_number(code: Column, width: int = 5) -> Column:
    """Digits with zeros before them, longer codes unchanged; blank and zero give the empty string."""
    code = F.trim(code)
    return F.when(code.isNull() | code.rlike("^0*$"), "").when(code.rlike(r"^\d+$") & (F.length(code) < width), F.lpad(code, width, "0")).otherwise(code)


def station_number(code: Column) -> Column:
    """Letters in upper case and the number without leading zeros."""
    up = F.upper(F.trim(code))
    return F.concat(F.regexp_extract(up, r"^(\D*)", 1), F.regexp_replace(F.regexp_extract(up, r"^\D*(.*)$", 1), r"^0+(?=\d)", ""))


def collapse_spaces(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def line_norm(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(s, r"\s", "")), "^수도권", "")


def route_loose(s: Column) -> Column:
    """A route's name without brackets and without the letter of a variant after its number."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(s, r"\s", "")), r"\([^()]*\)", ""), r"(?<=\d)-?[a-z]$", "")


def guidance(s: Column) -> tuple[Column, Column]:
    """From and to of 'line (A > B)'; brackets may stand in the names."""
    return tuple(F.nullif(F.trim(F.regexp_extract(s, r"^[^(]*?\s*\((.*) > (.*)\)$", i)), F.lit("")) for i in (1, 2))


def stops_ahead(s: Column) -> Column:
    return F.coalesce(*[F.regexp_extract(s, p, 1).try_cast("int") for p in (r"\[(\d+)번째 전\]", r"\[(\d+)\]번째 전역")])


def masked(s: Column) -> Column:
    """Keys of 32 hexadecimal digits and UUIDs are starred; what is left is cut to 200 characters."""
    hidden = F.regexp_replace(s, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|\b[0-9a-fA-F]{32}\b", "***")
    return F.left(hidden, F.lit(200))


def last_category(group: Column, path: Column) -> Column:
    """The group's name, else the last part of a path of categories."""
    return F.coalesce(F.nullif(F.trim(group), F.lit("")), F.trim(F.element_at(F.filter(F.split(path, ">"), lambda x: F.trim(x) != ""), -1)))


def tolerant_number(s: Column, kind: str = "double") -> Column:
    """Blank or unreadable text is null."""
    return F.nullif(F.trim(s), F.lit("")).try_cast(kind)


def headsign_next(sign: Column) -> Column:
    """The next stop of a sign 'A행 - B방면', which is B; null where what follows the last hyphen isn't of this form."""
    return F.trim(F.regexp_extract(F.when(sign.rlike(r"-[^-]*방면\s*$"), sign), r"-([^-]*)방면\s*$", 1))
