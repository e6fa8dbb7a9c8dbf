"""Text expressions: null texts, literal edits, number and date parsing, markup fields."""

from __future__ import annotations

from html.entities import html5

from paylens.functions.sql import let, lit, one_of
from paylens.schema import NULL_TEXTS


def null_if_missing(e: str) -> str:
    """Null for every text that stands for a missing value."""
    return f"CASE WHEN NOT ({one_of(e, NULL_TEXTS)}) THEN {e} END"


# Fixed value: the characters that count as white space.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(e: str) -> str:
    """Remove white space at both ends, no-break spaces included."""
    return f"btrim({e}, {lit(WHITE_SPACE)})"


def replace_literal(e: str, old: str, new: str) -> str:
    return f"replace({e}, {lit(old)}, {lit(new)})"


def digits_and_commas(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9,]', '')"


def letters_only(e: str) -> str:
    return f"regexp_replace({e}, '[^a-zA-Z]', '')"


def strip_to_number(e: str) -> str:
    """Keep the digits as a double; no digits means null."""
    return f"CAST(nullif(regexp_replace({e}, '[^0-9]', ''), '') AS DOUBLE)"


def parse_thousands(e: str) -> str:
    """'1,234' as a whole number; a text that is no number raises under ANSI mode."""
    return f"CAST(replace({e}, ',', '') AS BIGINT)"


def coerce_int(e: str) -> str:
    """A whole number where the text is numeric, else null."""
    return f"CAST(nullif(try_cast({e} AS DOUBLE), double('NaN')) AS INT)"


def month_from_stamp(e: str) -> str:
    """First of the month for a stamp such as "Jun '24"; two-digit years 69 to 99 mean 1969 to 1999."""
    parsed = rf"to_date(replace({e}, '\'', ''), 'MMM yy')"
    return f"CASE WHEN year({parsed}) > 2068 THEN add_months({parsed}, -1200) ELSE {parsed} END"


# --- ordered rules over list items ------------------------------------------------------------


# The marker words of each field, in the order in which they decide an item.
FIRM_MARKERS = {
    "firm_size": ["People"],
    "health_insurance": ["Health Insurance"],
    "overtime": ["Overtime"],
    "vacation_days": ["Days Vacation"],
    "annual_bonus": ["Bonus"],
}
PERSON_MARKERS = {
    "work_status": ["time", "Freelance"],
    "years_of_experience": ["Years of Experience"],
    "age": ["Years old"],
    "licensed": ["Licensed"],
}


def tagged(items: str, markers: dict[str, list[str]], otherwise: str) -> str:
    """Each item with the first field that has a marker in it, as struct(tag, x).

    Items without any marker belong to the field `otherwise`; empty items to none. Keep the result in a column:
    every field is picked from it.
    """
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains(x, {lit(w)})' for w in words)} THEN {lit(name)}" for name, words in markers.items()
    )
    tag = f"CASE {cases} WHEN x <> '' THEN {lit(otherwise)} END"
    return f"transform({items}, x -> named_struct('tag', {tag}, 'x', x))"


def fields_by_tag(tags: str, markers: dict[str, list[str]], otherwise: str) -> dict[str, str]:
    """Last item per field of tagged items."""
    return {name: f"try_element_at(filter({tags}, t -> t.tag = {lit(name)}), -1).x" for name in [*markers, otherwise]}


def first_token(e: str) -> str:
    return rf"get(split({strip(e)}, r'\s+'), 0)"


# The fields of items without a marker.
FIRM_REST, PERSON_REST = "firm_type", "gender"


def firm_tags(items: str) -> str:
    return tagged(items, FIRM_MARKERS, FIRM_REST)


def person_tags(items: str) -> str:
    return tagged(items, PERSON_MARKERS, PERSON_REST)


def firm_fields(tags: str) -> dict[str, str]:
    """Firm facts from a column of firm_tags."""
    f = fields_by_tag(tags, FIRM_MARKERS, FIRM_REST)
    return {
        **f,
        "health_insurance": f"CASE WHEN {f['health_insurance']} IS NOT NULL THEN 'Yes' END",
        "vacation_days": replace_literal(f["vacation_days"], " Days Vacation", ""),
        "annual_bonus": replace_literal(replace_literal(f["annual_bonus"], "$", ""), " Bonus", ""),
    }


def person_fields(tags: str) -> dict[str, str]:
    """Person facts from a column of person_tags."""
    f = fields_by_tag(tags, PERSON_MARKERS, PERSON_REST)
    years = f"CASE WHEN contains(y, '<') THEN '< 1' ELSE {first_token('y')} END"
    return {
        **f,
        "years_of_experience": let(f["years_of_experience"], "y", years),
        "age": first_token(f["age"]),
        "licensed": f"CASE WHEN {f['licensed']} IS NOT NULL THEN 'Licensed' ELSE 'No' END",
    }


def first_with_prefix(items: str, prefix: str) -> str:
    """The first item that starts with the prefix, without "prefix + blank" and stripped."""
    hit = f"get(filter({items}, x -> startswith(x, {lit(prefix)})), 0)"
    return strip(replace_literal(hit, prefix + " ", ""))


# --- markup -----------------------------------------------------------------------------------


# maps that the reference names are dealt to, as Spark looks through a map from its begin
_NAME_MAPS = 64


def _name_map(name: str) -> int:
    return (7 * ord(name[0]) + 31 * ord(name[1]) + 13 * len(name)) % _NAME_MAPS


def _entity_names() -> str:
    """An array of maps; `_names_of` picks that of a name."""
    dealt: list[list[str]] = [[] for _ in range(_NAME_MAPS)]
    for k, v in sorted(html5.items()):
        dealt[_name_map(k)].append(f"{k}\x02{v}")
    return "array(" + ", ".join("str_to_map(" + lit("\x01".join(d)) + r", '\u0001', '\u0002')" for d in dealt) + ")"


def _names_of(name: str) -> str:
    return f"get(names, (7 * ascii({name}) + 31 * ascii(substr({name}, 2, 1)) + 13 * length({name})) % {_NAME_MAPS})"


# names that count without a semicolon, the longer before those they begin with
_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
# numbers 128 to 159 mean the characters of Windows-1252; five of them have none there
_WINDOWS = "array(" + ", ".join(lit(bytes([c]).decode("cp1252", errors="ignore") or chr(c)) for c in range(128, 160)) + ")"


def decode_entities(e: str) -> str:
    """Character references as HTML 5 reads them, named or numeric; unknown ones stay as written.

    Some names need no semicolon, the longest known one counts. A number that is no character gives U+FFFD. The text
    is cut at each "&" and every piece is decoded by itself, so nothing is decoded twice.
    """
    reference = r"regexp_extract(piece, '^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)', 1)"
    digits = r"regexp_extract(ref, '^#[xX]?0*([0-9A-Fa-f]*)', 1)"
    # eight digits are more than any character has, and fit into a number
    number = f"""{let(digits, 'd', "CASE WHEN length(d) > 8 THEN 1114112L WHEN ref RLIKE '^#[xX]' THEN CAST(conv(concat('0', d), 16, 10) AS BIGINT) WHEN startswith(ref, '#') THEN CAST(concat('0', d) AS BIGINT) END")}"""
    numeric = let(
        number,
        "code",
        f"""CASE WHEN code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN '\ufffd'
        WHEN code BETWEEN 128 AND 159 THEN get({_WINDOWS}, CAST(code - 128 AS INT))
        WHEN code > 0 THEN decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END""",
    )
    bare = f"regexp_extract(piece, '^({_BARE})', 1)"
    used = f"CASE WHEN startswith(ref, '#') OR (ref <> '' AND map_contains_key({_names_of('ref')}, ref)) THEN ref ELSE {bare} END"
    decoded = let(
        reference,
        "ref",
        let(used, "used", f"concat(CASE WHEN startswith(used, '#') THEN {numeric} ELSE try_element_at({_names_of('used')}, used) END, substr(piece, length(used) + 1))"),
    )
    pieces = f"""transform(split(whole, '&'), (piece, i) ->
        CASE WHEN i = 0 THEN piece ELSE coalesce({decoded}, concat('&', piece)) END)"""
    all_names = let(_entity_names(), "names", f"array_join({pieces}, '')")
    return let(e, "whole", f"CASE WHEN contains(whole, '&') THEN {all_names} ELSE whole END")


# a quote of either kind, written so that it fits into a raw SQL text
_QUOTE = r"[\x22\x27]"
_NO_QUOTE = r"[^\x22\x27>]"


def class_attr(name: str) -> str:
    """Pattern for a class attribute that holds the given class among others."""
    return rf"\bclass\s*=\s*{_QUOTE}?(?:{_NO_QUOTE}*\s)?{name}(?:\s{_NO_QUOTE}*)?{_QUOTE}?(?=[\s/>])"


def _attributes(css_class: str | None) -> str:
    return rf"\b[^>]*{class_attr(css_class)}[^>]*" if css_class else r"(?:\s[^>]*)?"


def element(html: str, tag: str, css_class: str | None = None) -> str:
    """Inner markup of the first such element; null when there is none or it is empty."""
    return rf"nullif(regexp_extract({html}, r'(?is)<{tag}{_attributes(css_class)}>(.*?)</{tag}\s*>', 1), '')"


def plain_text(markup: str) -> str:
    """Text of a fragment: pieces between tags, each stripped, joined, entities decoded."""
    pieces = rf"transform(split(m, r'(?s)<!--.*?-->|<[^>]*>'), p -> {strip('p')})"
    inner = f"CASE WHEN contains(m, '<') THEN array_join({pieces}, '') ELSE m END"
    return strip(decode_entities(let(markup, "m", inner)))


def list_items(markup: str) -> str:
    """Plain text of every list item of a fragment; an empty list when there is no fragment."""
    found = rf"regexp_extract_all({markup}, r'(?is)<li\b[^>]*>(.*?)</li\s*>', 1)"
    text = f"CASE WHEN contains(item, '<') OR contains(item, '&') THEN {plain_text('item')} ELSE {strip('item')} END"
    return f"coalesce(transform({found}, item -> {text}), CAST(array() AS ARRAY<STRING>))"


def tag_attribute(html: str, tag: str, attribute: str, css_class: str | None = None) -> str:
    """An attribute of the first such tag, entities decoded; null when absent."""
    opening = rf"regexp_extract({html}, r'(?is)<{tag}{_attributes(css_class)}>', 0)"
    pattern = rf"(?is)\s{attribute}\s*=\s*([\x22\x27]?)(.*?)\1(?=[\s/>])"
    return decode_entities(f"nullif(regexp_extract({opening}, r'{pattern}', 2), '')")


def texts_after(markup: str, tag: str, css_class: str) -> str:
    """The texts that directly follow each such element, up to the next tag."""
    return rf"regexp_extract_all({markup}, r'(?is)<{tag}{_attributes(css_class)}>.*?</{tag}\s*>([^<]*)', 1)"
