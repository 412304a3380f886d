"""Text functions as Column expressions: trimming, tokens, lexicon tests, welfare and money."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import lexicons as L


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: str | Column) -> Column:
    """Runs of white space as one space, stripped."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def blank(c: str | Column) -> Column:
    """NULL read as the empty text."""
    return F.coalesce(col(c), F.lit(""))


def clean_html(c: str | Column) -> Column:
    """Tags and the six common entities as spaces, collapsed."""
    bare = F.regexp_replace(col(c), r"<[^>]+>", " ")
    return collapse(F.regexp_replace(bare, r"&nbsp;|&amp;|&lt;|&gt;|&quot;|&#39;", " "))


#: Comments and tags; a ">" inside a quoted attribute does not end a tag.
MARKUP = r"(?s)<!--.*?(?:-->|\z)|</?[A-Za-z!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[A-Za-z!?][^>]*>"


def unescape(c: str | Column) -> Column:
    """Character references decoded: numbers, and the names of HTML 4 with their semicolon; anything
    else stays as written. A number that is no character gives U+FFFD."""
    names = F.from_json(F.lit(json.dumps({name: chr(point) for name, point in name2codepoint.items()})), "map<string,string>")  # a constant

    def decoded(x: Column) -> Column:
        """What a piece after an ampersand stands for."""
        name = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        number = F.regexp_extract(x, r"^(#(?:[0-9]+|[xX][0-9A-Fa-f]+));?", 1)
        digits = F.regexp_extract(x, r"^#([0-9]+)", 1)
        point = F.when(digits != "", digits.try_cast("bigint")).otherwise(F.conv(F.regexp_extract(x, r"^#[xX]([0-9A-Fa-f]{1,7})", 1), 16, 10).try_cast("bigint"))
        is_character = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
        character = F.when(is_character, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        by_name = F.try_element_at(names, name)
        return (
            F.when(x.startswith("#") & (number != ""), F.concat(character, F.regexp_replace(x, r"^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", "")))
            .when(by_name.isNotNull(), F.concat(by_name, F.substring(x, F.length(name) + 2, F.length(x))))
            .otherwise(F.concat(F.lit("&"), x))
        )

    def whole(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))

    return once(col(c), lambda t: F.when(t.contains("&"), once(F.split(t, "&"), whole)).otherwise(t))


def node_text(c: str | Column) -> Column:
    """The text nodes of a piece of HTML, a space between them, decoded and collapsed."""
    return collapse(unescape(F.regexp_replace(col(c), MARKUP, " ")))


def words(items: list[str]) -> Column:
    """A list as an array literal."""
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def any_in(c: Column, items: list[str]) -> Column:
    """Whether any item is a substring."""
    hit = F.lit(False)
    for x in items:
        hit = hit | c.contains(x)
    return hit


def count_in(c: Column, items: list[str]) -> Column:
    """How many items are substrings; overlapping items count each."""
    total = F.lit(0)
    for x in items:
        total = total + c.contains(x).cast("int")
    return total


def first_in(c: Column, items: list[str], otherwise: Column | None = None) -> Column:
    """The first item (in list order) that is a substring."""
    out = None
    for x in items:
        out = F.when(c.contains(x), F.lit(x)) if out is None else out.when(c.contains(x), F.lit(x))
    return (F.lit(None).cast("string") if out is None else out).otherwise(otherwise) if otherwise is not None else out


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, though ``use`` reads it in a lambda."""
    return F.transform(F.array(value), use)[0]


def found_in(c: Column, items: list[str]) -> Column:
    """The items that are substrings, in list order."""
    return once(c, lambda t: F.filter(words(items), lambda x: t.contains(x)))


def token_set(c: str | Column) -> Column:
    """Distinct lower-cased tokens of a delimited text; NULL gives none."""
    parts = F.split(blank(c), r"(?U)[,/|\s]+")
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: x != ""))


def token_set_of_list(c: str | Column) -> Column:
    """Distinct stripped, lower-cased elements; elements are not split, a NULL one reads 'none'."""
    items = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.lower(strip(F.coalesce(x, F.lit("None")))))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def welfare_set(tokens: Column, rules: list[tuple[list[str], str]] | None = None) -> Column:
    """Canonical benefits of tokens, sorted; the first rule that fits a token counts."""

    def canonical(token: Column) -> Column:
        out = None
        for parts, name in L.WELFARE_RULES if rules is None else rules:
            fits = F.lit(True)
            for p in parts:
                fits = fits & token.contains(p)
            out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
        return out

    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, canonical), lambda x: x.isNotNull())))


def _ascii_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def salary_min(c: str | Column) -> Column:
    """Least of all numbers of at least three digits or commas; NULL where there are none."""
    found = F.regexp_extract_all(blank(c), F.lit(r"(?U)\d[\d,]{2,}"), F.lit(0))
    numbers = F.transform(found, lambda x: _ascii_digits(F.replace(x, F.lit(","), F.lit(""))).try_cast("decimal(38,0)"))
    return F.array_min(F.filter(numbers, lambda x: x.isNotNull())).try_cast("bigint")


def salary_floor500(c: str | Column) -> Column:
    """Largest pay that a text names, in 10,000s, floored to 500."""
    text = F.replace(F.lower(blank(c)), F.lit(","), F.lit(""))
    number = lambda x: _ascii_digits(x).try_cast("bigint")
    hundred_millions = number(F.nullif(F.regexp_extract(text, r"(?U)(\d+)\s*억", 1), F.lit(""))) * 10000
    ten_thousands = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\d{3,5})\s*만"), F.lit(1)), number)
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b(\d{3,5})\b"), F.lit(1)), number)
    most = F.array_max(F.concat(F.array(hundred_millions), ten_thousands, plain))
    return (F.floor(most / 500) * 500).cast("bigint")


def has_digit(c: str | Column) -> Column:
    return col(c).rlike(r"(?U)\d")


def flag(c: str | Column) -> Column:
    """Three-way flag of a query parameter or CSV cell: true, false, or NULL for anything else."""
    low = F.lower(strip(c))
    return F.when(low.isin("1", "y", "yes", "true", "t"), True).when(low.isin("0", "n", "no", "false", "f"), False)
