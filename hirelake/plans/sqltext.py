"""Pieces of oracle SQL made from the same lists that the operators take."""

from __future__ import annotations


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(items: list[str]) -> str:
    return "[" + ", ".join(map(text, items)) + "]"


def any_in(c: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {text(x)})" for x in items) + ")"


def count_in(c: str, items: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {text(x)}) AS INTEGER)" for x in items) + ")"


def first_in(c: str, items: list[str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {text(x)}) THEN {text(x)}" for x in items) + f" ELSE {otherwise} END"


def found_in(c: str, items: list[str]) -> str:
    return f"list_filter({array(items)}, lambda k: contains({c}, k))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean_html(c: str) -> str:
    bare = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    bare = f"regexp_replace({bare}, '&nbsp;|&amp;|&lt;|&gt;|&quot;|&#39;', ' ', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


#: References that the pages of the tests have; numbers are decoded by rule.
NAMED = {"copy": "©", "middot": "·", "quot": '"', "nbsp": "\u00a0", "eacute": "é", "gt": ">", "lt": "<", "amp": "&"}


def unescape(c: str) -> str:
    """Numbers of any kind, then the names above, the ampersand last."""
    point = "CASE WHEN x[1] IN ('x', 'X') THEN CAST(concat('0x', x[2:]) AS INTEGER) ELSE CAST(x AS INTEGER) END"
    numbers = f"list_distinct(regexp_extract_all({c}, '&#([0-9]+|[xX][0-9A-Fa-f]+);', 1))"
    out = f"list_reduce(list_prepend({c}, {numbers}), lambda t, x: replace(t, concat('&#', x, ';'), chr({point})))"
    for name, character in NAMED.items():
        out = f"replace({out}, {text(f'&{name};')}, {text(character)})"
    return out


def node_text(c: str) -> str:
    bare = f"regexp_replace({c}, '<!--.*?-->|</?[A-Za-z!](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>', ' ', 'gs')"
    return rf"trim(regexp_replace({unescape(bare)}, '[\s\x{{a0}}]+', ' ', 'g'))"


def welfare(token: str, rules: list[tuple[list[str], str]]) -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(f'contains({token}, {text(p)})' for p in parts)} THEN {text(name)}" for parts, name in rules) + " END"


def token_set(c: str) -> str:
    return rf"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[,/|\s]+'), lambda x: lower(x)), lambda x: x <> ''))"


def salary_min(c: str) -> str:
    numbers = rf"list_transform(regexp_extract_all(coalesce({c}, ''), '[0-9][0-9,]{{2,}}'), lambda x: try_cast(replace(x, ',', '') AS HUGEINT))"
    return f"try_cast(list_min(list_filter({numbers}, lambda x: x IS NOT NULL)) AS BIGINT)"


def netloc(c: str) -> str:
    return f"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def path(c: str) -> str:
    return f"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def same_org(a: str, b: str) -> str:
    x, y = (f"lower(regexp_replace({c}, ':[0-9]*$', ''))" for c in (a, b))
    last = lambda h: f"regexp_extract({h}, '([^.]*[.][^.]*)$', 1)"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN false ELSE {x} = {y} OR (contains({x}, '.') AND contains({y}, '.') AND {last(x)} = {last(y)}) END"
