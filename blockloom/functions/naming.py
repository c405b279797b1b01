"""Table and column names of entities."""

from __future__ import annotations

import re

# Words and rules of pluralisation; the first rule that matches holds.
UNCOUNTABLE = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "jeans", "moose", "deer", "news")
IRREGULAR = {"person": "people", "man": "men", "child": "children", "sex": "sexes", "move": "moves", "cow": "kine", "zombie": "zombies"}
PLURAL_RULES = (
    (r"(quiz)$", r"\1zes"),
    (r"^(ox)$", r"\1en"),
    (r"([ml])ouse$", r"\1ice"),
    (r"(matr|vert|ind)(ix|ex)$", r"\1ices"),
    (r"(x|ch|ss|sh)$", r"\1es"),
    (r"([^aeiouy]|qu)y$", r"\1ies"),
    (r"(hive)$", r"\1s"),
    (r"(?:([^f])fe|([lr])f)$", r"\1\2ves"),
    (r"sis$", "ses"),
    (r"([ti])um$", r"\1a"),
    (r"(buffal|tomat)o$", r"\1oes"),
    (r"(bu)s$", r"\1ses"),
    (r"(alias|status)$", r"\1es"),
    (r"(octop|vir)us$", r"\1i"),
    (r"(ax|test)is$", r"\1es"),
    (r"s$", "s"),
    (r"$", "s"),
)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
MOST_BYTES = 63


def underscore(name: str) -> str:
    split = re.sub(r"([A-Z\d]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"([a-z\d])([A-Z])", r"\1_\2", split).replace("-", "_").lower()


def plural(word: str) -> str:
    low = word.lower()
    if not word or low in UNCOUNTABLE:
        return word
    if low in IRREGULAR:
        many = IRREGULAR[low]
        return many[0].upper() + many[1:] if word[0].isupper() else many
    for pattern, form in PLURAL_RULES:
        if re.search(pattern, word, re.I):
            return re.sub(pattern, form, word, count=1, flags=re.I)
    return word


def table_name(entity: str) -> str:
    return underscore(plural(entity))


def checked_identifier(name: str) -> str:
    """A name that may stand in SQL and paths."""
    if not _IDENTIFIER.fullmatch(name) or len(name) > MOST_BYTES:
        raise ValueError(f"not an identifier: {name!r}")
    return name
