"""Tokens and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return found if not stop else F.filter(found, lambda t: ~t.isin(stop))


def spaced(text: Column, stop: list[str] | None = None) -> Column:
    """The tokens of a text with a space between them; without ``stop`` words no list of them is made."""
    if stop:
        return F.array_join(tokens(text, stop), " ")
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def token_count(text: Column, stop: list[str] | None = None) -> Column:
    """How many tokens a text has."""
    return F.size(tokens(text, stop)) if stop else F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[^\w]|_", query.lower()) if t))


def contains_ignoring_case(text: Column, query: str) -> Column:
    """Whether ``query`` occurs in the text as it is written, in any case; its special characters mean themselves."""
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def glob(pattern: str) -> str:
    """An anchored pattern: * is anything (slashes too), ? one character, [seq] and [!seq] one of or none of them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) >= 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += "\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c
    return f"(?s)^{out}$"
