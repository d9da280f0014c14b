"""Splitting of texts into pre-tokens by a pattern with Unicode classes.

Texts within Latin-1 go through the standard library's engine, with the classes written out for that range; all others
through the `regex` package. Both give the same matches.
"""

from __future__ import annotations

import re

import regex

#: Letters, numbers and white space of Latin-1, by Unicode's general categories. Fixed values.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"


def latin_pattern(pattern: str) -> str:
    """`pattern` for Latin-1 texts: \\p{L}, \\p{N}, \\s and (outside brackets) \\S become character sets."""
    out, inside, at = [], False, 0
    sets = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": SPACES}
    while at < len(pattern):
        for name, chars in sets.items():
            if pattern.startswith(name, at):
                out.append(chars if inside else f"[{chars}]")
                at += len(name)
                break
        else:
            if pattern.startswith(r"\S", at):
                if inside:
                    raise ValueError(r"\S inside brackets")
                out.append(f"[^{SPACES}]")
                at += 2
            elif pattern[at] == "\\":
                if pattern[at + 1] in "pPwWdDbB":
                    raise ValueError(f"no set for {pattern[at : at + 2]}")
                out.append(pattern[at : at + 2])
                at += 2
            else:
                inside = pattern[at] == "[" or (inside and pattern[at] != "]")
                out.append(pattern[at])
                at += 1
    return "".join(out)


class Splitter:
    """findall over a pattern."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern).findall
        try:
            self.latin = re.compile(latin_pattern(pattern)).findall
        except (ValueError, re.error):
            self.latin = None

    def __call__(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or _latin(text)):
            return self.latin(text)
        return self.full(text)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
