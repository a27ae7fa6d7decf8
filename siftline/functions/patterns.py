"""Building Java regular expressions from phrases.

Patterns reach Spark as literals, so each task compiles them once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

# Java needs U for Unicode-aware \\b, \\w and \\s; U also turns on Unicode case folding.
IGNORE_CASE = "(?iU)"
# Python-style whitespace: the Unicode property plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"


def quote(literal: str) -> str:
    """Escape a literal for a Java pattern, character by character."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in literal)


def phrase_body(phrase: str) -> tuple[str, str, str]:
    """``(left boundary, body, right boundary)`` of a phrase.

    Words may be separated by any whitespace. A boundary is asserted only beside
    an alphanumeric edge: next to ``)`` it would demand a letter.
    """
    text = phrase.lower()
    words = text.split()
    if not words:
        raise ValueError("empty phrase")
    left = r"\b" if text[0].isalnum() else ""
    right = r"\b" if text[-1].isalnum() else ""
    return left, rf"{SPACE}+".join(quote(w) for w in words), right


def phrase(phrase_text: str) -> str:
    return IGNORE_CASE + "".join(phrase_body(phrase_text))


def pieces(phrase_text: str) -> list[str]:
    """The runs of ASCII letters and digits that stand, whole, wherever the phrase
    does; none for a phrase with other letters, which may match across them."""
    text = phrase_text.lower()
    return sorted(set(re.findall(r"[a-z0-9]+", text))) if text.isascii() else []


def sql_string(value: str) -> str:
    """A SQL string literal with this exact value."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_phrase(phrases: Iterable[str]) -> str:
    """One pattern that matches where at least one of the phrases does.

    It is a screen: it answers *whether*, never *which*, because an alternation
    reports the leftmost match and the rules need the first declared one.
    Phrases are merged on shared prefixes so that a position which starts none
    of them is rejected after a single character.
    """
    bounded: list[list[str]] = []
    loose: list[list[str]] = []
    for text in phrases:
        left, _, right = phrase_body(text)
        units = _units(text) + ([right] if right else [])
        (bounded if left else loose).append(units)
    parts = []
    if bounded:
        parts.append(r"\b" + _trie(bounded))
    if loose:
        parts.append(_trie(loose))
    return IGNORE_CASE + "|".join(parts)


def _units(text: str) -> list[str]:
    units: list[str] = []
    for i, word in enumerate(text.lower().split()):
        if i:
            units.append(rf"{SPACE}+")
        units.extend(quote(c) for c in word)
    return units


def _trie(sequences: Sequence[Sequence[str]]) -> str:
    heads: dict[str, list[Sequence[str]]] = {}
    ends = False
    for seq in sequences:
        if seq:
            heads.setdefault(seq[0], []).append(seq[1:])
        else:
            ends = True
    if not heads:
        return ""
    branches = [head + _trie(rest) for head, rest in heads.items()]
    if len(branches) == 1 and not ends:
        return branches[0]
    return "(?:" + "|".join(branches) + ")" + ("?" if ends else "")
