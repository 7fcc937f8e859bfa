"""Unicode character classes shared by the Spark (Java regex) and oracle (RE2) sides.

The reference runs Python's ``re`` / ``str`` predicates, whose notion of whitespace,
digit and upper case is Unicode-wide.  Java's ``\\s`` / ``\\d`` are ASCII-only and RE2
lacks some properties, so every class here is *derived by rule* from Python's own
``unicodedata`` tables and rendered as explicit code-point ranges for both engines.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _render(ranges: list[tuple[int, int]]) -> str:
    # ``\x{h..h}`` is understood by both java.util.regex and RE2.
    parts = []
    for lo, hi in ranges:
        if lo == hi:
            parts.append(f"\\x{{{lo:x}}}")
        else:
            parts.append(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


@lru_cache(maxsize=None)
def whitespace_points() -> tuple[int, ...]:
    """Code points Python's ``str.isspace`` accepts (== ``\\s`` of ``re`` on str)."""
    return tuple(c for c in range(sys.maxunicode + 1) if chr(c).isspace())


@lru_cache(maxsize=None)
def ws_body() -> str:
    """Body (no brackets) of the Unicode whitespace class."""
    return _render(_ranges(list(whitespace_points())))


def ws_class() -> str:
    return f"[{ws_body()}]"


def non_ws_class() -> str:
    return f"[^{ws_body()}]"


@lru_cache(maxsize=None)
def extra_digit_body() -> str:
    """Characters ``str.isdigit`` accepts beyond general category Nd (e.g. superscripts)."""
    pts = [c for c in range(sys.maxunicode + 1)
           if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return _render(_ranges(pts))


def digit_class() -> str:
    return f"[\\p{{Nd}}{extra_digit_body()}]"


@lru_cache(maxsize=None)
def extra_upper_body() -> str:
    """Characters whose single-char ``isupper`` holds without being in category Lu."""
    pts = [c for c in range(sys.maxunicode + 1)
           if chr(c).isupper() and unicodedata.category(chr(c)) != "Lu"]
    return _render(_ranges(pts))


def upper_class() -> str:
    return f"[\\p{{Lu}}{extra_upper_body()}]"


@lru_cache(maxsize=None)
def _other_case() -> dict[str, str]:
    """One pass over all code points: lowercase target -> the other characters mapping onto it.

    Characters that are their own lower case, nearly all, are left out: with them the table
    takes 300 MB of every process that asks."""
    out: dict[str, list[str]] = {}
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        lo = ch.lower()
        if lo != ch and len(lo) == 1:
            out.setdefault(lo, []).append(ch)
    return {k: "".join(v) for k, v in out.items()}


def lower_preimage(target: str) -> str:
    """All single characters ``x`` with ``x.lower() == target`` (``target`` included)."""
    others = _other_case().get(target, "")
    if len(target) == 1 and target.lower() == target:
        return "".join(sorted(others + target))
    return target + others
