"""Text helpers shared by the operators."""

from __future__ import annotations


def _python_whitespace() -> str:
    # the characters Python's str.strip() removes: exactly those with isspace()
    return "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


PY_WHITESPACE = _python_whitespace()


def sql_chars(chars: str) -> str:
    """A SQL expression for a string of arbitrary characters (via chr())."""
    return " || ".join(f"chr({ord(c)})" for c in chars)
