"""Regular expressions: guarding, and translating to the dialect of the JVM."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

MAX_LENGTH = 1000
# Shapes of nested quantifiers that are refused.
DANGEROUS = (
    r"\([^)]+\+\)\+",
    r"\([^)]+\*\)\+",
    r"\([^)]+\+\)\*",
    r"\([^)]+\|[^)]+\)\*",
    r"\([^)]+\|[^)]+\)\+",
)
# POSIX classes and what the JVM calls them.
POSIX = {
    "[:alnum:]": r"\p{Alnum}",
    "[:alpha:]": r"\p{Alpha}",
    "[:blank:]": r"\p{Blank}",
    "[:cntrl:]": r"\p{Cntrl}",
    "[:digit:]": r"\p{Digit}",
    "[:graph:]": r"\p{Graph}",
    "[:lower:]": r"\p{Lower}",
    "[:print:]": r"\p{Print}",
    "[:punct:]": r"\p{Punct}",
    "[:space:]": r"\s",
    "[:upper:]": r"\p{Upper}",
    "[:xdigit:]": r"\p{XDigit}",
}
PLAIN = re.compile(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^\w\s])*\Z")


def guarded(pattern: str) -> str:
    """The pattern, or ValueError if it is too long, dangerous or invalid."""
    if len(pattern) > MAX_LENGTH:
        raise ValueError(f"pattern has {len(pattern)} characters, more than {MAX_LENGTH}")
    if any(re.search(shape, pattern) for shape in DANGEROUS):
        raise ValueError(f"pattern may take exponential time: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return pattern


def balanced(pattern: str) -> str:
    """Escapes closing parentheses that close nothing, as SURT patterns have them."""
    out, depth, in_class, i = [], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] in ("]", "^"):  # a bracket right behind is a member
                take = 3 if pattern[i + 1 : i + 3] == "^]" else 2
                out.append(pattern[i : i + take])
                i += take
                continue
        elif c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                out.append("\\")
            else:
                depth -= 1
        out.append(c)
        i += 1
    return "".join(out)


def to_jvm(pattern: str, unicode: bool = True) -> str:
    """The pattern in the dialect of ``rlike``.

    Named groups are respelled, POSIX classes replaced, and ``\\d \\w \\s \\b`` made to mean
    Unicode classes as they do for text in Python.
    """
    for name, own in POSIX.items():
        pattern = pattern.replace(name, own)
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)
    return "(?U)" + pattern if unicode and re.search(r"\\[dwsbDWSB]", pattern) else pattern


def to_automaton(pattern: str) -> str | None:
    """The pattern in the dialect of Arrow's matcher; None if no automaton can hold it
    (references to groups, looking around) or it is too large."""
    own = re.sub(r"\(\?P<\w+>", "(?:", pattern)
    own = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", own)
    try:
        pc.match_substring_regex(pa.array([""]), own)
    except pa.ArrowInvalid:
        return None
    return own


def literal(pattern: str) -> tuple[bool, str] | None:
    """(anchored at the start, text) if the pattern is plain text, else None."""
    anchored = pattern.startswith("^")
    body = pattern[1:] if anchored else pattern
    if not PLAIN.match(body):
        return None
    return anchored, re.sub(r"\\(.)", r"\1", body)
