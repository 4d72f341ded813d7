"""User-written patterns with the meaning of Python's ``re``.

A pattern whose syntax tree holds only pieces that mean the same in the JVM, and that the JVM matches without recursion
per character, runs there. Any other one runs through ``re`` itself on Arrow batches. A pattern that ``re`` refuses is an error
for the caller to handle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import SPACES

_ONE = {C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN}
_PLACES = {C.AT_BEGINNING, C.AT_END, C.AT_BEGINNING_STRING}
# Text the two dialects read differently: named groups, classes in classes, braces that are no counts, \Z.
_FOREIGN = re.compile(r"\(\?P|\[[^\]]*\[|&&|\{,|\\[ZNuUx0-9]|(?<!\\)[{}]")
_REPEATED_GROUP = re.compile(r"(?<!\\)\)[*+?{]")  # the JVM recurses for each turn
_COUNTS = re.compile(r"(?<!\\)\{\d+(?:,\d*)?\}")


def _plain(tree, depth: int = 0) -> bool:
    for op, value in tree:
        if op in _ONE or op is C.GROUPREF or (op is C.AT and value in _PLACES):
            continue
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and len(value[2]) == 1 and value[2][0][0] in _ONE:
            continue
        if op is C.SUBPATTERN and not value[1] and not value[2] and _plain(value[3], depth + 1):
            continue
        if op is C.BRANCH and all(_plain(branch, depth + 1) for branch in value[1]):
            continue
        return False
    return True


# Python's categories spelled out: the JVM's own cover ASCII only.
_CLASSES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": "".join(rf"\x{{{ord(c):x}}}" for c in SPACES)}


def _spelled(pattern: str) -> str | None:
    """The pattern with its categories as sets of characters; None for the opposite of one within brackets, whose unions the JVM reads its own way."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            name, at = pattern[at + 1], at + 2
            own = _CLASSES.get(name.lower()) if name.isalpha() else None
            if own is None:
                out.append(c + name)
            elif inside:
                if name.isupper():
                    return None
                out.append(own)
            else:
                out.append(f"[{'^' if name.isupper() else ''}{own}]")
            continue
        at += 1
        out.append(c)
        if c == "[" and not inside:
            inside = True
            for first in ("^", "]"):  # a bracket right after the opening one is a character
                if pattern.startswith(first, at):
                    out.append(first if first == "^" else "\\]")
                    at += 1
        elif c == "]" and inside:
            inside = False
    return "".join(out)


def java_form(pattern: str, flags: int = 0) -> str | None:
    """The pattern for the JVM, or None where it has no safe form there."""
    tree = _parser.parse(pattern, flags)
    back_reference = re.search(r"\\[1-9](?!\d)", pattern)
    text = _COUNTS.sub("", pattern)
    if back_reference:
        text = re.sub(r"\\[1-9](?!\d)", "", text)
    if tree.state.flags & ~(re.DOTALL | re.IGNORECASE | re.UNICODE) or _FOREIGN.search(text) or _REPEATED_GROUP.search(pattern) or "(?" in pattern.replace("(?:", "") or not _plain(tree):
        return None
    pattern = _spelled(pattern)
    if pattern is None:
        return None
    # Only the line feed ends a line, as in Python.
    return "(?d" + ("s" if flags & re.DOTALL else "") + ("iu" if flags & re.IGNORECASE else "") + ")" + pattern


def _per_text(one, returns: str, kind: pa.DataType):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if t is None else one(t) for t in column.to_pylist()], kind)

    return F.arrow_udf(run, returns)


def first_group(text: Column, pattern: str, flags: int = 0) -> Column:
    """First group of the first match, the whole match where there is no group; '' without a match or for a group that took no part."""
    compiled = re.compile(pattern, flags)
    group = 1 if compiled.groups else 0
    java = java_form(pattern, flags)
    if java is not None:
        return F.coalesce(F.regexp_extract(text, java, group), F.lit(""))

    def one(t: str) -> str:
        m = compiled.search(t)
        return (m[group] or "") if m else ""

    return F.coalesce(_per_text(one, "string", pa.string())(text), F.lit(""))


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs."""
    compiled = re.compile(pattern)
    java = java_form(pattern)
    if java is not None:
        return text.rlike(java)
    return _per_text(lambda t: compiled.search(t) is not None, "boolean", pa.bool_())(text)
