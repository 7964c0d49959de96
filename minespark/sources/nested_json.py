"""Decoding JSON text of any depth, with whatever surrounds or encloses it."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+)', re.S)
_DECODER = json.JSONDecoder(strict=False)


def decode(text: str | None):
    """The JSON object or array in ``text``; None if there is none or it is cut off.

    A byte-order mark, blanks, text before or after the value, and JSON that is
    itself the content of a JSON string, however often, do not matter.
    """
    while True:
        if not isinstance(text, str):
            return text if isinstance(text, (dict, list)) else None
        s = text.lstrip("\ufeff \t\r\n")
        if s.startswith('"'):
            try:
                text = _DECODER.raw_decode(s)[0]
                continue
            except ValueError:
                return None
        at = -1
        while True:
            nxt = re.compile(r"[{\[]").search(s, at + 1)
            if nxt is None:
                return None
            at = nxt.start()
            try:
                return _raw(s, at)
            except ValueError as x:
                # prose such as "[note] {...}": go on only if the value broke off before any nested value began
                inner = re.compile(r"[{\[]").search(s, at + 1)
                if inner is None or getattr(x, "pos", len(s)) >= inner.start():
                    return None


def _raw(s: str, at: int):
    try:
        return _DECODER.raw_decode(s, at)[0]
    except RecursionError:
        return _iterative(s, at)


def _iterative(s: str, at: int):
    """A decoder with its own stack, for nesting beyond the interpreter's limit."""
    stack: list = []
    keys: list = []
    expect_key = False
    while True:
        m = _TOKEN.match(s, at)
        if m is None:
            raise ValueError("cut off")
        t, at = m.group(1), m.end()
        if t in "{[":
            stack.append({} if t == "{" else [])
            keys.append(None)
            expect_key = t == "{"
            continue
        if t == ",":
            expect_key = isinstance(stack[-1], dict)
            continue
        if t == ":":
            expect_key = False
            continue
        if t in "}]":
            value = stack.pop()
            keys.pop()
            if not stack:
                return value
        elif expect_key and keys[-1] is None:
            keys[-1] = (json.loads(t, strict=False),)
            continue
        else:
            value = json.loads(t, strict=False)
        if isinstance(stack[-1], dict):
            if keys[-1] is None:
                raise ValueError("no key")
            stack[-1][keys[-1][0]] = value
            keys[-1] = None
        else:
            stack[-1].append(value)
        expect_key = False
