"""Tokens of Rust source with byte offsets, and the brackets that match."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The source is read as Latin-1, so that an offset in the string is a byte offset; bytes beyond ASCII count as letters.
_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<doc>///(?!/)[^\n]*)
    |(?P<comment>//[^\n]*)
    |(?P<block>/\*)
    |(?P<raw>(?:b|c)?r(?P<hash>\#*)")
    |(?P<string>(?:b|c)?"(?:\\.|[^"\\])*(?:"|\Z))
    |(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')
    |(?P<life>'[A-Za-z_\x80-\xff][\w\x80-\xff]*)
    |(?P<ident>(?:r\#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)
    |(?P<number>\d\w*(?:\.\d\w*)?)
    |(?P<punct>::|->|=>|==|!=|<=|>=|\+=|-=|\*=|/=|%=|\^=|\|\||\|=|&&|&=|\.\.=|\.\.\.|\.\.|.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(slots=True)
class Token:
    kind: str  # doc, string, char, life, ident, number, punct
    text: str
    start: int
    end: int


def tokens(source: bytes) -> list[Token]:
    text, at, out = source.decode("latin-1"), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "hash":
            kind = "raw"
        if kind == "block":  # comments nest
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if n.group() == "/*" else -1
                end = n.end()
            end = end if not depth else len(text)
        elif kind == "raw":
            close = text.find('"' + m.group("hash"), end)
            end = len(text) if close < 0 else close + 1 + len(m.group("hash"))
            out.append(Token("string", text[at:end], at, end))
        elif kind not in ("space", "comment"):
            raw = m.group()
            # a run of letters beyond ASCII may hold a character that Latin-1 calls something else
            out.append(Token(kind, raw.encode("latin-1").decode("utf-8", "replace") if not raw.isascii() else raw, at, end))
        at = end
    return out


def partners(toks: list[Token]) -> list[int]:
    """For each opening bracket the index of its partner (the end of the file, if there is none), else -1."""
    out, stack = [-1] * len(toks), []
    for i, t in enumerate(toks):
        if t.kind == "punct":
            if t.text in "([{":
                stack.append(i)
            elif t.text in ")]}" and stack:
                out[stack.pop()] = i
    for i in stack:
        out[i] = len(toks)
    return out
