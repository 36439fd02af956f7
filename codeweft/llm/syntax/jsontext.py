"""Strict JSON (RFC 8259) by recursive descent with panic-mode recovery."""

from __future__ import annotations

import re

from codeweft.llm.syntax.base import Bad, Cursor

_TOKEN = re.compile(r'[ \t\n\r]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|([{}\[\],:])|(true|false|null)(?!\w)', re.A)


class _Json(Cursor):
    def value(self) -> None:
        """Values with an explicit stack, so that depth costs no recursion."""
        stack: list[str] = []
        while True:
            k = self.k[self.i]
            if k == "{" or k == "[":
                self.i += 1
                close = "}" if k == "{" else "]"
                if self.eat(close):
                    pass
                else:
                    stack.append(close)
                    if k == "{":
                        self.name()
                    continue
            elif k == "STR" or k == "NUM" or k == "WORD":
                self.i += 1
            else:
                self.fail()
            while stack:
                if self.eat(","):
                    if stack[-1] == "}":
                        self.name()
                    break
                self.need(stack.pop())
            else:
                return

    def name(self) -> None:
        self.need("STR")
        self.need(":")


def check(text: str) -> list[tuple[int, str]]:
    kinds, values, offsets, errors = [], [], [], []
    pos, n, match = 0, len(text), _TOKEN.match
    while pos < n:
        m = match(text, pos)
        if not m:
            errors.append((pos, f"not a JSON token: {text[pos : pos + 20]!r}"))
            pos += 1
            while pos < n and text[pos] not in "\n,]}":
                pos += 1
            continue
        g = m.lastindex
        if g:
            v = m.group(g)
            kinds.append("STR" if g == 1 else "NUM" if g == 2 else v if g == 3 else "WORD")
            values.append(v)
            offsets.append(pos)
        pos = m.end()
    kinds.append("END")
    values.append("")
    offsets.append(n)
    p = _Json(text, kinds, values, offsets, [])
    while True:
        try:
            p.value()
            if p.k[p.i] != "END":
                p.fail("text after the value")
            break
        except Bad as e:
            p.note(e)
            # panic: go on after the next closing bracket or comma, where a value may start
            while p.k[p.i] not in ("END", ",", "}", "]"):
                p.i += 1
            while p.k[p.i] in (",", "}", "]"):
                p.i += 1
            if p.k[p.i] == "END":
                break
            if p.k[p.i] == "STR" and p.k[p.i + 1] == ":":
                p.i += 2
    return sorted(errors + p.errors)
