"""Python 3 by recursive descent: indentation in the lexer, precedence climbing for expressions."""

from __future__ import annotations

import re

from codeweft.llm.syntax.base import Bad, Cursor, LexError

_TOKEN = re.compile(
    r"(?P<S>[ \t\f]+|\\\r?\n|\#[^\n\r]*)|(?P<NL>\r\n|\n|\r)"
    r"|(?P<Q>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:'''|\"\"\"|'|\"))"
    r"|(?P<ID>(?:[^\W\d]|[^\x00-\x7f\s])(?:\w|[^\x00-\x7f\s])*)"
    r"|(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<P>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:;.=!])"
)
_BODY = {q: re.compile(p) for q, p in (("'", r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*"), ('"', r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*'), ("'''", r"(?:[^'\\]|\\[\s\S]|'(?!''))*"), ('"""', r'(?:[^"\\]|\\[\s\S]|"(?!""))*'))}
_BAD_ESCAPE = re.compile(r"\\(?:\\|x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N(?!\{[^}\n]+\}))|\\[\s\S]")
_BAD_BYTES = re.compile(r"\\\\|\\x(?![0-9a-fA-F]{2})")

#: Keywords.
KEYWORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally for from global
    if import in is lambda nonlocal not or pass raise return try while with yield""".split()
)
#: Binary operators above comparison and how tightly they bind.
BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
COMPARE = frozenset(["==", "!=", "<", ">", "<=", ">=", "in", "is", "not"])
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}
_TARGET = frozenset(["id", "attr", "sub", "tuple", "list", "star"])


class _Lexer:
    def __init__(self, text: str) -> None:
        self.text = text
        self.k: list[str] = []
        self.v: list[str] = []
        self.o: list[int] = []
        self.errors: list[tuple[int, str]] = []

    def add(self, kind: str, value: str, at: int) -> None:
        self.k.append(kind)
        self.v.append(value)
        self.o.append(at)

    def run(self) -> None:
        text, n = self.text, len(self.text)
        pos = 1 if text[:1] == "﻿" else 0
        if "\0" in text:
            self.errors.append((text.index("\0"), "null character"))
        indents = [(0, 0)]
        line_start = True
        stack: list[tuple[str, int]] = []
        match = _TOKEN.match
        while pos < n:
            if line_start and not stack:
                line_start = False
                col = alt = 0
                p = pos
                while p < n and text[p] in " \t\f":
                    c = text[p]
                    if c == " ":
                        col, alt = col + 1, alt + 1
                    elif c == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    else:
                        col = alt = 0
                    p += 1
                if p < n and text[p] not in "#\n\r" and text[p : p + 2] not in ("\\\n", "\\\r"):
                    top = indents[-1]
                    if col == top[0]:
                        if alt != top[1]:
                            self.errors.append((p, "inconsistent use of tabs and spaces"))
                    elif col > top[0]:
                        if alt <= top[1]:
                            self.errors.append((p, "inconsistent use of tabs and spaces"))
                        indents.append((col, alt))
                        self.add("INDENT", "", p)
                    else:
                        while col < indents[-1][0]:
                            indents.pop()
                            self.add("DEDENT", "", p)
                        if indents[-1][0] != col:
                            self.errors.append((p, "unindent to no outer level"))
                        elif indents[-1][1] != alt:
                            self.errors.append((p, "inconsistent use of tabs and spaces"))
                pos = p
                if pos >= n:
                    break
            m = match(text, pos)
            if not m:
                self.errors.append((pos, f"not a Python token: {text[pos : pos + 12]!r}"))
                end = text.find("\n", pos)
                pos = n if end < 0 else end
                continue
            g, end = m.lastgroup, m.end()
            if g == "S":
                if text[pos] == "\\" and end >= n:
                    self.errors.append((pos, "end of file after a line continuation"))
            elif g == "NL":
                if not stack:
                    if self.k and self.k[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                        self.add("NEWLINE", "\n", pos)
                    line_start = True
            elif g == "Q":
                try:
                    end = self.string(pos, m.group())
                except LexError as e:
                    self.errors.append((e.pos, e.message))
                    q = text.find("\n", pos)
                    end = n if q < 0 or "'''" in m.group() or '"""' in m.group() else q
            elif g == "ID":
                v = m.group()
                if not v.isascii() and not v.isidentifier():
                    self.errors.append((pos, f"invalid character in {v[:12]!r}"))
                self.add(v if v in KEYWORDS else "ID", v, pos)
            elif g == "NUM":
                v = m.group()
                self.number(v, pos, end)
                self.add("NUM", v, pos)
            else:
                v = m.group()
                if v in _OPEN:
                    stack.append((_OPEN[v], pos))
                elif v in (")", "]", "}"):
                    if not stack:
                        self.errors.append((pos, f"unmatched {v!r}"))
                    elif stack[-1][0] != v:
                        self.errors.append((pos, f"{v!r} does not close {text[stack[-1][1]]!r}"))
                        stack.pop()
                    else:
                        stack.pop()
                self.add(v, v, pos)
            pos = end
        if stack:
            self.errors.append((stack[-1][1], f"{text[stack[-1][1]]!r} was never closed"))
        if self.k and self.k[-1] != "NEWLINE":
            self.add("NEWLINE", "", n)
        for _ in indents[1:]:
            self.add("DEDENT", "", n)
        self.add("END", "", n)

    def number(self, v: str, pos: int, end: int) -> None:
        text = self.text
        if end < len(text) and (text[end].isalnum() or text[end] == "_"):
            rest = re.match(r"\w+", text[end:]).group()
            if rest not in ("and", "or", "in", "is", "if", "else", "for", "not"):
                self.errors.append((pos, "invalid number"))
        if len(v) > 1 and v[0] == "0" and v.replace("_", "").isdigit() and v.strip("0_"):
            self.errors.append((pos, "leading zeros in a number"))

    def string(self, pos: int, opening: str) -> int:
        quote = opening[-3:] if len(opening) >= 3 and opening[-3:] in ("'''", '"""') else opening[-1]
        prefix = opening[: -len(quote)].lower()
        at = pos + len(opening)
        if "f" in prefix or "t" in prefix:
            if "t" in prefix:
                raise LexError(pos, "template strings are not of this version")
            return self.fstring(pos, at, quote, "r" in prefix)
        m = _BODY[quote].match(self.text, at)
        end = m.end()
        if self.text[end : end + len(quote)] != quote:
            raise LexError(pos, "string without an end")
        body = m.group()
        if "b" in prefix:
            if not body.isascii():
                self.errors.append((pos, "bytes hold only ASCII"))
            if "r" not in prefix and "\\" in body and any(x.group() != "\\\\" for x in _BAD_BYTES.finditer(body)):
                self.errors.append((pos, "invalid escape in bytes"))
        elif "r" not in prefix and "\\" in body:
            self.escapes(body, pos)
        self.add("BYTES" if "b" in prefix else "STR", "", pos)
        return end + len(quote)

    def escapes(self, body: str, pos: int) -> None:
        for m in _BAD_ESCAPE.finditer(body):
            x = m.group()
            if x in ("\\x", "\\u", "\\U", "\\N"):
                tail = body[m.start() + 2 :]
                need = {"x": r"[0-9a-fA-F]{2}", "u": r"[0-9a-fA-F]{4}", "U": r"(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}", "N": r"\{[^}\n]+\}"}[x[1]]
                if not re.match(need, tail):
                    self.errors.append((pos, "invalid escape in a string"))
                    return

    def fstring(self, pos: int, at: int, quote: str, raw: bool) -> int:
        self.add("F(", "", pos)
        at = self.fparts(pos, at, quote, raw, False)
        self.add("F)", "", at)
        return at + len(quote)

    def fparts(self, pos: int, at: int, quote: str, raw: bool, spec: bool) -> int:
        text, n = self.text, len(self.text)
        start = at
        while True:
            if at >= n or (len(quote) == 1 and text[at] in "\n\r"):
                raise LexError(pos, "f-string without an end")
            c = text[at]
            if c == "\\" and not spec:
                if not raw and text[at + 1 : at + 3] == "N{":
                    end = text.find("}", at)
                    if end < 0:
                        raise LexError(pos, "f-string without an end")
                    at = end + 1
                elif raw and text[at + 1 : at + 2] in ("{", "}"):
                    at += 1
                else:
                    at += 2 if text[at + 1 : at + 2] not in ("{", "}") else 1
            elif text.startswith(quote, at):
                if spec:
                    raise LexError(pos, "f-string: expected '}'")
                return at
            elif c == "{":
                if text.startswith("{{", at) and not spec:
                    at += 2
                else:
                    at = self.field(pos, at, quote, raw)
            elif c == "}":
                if spec:
                    return at
                if not text.startswith("}}", at):
                    raise LexError(at, "f-string: single '}'")
                at += 2
            else:
                at += 1

    def field(self, pos: int, at: int, quote: str, raw: bool) -> int:
        text, n = self.text, len(self.text)
        self.add("F{", "{", at)
        at += 1
        stack: list[str] = []
        while True:
            m = _TOKEN.match(text, at)
            if not m:
                raise LexError(at, "f-string: expected '}'")
            g, v, end = m.lastgroup, m.group(), m.end()
            if not stack and g == "P":
                if v[0] == "!" and v != "!=":
                    self.add("!", "!", at)
                    at += 1
                    continue
                if v[0] == ":":
                    self.add("F:", ":", at)
                    at = self.fparts(pos, at + 1, quote, raw, True)
                    self.add("F}", "}", at)
                    return at + 1
                if v == "}":
                    self.add("F}", "}", at)
                    return at + 1
            if g == "S" and v[0] != "#" or g == "NL" and len(quote) == 3:
                pass
            elif g in ("S", "NL"):
                if len(quote) == 1:
                    raise LexError(pos, "f-string without an end")
            elif g == "Q":
                end = self.string(at, v)
            elif g == "ID":
                self.add(v if v in KEYWORDS else "ID", v, at)
            elif g == "NUM":
                self.number(v, at, end)
                self.add("NUM", v, at)
            else:
                if v in _OPEN:
                    stack.append(_OPEN[v])
                elif v in (")", "]", "}"):
                    if not stack or stack.pop() != v:
                        raise LexError(at, f"f-string: unmatched {v!r}")
                self.add(v, v, at)
            at = end
            if at >= n:
                raise LexError(pos, "f-string without an end")


class Python(Cursor):
    def __init__(self, text: str) -> None:
        lexer = _Lexer(text)
        lexer.run()
        super().__init__(text, lexer.k, lexer.v, lexer.o, [])
        self.errors = lexer.errors

    def show(self) -> str:
        k = self.k[self.i]
        return {"NEWLINE": "end of line", "INDENT": "indentation", "DEDENT": "unindentation"}.get(k) or super().show()

    def word(self, w: str) -> bool:
        return self.k[self.i] == "ID" and self.v[self.i] == w

    # -- statements
    def file(self) -> None:
        while self.k[self.i] != "END":
            start = self.i
            try:
                self.statement()
            except Bad as e:
                self.note(e)
                self.depth = 0
                # panic: on to the next line; what it indented is skipped over as blocks
                self.i = max(start, self.i)
                while self.k[self.i] not in ("NEWLINE", "END"):
                    self.i += 1
                while self.k[self.i] in ("NEWLINE", "INDENT", "DEDENT"):
                    self.i += 1

    def statement(self) -> None:
        k = self.k[self.i]
        f = _COMPOUND.get(k)
        if f:
            f(self)
        elif k == "ID" and self.v[self.i] == "match" and self.match_():
            pass
        else:
            self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.small()
            if self.eat(";"):
                if self.eat("NEWLINE"):
                    return
                continue
            if self.k[self.i] != "NEWLINE":
                self.fail(f"invalid syntax at {self.show()}")
            self.i += 1
            return

    def suite(self) -> None:
        self.need(":")
        self.deeper()
        if self.eat("NEWLINE"):
            if self.k[self.i] != "INDENT":
                self.fail("expected an indented block")
            self.i += 1
            k = self.k
            while k[self.i] != "DEDENT":
                if k[self.i] == "END":
                    break
                self.statement()
            else:
                self.i += 1
        else:
            self.simple_line()
        self.depth -= 1

    def small(self) -> None:
        k = self.k[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in ("NEWLINE", ";"):
                self.stars()
        elif k == "raise":
            self.i += 1
            if self.k[self.i] not in ("NEWLINE", ";"):
                self.test()
                if self.eat("from"):
                    self.test()
        elif k == "del":
            self.i += 1
            while True:
                kind = self.test(True)
                if kind not in ("id", "attr", "sub", "tuple", "list"):
                    self.fail("cannot delete this")
                if not self.eat(",") or self.k[self.i] in ("NEWLINE", ";"):
                    break
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.need("ID")
            while self.eat(","):
                self.need("ID")
        elif k == "assert":
            self.i += 1
            self.test()
            if self.eat(","):
                self.test()
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.eat("as"):
                    self.need("ID")
                if not self.eat(","):
                    break
        elif k == "from":
            self.from_()
        elif k == "ID" and self.v[self.i] == "type" and self.k[self.i + 1] == "ID" and self.k[self.i + 2] in ("=", "["):
            self.i += 2
            if self.k[self.i] == "[":
                self.type_parameters()
            self.need("=")
            self.test()
        else:
            self.expression_statement()

    def dotted(self) -> None:
        self.need("ID")
        while self.eat("."):
            self.need("ID")

    def from_(self) -> None:
        self.i += 1
        dots = False
        while self.k[self.i] in (".", "..."):
            self.i += 1
            dots = True
        if self.k[self.i] == "ID":
            self.dotted()
        elif not dots:
            self.fail(f"invalid syntax at {self.show()}")
        self.need("import")
        if self.eat("*"):
            return
        paren = self.eat("(")
        while True:
            self.need("ID")
            if self.eat("as"):
                self.need("ID")
            if not self.eat(","):
                break
            if paren and self.k[self.i] == ")":
                break
        if paren:
            self.need(")")

    def expression_statement(self) -> None:
        start = self.i
        kind = self.value()
        k = self.k[self.i]
        if k == "=":
            while True:
                if kind not in _TARGET:
                    raise Bad(start, "cannot assign to this")
                self.i += 1
                start = self.i
                kind = self.value()
                if self.k[self.i] != "=":
                    return
        elif k in AUGMENTED:
            if kind not in ("id", "attr", "sub"):
                raise Bad(start, "cannot assign to this")
            self.i += 1
            self.value()
        elif k == ":":
            if kind not in ("id", "attr", "sub"):
                raise Bad(start, "cannot annotate this")
            self.i += 1
            self.test()
            if self.eat("="):
                self.value()

    def value(self) -> str:
        return self.yield_() if self.k[self.i] == "yield" else self.stars()

    def yield_(self) -> str:
        self.need("yield")
        if self.eat("from"):
            self.test()
        elif self.k[self.i] not in ("NEWLINE", ")", "]", "}", ";", "=", "F}", "F:", "!"):
            self.stars()
        return "yield"

    def stars(self) -> str:
        """One or more expressions, any of them starred."""
        kind = self.star_or_test()
        if self.k[self.i] != ",":
            return kind
        good = kind in _TARGET
        while self.eat(","):
            if self.k[self.i] in _AFTER_COMMA:
                break
            good &= self.star_or_test() in _TARGET
        return "tuple" if good else "values"

    def star_or_test(self) -> str:
        if self.eat("*"):
            kind = self.bitwise(0)
            return "star" if kind in _TARGET else "stars"
        return self.named()

    def named(self) -> str:
        if self.k[self.i] == "ID" and self.k[self.i + 1] == ":=":
            self.fail("':=' needs parentheses here")
        return self.test()

    def decorated(self) -> None:
        while self.eat("@"):
            self.walrus()
            if not self.eat("NEWLINE"):
                self.fail()
        if self.k[self.i] not in ("def", "class", "async"):
            self.fail("expected def or class after a decorator")
        self.statement()

    def def_(self) -> None:
        self.need("def")
        self.need("ID")
        if self.k[self.i] == "[":
            self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat("->"):
            self.test()
        self.suite()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            star = self.eat("*") or self.eat("**")
            self.need("ID")
            if not star and self.eat(":"):
                self.test()
            if self.eat("="):
                if star:
                    self.star_or_test()
                else:
                    self.test()
            if self.k[self.i] != "]":
                self.need(",")

    def parameters(self, end: str, annotated: bool) -> None:
        defaults = star = slash = False
        first = True
        while self.k[self.i] != end:
            if self.eat("**"):
                self.need("ID")
                if annotated and self.eat(":"):
                    self.test()
                if self.k[self.i] == "=":
                    self.fail("default of **parameter")
                self.eat(",")
                if self.k[self.i] != end:
                    self.fail("parameter after **")
                return
            if self.eat("*"):
                if star:
                    self.fail("second * in parameters")
                star = True
                if self.k[self.i] == "ID":
                    self.i += 1
                    if annotated and self.eat(":"):
                        self.star_or_test()
                    if self.k[self.i] == "=":
                        self.fail("default of *parameter")
                elif self.k[self.i] != "," or self.k[self.i + 1] in (end, "**"):
                    self.fail("named parameters must follow bare *")
            elif self.k[self.i] == "/":
                if slash or star or first:
                    self.fail("misplaced / in parameters")
                slash = True
                self.i += 1
            else:
                self.need("ID")
                if annotated and self.eat(":"):
                    self.test()
                if self.eat("="):
                    defaults = True
                    self.test()
                elif defaults and not star:
                    self.fail("parameter without a default follows one with a default")
            first = False
            if self.k[self.i] != end:
                self.need(",")

    def class_(self) -> None:
        self.need("class")
        self.need("ID")
        if self.k[self.i] == "[":
            self.type_parameters()
        if self.eat("("):
            self.arguments()
        self.suite()

    def async_(self) -> None:
        self.need("async")
        if self.k[self.i] not in ("def", "with", "for"):
            self.fail()
        _COMPOUND[self.k[self.i]](self)

    def if_(self) -> None:
        self.i += 1
        self.walrus()
        self.suite()
        while self.eat("elif"):
            self.walrus()
            self.suite()
        if self.eat("else"):
            self.suite()

    def while_(self) -> None:
        self.i += 1
        self.walrus()
        self.suite()
        if self.eat("else"):
            self.suite()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.need("in")
        self.stars()
        self.suite()
        if self.eat("else"):
            self.suite()

    def targets(self) -> None:
        while True:
            at = self.i
            self.eat("*")
            if self.bitwise(0) not in _TARGET:
                raise Bad(at, "cannot assign to this")
            if not self.eat(",") or self.k[self.i] == "in":
                return

    def try_(self) -> None:
        self.i += 1
        self.suite()
        star = None
        handlers = bare = False
        while self.k[self.i] == "except":
            self.i += 1
            if bare:
                self.fail("default except must be last")
            group = self.eat("*")
            if star is not None and star != group:
                self.fail("except and except* in one try")
            star, handlers = group, True
            if self.k[self.i] != ":":
                self.test()
                if self.eat("as"):
                    self.need("ID")
            elif group:
                self.fail("except* needs a type")
            else:
                bare = True
            self.suite()
        if handlers and self.eat("else"):
            self.suite()
        if self.eat("finally"):
            self.suite()
        elif not handlers:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.i += 1
        if self.k[self.i] == "(":
            i, depth = self.i, self.depth
            try:
                self.i += 1
                while True:
                    self.item()
                    if self.eat(")"):
                        break
                    self.need(",")
                    if self.eat(")"):
                        break
                if self.k[self.i] != ":":
                    self.fail()
                parenthesised = True
            except Bad:
                self.i, self.depth = i, depth
                parenthesised = False
            if parenthesised:
                self.suite()
                return
        while True:
            self.item()
            if not self.eat(","):
                break
        self.suite()

    def item(self) -> None:
        self.test()
        if self.eat("as"):
            at = self.i
            if self.star_target() not in _TARGET:
                raise Bad(at, "cannot assign to this")

    def star_target(self) -> str:
        return self.bitwise(0)

    # -- match
    def match_(self) -> bool:
        """A match statement if one starts here; the word is a name otherwise."""
        nxt = self.k[self.i + 1]
        if nxt in (".", "=", ")", ",", ":", "NEWLINE", ";") or nxt in AUGMENTED:
            return False
        i, depth = self.i, self.depth
        try:
            self.i += 1
            self.subject()
            self.need(":")
            self.need("NEWLINE")
            self.need("INDENT")
            if not self.word("case"):
                self.fail()
        except Bad:
            self.i, self.depth = i, depth
            return False
        self.deeper()
        while not self.eat("DEDENT"):
            if not self.word("case"):
                self.fail("expected case")
            self.i += 1
            self.patterns()
            if self.eat("if"):
                self.walrus()
            self.suite()
            if self.k[self.i] == "END":
                break
        self.depth -= 1
        return True

    def subject(self) -> None:
        while True:
            if self.eat("*"):
                self.bitwise(0)
            else:
                self.walrus()
            if not self.eat(",") or self.k[self.i] == ":":
                return

    def patterns(self) -> None:
        while True:
            if self.eat("*"):
                self.need("ID")
            else:
                self.as_pattern()
            if not self.eat(",") or self.k[self.i] in (":", "if"):
                return

    def as_pattern(self) -> None:
        self.deeper()
        self.closed_pattern()
        while self.eat("|"):
            self.closed_pattern()
        if self.eat("as"):
            self.need("ID")
        self.depth -= 1

    def closed_pattern(self) -> None:
        k = self.k[self.i]
        if k in ("None", "True", "False"):
            self.i += 1
        elif k in ("STR", "BYTES", "F("):
            self.strings()
        elif k == "NUM" or k == "-":
            self.eat("-")
            self.need("NUM")
            if self.k[self.i] in ("+", "-"):
                self.i += 1
                self.need("NUM")
        elif k == "ID":
            self.dotted()
            if self.eat("("):
                named = False
                while not self.eat(")"):
                    if self.k[self.i] == "ID" and self.k[self.i + 1] == "=":
                        self.i += 2
                        named = True
                    elif named:
                        self.fail("positional pattern follows keyword pattern")
                    self.as_pattern()
                    if self.k[self.i] != ")":
                        self.need(",")
        elif k in ("(", "["):
            self.i += 1
            while not self.eat(_OPEN[k]):
                if self.eat("*"):
                    self.need("ID")
                else:
                    self.as_pattern()
                if self.k[self.i] != _OPEN[k]:
                    self.need(",")
        elif k == "{":
            self.i += 1
            while not self.eat("}"):
                if self.eat("**"):
                    self.need("ID")
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.as_pattern()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            self.fail()

    # -- expressions
    def walrus(self) -> str:
        if self.k[self.i] == "ID" and self.k[self.i + 1] == ":=":
            self.i += 2
            self.test()
            return "named"
        return self.test()

    def test(self, target: bool = False) -> str:
        self.deeper()
        if self.k[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.test()
            kind = "lambda"
        else:
            kind = self.or_()
            if self.k[self.i] == "if":
                self.i += 1
                self.or_()
                self.need("else")
                self.test()
                kind = "cond"
        self.depth -= 1
        return kind

    def or_(self) -> str:
        kind = self.not_()
        while self.k[self.i] in ("and", "or"):
            self.i += 1
            self.not_()
            kind = "bool"
        return kind

    def not_(self) -> str:
        if self.eat("not"):
            self.deeper()
            self.not_()
            self.depth -= 1
            return "bool"
        kind = self.bitwise(0)
        while self.k[self.i] in COMPARE:
            k = self.k[self.i]
            if k == "not" and self.k[self.i + 1] != "in":
                return kind
            self.i += 2 if k == "not" or (k == "is" and self.k[self.i + 1] == "not") else 1
            self.bitwise(0)
            kind = "compare"
        return kind

    def bitwise(self, least: int) -> str:
        kind = self.factor()
        while True:
            p = BINARY.get(self.k[self.i])
            if p is None or p <= least:
                return kind
            self.i += 1
            self.bitwise(p)
            kind = "binary"

    def factor(self) -> str:
        if self.k[self.i] in ("+", "-", "~"):
            self.i += 1
            self.deeper()
            self.factor()
            self.depth -= 1
            return "unary"
        awaited = self.eat("await")
        kind = self.primary()
        if self.eat("**"):
            self.factor()
            return "binary"
        return "await" if awaited else kind

    def primary(self) -> str:
        kind = self.atom()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.need("ID")
                kind = "attr"
            elif k == "(":
                self.i += 1
                self.arguments()
                kind = "call"
            elif k == "[":
                self.i += 1
                self.subscripts()
                kind = "sub"
            else:
                return kind

    def arguments(self) -> None:
        """After '(': the arguments of a call or the bases of a class, and ')'."""
        self.deeper()
        keyword = unpacked = False
        n = 0
        while not self.eat(")"):
            n += 1
            k = self.k[self.i]
            if k == "**":
                self.i += 1
                self.test()
                unpacked = True
            elif k == "*":
                if unpacked:
                    self.fail("* follows ** in a call")
                self.i += 1
                self.test()
            elif k == "ID" and self.k[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                at = self.i
                kind = self.walrus()
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    if n > 1 or not (self.k[self.i] == ")" or self.k[self.i] == "," and self.k[self.i + 1] == ")"):
                        self.fail("generator expression needs parentheses")
                elif self.k[self.i] == "=":
                    self.fail("not a name before '='")
                elif keyword or unpacked:
                    raise Bad(at, "positional argument follows keyword argument")
                del kind
            if self.k[self.i] != ")":
                self.need(",")
        self.depth -= 1

    def subscripts(self) -> None:
        self.deeper()
        while True:
            if self.eat("*"):
                self.bitwise(0)
            else:
                if self.k[self.i] != ":":
                    self.walrus()
                if self.eat(":"):
                    if self.k[self.i] not in (":", "]", ","):
                        self.test()
                    if self.eat(":") and self.k[self.i] not in ("]", ","):
                        self.test()
            if self.eat("]"):
                break
            self.need(",")
            if self.eat("]"):
                break
        self.depth -= 1

    def comprehension(self) -> None:
        while self.k[self.i] in ("for", "async"):
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.or_()
            while self.eat("if"):
                if self.k[self.i] == "ID" and self.k[self.i + 1] == ":=":
                    self.fail("':=' needs parentheses here")
                self.or_()

    def strings(self) -> None:
        kinds = set()
        while self.k[self.i] in ("STR", "BYTES", "F("):
            kinds.add("BYTES" if self.k[self.i] == "BYTES" else "STR")
            if len(kinds) > 1:
                self.fail("bytes and text strings in a row")
            if self.k[self.i] == "F(":
                self.i += 1
                while not self.eat("F)"):
                    self.replacement()
            else:
                self.i += 1

    def replacement(self) -> None:
        self.need("F{")
        self.deeper()
        if self.k[self.i] == "yield":
            self.yield_()
        else:
            self.stars()
        self.eat("=")
        if self.eat("!"):
            if self.k[self.i] != "ID" or self.v[self.i] not in ("s", "r", "a"):
                self.fail("f-string: invalid conversion")
            self.i += 1
        if self.eat("F:"):
            while not self.eat("F}"):
                self.replacement()
        else:
            self.need("F}")
        self.depth -= 1

    def atom(self) -> str:
        k = self.k[self.i]
        if k == "ID":
            self.i += 1
            return "id"
        if k in ("NUM", "None", "True", "False", "..."):
            self.i += 1
            return "lit"
        if k in ("STR", "BYTES", "F("):
            self.strings()
            return "lit"
        if k == "(":
            return self.paren()
        if k == "[":
            return self.list_()
        if k == "{":
            return self.dict_()
        self.fail(f"invalid syntax at {self.show()}")

    def paren(self) -> str:
        self.need("(")
        if self.eat(")"):
            return "tuple"
        self.deeper()
        if self.k[self.i] == "yield":
            self.yield_()
            self.need(")")
            self.depth -= 1
            return "yield"
        kind = self.element()
        if self.k[self.i] in ("for", "async"):
            if kind in ("star", "stars"):
                self.fail("unpacking in a comprehension")
            self.comprehension()
            kind = "gen"
        elif self.k[self.i] == ",":
            good = kind in _TARGET
            while self.eat(","):
                if self.k[self.i] == ")":
                    break
                good &= self.element() in _TARGET
            kind = "tuple" if good else "values"
        elif kind in ("star", "stars"):
            self.fail("starred expression here")
        self.need(")")
        self.depth -= 1
        return kind

    def element(self) -> str:
        if self.eat("*"):
            return "star" if self.bitwise(0) in _TARGET else "stars"
        return self.walrus()

    def list_(self) -> str:
        self.need("[")
        if self.eat("]"):
            return "list"
        self.deeper()
        kind = self.element()
        good = kind in _TARGET
        if self.k[self.i] in ("for", "async"):
            if kind in ("star", "stars"):
                self.fail("unpacking in a comprehension")
            self.comprehension()
            good = False
        else:
            while self.eat(","):
                if self.k[self.i] == "]":
                    break
                good &= self.element() in _TARGET
        self.need("]")
        self.depth -= 1
        return "list" if good else "values"

    def dict_(self) -> str:
        self.need("{")
        self.deeper()
        first = True
        pairs = None
        while not self.eat("}"):
            if self.eat("**"):
                self.bitwise(0)
                is_pair, unpack = True, True
            else:
                kind, unpack = self.element(), False
                is_pair = False
                if self.k[self.i] == ":" and kind not in ("star", "stars", "named"):
                    self.i += 1
                    self.test()
                    is_pair = True
            if pairs is not None and pairs != is_pair:
                self.fail("mixed set and dict")
            pairs = is_pair
            if first and self.k[self.i] in ("for", "async"):
                if unpack:
                    self.fail("unpacking in a comprehension")
                self.comprehension()
                self.need("}")
                break
            first = False
            if self.k[self.i] != "}":
                self.need(",")
        self.depth -= 1
        return "dict"


_AFTER_COMMA = frozenset(["NEWLINE", ")", "]", "}", "=", ";", ":", "F}", "F:", "!", "in"]) | AUGMENTED
_COMPOUND = {
    "def": Python.def_, "class": Python.class_, "if": Python.if_, "for": Python.for_, "while": Python.while_,
    "try": Python.try_, "with": Python.with_, "async": Python.async_, "@": Python.decorated,
}


def check(text: str) -> list[tuple[int, str]]:
    p = Python(text)
    p.file()
    return sorted(p.errors)
