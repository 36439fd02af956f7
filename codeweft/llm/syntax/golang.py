"""Go by recursive descent: automatic semicolons in the lexer, precedence climbing for expressions."""

from __future__ import annotations

import re

from codeweft.llm.syntax.base import Bad, Cursor

_TOKEN = re.compile(
    r"(?P<S>[ \t\r]+|//[^\n]*)|(?P<NL>\n)|(?P<C>/\*[\s\S]*?\*/)"
    r"|(?P<ID>[^\W\d]\w*)"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<STR>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|`[^`]*`)"
    r"|(?P<CHAR>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<P>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])"
)
#: Keywords.
KEYWORDS = frozenset(
    """break case chan const continue default defer else fallthrough for func go goto if import interface map package
    range return select struct switch type var""".split()
)
#: Binary operators and how tightly they bind.
BINARY = {
    "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3,
    "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5,
}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_ENDS = frozenset(["ID", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_UNARY = frozenset("+ - ! ^ * & <- ~".split())


def tokens(text: str):
    kinds: list[str] = []
    values: list[str] = []
    offsets: list[int] = []
    errors: list[tuple[int, str]] = []
    pos, n, match = 0, len(text), _TOKEN.match
    if text[:1] == "﻿":
        pos = 1
    last = ""
    while pos < n:
        m = match(text, pos)
        if not m:
            errors.append((pos, f"not a Go token: {text[pos : pos + 12]!r}"))
            end = text.find("\n", pos)
            pos = n if end < 0 else end
            last = ""
            continue
        g = m.lastgroup
        end = m.end()
        if g == "S":
            pos = end
            continue
        if g == "NL" or (g == "C" and "\n" in m.group()):
            if last in _ENDS:
                kinds.append(";")
                values.append("\n")
                offsets.append(pos)
            last = ""
        elif g != "C":
            v = m.group()
            k = v if g == "P" or (g == "ID" and v in KEYWORDS) else g
            if g == "NUM" and (end < n and (text[end].isalnum() or text[end] == "_") or (len(v) > 1 and v[0] == "0" and v.isdigit() and ("8" in v or "9" in v)) or v in ("0x", "0X")):
                errors.append((pos, "not a number"))
            kinds.append(k)
            values.append(v)
            offsets.append(pos)
            last = k
        pos = end
    if last in _ENDS:
        kinds.append(";")
        values.append("\n")
        offsets.append(n)
    kinds.append("END")
    values.append("")
    offsets.append(n)
    return kinds, values, offsets, errors


class Go(Cursor):
    def __init__(self, text: str) -> None:
        k, v, o, errors = tokens(text)
        super().__init__(text, k, v, o, [])
        self.errors = errors
        #: Below 0 inside the header of a control clause, where a composite literal needs parentheses.
        self.level = 0

    def show(self) -> str:
        return "end of line" if self.v[self.i] == "\n" else super().show()

    # -- files and declarations
    def file(self) -> None:
        try:
            self.need("package")
            self.need("ID")
            self.end()
        except Bad as e:
            self.note(e)
            self.panic()
        imports = True
        while self.k[self.i] != "END":
            start = self.i
            try:
                k = self.k[self.i]
                if k == "import":
                    if not imports:
                        self.fail("import after declarations")
                    self.group(self.import_spec)
                elif k == "func":
                    imports = False
                    self.function()
                elif k in ("var", "const", "type"):
                    imports = False
                    self.declaration()
                elif k == ";":
                    self.i += 1
                    continue
                else:
                    self.fail(f"expected a declaration, found {self.show()}")
                self.end()
            except Bad as e:
                self.note(e)
                self.i = max(start + 1, self.i)
                self.panic()

    def panic(self) -> None:
        """Skip to the next line that starts a declaration."""
        self.depth = self.level = 0
        while self.k[self.i] != "END" and not self.starts_declaration(self.i):
            self.i += 1

    def starts_declaration(self, i: int) -> bool:
        """Whether a line begins at a token that starts a declaration."""
        return self.k[i] in ("func", "type", "var", "const", "import") and (self.o[i] == 0 or self.text[self.o[i] - 1] == "\n")

    def end(self) -> None:
        if self.k[self.i] == "END":
            return
        self.need(";")

    def close(self, bracket: str) -> None:
        """A closing bracket, before which a line's semicolon may have been left out."""
        self.need(bracket)

    def group(self, spec) -> None:
        self.i += 1
        if self.eat("("):
            first = True
            while not self.eat(")"):
                spec(first)
                first = False
                if self.k[self.i] != ")":
                    self.need(";")
        else:
            spec(True)

    def import_spec(self, first: bool) -> None:
        if self.k[self.i] in ("ID", "."):
            self.i += 1
        self.need("STR")

    def declaration(self) -> None:
        k = self.k[self.i]
        self.group(self.type_spec if k == "type" else self.const_spec if k == "const" else self.var_spec)

    def names(self) -> None:
        self.need("ID")
        while self.eat(","):
            self.need("ID")

    def const_spec(self, first: bool) -> None:
        self.names()
        if self.k[self.i] not in ("=", ";", ")"):
            self.type()
            if self.k[self.i] != "=":
                self.fail("constant with a type but no value")
        if self.eat("="):
            self.expressions()
        elif first:
            self.fail("first constant without a value")

    def var_spec(self, first: bool) -> None:
        self.names()
        if self.k[self.i] != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self, first: bool) -> None:
        self.need("ID")
        if self.k[self.i] == "[":
            i, depth, noted = self.i, self.depth, len(self.errors)
            try:
                self.type_parameters()
                if self.k[self.i] in (";", ")"):
                    self.fail()
            except Bad:
                self.i, self.depth = i, depth
                del self.errors[noted:]
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if self.eat("]"):
                return
            self.need(",")
            if self.eat("]"):
                return

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def function(self) -> None:
        self.need("func")
        if self.k[self.i] == "(":
            self.parameters()
        self.need("ID")
        if self.k[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.k[self.i] == "{":
            self.body()

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.starts_type():
            self.type()

    def parameters(self) -> None:
        """Either all are types or all are names (groups) with types."""
        self.need("(")
        level, self.level = self.level, 0
        typed = False
        entries = 0
        lone = True
        while not self.eat(")"):
            entries += 1
            if self.eat("..."):
                self.type()
                lone = False
            else:
                i = self.i
                self.type()
                named = self.k[i] == "ID" and self.i == i + 1
                if named and self.k[self.i] not in (",", ")"):
                    self.eat("...")
                    self.type()
                    typed = True
                    lone = True
                else:
                    lone = named
                    if typed and not named:
                        self.fail("mixed named and unnamed parameters")
            if self.k[self.i] != ")":
                self.need(",")
                if self.k[self.i] == ")":
                    pass
        self.level = level

    # -- types
    def starts_type(self) -> bool:
        return self.k[self.i] in ("ID", "*", "[", "(", "map", "chan", "func", "struct", "interface", "<-")

    def type(self) -> None:
        self.deeper()
        k = self.k[self.i]
        if k == "ID":
            self.i += 1
            if self.k[self.i] == "." and self.k[self.i + 1] == "ID":
                self.i += 2
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
                i, depth, noted = self.i, self.depth, len(self.errors)
                try:
                    self.i += 1
                    self.type()
                    while self.eat(","):
                        if self.k[self.i] == "]":
                            break
                        self.type()
                    self.need("]")
                except Bad:
                    self.i, self.depth = i, depth
                    del self.errors[noted:]
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if self.eat("]"):
                self.type()
            else:
                level, self.level = self.level, 0
                if not self.eat("..."):
                    self.expression()
                self.level = level
                self.need("]")
                self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                if self.k[self.i] != "}":
                    self.need(";")
        elif k == "interface":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.k[self.i] == "ID" and self.k[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                if self.k[self.i] != "}":
                    self.need(";")
        else:
            self.fail(f"expected a type, found {self.show()}")
        self.depth -= 1

    def field(self) -> None:
        if self.k[self.i] == "*" or self.k[self.i] == "(":
            self.type()
        elif self.k[self.i + 1] in (";", "}", "STR", "."):
            self.type()
        elif self.k[self.i] == "ID" and self.k[self.i + 1] == "[":
            i, depth, noted = self.i, self.depth, len(self.errors)
            try:
                self.i += 1
                self.type()
            except Bad:
                self.i, self.depth = i, depth
                del self.errors[noted:]
                self.type()
        else:
            self.names()
            self.type()
        self.eat("STR")

    # -- statements
    def block(self) -> None:
        self.need("{")
        self.deeper()
        self.statements()
        self.need("}")
        self.depth -= 1

    def statements(self) -> None:
        while True:
            k = self.k[self.i]
            if k in ("}", "case", "default", "END"):
                return
            if k == ";":
                self.i += 1
                continue
            start, depth, level = self.i, self.depth, self.level
            try:
                self.statement()
                if self.k[self.i] not in ("}", "case", "default"):
                    self.need(";")
            except Bad as e:
                bad: Bad | None = e
                while bad:
                    if not self.closes(start):
                        raise bad
                    self.note(bad)
                    self.depth, self.level = depth, level
                    try:
                        bad = self.resume(start)
                    except Bad as later:
                        bad = later

    def closes(self, start: int) -> bool:
        """Whether the statement from a token on ends, with its braces closed, before the next declaration."""
        i, level = start, 0
        while self.k[i] != "END" and not self.starts_declaration(i):
            k = self.k[i]
            level += (k == "{") - (k == "}")
            if level < 0 or (k == ";" and not level and i >= self.i):
                return True
            i += 1
        return False

    def resume(self, start: int) -> None:
        """Skip to the end of the statement that began at a token; blocks of a control clause are parsed."""
        first = self.k[start]
        level = self.k[start : self.i].count("{") - self.k[start : self.i].count("}")
        while True:
            k = self.k[self.i]
            if k == "END" or (not level and k in ("}", ";")):
                return
            if not level and k == "{" and first in ("if", "for"):
                self.block()
            elif not level and k == "{" and first in ("switch", "select"):
                self.i += 1
                self.clauses(self.case_list if first == "switch" else self.simple)
            elif not level and k == "else" and self.k[self.i + 1] == "if":
                self.i += 1
                self.if_()
            else:
                level += (k == "{") - (k == "}")
                self.i += 1

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "}"):
                self.expressions()
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.need("{")
            self.clauses(self.simple)
        elif k in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                self.fail("expected a call")
        elif k in ("break", "continue"):
            self.i += 1
            self.eat("ID")
        elif k == "goto":
            self.i += 1
            self.need("ID")
        elif k == "fallthrough":
            self.i += 1
        elif k == "{":
            self.block()
        elif k == "func" and self.k[self.i + 1] == "ID":
            self.fail("a named function inside a function")
        elif k == "ID" and self.k[self.i + 1] == ":":
            self.i += 2
            if self.k[self.i] not in ("}", ";", "case", "default"):
                self.statement()
        else:
            self.simple()

    def simple(self, ranges: bool = False) -> str:
        if ranges and self.k[self.i] == "range":
            self.i += 1
            self.expression()
            return "range"
        start = self.i
        kinds = [self.expression()]
        while self.eat(","):
            kinds.append(self.expression())
        op = self.k[self.i]
        if op in ASSIGN:
            if op == ":=" and any(x != "id" for x in kinds):
                raise Bad(start, "not a name left of ':='")
            if op not in ("=", ":=") and len(kinds) > 1:
                self.fail()
            if any(x not in ("id", "operand", "index", "deref", "paren") for x in kinds):
                raise Bad(start, "not a target of an assignment")
            self.i += 1
            if ranges and self.eat("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if len(kinds) > 1:
            self.fail(f"expected an assignment, found {self.show()}")
        if op in ("++", "--"):
            self.i += 1
            return "assign"
        if op == "<-":
            self.i += 1
            self.expression()
            return "send"
        if kinds[0] in ("lit", "binary", "id", "operand", "index", "composite", "type", "func") and not ranges and self.level >= 0:
            raise Bad(start, "an expression is not a statement")
        return kinds[0]

    def header(self, ranges: bool = False) -> None:
        """The clause before a block: [simple;] [expression], or the three of a for."""
        level, self.level = self.level, -1
        if self.k[self.i] != "{":
            kind = ""
            if self.k[self.i] != ";":
                kind = self.simple(ranges)
            if kind != "range" and self.k[self.i] == ";" :
                self.i += 1
                if self.k[self.i] not in ("{", ";"):
                    kind = self.simple()
                else:
                    kind = ""
                if ranges and self.eat(";"):
                    if self.k[self.i] != "{":
                        self.simple()
                    kind = ""
                elif ranges and self.k[self.i] == "{":
                    self.fail("expected ';' in for")
            if ranges and kind in ("assign", "send"):
                self.fail("an assignment is no condition")
        self.level = level

    def if_(self) -> None:
        self.need("if")
        if self.k[self.i] == "{":
            self.fail("if without a condition")
        self.header()
        if self.k[self.i] == "{" and self.k[self.i - 1] == ";":
            self.fail("if without a condition")
        self.block()
        if self.eat("else"):
            if self.k[self.i] == "if":
                self.if_()
            elif self.k[self.i] == "{":
                self.block()
            else:
                self.fail("expected if or a block after else")

    def for_(self) -> None:
        self.need("for")
        self.header(True)
        self.block()

    def switch(self) -> None:
        self.need("switch")
        self.header()
        self.need("{")
        self.clauses(self.case_list)

    def case_list(self) -> None:
        while True:
            if self.k[self.i] in ("ID", "(", "*") or self.k[self.i] not in ("[", "map", "chan", "func", "struct", "interface", "<-"):
                self.expression()
            else:
                self.type_or_expression()
            if not self.eat(","):
                return

    def type_or_expression(self) -> None:
        i, depth, noted = self.i, self.depth, len(self.errors)
        try:
            self.expression()
        except Bad:
            self.i, self.depth = i, depth
            del self.errors[noted:]
            self.type()

    def clauses(self, head) -> None:
        self.deeper()
        while not self.eat("}"):
            level, depth = self.level, self.depth
            try:
                if self.eat("case"):
                    self.level = -2 if head == self.simple else 0
                    head()
                else:
                    self.need("default")
                self.need(":")
            except Bad as e:
                i = self.i
                while self.k[i] not in (":", "case", "default", ";", "}", "END") and not self.starts_declaration(i):
                    i += 1
                if self.k[i] == "END" or self.starts_declaration(i):
                    raise
                self.note(e)
                self.i, self.depth = i, depth
                self.eat(":")
            self.level = 0
            self.statements()
            self.level = level
        self.depth -= 1

    # -- expressions
    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self, least: int = 0) -> str:
        kind = self.unary()
        while True:
            p = BINARY.get(self.k[self.i])
            if p is None or p <= least:
                return kind
            self.i += 1
            self.expression(p)
            kind = "binary"

    def unary(self) -> str:
        k = self.k[self.i]
        if k in _UNARY:
            if k == "<-" and self.k[self.i + 1] == "chan":
                self.type()
                return self.tail("type")
            self.i += 1
            self.deeper()
            self.unary()
            self.depth -= 1
            return "deref" if k == "*" else "receive" if k == "<-" else "binary"
        return self.tail(self.operand())

    def operand(self) -> str:
        k = self.k[self.i]
        if k == "ID":
            self.i += 1
            return "id"
        if k in ("NUM", "STR", "CHAR"):
            self.i += 1
            return "lit"
        if k == "(":
            self.i += 1
            self.deeper()
            level, self.level = self.level, 0
            if self.k[self.i] in ("[", "map", "chan", "struct", "interface"):
                self.type_or_expression()
            else:
                self.expression()
            self.level = level
            self.need(")")
            self.depth -= 1
            return "paren"
        if k == "func":
            self.i += 1
            self.signature()
            if self.k[self.i] == "{":
                self.body()
                return "func"
            return "type"
        if k in ("[", "map", "chan", "struct", "interface"):
            self.type()
            return "type"
        self.fail()

    def tail(self, kind: str) -> str:
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    kind = "assert"
                else:
                    self.need("ID")
                    kind = "operand"
            elif k == "(":
                self.arguments()
                kind = "call"
            elif k == "[" and kind != "type":
                self.i += 1
                self.index()
                kind = "index"
            elif k == "{" and kind in ("type", "id", "operand", "index") and (kind == "type" or self.level >= 0):
                self.literal()
                kind = "composite"
            else:
                return kind

    def index(self) -> None:
        level, self.level = self.level, 0
        self.deeper()
        colons = 0
        if self.k[self.i] == "]":
            self.fail()
        while not self.eat("]"):
            if self.eat(":"):
                colons += 1
                if colons > 2:
                    self.fail()
                continue
            if self.k[self.i] in ("map", "chan", "struct", "interface", "func") or (self.k[self.i] == "["):
                self.type()
            else:
                self.expression()
            if self.eat(","):
                continue
            if self.k[self.i] not in ("]", ":"):
                self.fail()
        self.depth -= 1
        self.level = level

    def arguments(self) -> None:
        self.need("(")
        self.deeper()
        level, self.level = self.level, 0
        while not self.eat(")"):
            if self.k[self.i] in ("[", "map", "chan", "struct", "interface", "func", "*", "<-"):
                self.type_or_expression()
            else:
                self.expression()
            self.eat("...")
            if self.k[self.i] != ")":
                self.need(",")
        self.level = level
        self.depth -= 1

    def literal(self) -> None:
        self.need("{")
        self.deeper()
        level, self.level = self.level, 0
        while not self.eat("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if self.k[self.i] != "}":
                self.need(",")
        self.level = level
        self.depth -= 1

    def element(self) -> None:
        if self.k[self.i] == "{":
            self.literal()
        else:
            self.expression()


def check(text: str) -> list[tuple[int, str]]:
    """An empty file is no error here: it holds no invalid syntax."""
    if not text.strip():
        return []
    p = Go(text)
    p.file()
    return sorted(p.errors)
