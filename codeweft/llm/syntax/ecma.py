"""ECMAScript (script or module) and TypeScript by recursive descent.

Statements are parsed by descent, expressions by precedence climbing; arrow functions and type
arguments are decided by looking ahead with the cursor restored on failure.
"""

from __future__ import annotations

import re

from codeweft.llm.syntax.base import Bad, Cursor, LexError

_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)+")
_TOKEN = re.compile(
    r"(?P<ID>(?:[^\W\d]|[$\\#])(?:[\w$\u200c\u200d]|\\u\{?[0-9a-fA-F]+\}?)*)"
    r"|(?P<NUM>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:\d+(?:_\d+)*)?\.?\d+(?:_\d+)*(?:[eE][+-]?\d+)?n?|\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?(?:[eE][+-]?\d+)?n?)"
    r"|(?P<STR>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<P>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_NUMBER_END = re.compile(r"[\w$]")

#: Reserved words.
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for
    function if import in instanceof new null return super switch this throw true try typeof var void while with""".split()
)
#: Binary operators and how tightly they bind.
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
#: Assignment operators.
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default".split())


def tokens(text: str) -> tuple[list[str], list[str], list[int], list[bool], list[tuple[int, str]]]:
    kinds: list[str] = []
    values: list[str] = []
    offsets: list[int] = []
    breaks: list[bool] = []
    errors: list[tuple[int, str]] = []
    pos, n, broke = 0, len(text), True
    space, token = _SPACE.match, _TOKEN.match
    # open brackets: (text, does a regular expression follow its close)
    stack: list[tuple[str, bool]] = []
    prev, regex = "", True
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n

    def add(kind: str, value: str, at: int) -> None:
        kinds.append(kind)
        values.append(value)
        offsets.append(at)
        breaks.append(broke)

    def template(at: int) -> int:
        end = _TEMPLATE.match(text, at).end()
        if end >= n:
            raise LexError(at, "template literal without an end")
        if text[end] == "`":
            add("T)", "`", end)
            return end + 1
        stack.append(("`", False))
        add("T$", "${", end)
        return end + 2

    while True:
        m = space(text, pos)
        if m:
            s = m.group()
            if "\n" in s or "\r" in s or "\u2028" in s or "\u2029" in s:
                broke = True
            pos = m.end()
        if pos >= n:
            break
        c = text[pos]
        try:
            if c == "`":
                add("T(", "`", pos)
                broke = False
                pos = template(pos + 1)
                prev, regex = "T", kinds[-1] == "T$"
                continue
            if c == "/" and regex:
                m = _REGEX.match(text, pos)
                if not m:
                    raise LexError(pos, "regular expression or comment without an end")
                add("RE", m.group(), pos)
                pos, prev, regex, broke = m.end(), "RE", False, False
                continue
            m = token(text, pos)
            if not m:
                raise LexError(pos, f"unexpected character {c!r}" if c not in "\"'" else "string without an end")
        except LexError as e:
            errors.append((e.pos, e.message))
            end = text.find("\n", pos)
            pos = n if end < 0 else end
            regex = True
            continue
        kind, v = m.lastgroup, m.group()
        at, pos = pos, m.end()
        if kind == "ID":
            if "\\" not in v and v in RESERVED:
                add(v, v, at)
                regex = v not in ("this", "super", "null", "true", "false")
            else:
                if v == "#" or (v[0] == "\\" and len(v) < 3) or "#" in v[1:]:
                    errors.append((at, "unexpected character '#'"))
                add("ID", v, at)
                regex = v in _BEFORE_REGEX
            if prev == "." or prev == "?.":
                regex = False
        elif kind == "P":
            if v == "}" and stack and stack[-1][0] == "`":
                stack.pop()
                broke = False
                pos = template(at + 1) if _safe(text, at + 1, n) else n
                if pos == n and kinds[-1] not in ("T)", "T$"):
                    errors.append((at, "template literal without an end"))
                prev, regex = "T", kinds[-1] == "T$"
                continue
            add(v, v, at)
            if v == "(":
                stack.append((v, prev in ("if", "while", "for", "with")))
                regex = True
            elif v == "{":
                block = prev in ("", ")", ";", "{", "}", "=>", "else", "do", "try", "finally", "ID") or prev == ":" or breaks[-1]
                stack.append((v, block))
                regex = True
            elif v == "[":
                stack.append((v, False))
                regex = True
            elif v in (")", "}", "]"):
                regex = stack.pop()[1] if stack else False
            elif v in ("++", "--"):
                regex = regex and prev not in (")", "]", "ID")
            else:
                regex = True
        else:
            add(kind, v, at)
            regex = False
            if kind == "NUM" and (pos < n and _NUMBER_END.match(text, pos)):
                errors.append((at, "identifier directly after number"))
        prev = kinds[-1] if kind != "ID" else (v if v in RESERVED or v in _BEFORE_REGEX else "ID")
        broke = False
    broke = True
    add("END", "", n)
    return kinds, values, offsets, breaks, errors


def _safe(text: str, at: int, n: int) -> bool:
    return _TEMPLATE.match(text, at).end() < n


class Ecma(Cursor):
    def __init__(self, text: str, ts: bool) -> None:
        k, v, o, b, errors = tokens(text)
        super().__init__(text, k, v, o, b)
        self.errors = errors
        self.ts = ts
        self.functions = self.generators = 0
        self.loops = self.switches = 0
        self.covers: list[int] = []
        self.no_in = False
        self.ambient = 0
        self.no_conditional = False
        self.match = self._brackets()

    def _brackets(self) -> dict[int, int]:
        out, stack = {}, []
        for i, k in enumerate(self.k):
            if k in ("(", "[", "{", "T$"):
                stack.append(i)
            elif k in (")", "]", "}") and stack:
                out[stack.pop()] = i
        return out

    # -- helpers
    def word(self, w: str) -> bool:
        return self.k[self.i] == "ID" and self.v[self.i] == w

    def eat_word(self, w: str) -> bool:
        if self.k[self.i] == "ID" and self.v[self.i] == w:
            self.i += 1
            return True
        return False

    def adjacent(self) -> str:
        """The operator at the cursor; > and what touches it is joined here, since types split it."""
        k = self.k[self.i]
        if k != ">":
            return k
        i, s = self.i, ">"
        while len(s) < 4 and self.k[i + 1] in (">", "=", "==", "=>", "===") and self.o[i + 1] == self.o[i] + len(self.v[i]):
            nxt = self.k[i + 1]
            if nxt == ">":
                s += ">"
                i += 1
            elif nxt == "=":
                return s + "="
            else:
                break
        return s

    def skip_op(self, op: str) -> None:
        self.i += len(op) if op[0] == ">" else 1

    def trying(self, f):
        """f's result, or None with the cursor back where it was."""
        i, depth, covers, no_in, nc = self.i, self.depth, list(self.covers), self.no_in, self.no_conditional
        state = self.functions, self.generators, self.loops, self.switches, self.ambient
        try:
            return f() or True
        except Bad:
            self.i, self.depth, self.covers, self.no_in, self.no_conditional = i, depth, covers, no_in, nc
            self.functions, self.generators, self.loops, self.switches, self.ambient = state
            return None

    def semicolon(self) -> None:
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and k != "END" and not self.nl[self.i]:
            self.fail(f"expected ';', found {self.show()}")

    def name(self) -> None:
        """A binding identifier."""
        if self.k[self.i] != "ID" or self.v[self.i][0] == "#":
            self.fail(f"expected a name, found {self.show()}")
        self.i += 1

    def any_name(self) -> None:
        k = self.k[self.i]
        if k != "ID" and k not in RESERVED:
            self.fail(f"expected a name, found {self.show()}")
        self.i += 1

    # -- program and statements
    def program(self) -> None:
        while self.k[self.i] != "END":
            start = self.i
            try:
                self.statement(True)
                self.uncovered(0)
            except Bad as e:
                self.note(e)
                self.panic(max(start, min(e.at, self.i)))

    def uncovered(self, upto: int) -> None:
        if len(self.covers) > upto:
            at = self.covers[upto]
            del self.covers[upto:]
            raise Bad(at, "initialiser of a shorthand property outside a pattern")

    def panic(self, start: int) -> None:
        """Skip to where a statement may begin: past ';' or '}', or a line that starts with a keyword."""
        self.depth = self.functions = self.generators = self.loops = self.switches = self.ambient = 0
        self.covers.clear()
        self.no_in = self.no_conditional = False
        self.i = max(self.i, start)
        while self.k[self.i] != "END":
            k = self.k[self.i]
            self.i += 1
            if k in (";", "}") or (self.nl[self.i] and self.k[self.i] in ("function", "class", "const", "var", "import", "export", "if", "for", "while", "return", "try")):
                return

    def block(self) -> None:
        self.need("{")
        self.deeper()
        k = self.k
        while k[self.i] != "}":
            if k[self.i] == "END":
                self.fail("'{' is never closed")
            self.statement()
        self.i += 1
        self.depth -= 1

    def statement(self, top: bool = False) -> None:
        k = self.k[self.i]
        f = _STATEMENTS.get(k)
        if f:
            if k == "import" and self.k[self.i + 1] in ("(", "."):
                self.expression_statement()
            else:
                f(self)
            return
        if k == "ID":
            v, nxt = self.v[self.i], self.k[self.i + 1]
            if nxt == ":" and v != "await":
                self.i += 2
                self.statement()
                return
            if v == "async" and nxt == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True)
                return
            if v == "let" and (nxt in ("ID", "[", "{")):
                self.declarations()
                self.semicolon()
                return
            if self.ts and self.ts_statement(v, nxt):
                return
            if v == "using" and nxt == "ID" and not self.nl[self.i + 1]:
                self.declarations()
                self.semicolon()
                return
        self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.uncovered(0)
        self.semicolon()

    def empty(self) -> None:
        self.i += 1

    def variable(self) -> None:
        if self.k[self.i] == "const" and self.ts and self.k[self.i + 1] == "enum":
            self.i += 1
            self.ts_enum()
            return
        self.declarations()
        self.semicolon()

    def declarations(self, in_for: bool = False) -> None:
        const = self.k[self.i] == "const"
        self.i += 1
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.binding()
            typed = False
            if self.ts:
                if self.k[self.i] == "!":
                    self.i += 1
                if self.eat(":"):
                    self.type()
                    typed = not pattern
            if self.eat("="):
                self.assignment()
            elif (pattern or const) and not in_for and not self.ambient and not typed:
                self.fail("declaration without a value")
            elif in_for and (pattern or const) and not (self.k[self.i] == "in" or self.word("of")):
                self.fail("declaration without a value")
            if not self.eat(","):
                return

    def binding(self) -> None:
        k = self.k[self.i]
        if k == "[":
            self.deeper()
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding_element()
                if self.k[self.i] != "]":
                    if rest:
                        self.fail("rest element must be last")
                    self.need(",")
            self.depth -= 1
        elif k == "{":
            self.deeper()
            self.i += 1
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                    if self.k[self.i] != "}":
                        self.fail("rest element must be last")
                    continue
                plain = self.k[self.i] == "ID"
                self.property_name()
                if self.eat(":"):
                    self.binding_element()
                elif not plain:
                    self.fail()
                elif self.eat("="):
                    self.assignment()
                if self.k[self.i] != "}":
                    self.need(",")
            self.depth -= 1
        else:
            self.name()

    def binding_element(self) -> None:
        self.binding()
        if self.eat("="):
            self.assignment()

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.substatement()
        if self.eat("else"):
            self.substatement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.uncovered(0)
        self.need(")")

    def substatement(self) -> None:
        k = self.k[self.i]
        if k in ("class", "const", "import", "export") or (k == "ID" and self.v[self.i] == "let" and self.k[self.i + 1] == "["):
            self.fail("a declaration is not a statement here")
        self.deeper()
        self.statement()
        self.depth -= 1

    def for_(self) -> None:
        self.i += 1
        self.eat_word("await")
        self.need("(")
        no_in, self.no_in = self.no_in, True
        k = self.k[self.i]
        each = False
        if k == ";":
            pass
        elif k in ("var", "const") or (k == "ID" and self.v[self.i] in ("let", "using") and self.k[self.i + 1] in ("ID", "[", "{") and self.v[self.i + 1] not in ("of", "in")):
            self.declarations(True)
        else:
            kind = self.expression()
            if self.k[self.i] == "in" or self.word("of"):
                if kind not in ("id", "mem", "obj", "arr"):
                    self.fail("not a target")
                self.covers.clear()
        self.no_in = no_in
        if self.k[self.i] == "in":
            self.i += 1
            self.expression()
            each = True
        elif self.word("of"):
            self.i += 1
            self.assignment()
            each = True
        if not each:
            self.uncovered(0)
            self.need(";")
            if self.k[self.i] != ";":
                self.expression()
            self.need(";")
            if self.k[self.i] != ")":
                self.expression()
        self.uncovered(0)
        self.need(")")
        self.body_of_loop()

    def body_of_loop(self) -> None:
        self.loops += 1
        self.substatement()
        self.loops -= 1

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.body_of_loop()

    def do(self) -> None:
        self.i += 1
        self.body_of_loop()
        self.need("while")
        self.condition()
        self.eat(";")

    def with_(self) -> None:
        self.i += 1
        self.condition()
        self.substatement()

    def return_(self) -> None:
        if not self.functions:
            self.fail("return outside a function")
        self.i += 1
        if not self.nl[self.i] and self.k[self.i] not in (";", "}", "END"):
            self.expression()
            self.uncovered(0)
        self.semicolon()

    def jump(self) -> None:
        word = self.k[self.i]
        self.i += 1
        if self.k[self.i] == "ID" and not self.nl[self.i]:
            self.i += 1
        elif not self.loops and not (word == "break" and self.switches):
            self.i -= 1
            self.fail(f"{word} outside a loop")
        self.semicolon()

    def throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.fail("line break after throw")
        self.expression()
        self.uncovered(0)
        self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = False
        if self.eat("catch"):
            caught = True
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            self.fail("expected catch or finally")

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        self.deeper()
        self.switches += 1
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                if default:
                    self.fail("more than one default")
                self.need("default")
                default = True
            self.need(":")
            while self.k[self.i] not in ("case", "default", "}"):
                if self.k[self.i] == "END":
                    self.fail("'{' is never closed")
                self.statement()
        self.switches -= 1
        self.depth -= 1

    def debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def import_(self) -> None:
        self.i += 1
        if self.k[self.i] == "STR":
            self.i += 1
            self.attributes()
            self.semicolon()
            return
        if self.ts and self.word("type") and (self.k[self.i + 1] in ("{", "*") or self.k[self.i + 1] == "ID" and self.v[self.i + 1] != "from" or self.k[self.i + 1] == "ID" and self.v[self.i + 2] == "from"):
            self.i += 1
        if self.k[self.i] == "ID":
            self.i += 1
            if self.ts and self.eat("="):
                if self.word("require") and self.k[self.i + 1] == "(":
                    self.i += 2
                    self.need("STR")
                    self.need(")")
                else:
                    self.type_name()
                self.semicolon()
                return
            if not self.eat(","):
                self.from_()
                return
        if self.eat("*"):
            if not self.eat_word("as"):
                self.fail("expected 'as'")
            self.name()
        else:
            self.specifiers(True)
        self.from_()

    def from_(self) -> None:
        if not self.eat_word("from"):
            self.fail(f"expected 'from', found {self.show()}")
        self.need("STR")
        self.attributes()
        self.semicolon()

    def attributes(self) -> None:
        if self.k[self.i] == "with" or (self.word("assert") and not self.nl[self.i]):
            self.i += 1
            if self.k[self.i] != "{":
                self.fail()
            self.primary()

    def specifiers(self, bind: bool) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.word("type") and self.k[self.i + 1] not in (",", "}") and self.v[self.i + 1] != "as":
                self.i += 1
            reserved = self.k[self.i] in RESERVED or self.k[self.i] == "STR"
            if not self.eat("STR"):
                self.any_name()
            if self.eat_word("as"):
                if bind:
                    self.name()
                elif not self.eat("STR"):
                    self.any_name()
            elif bind and reserved:
                self.fail("a reserved word is no name")
            if self.k[self.i] != "}":
                self.need(",")

    def export(self) -> None:
        self.i += 1
        k = self.k[self.i]
        if k == "default":
            self.i += 1
            if self.k[self.i] == "function":
                self.function(False, True)
            elif self.word("async") and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True, True)
            elif self.k[self.i] == "class" or self.k[self.i] == "@":
                self.class_(True)
            elif self.ts and self.word("abstract") and self.k[self.i + 1] == "class":
                self.i += 1
                self.class_(True)
            elif self.ts and self.word("interface") and self.k[self.i + 1] == "ID":
                self.ts_statement("interface", "ID")
            else:
                self.assignment()
                self.uncovered(0)
                self.semicolon()
        elif k == "*":
            self.i += 1
            if self.eat_word("as") and not self.eat("STR"):
                self.any_name()
            self.from_()
        elif k == "{" or (self.ts and self.word("type") and self.k[self.i + 1] in ("{", "*")):
            if k != "{":
                self.i += 1
            if self.eat("*"):
                if self.eat_word("as"):
                    self.any_name()
                self.from_()
                return
            self.specifiers(False)
            if self.word("from"):
                self.from_()
            else:
                self.semicolon()
        elif self.ts and k == "=":
            self.i += 1
            self.expression()
            self.semicolon()
        elif self.ts and self.word("as") and self.v[self.i + 1] == "namespace":
            self.i += 2
            self.name()
            self.semicolon()
        elif self.ts and k == "import":
            self.import_()
        elif k in ("var", "const", "function", "class", "@") or (k == "ID" and (self.v[self.i] in ("let", "async") or self.ts)):
            start = self.i
            self.statement()
            if k == "ID" and self.v[start] not in ("let", "async", "interface", "type", "enum", "namespace", "module", "declare", "abstract"):
                raise Bad(start, "not a declaration")
        elif self.ts and k == "enum":
            self.ts_enum()
        else:
            self.fail()

    # -- functions and classes
    def function(self, is_async: bool = False, unnamed: bool = False) -> None:
        self.need("function")
        star = self.eat("*")
        if self.k[self.i] == "ID":
            self.i += 1
        elif not unnamed:
            self.fail(f"expected a name, found {self.show()}")
        self.signature_and_body(star)

    def signature_and_body(self, star: bool = False, optional: bool = False) -> None:
        if self.ts and self.k[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()
        if self.k[self.i] != "{" and self.ts:
            self.semicolon()
            return
        self.body(star)

    def body(self, star: bool = False) -> None:
        if self.k[self.i] != "{":
            self.fail(f"expected '{{', found {self.show()}")
        saved = self.loops, self.switches, self.generators, self.no_in, self.ambient, self.covers, self.no_conditional
        self.loops = self.switches = self.ambient = 0
        self.generators, self.no_in, self.covers, self.no_conditional = int(star), False, [], False
        self.functions += 1
        self.block()
        self.functions -= 1
        self.loops, self.switches, self.generators, self.no_in, self.ambient, self.covers, self.no_conditional = saved

    def parameters(self) -> None:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        while not self.eat(")"):
            while self.k[self.i] == "@":
                self.decorator()
            rest = self.eat("...")
            if self.ts:
                while self.k[self.i] == "ID" and self.v[self.i] in ("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] in ("ID", "{", "["):
                    self.i += 1
                if self.k[self.i] == "this":
                    self.i += 1
                else:
                    self.binding()
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                self.binding()
            if self.eat("="):
                if rest:
                    self.fail("rest parameter with a default")
                self.assignment()
            if self.k[self.i] != ")":
                if rest:
                    self.fail("rest parameter must be last")
                self.need(",")
        self.no_in = no_in

    def decorator(self) -> None:
        self.need("@")
        if self.eat("("):
            self.expression()
            self.need(")")
        else:
            self.any_name()
            while self.eat("."):
                self.any_name()
            if self.ts and self.k[self.i] == "<":
                self.type_arguments()
            if self.k[self.i] == "(":
                self.arguments()

    def class_(self, unnamed: bool = False) -> None:
        while self.k[self.i] == "@":
            self.decorator()
        if self.k[self.i] == "export":
            self.export()
            return
        if self.ts:
            self.eat_word("abstract")
        self.need("class")
        if self.k[self.i] == "ID" and not (self.ts and self.v[self.i] == "implements"):
            self.i += 1
        elif not unnamed:
            self.fail(f"expected a name, found {self.show()}")
        if self.ts and self.k[self.i] == "<":
            self.type_parameters()
        if self.eat("extends"):
            self.postfix()
            if self.ts and self.k[self.i] == "<":
                self.type_arguments()
        if self.ts and self.eat_word("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.deeper()
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()
        self.depth -= 1

    def member(self) -> None:
        while self.k[self.i] == "@":
            self.decorator()
        star, ends = False, ("(", "=", ";", "}", "?", "!", ":", "<") if self.ts else ("(", "=", ";", "}")
        mods = ("static", "get", "set", "async", "accessor") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.ts else ())
        while self.k[self.i] == "ID" and self.v[self.i] in mods and self.k[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.v[self.i] != "static"):
            if self.v[self.i] == "static" and self.k[self.i + 1] == "{":
                self.i += 1
                self.body()
                return
            self.i += 1
        if self.eat("*"):
            star = True
        if self.ts and self.k[self.i] == "[" and self.k[self.i + 1] == "ID" and self.k[self.i + 2] == ":":
            self.index_signature()
            self.semicolon()
            return
        self.property_name()
        if self.ts:
            if self.k[self.i] in ("?", "!"):
                self.i += 1
        if self.k[self.i] == "(" or (self.ts and self.k[self.i] == "<"):
            self.signature_and_body(star)
            return
        if star:
            self.fail()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.semicolon()

    def property_name(self) -> None:
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = no_in
            self.need("]")
        elif k in ("ID", "STR", "NUM") or k in RESERVED:
            self.i += 1
        else:
            self.fail(f"expected a property, found {self.show()}")

    # -- expressions
    def expression(self) -> str:
        kind = self.assignment()
        while self.k[self.i] == ",":
            self.i += 1
            self.assignment()
            kind = "seq"
        return kind

    def assignment(self) -> str:
        self.deeper()
        kind = self._assignment()
        self.depth -= 1
        return kind

    def _assignment(self) -> str:
        k, i = self.k[self.i], self.i
        if k == "ID":
            v, nxt = self.v[i], self.k[i + 1]
            if nxt == "=>" and not self.nl[i + 1]:
                self.i += 1
                return self.arrow()
            if v == "async" and not self.nl[i + 1]:
                if nxt == "ID" and self.k[i + 2] == "=>":
                    self.i += 2
                    return self.arrow()
                if nxt == "(" or (self.ts and nxt == "<"):
                    self.i += 1
                    if self.is_arrow():
                        return "arrow"
                    self.i = i
            elif v == "yield" and self.generators:
                self.i += 1
                if not self.nl[self.i] and (self.eat("*") or self.k[self.i] not in (")", "]", "}", ",", ";", ":", "END", "T$", "in")):
                    self.assignment()
                return "yield"
        elif (k == "(" or (k == "<" and self.ts)) and self.is_arrow():
            return "arrow"
        covers = len(self.covers)
        kind = self.conditional()
        op = self.adjacent()
        if op in ASSIGN:
            if op == "=":
                if kind not in ("id", "mem", "obj", "arr"):
                    self.fail("not a target of an assignment")
                del self.covers[covers:]
            elif kind not in ("id", "mem"):
                self.fail("not a target of an assignment")
            self.skip_op(op)
            self.assignment()
            return "assign"
        return kind

    def is_arrow(self) -> bool:
        """Parses an arrow function if one starts here."""
        i = self.i
        if self.k[i] == "(":
            end = self.match.get(i)
            if end is None:
                return False
            after = self.k[end + 1]
            if after != "=>" and not (self.ts and after == ":"):
                return False
            if after == "=>":
                self.parameters()
                self.arrow()
                return True
        return bool(self.trying(self.ts_arrow))

    def ts_arrow(self) -> None:
        if self.k[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.eat(":"):
            nc, self.no_conditional = self.no_conditional, False
            self.return_type()
            self.no_conditional = nc
        self.arrow()

    def arrow(self) -> str:
        if self.nl[self.i]:
            self.fail("line break before '=>'")
        self.need("=>")
        if self.k[self.i] == "{":
            self.body()
        else:
            saved, self.generators = self.generators, 0
            self.functions += 1
            self.assignment()
            self.functions -= 1
            self.generators = saved
        return "arrow"

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.k[self.i] == "?":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = no_in
            self.need(":")
            self.assignment()
            return "cond"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        while True:
            op = self.adjacent()
            p = BINARY.get(op)
            if p is None:
                if self.ts and op == "ID" and self.v[self.i] in ("as", "satisfies") and not self.nl[self.i] and least < 8:
                    self.i += 1
                    if self.k[self.i] == "const":
                        self.i += 1
                    else:
                        self.type()
                    kind = kind if kind in ("id", "mem") else "bin"
                    continue
                return kind
            if p <= least and not (op == "**" and p == least):
                return kind
            if op == "in" and self.no_in:
                return kind
            if op == "**" and kind == "unary":
                self.fail("unary expression before '**'")
            self.skip_op(op)
            if kind == "private" and op != "in":
                self.fail("a private name is no value")
            self.binary(p - 1 if op == "**" else p)
            kind = "bin"

    def unary(self) -> str:
        k = self.k[self.i]
        if k in _PREFIX:
            self.i += 1
            self.deeper()
            kind = self.unary()
            self.depth -= 1
            if k in ("++", "--"):
                if kind not in ("id", "mem"):
                    self.fail(f"not a target of {k}")
                return "update"
            return "unary"
        if k == "ID" and self.v[self.i] == "await":
            nxt = self.k[self.i + 1]
            if not self.nl[self.i + 1] and (nxt in ("ID", "NUM", "STR", "RE", "T(", "(", "[", "{", "this", "new", "function", "class", "null", "true", "false", "super", "import", "!", "~", "typeof", "void", "delete")):
                self.i += 1
                self.unary()
                return "unary"
        if k == "<" and self.ts:
            self.i += 1
            if not self.eat("const"):
                self.type()
            self.need(">")
            return self.unary()
        kind = self.postfix()
        if self.k[self.i] in ("++", "--") and not self.nl[self.i]:
            if kind not in ("id", "mem"):
                self.fail("not a target of an update")
            self.i += 1
            return "update"
        return kind

    def postfix(self) -> str:
        kind = self.new() if self.k[self.i] == "new" else self.primary()
        return self.tail(kind, True)

    def tail(self, kind: str, calls: bool) -> str:
        optional = False
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.any_name()
                kind = "mem"
            elif k == "?.":
                if not calls:
                    self.fail("optional chain in new")
                self.i += 1
                optional = True
                if self.k[self.i] == "(":
                    self.arguments()
                elif self.k[self.i] == "[":
                    self.i += 1
                    self.expression()
                    self.need("]")
                else:
                    self.any_name()
                kind = "call"
            elif k == "(" and calls:
                self.arguments()
                kind = "call"
            elif k == "[":
                self.i += 1
                no_in, self.no_in = self.no_in, False
                self.expression()
                self.no_in = no_in
                self.need("]")
                kind = "mem"
            elif k == "T(":
                self.template()
                kind = "call"
            elif k == "!" and self.ts and not self.nl[self.i]:
                self.i += 1
            elif k == "<" and self.ts and calls and self.trying(self.call_types):
                kind = "call" if kind != "id" else "id"
            else:
                return "call" if optional and kind == "mem" else kind

    def call_types(self) -> None:
        self.type_arguments()
        if self.k[self.i] not in ("(", "T(", ")", "]", ",", ";", ":", "}", "END", "?.", "."):
            self.fail()

    def arguments(self) -> None:
        self.need("(")
        self.deeper()
        no_in, self.no_in = self.no_in, False
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if self.k[self.i] != ")":
                self.need(",")
        self.no_in = no_in
        self.depth -= 1

    def new(self) -> str:
        self.need("new")
        if self.eat("."):
            self.any_name()
            return "lit"
        if self.k[self.i] == "new":
            self.new()
        else:
            self.tail(self.primary(), False)
            if self.ts and self.k[self.i] == "<":
                self.trying(self.type_arguments)
        if self.k[self.i] == "(":
            self.arguments()
        return "call"

    def template(self) -> None:
        self.need("T(")
        while True:
            if self.eat("T)"):
                return
            self.need("T$")
            self.expression()
            if self.k[self.i] not in ("T$", "T)"):
                self.fail(f"expected '}}' in a template, found {self.show()}")

    def primary(self) -> str:
        k = self.k[self.i]
        if k == "ID":
            if self.v[self.i] == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(True, True)
                return "lit"
            if self.v[self.i][0] == "#":
                self.i += 1
                if self.k[self.i] != "in":
                    self.fail("a private name is no value")
                return "private"
            self.i += 1
            return "id"
        if k in ("NUM", "STR", "RE", "this", "null", "true", "false"):
            self.i += 1
            return "lit"
        if k == "(":
            self.i += 1
            self.deeper()
            no_in, self.no_in = self.no_in, False
            kind = self.expression()
            self.no_in = no_in
            self.need(")")
            self.depth -= 1
            return kind if kind in ("id", "mem") else "paren"
        if k == "[":
            self.i += 1
            self.deeper()
            no_in, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
            self.no_in = no_in
            self.depth -= 1
            return "arr"
        if k == "{":
            return self.object()
        if k == "function":
            self.function(False, True)
            return "lit"
        if k == "class" or k == "@":
            self.class_(True)
            return "lit"
        if k == "T(":
            self.template()
            return "lit"
        if k == "super":
            self.i += 1
            if self.k[self.i] not in ("(", ".", "["):
                self.fail("super without a use")
            return "lit"
        if k == "import":
            self.i += 1
            if self.eat("."):
                self.any_name()
                return "lit"
            if self.k[self.i] != "(":
                self.fail()
            return "lit"
        if k == "new":
            return self.new()
        self.fail()

    def object(self) -> str:
        self.need("{")
        self.deeper()
        no_in, self.no_in = self.no_in, False
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                plain, star = self.k[self.i] == "ID", False
                nxt = self.k[self.i + 1]
                if plain and self.v[self.i] in ("get", "set", "async") and nxt not in ("(", ",", ":", "}", "=", "<"):
                    self.i += 1
                    plain = False
                    star = self.eat("*")
                    self.property_name()
                    self.signature_and_body(star)
                elif self.k[self.i] == "*":
                    self.i += 1
                    self.property_name()
                    self.signature_and_body(True)
                else:
                    self.property_name()
                    if self.k[self.i] == ":":
                        self.i += 1
                        self.assignment()
                    elif self.k[self.i] == "(" or (self.ts and self.k[self.i] == "<"):
                        self.signature_and_body()
                    elif not plain:
                        self.fail(f"expected ':', found {self.show()}")
                    elif self.k[self.i] == "=":
                        self.covers.append(self.i)
                        self.i += 1
                        self.assignment()
            if self.k[self.i] != "}":
                self.need(",")
        self.no_in = no_in
        self.depth -= 1
        return "obj"

    # -- TypeScript declarations
    def ts_statement(self, v: str, nxt: str) -> bool:
        same_line = not self.nl[self.i + 1]
        if v == "interface" and nxt == "ID" and same_line:
            self.i += 2
            if self.k[self.i] == "<":
                self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
            return True
        if v == "type" and nxt == "ID" and same_line:
            self.i += 2
            if self.k[self.i] == "<":
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if v == "abstract" and nxt == "class":
            self.class_()
            return True
        if v == "declare" and same_line and (nxt in ("ID", "const", "var", "function", "class", "enum", "import")):
            self.i += 1
            self.ambient += 1
            if self.word("global") and self.k[self.i + 1] == "{":
                self.i += 1
                self.block()
            else:
                self.statement()
            self.ambient -= 1
            return True
        if v == "global" and nxt == "{":
            self.i += 1
            self.block()
            return True
        if v in ("namespace", "module") and nxt in ("ID", "STR") and same_line:
            self.i += 2
            while self.eat("."):
                self.any_name()
            if self.k[self.i] == "{":
                self.block()
            else:
                self.semicolon()
            return True
        return False

    def ts_enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if self.k[self.i] != "}":
                self.need(",")

    def enum(self) -> None:
        if not self.ts:
            self.fail()
        self.ts_enum()

    # -- TypeScript types
    def type_parameters(self) -> None:
        self.need("<")
        while not self.eat(">"):
            while self.k[self.i] in ("const", "in") or (self.word("out") and self.k[self.i + 1] == "ID"):
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if self.k[self.i] != ">":
                self.need(",")

    def type_arguments(self) -> None:
        self.need("<")
        self.deeper()
        while True:
            self.type()
            if self.eat(">"):
                break
            self.need(",")
        self.depth -= 1

    def return_type(self) -> None:
        if self.word("asserts") and self.k[self.i + 1] in ("ID", "this") and not self.nl[self.i + 1]:
            self.i += 2
            if self.eat_word("is"):
                self.type()
            return
        if self.k[self.i] in ("ID", "this") and self.k[self.i + 1] == "ID" and self.v[self.i + 1] == "is" and not self.nl[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        self.deeper()
        if self.function_type():
            self.depth -= 1
            return
        self.union_type()
        if not self.no_conditional and self.k[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            nc, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = nc
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        self.depth -= 1

    def function_type(self) -> bool:
        i = self.i
        if self.word("abstract") and self.k[i + 1] == "new":
            self.i += 1
        if self.eat("new"):
            pass
        elif self.k[self.i] == "(":
            end = self.match.get(self.i)
            if end is None or self.k[end + 1] != "=>" or not self.starts_parameters(self.i + 1):
                return False
        elif self.k[self.i] != "<":
            return False
        if self.k[self.i] == "<":
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()
        return True

    def starts_parameters(self, i: int) -> bool:
        """Whether what follows '(' can only be parameters, as opposed to a type in parentheses."""
        k = self.k[i]
        if k in (")", "..."):
            return True
        if k in ("{", "["):
            i = self.match.get(i, i)
        elif k not in ("ID", "this"):
            return False
        return self.k[i + 1] in (":", ",", "?", "=") or (self.k[i + 1] == ")" and self.k[i + 2] == "=>")

    def union_type(self) -> None:
        if self.k[self.i] in ("|", "&"):
            self.i += 1
        while True:
            self.prefix_type()
            if self.k[self.i] not in ("|", "&"):
                return
            self.i += 1
            if self.function_type():
                return

    def prefix_type(self) -> None:
        while self.k[self.i] == "ID" and self.v[self.i] in ("keyof", "unique", "readonly", "infer") and self.k[self.i + 1] in ("ID", "(", "[", "{", "STR", "NUM", "typeof", "this", "T("):
            infer = self.v[self.i] == "infer"
            self.i += 1
            if infer:
                self.name()
                if self.k[self.i] == "extends":
                    self.trying(self.infer_constraint)
                return self.array_tail()
        k = self.k[self.i]
        if k == "(":
            self.i += 1
            nc, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = nc
            self.need(")")
        elif k == "{":
            self.object_type()
        elif k == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.k[self.i] == "ID" and (self.k[self.i + 1] == ":" or (self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":")):
                    self.i += 2 if self.k[self.i + 1] == ":" else 3
                self.type()
                self.eat("?")
                if self.k[self.i] != "]":
                    self.need(",")
        elif k in ("STR", "NUM", "this", "null", "true", "false", "void"):
            self.i += 1
        elif k == "-" and self.k[self.i + 1] == "NUM":
            self.i += 2
        elif k == "T(":
            self.i += 1
            while not self.eat("T)"):
                self.need("T$")
                self.type()
        elif k == "typeof":
            self.i += 1
            if self.k[self.i] == "import":
                self.import_type()
            else:
                self.type_name()
        elif k == "import":
            self.import_type()
        elif k == "ID":
            self.type_name()
        else:
            self.fail(f"expected a type, found {self.show()}")
        self.array_tail()

    def infer_constraint(self) -> None:
        self.need("extends")
        nc, self.no_conditional = self.no_conditional, True
        self.type()
        self.no_conditional = nc
        if self.k[self.i] == "?" and not nc:
            self.fail()

    def import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.eat(","):
            self.type()
        self.need(")")
        while self.eat("."):
            self.any_name()
        if self.k[self.i] == "<":
            self.type_arguments()

    def array_tail(self) -> None:
        while self.k[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def type_name(self) -> None:
        if self.k[self.i] == "this":
            self.i += 1
        else:
            self.name()
        while self.eat("."):
            self.any_name()
        if self.k[self.i] == "<" and not self.nl[self.i]:
            self.type_arguments()

    def index_signature(self) -> None:
        self.i += 3
        self.type()
        self.need("]")
        if self.eat(":"):
            self.type()

    def object_type(self) -> None:
        self.need("{")
        self.deeper()
        nc, self.no_conditional = self.no_conditional, False
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",")) and self.k[self.i] != "}" and not self.nl[self.i]:
                self.fail(f"expected ';', found {self.show()}")
        self.no_conditional = nc
        self.depth -= 1

    def type_member(self) -> None:
        if self.k[self.i] in ("+", "-") and self.v[self.i + 1] == "readonly":
            self.i += 2
        while self.k[self.i] == "ID" and self.v[self.i] in ("readonly", "get", "set") and self.k[self.i + 1] not in ("?", ":", "(", "<", ";", ",", "}"):
            self.i += 1
        k = self.k[self.i]
        if k == "new" and self.k[self.i + 1] in ("(", "<"):
            self.i += 1
            k = self.k[self.i]
        if k in ("(", "<"):
            self.call_signature()
            return
        if k == "[" and self.k[self.i + 1] == "ID":
            if self.k[self.i + 2] == ":":
                self.index_signature()
                return
            if self.k[self.i + 2] == "in":
                self.i += 3
                self.type()
                if self.eat_word("as"):
                    self.type()
                self.need("]")
                if self.k[self.i] in ("+", "-"):
                    self.i += 1
                self.eat("?")
                if self.eat(":"):
                    self.type()
                return
        self.property_name()
        self.eat("?")
        if self.k[self.i] in ("(", "<"):
            self.call_signature()
        elif self.eat(":"):
            self.type()

    def call_signature(self) -> None:
        if self.k[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.eat(":"):
            self.return_type()


_PREFIX = frozenset(["!", "~", "+", "-", "++", "--", "typeof", "void", "delete"])
_STATEMENTS = {
    "{": Ecma.block, ";": Ecma.empty, "var": Ecma.variable, "const": Ecma.variable, "function": Ecma.function,
    "class": Ecma.class_, "@": Ecma.class_, "if": Ecma.if_, "for": Ecma.for_, "while": Ecma.while_, "do": Ecma.do,
    "with": Ecma.with_, "return": Ecma.return_, "break": Ecma.jump, "continue": Ecma.jump, "throw": Ecma.throw,
    "try": Ecma.try_, "switch": Ecma.switch, "debugger": Ecma.debugger, "import": Ecma.import_, "export": Ecma.export,
    "enum": Ecma.enum,
}


def check_javascript(text: str) -> list[tuple[int, str]]:
    p = Ecma(text, False)
    p.program()
    return sorted(p.errors)


def check_typescript(text: str) -> list[tuple[int, str]]:
    p = Ecma(text, True)
    p.program()
    return sorted(p.errors)
