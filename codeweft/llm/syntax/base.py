"""What the parsers share: errors, the token cursor and panic-mode recovery."""

from __future__ import annotations

#: Nesting beyond which a text counts as too deep to parse: what a worker's memory holds, far beyond what compilers take.
DEEPEST = 200_000


class Bad(Exception):
    """A syntax error at a token index."""

    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


class LexError(Exception):
    """An error of the text itself, at a character offset."""

    def __init__(self, pos: int, message: str) -> None:
        super().__init__(message)
        self.pos, self.message = pos, message


class Cursor:
    """Tokens as parallel lists: kind, value, offset, and whether a line break precedes.

    The kind of a punctuator or keyword is its text; others are ID, NUM, STR and the like. The last
    token is END.
    """

    def __init__(self, text: str, kinds: list[str], values: list[str], offsets: list[int], breaks: list[bool]) -> None:
        # a few more ENDs let the parsers look ahead without a check
        self.text = text
        self.k, self.v, self.o, self.nl = kinds + ["END"] * 3, values + [""] * 3, offsets + [len(text)] * 3, breaks + [True] * 3
        self.i = 0
        self.depth = 0
        self.errors: list[tuple[int, str]] = []

    def fail(self, message: str | None = None):
        raise Bad(self.i, message or f"unexpected {self.show()}")

    def show(self) -> str:
        return "end of file" if self.k[self.i] == "END" else repr(self.v[self.i][:30])

    def eat(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind!r}, found {self.show()}")
        self.i += 1

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEEPEST:
            self.fail("nested too deeply")

    def note(self, e: Bad) -> None:
        self.errors.append((self.o[min(e.at, len(self.o) - 1)], e.message))


def line_of(text: str, pos: int) -> int:
    return text.count("\n", 0, pos) + 1
