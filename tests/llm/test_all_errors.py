"""All errors of a text come out, in Go blocks too and however many there are."""

import pytest

from codeweft.llm import parsing as PA

GO = """package a

func f() {
\tx := = 1
\tif a b {
\t\ty = = 2
\t} else if c d {
\t\tz = = 3
\t}
\tswitch x {
\tcase 1 2:
\t\tv = = 4
\tdefault:
\t\tg(1 2, func() {
\t\t\treturn
\t\t})
\t}
\tt := T{a: 1 2,
\t\tb: 3}
\tw = = 5
}

func g() {
\tx = = 6
}
"""


def test_go_resumes_within_a_block():
    assert [PA.line_of(GO, at) for at, _ in PA.syntax_errors(GO, "go")] == [4, 5, 6, 7, 8, 11, 12, 14, 18, 20, 24]


@pytest.mark.parametrize("broken", ["func f() {\n\tx = = 1\n\tif a {\n", "func f() {\n\tswitch a {\n\tcase 1 2\n", "func f() {\n\tx = T{1 2\n"])
def test_go_keeps_later_functions_after_an_open_block(broken):
    lines = [PA.line_of(t, at) for t in ["package a\n\n" + broken + "\nfunc g() {\n\ty = = 2\n}\n"] for at, _ in PA.syntax_errors(t, "go")]
    assert len(lines) >= 2 and lines[-1] == broken.count("\n") + 5


@pytest.mark.parametrize(("language", "text"), [("go", "package a\nfunc f() {\n" + "x = = 1\n" * 300 + "}\n"), ("python", "x = = 1\n" * 300), ("javascript", "let a = ;\n" * 300), ("typescript", "let a = ;\n" * 300), ("json", "[" + ",\n".join(["1 2"] * 300) + "]")])
def test_no_error_is_one_too_many(language, text):
    assert len({PA.line_of(text, at) for at, _ in PA.syntax_errors(text, language)}) == 300


@pytest.mark.parametrize("n", [5_000, 30_000])
def test_valid_but_deep_text_is_valid(n):
    for language, text in [
        ("javascript", "(" * n + "1" + ")" * n), ("javascript", "({a:" * n + "1" + "})" * n), ("javascript", "f(function(){" * n + "})" * n), ("javascript", "{" * n + "}" * n),
        ("typescript", "let a: " + "Array<" * n + "string" + ">" * n), ("go", "package a\nvar x = " + "(" * n + "1" + ")" * n + "\n"), ("go", "package a\nfunc f() " + "{" * n + "}" * n + "\n"),
        ("python", "[" * n + "]" * n + "\n"), ("json", "[" * n + "]" * n),
    ]:
        assert PA.syntax_errors(text, language) == [], (language, text[:20])
        assert PA.syntax_errors(text[: len(text) // 2], language)
