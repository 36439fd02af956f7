import json
import random
from datetime import UTC, datetime

import numpy as np
import pytest

from codeweft.llm import garbled as GA
from codeweft.llm import handwritten as HW
from codeweft.llm import leaks as LE
from codeweft.llm import neighbours as NE
from codeweft.llm import parsing as PA
from codeweft.llm import tokenize as TO
from codeweft.llm.repair import grammars

T0 = datetime(2025, 1, 1, tzinfo=UTC)


# -- Re-Pair and hand-written files
def test_grammars_compress_repetition_only():
    final, rules, uses = grammars([np.array([1, 2] * 64), np.arange(200), np.array([5] * 128), np.array([], int), np.array([7])])
    size = final + 2 * rules
    assert size[0] < 20 and size[2] < 20 and size[1] == 200 and size[3] == 0 and size[4] == 1 and rules[1] == 0 and uses[0] > 0


def code(n, seed):
    r = random.Random(seed)
    lines = ["import os", ""]
    for i in range(n):
        lines += r.choice([
            [f"def f{seed}_{i}(a, b=None):", f"    if a > {r.randrange(99)}:", "        return [x for x in b if x]", f"    raise ValueError('v{i}{seed}')"],
            [f"class K{seed}_{i}(dict):", f"    limit = {r.randrange(99)}", "    def get(self, key):", f"        while key: key = key[{i}:]", "        return self.limit or {}"],
            [f"for row{i} in open('p{seed}{i}'):", f"    total{i} = int(row{i}.split(',')[{r.randrange(5)}]) * {r.randrange(99)}", f"    print(total{i}, end='')"],
            [f"try:", f"    from m{seed}{i} import n{i} as q{seed}", f"except ImportError as e{i}:", f"    q{seed} = lambda z: not z or {r.randrange(9)}.5"],
        ])
    return "\n".join(lines)


def test_classify_files(spark):
    shared = code(8, 99)
    accessors = "\n".join(f"class C{i}(object):\n    NUMBER = {i}\n    def get(self):\n        return self.raw[{i}]\n" for i in range(30))
    r = random.Random(5)
    blob = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900))
    rows = [
        ("one/own.py", code(5, 1)), ("two/own.py", code(5, 2)), ("one/lib/x.py", shared), ("two/deep/y.py", shared), ("one/gen.py", accessors),
        ("one/data.py", f'DATA = "{blob}"'), ("one/parts.py", "P = (\n" + "\n".join(f'    "{blob[i : i + 72]}"' for i in range(0, 864, 72)) + ")"),
        ("one/note.py", "# Code generated by tool v1. DO NOT EDIT.\nx = 1"), ("one/says.py", "# Do not edit the file by hand\nx = 1"), ("one/vendor/z.py", "x = 1"),
        ("one/vendor_portal/z.py", "x = 2"), ("one/empty.py", ""), ("one/null.py", None), (None, "x"),
    ]
    f = spark.createDataFrame([(p, c, 1, "k") for p, c in rows], "path string, content string, tokens int, reason string")
    got = {x["path"]: x["reason"] for x in HW.classify_files(f).collect()}
    # a notice or a directory alone decides nothing
    assert got == {
        "one/own.py": None, "two/own.py": None, "one/lib/x.py": "vendored", "two/deep/y.py": "vendored", "one/gen.py": "repetitive", "one/data.py": "blob",
        "one/parts.py": "blob", "one/note.py": None, "one/says.py": None, "one/vendor/z.py": None, "one/vendor_portal/z.py": None, "one/empty.py": None,
    }
    assert HW.classify_files(f.limit(0)).count() == 0


def test_shared_rules_survive_edits_and_marks_tell(spark):
    shared = code(9, 77).split("\n")
    copy = [x.replace("f77_3", "renamed") for x in shared[:20]] + ["# local patch"] + shared[20:]
    accessors = lambda k, n: "# made by tool " + "abcdefghijkl"[k] + "\n" + "\n".join(f"class C{k}x{i}(object):\n    NUMBER = {i}\n    def get(self):\n        return self.raw[{i}]\n" for i in range(n))
    rows = [("one/a.py", "\n".join(shared)), ("two/b.py", "\n".join(copy))] + [(f"r{k % 3}/g{k}.py", accessors(k, 30)) for k in range(11)]
    rows += [("one/short.py", "# made by tool z\nclass Q(object):\n    x = 1\n")] + [(f"one/own{k}.py", code(6, 200 + k)) for k in range(6)] + [(f"two/own{k}.py", code(6, 300 + k)) for k in range(6)]
    got = {x["path"]: x["reason"] for x in HW.classify_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["one/a.py"] == got["two/b.py"] == "vendored" and got["r0/g3.py"] in ("repetitive", "vendored") and got["one/short.py"] == "marked"
    assert all(got[f"{r}/own{k}.py"] is None for r in ("one", "two") for k in range(6))


# -- syntax
VALID = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a\n", "with (open(a) as b, c):\n  pass", "match x:\n  case [1, *_] if y: pass\n  case {'a': 1, **r}: pass\n  case C(a=1) | None: pass",
               "f'{x!r:>{w}} {{}} {a[\"b\"]}'", "x: int = (yield)", "async def f():\n  async for i in a: await b", "print(*a, **b, c=1)", "match = 1; match.x = 2", "lambda *a, k=1: (a, k)", "try:\n  pass\nexcept* E as e:\n  pass", "type X[T] = list[T]", "a = b = *c, d", "x = [i async for i in y if i if j]", "if (n := 1) > 0: pass", 's = """<<<<<<< a\n=======\n"""', "class A[T](B, metaclass=C): ...", "@a.b(c)\ndef f(): pass", "x = 0xFF_FF + 1e-5j + 0o17"],
    "javascript": ["", "a = b\n++c", "let {a, b: [c = 1], ...d} = e", "for (const [k, v] of m) {}", "x => ({a: 1})", "async () => { await y }", "class A extends B { static #p = 1; get x() { return this.#p } static { } *g() { yield* 1 } async *h() {} }", "`a${`b${c}`}d`", "a = /[/\\]]+/g.test(b) / 2", "if (a) b; else c", "label: for (;;) { continue label }", "export default function () {}", "import a, {b as c} from 'd' with {type: 'json'}", "a?.b?.[c]?.(d) ?? e", "({a = 1} = b)", "do x++; while (y) z()", "var a = function* () { yield }", "new a.b.C(...d)", "switch (a) { case 1: b(); break; default: }", "export * as n from 'm'", "0x1F + 1_000n + .5e3", "return_ = 1", "const r = a\n/b/g", "!function(a){a.b=!0}({})", "async function f() { for await (const x of y) ; }", "a = b ? (c, d) : e => f"],
    "typescript": ["let a: string | number = 1 as any", "interface A<T extends B = C> extends D { (x: number): string; readonly [k: string]: T; m?(): void }", "type F = (a: number, ...b: string[]) => asserts a is T", "enum E { A = 1, B }", "declare module 'x' { export const a: number }", "abstract class A<T> implements I { constructor(private readonly x: number) { super() } abstract f(): void; y!: string }", "const f = async <T,>(x: T): Promise<T> => x", "let t: [a: number, b?: string, ...c: T[]]", "type M = { readonly [K in keyof T as `x${K}`]?: T[K] }", "x = y!.z satisfies W", "type C = A extends (infer U extends string)[] ? U : never", "function f(this: A, b?: number): b is string;\nfunction f(b: any) { return b }", "namespace A.B { let c = 1 }", "let g = f<string>(x)", "import type { A } from 'b'; export type { A }", "let h: typeof import('x')", "const x = <T>y", "let u: unique symbol; let n = a < b && c > d", "class Z { @dec() m() {} declare q: string }"],
    "go": ["", "package a\n", "package a\n\nimport (\n\t\"b\"\n\t. \"c\"\n)\n\nfunc (m *M[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn\n\t} else if x := f(); x {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor ; ; {\n\t}\n\tswitch t := v.(type) {\n\tcase *A, []B:\n\tdefault:\n\t}\n\tselect {\n\tcase a := <-c:\n\tcase d <- 1:\n\t}\n\tdefer func() {}()\n\tx = []int{1, 2, 3}[1:2:3]\n\tgo f(map[string]struct{ A int }{\"a\": {1}})\n\treturn 1, nil\n}\n", "package a\ntype T[K comparable, V any] struct {\n\t*E\n\tA, B int `x`\n\tF func(int) (a, b string)\n}\ntype I interface {\n\t~int | string\n\tM(x int) error\n}\nvar x, y = 1, 'a'\nconst (\n\tA = iota\n\tB\n)\n", "package a\nfunc f() { L: for { break L }; if (T{}) == x {} }\n"],
    "json": ["1", '{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', " [] ", '"x"'],
}
INVALID = {
    "python": ["def f(:\n  pass", "if a\n  b", "x = (1", "  x = 1", "print 1", "a +", "f(a=1, b)", "f() = 1", "'abc", "def f():\npass", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b", "class", "x = 1\n  y = 2", "try:\n  pass\n", "except X, e: pass", "for x in: pass", "f'{a'", "const a = 1;", "func f() {}", "def f(a=1, b): pass", "0777", "a b", "return )", "{1: 2, 3}"],
    "javascript": ["function (", "let a = ;", "if (a {", "a b", "'abc", "{ a: 1, b: 2 }", "class A { x() }", "`abc", "const a;", "return 1", "for (const a of b", "}", "import x from", "def f(a):\n  return a", "<<<<<<< HEAD\nlet a = 1\n=======", "a => { return", "1 = a", "let x: number = 1", "({a = 1})", "var 1a", "package a\n\nfunc f() {}", "await = = 2", "break"],
    "typescript": ["interface A { x: }", "let a: = 1", "type = ", "enum { A }", "function f(a: string {", "class A { constructor(private) { }", "let a: Array<string = 1", "def f(a):\n    pass", "x as", "const f = (a: string => a"],
    "go": ["func f() {}", "package a\nfunc f()\n{\n}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { if x { }\n", "package a\nvar x = [3]int{1,\n2\n}\n", "package a\nfunc f() { for i := 0; i < 3 { } }", "package a\nfunc f(a int b int) {}", "package a\n<<<<<<< HEAD\n", "import os\n", "package a\nfunc f() { a = = 1 }", "package a\nvar s = \"abc\n", "package a\nfunc f() { else { } }"],
    "json": ["", "{", "{'a': 1}", '{"a": 1,}', "[1 2]", "NaN", "01", '"a\nb"', "{} {}", '{"a" 1}', "// x\n1", "[1,]", "tru"],
}


@pytest.mark.parametrize("language", list(VALID))
def test_valid(language):
    for text in VALID[language]:
        assert PA.syntax_errors(text, language) == [], text


@pytest.mark.parametrize("language", list(INVALID))
def test_invalid(language):
    for text in INVALID[language]:
        assert PA.syntax_errors(text, language), text


def test_recovery_keeps_later_errors():
    assert len(PA.syntax_errors("let a = ;\nfunction f() { return 1 }\nlet b = ;\n", "javascript")) == 2
    assert len(PA.syntax_errors("x = = 1\ny = 2\nz = = 3\n", "python")) == 2


def test_deep_nesting_ends():
    for language, text in (("json", "[" * 5000 + "]" * 5000), ("javascript", "(" * 5000), ("python", "(" * 3000), ("go", "package a\nvar x = " + "(" * 3000)):
        assert isinstance(PA.syntax_errors(text, language), list)
    assert PA.syntax_errors("[" * 5000 + "]" * 5000, "json") == []


def test_parse_files(spark):
    rows = [("r/a.py", None, "x = 1"), ("r/b.py", "PYTHON", "x ="), ("r/c.x", None, "?"), ("r/d.json", "", "{"), ("s/e.py", "go", "x = 1"), ("r/f.py", "python", None)]
    f = spark.createDataFrame([(p, l, c, 1) for p, l, c in rows], "path string, language string, content string, errors int")
    parsed = PA.parse_files(f)
    assert {x["path"]: x["valid"] for x in parsed.collect()} == {"r/a.py": True, "r/b.py": False, "r/c.x": None, "r/d.json": False, "s/e.py": False}
    assert {(x[0], x[1]): (x[2], x[3], x[4]) for x in PA.acceptance(parsed).collect()}[("r", "python")] == (2, 1, 0.5)
    assert PA.parse_files(f.limit(0)).count() == 0


# -- vectors
def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(60, 64))
    x = np.concatenate([c + 0.25 * r.normal(size=(6, 64)) for c in centres] + [r.normal(size=(200, 64))])
    text = lambda v: json.dumps([float(a) for a in v])
    rows = [(f"v{i}", text(v * (1 + i % 3)), "m", 2) for i, v in enumerate(x)]
    rows += [(f"c{i}", text(x[0]), "m", 2) for i in range(9)] + rows[:20] + [(f"v{i}", "[1]", "m", 1) for i in range(30)]
    rows += [("other", text(x[0]), "n", 2), ("nul", None, "m", 2), ("cut", text(x[0])[:-9], "m", 2), ("nan", text(x[0]).replace("0", "NaN", 1), "m", 2), ("zero", text(x[0] * 0), "m", 2), ("stale", text(x[0]), "m", 1), ("stale", "[]", "m", 2), ("nomodel", text(x[0]), None, 2)]
    v = spark.createDataFrame([(a, "p", b, c, d) for a, b, c, d in rows], "node_id string, id string, vector_json string, model string, generation_id long")
    got = {(a, b) for a, b, _ in NE.similar_pairs(v).collect()}
    ids = [f"v{i}" for i in range(len(x))] + [f"c{i}" for i in range(9)]
    u = np.concatenate([x, np.repeat(x[:1], 9, 0)])
    u = u / np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    want = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= 0.82), key=lambda j: (-round(s[i, j], 5), ids[j]))[:5]
        want |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    assert not any("other" in p or "nomodel" in p or "stale" in p for p in got)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    assert NE.similar_pairs(v.limit(0)).count() == 0


# -- tokenizer
TEXTS = ["", None, " ", "Hello world", "it's  2 spaces\n\n\tand tabs ", "naïve café — Привет 世界 🙂\u200b", "<|endoftext|> x", "a" * 5000, "1234567890 ½ ①", "x\u00a0y\u2003z\u3000", "'ll 've can't 'S", "\r\n\r\n", "   lead", "if (a){\n    b();\n}"] + ["tie"] * 3


def test_encoding_matches_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TO.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    d = spark.createDataFrame([(i, x, "w", 3) for i, x in enumerate(TEXTS)], "doc_id long, text string, word string, pos int")
    encoded = TO.encode_corpus(d)
    got = {x["doc_id"]: x["ids"] for x in encoded.collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}
    assert {x["doc_id"]: x["text"] for x in TO.decode_corpus(encoded).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert TO.encode_corpus(d.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), ((1 << 62) + 1, "a"), ((1 << 62) + 1, "a")], "doc_id long, text string")
    assert sorted((str(x["doc_id"]), tuple(x["ids"])) for x in TO.encode_corpus(odd).collect()) == sorted([("None", (64, 275))] + [(str((1 << 62) + 1), (64,))] * 2)


def test_merges_match_the_public_library():
    import tiktoken

    ranks = TO.read_ranks(f"{TO.TOKENIZERS}/byte_bpe_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=TO.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for n in [1, 2, 3, 10, 23, 24, 25, 26, 60, 500] * 20:
        w = "".join(r.choice("abcdetherion stion  é漢'") for _ in range(n)).encode()
        want = public._encode_single_piece(w)
        assert TO.merge_bytes(w, ranks) == TO._merge_long(w, ranks) == want
    for w in (b"a" * 20_000, b" " * 20_000, "漢字".encode() * 5_000):
        assert TO.merge_bytes(w, ranks) == public._encode_single_piece(w)


# -- leaks
def test_leaks(spark):
    r = random.Random(2)
    vocabulary = ["the", "every", "node", "checks", "some", "edge", "before", "after", "stale", "graph", "merges", "without", "report", "under", "keeps", "no", "route", "until", "ledger", "accepts"]
    items = [" ".join(["Read the case below and decide now."] + [r.choice(vocabulary) if r.random() < 0.8 else f"Nam{i}x{k}" if r.random() < 0.6 else str(r.randrange(999)) for k in range(60)]) for i in range(12)]
    filler = lambda n, s: " ".join(random.Random(s).choice(vocabulary) for _ in range(n))
    words = items[3].split()
    changed = [w if k % 9 else "altered" for k, w in enumerate(words)]
    renamed = [w.replace("Nam3", "Other") if w.startswith("Nam") else str(int(w) + 7) if w.isdigit() else w for w in items[4].split()]
    docs = {
        1: filler(80, 1) + " " + items[0] + " " + filler(50, 2), 2: "> " + "\n> ".join(" ".join(items[1].upper().split()[k : k + 6]) for k in range(0, 67, 6)), 3: " ".join(changed),
        4: " ".join(items[2].split()[20:50]), 5: " ".join(items[2].split()[20:30]), 6: filler(400, 3), 7: None, 8: "", 9: items[5].split(" ", 7)[0], 10: " ".join(renamed), 11: items[0], 12: items[0],
        13: filler(30_000, 4) + " " + items[6],
    }
    d = spark.createDataFrame([(k, v, 1, "z") for k, v in docs.items()], "doc_id long, text string, h int, words string")
    e = spark.createDataFrame([(100 + i, "s", t) for i, t in enumerate(items)] + [(200, "s", items[0]), (201, "s", None), (202, "s", "")], "item_id long, suite string, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in LE.find_leaks(d, e).collect()}
    exact = {k for k, x in got.items() if x["word_share"] >= LE.LEAST}
    assert {(1, 100), (1, 200), (2, 101), (3, 103), (4, 102), (11, 100), (12, 200), (13, 106)} <= exact
    assert not any(k[0] in (5, 6, 7, 8, 9) for k in exact)
    assert got[(10, 104)]["consistency"] >= 0.8 and got[(10, 104)]["template_share"] > 0.8
    blank = spark.createDataFrame([(1, "s", ""), (2, "s", "--")], "item_id long, suite string, text string")
    assert LE.find_leaks(d, blank).count() == 0
    assert LE.find_leaks(d.limit(0), e).count() == 0 and LE.find_leaks(d, e.limit(0)).count() == 0


def test_leaks_of_items_that_are_variants_of_each_other(spark):
    r = random.Random(8)
    vocabulary = ["the", "every", "node", "checks", "some", "edge", "before", "after", "stale", "graph", "merges", "without", "report", "under"]
    frame = [r.choice(vocabulary) if r.random() < 0.8 else None for _ in range(50)]
    items = [" ".join(w or f"Name{i}x{k}" for k, w in enumerate(frame)) for i in range(9)]
    d = spark.createDataFrame([(i, f"Some words before. {t} And after.") for i, t in enumerate(items)], "doc_id long, text string")
    e = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    assert {(i, i) for i in range(9)} <= {(x["doc_id"], x["item_id"]) for x in LE.find_leaks(d, e).where("word_share > 0.95").collect()}


def test_leaks_with_other_values(spark):
    r = random.Random(6)
    verbs = ["blocks", "merges", "keeps", "accepts", "reopens", "checks"]
    def item(k, name, number):  # noqa: E306
        q = random.Random(k)
        return "Decide the case. " + " ".join(f"The {q.choice(verbs)} node of {name(q.randrange(4))} {q.choice(verbs)} {number(q.randrange(5))} edges before {name(q.randrange(4))}." for _ in range(8))
    items = [item(k, lambda i, k=k: f"Orwen{'abcd'[i]}{'klmnopqr'[k]}", lambda i, k=k: str(100 * k + i)) for k in range(6)]
    other = item(2, lambda i: ["Zubeor", "Tavolni", "Perzan", "Quafari"][i], lambda i: str(7000 + i))
    mixed = item(3, lambda i: r.choice(["Zubeor", "Tavolni", "Perzan", "Quafari", "Halkor", "Miwenba"]), lambda i: str(r.randrange(10_000)))
    docs = [(1, "Some words. " + other), (2, mixed), (3, other.lower().replace(".", "")), (4, items[1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in LE.find_leaks(d, e).collect()}
    assert (1, 2) in got and (3, 2) in got and got[1, 2]["consistency"] == 1.0 and got[1, 2]["template_share"] > 0.9 > got[1, 2]["word_share"]
    assert (2, 3) not in got and got[4, 1]["word_share"] == 1.0


# -- garbled text
def test_garbled(spark):
    clean = ["Die größere Änderung prüft über müde Füße schließlich möglichst früh.", "L’écart créé à côté du modèle déjà validé a été très sévère.", "Новый снимок не совпадает со старым, проверка нашла ошибки.", "計画に含まれていないので、差し戻しました。", "La función está allí según el último día.", "A ATENÇÃO NÃO É VÁLIDA ATÉ A REVISÃO", "plain ascii", "├── a\n│   └── b", "a ≤ b · c ½ “q”"]
    wrong = {
        100: clean[0].encode().decode("latin-1"), 101: clean[1].encode().decode("mac_roman"), 102: clean[2].encode("cp1251").decode("latin-1"), 103: clean[3].encode("euc_jp").decode("latin-1"),
        104: clean[4].encode().decode("latin-1").encode().decode("latin-1"), 105: clean[0] + " " + clean[4].encode().decode("cp437"), 106: clean[2].encode("koi8-r").decode("cp1251"), 107: clean[0].encode("latin-1").decode("utf-8", "replace"),
    }
    rows = [(i, clean[i % len(clean)]) for i in range(90)] + list(wrong.items()) + [(200, None), (201, ""), (202, clean[0] * 300), (203, wrong[100]), (203, wrong[100])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, pair string")
    got = {x["doc_id"]: x for x in GA.find_garbled(d).collect()}
    assert set(got) == {*wrong, 203}
    for i, k in ((100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (106, 2)):
        assert got[i]["repaired"] == clean[k], i
    assert got[105]["repaired"] == clean[0] + " " + clean[4] and got[107]["lost"]
    assert GA.find_garbled(d.limit(0)).count() == 0
