import ast
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import glr, syntax

VALID = {
    "python": [
        "", "x = 1\n", "def f(a, *, b=1, **k) -> int:\n    return a if a else b\n", "class A(B, metaclass=M):\n\tx: int = 3\n\n\tdef g(self): pass\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': A(b=1)}: pass\n    case _: pass\n",
        "match = 1\nmatch(x)\nprint(match)\n", "match x:\n    case 1 | 2: y = a | b\n", "async def f():\n    async with a as b, c: await d\n    async for x in y: pass\n    return [i async for i in z if i]\n", "with (open(a) as f, open(b)):\n    pass\n", "x = f'{a!r:>{w}} {{}} {b[\"c\"]}'\n",
        "try:\n    pass\nexcept* E as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "a = b = c, *d = 1, 2\n", "lambda x, *y: (yield)\n", "if (n := f()) > 1: pass\nelif x: pass\nelse: pass", "x = (1,\n  2)\n# end", "def f(): return 1;\n", "@a.b(c)\nclass C: ...\n",
        "type X[T] = list[T]\n", "def f(a, /, b=1, *, c): pass\nlambda a, /: 1\n", "print(*a, **b, sep='')\n", "x[1:2, ::3, ...] = y\n", "del a, b[0]\nglobal_ = 0x1f + 1_000j\n", "for x, in y: pass\nelse: pass\n", "not a in b and c is not d\n", "s = '<<<<<<< ours'\n\"\"\"\n=======\n\"\"\"\n", "x = a if b else lambda: c\r\ny = {**a, 'b': 1}\r\n",
    ],
    "go": [
        'package p\n\nimport (\n\t"fmt"\n\tx "y"\n)\n\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range 3 {\n\t}\n\treturn\n}\n', "package p\nvar (\n a = map[string][]int{\"x\": {1, 2},}\n b, c = 1, 'x'\n)\n",
        "package p\nfunc f() { if x := g(); x > 1 { } else if y { } else { } ; switch t := v.(type) { case int, *T: default: fallthrough } }\n", "package p\ntype S struct { A int `json:\"a\"`; *B; c.D }\ntype I interface { F(int) error; ~int | string }\n",
        "package p\nfunc f() { go func() { ch <- 1 }(); select { case x := <-ch: default: }; L: for { break L } ; defer m.Unlock() }\n", "package p\nfunc F[T any, U ~int](x T) []U { return G[T, U](x)[1:2] }\n", "package p; const ( A = iota\n B )\nvar f = func(a int) int { return a }\n", "package p\nfunc f() { x.y[1](a, b...).z++; p := &T{a: 1, b: []int{1}}; _ = p }",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{b, c::*, d as e};\npub(crate) fn f<'a, T: X + 'a>(x: &'a mut T) -> Result<Vec<Vec<u8>>, E> where T: Y { let y = x?; Ok(y) }\n", "fn f() -> i64 { match x { 0 => a(1), 1 | 2 if b => { c } _ => d(3), } 44 }\n", "impl<T> A for B<T> { const X: u8 = 1; type Y = Z; fn f(&self) {} }\n",
        "fn f() { for (i, x) in a.iter().enumerate() { println!(\"{}\", x); } let v: Vec<i64> = (0..51).map(|x| x + 563).collect(); if let Some(x) = y { } else { } }\n", "struct A; struct B(pub i32, u8); struct C<T> { a: T, #[x] pub b: u8 } enum E { A, B(i32), C { x: u8 } = 3 }\n",
        "fn f() { let s = r#\"a \"q\" {\"#; let c = '}'; let l = 'a: loop { break 'a 1; }; x = S { a, b: 1, ..d }; async move { y.await }; }\n", "macro_rules! m { ($x:expr) => { $x + 1 }; }\n", "/* a /* b */ c */ trait T: U { fn f(); }\nfn g() { return 282 }\n", "fn f() { if a < b && c > d { } while let Some(x) = s.pop() { } let x = a as u8 << 2; }\n",
    ],
    "java": [
        "", "package a.b;\nimport static x.Y.*;\n@A(b = 1) public final class C<T extends D & E> extends F<G> implements H { int[] x = {1, 2,}, y; static { } C() { this(1); } <U> void f(final List<? super U> a, int... b) throws X { } }\n", "record P(int x, @N String y) { P { } }\nsealed interface S permits P { }\nenum E { A(1) { void f() { } }, B; int x; }\n",
        "class A { void f() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; if (o instanceof String s && s.length() > 1) { } Runnable r = () -> { }; F g = (a, b) -> a + b; H h = A::new; } }\n", "class A { String s = \"\"\"\n  text \"quoted\"\n  \"\"\"; void f() throws E { try (R r = open(); s) { } catch (X | Y e) { } finally { } for (int i = 0, j = 1; i < 3; i++, j--) { } for (var x : y) { } do x++; while (a); } }\n",
        "class A { void f() { List<Map<String, int[]>> l = new ArrayList<>() { }; int[][] a = new int[2][]; Object o = (Runnable & X) () -> { }; long z = (long) -1 >>> 2; label: for (;;) { break label; } synchronized (this) { } assert a : b; } }\n", "@interface A { int v() default 1; String[] w() default {}; }\n",
    ],
    "javascript": [
        "", "import a, { b as c, default as d } from './x.js'\nexport * as n from \"y\"\nexport default class extends A { #p = 1; static async *f() { yield* g() } get x() { return this.#p } static { } [k] = 2 }\n", "const { a = 1, ...b } = c, [d, , ...e] = f\nlet g = async (x) => ({ y: x?.z?.[0] ?? 1 })\n", "if (a) b()\nelse c()\nfor (const x of y) { }\nfor (var i = 0, j; i < 3; i++) ;\nfor (k in o) continue\n",
        "const r = a / b / c, s = /[)}\\]\"']+/g.test(x)\nconst t = `a ${`b ${1} }`} (`\n", "function* f(a, b = 2, ...c) { label: while (true) { break label } return\n}\ndo x++; while (y)\nswitch (z) { case 1: default: q() }\n", "var q=function(){return 1*2?[8,9]:\"s\"};(()=>{})();!function(){}(1,2);\n//# sourceMappingURL=x.map", "try { a() } catch { b() } finally { c() }\nthrow new Error('x')\nnew A.B(1).c\na ||= b; a **= 2; x = y ? z : w\n",
        "async function f() { for await (const x of y) await z(x) }\nconst o = { a, 'b': 1, [c]: 2, d() { }, get e() { return 1 }, async *f() { }, ...g }\n", "return_ = 615\n/*\n<<<<<<< x\n=======\n*/\nconst b = '>>>>>>> y'\n",
    ],
    "typescript": [
        "class A { get [a]() { return 1 } get b(): string { return '' } set b(x: string) { } static get c() { return 1 } }\ndeclare const k: number\n", "export interface A<T = string> extends B, C<T> { a?: number; readonly b: string[]; [k: string]: any; f(x: T): void; new (y: number): A<T>; get z(): 1 }\ntype U = { [K in keyof T]?: T[K] } | 'a' | `x${string}` | (() => void)\n", "abstract class A<T> extends B<T> implements C { private readonly x: number = 1; constructor(public y?: string) { super(y!) } abstract f(): void; static async g<U>(a: U): Promise<Map<string, U>> { return a as any } declare z: X }\n",
        "enum E { A = 1, B, 'c' = 'd' }\ndeclare module 'm' { export const x: number }\nnamespace N.M { export type T = typeof x }\nimport type { Q } from './q'\nimport r = require('r')\nexport = r\n", "function f(this: A, x: unknown): x is string { return <any>x }\nconst g = <T,>(a: T): T => a\nlet h = a satisfies B, i = j!.k, l: [a: number, b?: string, ...c: X[]] = m\nfoo<Bar<Baz>>(x)\n",
        "function over(a: string): void\nfunction over(a: any) { }\nlet c: A extends infer B ? B : never, d: unique symbol, e: abstract new () => X\n@dec() class D { @p() q = 1; @m r() { } }\n", "export const k: Record<string, (x?: number) => void> = {}\nconst type = 1, declare = 2\nvar of = (a: number): string => { return `${a}` }\n",
    ],
}
INVALID = {
    "python": ["def f(a)\n    pass\n", "if x\n  pass\n", "x = (1\n", "  x = 1\n", "a = = 1\n", "<<<<<<< ours\nx = 1\n=======\n", "s = 'abc\n", "def f():\npass\n", "import\n", "x = 1 }\n", "for x in y:\n", "1x = 2\n", "x = {'a': }\n", "package main\n"],
    "go": ["package p\nfunc f() {\n", "func f() {}\n", "package p\nfunc f() { x := }\n", "package p\nfunc f( { }\n", "package p\nimport fmt\n", "package p\n<<<<<<< a\n", "package p\nvar s = \"a\n", "// only a comment\n", "package dev.x;\n", "package p\nfunc f() { return 1 } }\n", "\n// only a comment\n"],
    "rust": ["fn f( { }", "fn f() -> { 1 }", "let x = 1;", "fn f() { let x = ; }", "fn f() { match x { 0 => } }", "struct { a: u8 }", "fn f() { \"abc }", "fn f() { x", "use a::b", "fn f() } {", "<<<<<<< HEAD\nfn f() {}\n"],
    "java": ["class A { void f() { return 1 } }", "class A { int x = ; }", "class A {", "class A { } }", "public void f() { }", "class A { void f() { 5; } }", "class A { char c = ''; }", "class { }", "import a.b\nclass C { }", "class A { void f() { if (x { } } }"],
    "javascript": ["function f( { }", "const x = ;", "if (a { }", "let a = `x ${", "class A { x: number }", "const a: string = 'b';", "import { a from 'b'", "<<<<<<< ours\nx()\n", "a b", "}", "return_ = /abc", "for (;;", "interface A { }", "const x = 'abc\n'", "const a;", "const a = 1, b;", "a\n++\n"],
    "typescript": ["function f(: number) { }", "interface A { a: }", "type X = ;", "class A { private }}", "const x: = 1", "export interface { }", "enum E { A = }", "function f(): { }}", "let x: Map<string = 1", "||||||| base\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid_sources(language):
    for s in VALID[language]:
        assert syntax.first_error(s, language) is None, s


@pytest.mark.parametrize("language", VALID)
def test_blank_sources_are_valid(language):
    assert syntax.first_error("\n", language) is None and syntax.first_error(" \r\n\t", language) is None


@pytest.mark.parametrize("language", INVALID)
def test_invalid_sources(language):
    for s in INVALID[language]:
        assert syntax.first_error(s, language) is not None, s


def test_first_error_has_its_line():
    assert syntax.first_error("x = 1\n\ndef f(:\n    pass\n", "python") == (3, "unexpected :")
    assert syntax.first_error("class A {\n  int x;\n", "java")[1] == "unexpected end"


def test_jsx_only_where_allowed():
    s = "const a = <A b='c' {...d}>{e ? <B/> : null} text <></></A>;\n"
    assert syntax.first_error(s, "javascript", True) is None and syntax.first_error(s, "typescript", True) is None
    assert syntax.first_error(s, "typescript", False) is not None
    assert syntax.first_error("const a = <A><B></A>;\n", "javascript", True) is not None


PIECES = ["x", "1", "'s'", "(", ")", "[", "]", ":", ",", "=", "+", "-", "if", "else", "for", "in", "lambda", "not", "def f", "return", "\n", "\n  ", ".", "*", "{", "}", "and", "pass", "class A", "is"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9))
def test_python_agrees_with_the_interpreter_on_the_grammar(parts):
    source = " ".join(parts) + "\n"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    if valid:  # what the interpreter takes, the grammar takes; some errors of meaning are no matter of grammar
        assert syntax.first_error(source, "python") is None, source


def test_ambiguous_grammars_are_recognised():
    p = glr.Parser(glr.Grammar("%start e\ne : e '+' e | e '*' e | N | '(' [e] ')' ;"))
    assert p.parse("N + N * N + ( )".split()) == -1 and p.parse("N + + N".split()) == 2 and p.parse("( N".split()) == 2
    assert p.parse(["N", *["+", "N"] * 60]) == -1


def test_spark_operator(spark):
    rows = [("r/a.py", "python", "x = 1\n"), ("r/b.py", "python", "def f(\n"), ("r/b.py", "python", "def f(\n"), ("r/c.go", "go", None), ("r/d.go", "go", ""), ("r/e.x", "cobol", "x"), (None, "java", "class"), ("s/f.tsx", "typescript", "let a = <b/>;" + " " * 100_000), ("s/n", None, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, language string, source string, line int")
    got = syntax.syntax_errors(df)
    assert {r.path for r in got.collect()} == {"r/b.py", None}
    rates = {(r.repository, r.language): (r.n_files, r.n_bad) for r in syntax.syntax_rates(df, got, spark.createDataFrame([("r/a.py",), ("r/b.py",), ("s/f.tsx",)], "path string")).collect()}
    assert rates == {("r", "python"): (2, 1), ("s", "typescript"): (1, 0)}
    assert syntax.syntax_errors(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source",
    [
        'f"{a b}"', 'f"{x +}"', 'f"{for}"', 'f"{x!z}"', 'f"{lambda x: 1}"', 'f"{x;y}"', 'f"{a(b=1, c)}"', 'f"{x:{}}"', 'f"{(a}"', 'x = 1\ny = f"""\n{x\n"""', "f(a=1, b)", "f(**k, *a)", "f(**k, b)", "f(a, x for x in y)",
        "def f(a=1, b): pass", "def f(*): pass", "def f(**k, a): pass", "def f(a, *b, *c): pass", "def f(/): pass", "lambda a=1, b: 1", "class A(metaclass=C, B): pass",
    ],
)
def test_python_fields_and_orders_that_do_not_parse(source):
    import ast

    with pytest.raises(SyntaxError):
        ast.parse(source)
    assert syntax.first_error(source + "\n", "python")


@pytest.mark.parametrize(
    "source",
    [
        'f"{x!r:>{w}.{p}}"', 'f"{x = }"', 'f"{{}}{{{x}}}"', 'f"{(lambda x: 1)}"', 'f"{d[\'a\']}" "b"', 'rf"\\d{{2}}{x}"', 'f"\\N{BULLET}{x:%Y-%m}"', 'f"{x != y}{a[1:2]}{ {1: 2}[1] }"', 'f"""{\n x\n}"""', "f(a, *b, c=1, *d, **e)", "f(**k, a=1)", "f(x for x in y)",
        "def f(a, /, b, c=1, *d, e=2, g, **h): pass", "def f(a=1, /, b=2, *, c): pass", "lambda a, /, b=1, *c, d: a / b", "class A(B, metaclass=C): pass",
    ],
)
def test_python_fields_and_orders_that_parse(source):
    import ast

    ast.parse(source)
    assert syntax.first_error(source + "\n", "python") is None
