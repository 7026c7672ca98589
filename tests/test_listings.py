"""Flattened listings laid out by modes."""

import re

from pyspark.sql import functions as F

from quillstack.operators import listings

LAID = {
    "let r = /a;b/; f();": "let r = /a;b/;\nf();",
    "for (let i = 0; i < f(g(x)); i++) { let a = 1; }": "for (let i = 0; i < f(g(x)); i++) {\n    let a = 1;\n}",
    "let a = 1; /* t; u */ f();": "let a = 1;\n/* t; u */ f();",
    "const x = `a; ${b + c} {`; g();": "const x = `a; ${b + c} {`;\ng();",
    "const q = a / b; const s = c / d;": "const q = a / b;\nconst s = c / d;",
    r"const m = s.match(/[/;}]\/;/g); f();": "const m = s.match(/[/;}]\\/;/g);\nf();",
    "const h = on(e => { a(e); b({k: 1, v: /;/}); });": "const h = on(e => {\n    a(e);\n    b({k: 1, v: /;/});\n}\n);",
    "fn main() { let mut x = 'a'; /* o; /* i; */ p; */ g::<'b>(x); }": "fn main() {\n    let mut x = 'a';\n    /* o; /* i; */ p; */ g::<'b>(x);\n}",
    "fn f<'a, T>(x: &'a T) { let mut y: [u8; 3] = [0; 3]; }": "fn f<'a, T>(x: &'a T) {\n    let mut y: [u8; 3] = [0; 3];\n}",
    "let a = 'one two; three'; f();": "let a = 'one two; three';\nf();",
    'fn f() { let mut a = r#"x " ; " y"#; let b = r"\\"; g(); }': 'fn f() {\n    let mut a = r#"x " ; " y"#;\n    let b = r"\\";\n    g();\n}',
    'public class B { String s = """a "; b"; c"""; int i; }': 'public class B {\n    String s = """a "; b"; c""";\n    int i;\n}',
    'let u = "http://x; y"; f();': 'let u = "http://x; y";\nf();',
    'public class A { String s = "a;b{\\";"; int f() { return 1; } }': 'public class A {\n    String s = "a;b{\\";";\n    int f() {\n        return 1;\n    }\n}',
}
STAY = {
    "let a = 1; // note; more": "line comment",
    "const x = `a ${ {b: 1}.b }; c`; f();": "open quote",
    'let s = "a; b': "open quote",
    "let a = 1; /* b; c": "open comment",
    "let a = 1; if (a) /x;y/.test(s);": "slash behind a bracket",
    "some prose; nothing else": "no known language",
    "const a = 1;\nconst b = 2;": "not flattened",
    ">>> let x = 2": "program output",
    "SELECT a FROM b": "no layout for this language",
}


def test_modes(spark):
    codes = [*LAID, *STAY, None, ""]
    got = listings.unmangle(spark.createDataFrame(list(enumerate(codes)), "id int, code string")).orderBy("id").collect()
    for r, (code, want) in zip(got, LAID.items()):
        assert (r.result, r.skipped) == (want, None), code
    assert [r.skipped for r in got[len(LAID) : -2]] == list(STAY.values())
    assert all(r.result == r.code for r in got[len(LAID) :])
    assert all(re.sub(r"\s", "", r.result) == re.sub(r"\s", "", r.code) for r in got[: len(LAID)])
    again = listings.unmangle(spark.createDataFrame([(r.id, r.result) for r in got], "id int, code string")).orderBy("id").collect()
    assert [r.result for r in again] == [r.result for r in got]


def test_long_listing(spark):
    """Every sign is in one piece, in listings and texts of some length, too."""
    text = "let a = 'x\\'y;'; " * 300 + '"' + "z;" * 20000 + '"; /* ' + "c; " * 3000 + "*/ f(g(h(1;2)));"
    df = spark.createDataFrame([(1, text)], "id int, code string")
    r = listings.unmangle(df).select("result", "skipped", listings.pieces(df.code, F.lit("js")).alias("p")).first()
    assert "".join(r.p) == text and r.skipped is None
    assert r.result.split("\n") == ["let a = 'x\\'y;';"] * 300 + ['"' + "z;" * 20000 + '";', "/* " + "c; " * 3000 + "*/ f(g(h(1;2)));"]


def test_coarse_pieces(spark):
    """White space of any kind may stand before a block's brace; doubts are seen beside other signs; what is in doubt is not laid out; blocks nest in values."""
    codes = {
        "const f = on(e =>\t{ a(); });": ("const f = on(e =>\t{\n    a();\n}\n);", None),
        "let f = g({a: () => { x(); }, b: [1; 2]});": ("let f = g({a: () => {\n    x();\n}\n, b: [1; 2]});", None),
        "let a = f(b)/c; g();": (None, "slash behind a bracket"),
        "let a = b */c; g();": (None, "open comment"),
        "let a = b; c()'d; e": (None, "open quote"),
        "LET const x = 1; SELECT b; f();": ("LET const x = 1;\nSELECT b;\nf();", None),
    }
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code string")
    got = listings.unmangle(df).orderBy("id").collect()
    assert [(r.result, r.skipped) for r in got] == [(laid or code, why) for code, (laid, why) in codes.items()]


def test_layout_runs_once(spark):
    """A listing's signs are not folded one by one in expressions, and one pass lays it out."""
    plan = listings.unmangle(spark.createDataFrame([("let a = 1; f();",)], "code string"))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and plan.count("laid(") <= 2
