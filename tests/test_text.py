import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code
from corpusloom.functions import text as tx
from corpusloom.functions.calculator import calculate


def clauses(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(tx.clause_tokens(F.col("t")).alias("x"))
    return [(r.clause, r.tok) for r in df.first().x]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The cat sat. Then it ran!", [(0, "the"), (0, "cat"), (0, "sat"), (0, "."), (1, "then"), (1, "it"), (1, "ran"), (1, "!")]),
        ("don't stop, ever", [(0, "don't"), (0, "stop"), (0, ","), (1, "ever")]),
        ("", []),
        ("  \n\n  ", []),
        ("Naïve Zürich", [(0, "naïve"), (0, "zürich")]),
        ("don’t stop", [(0, "don't"), (0, "stop")]),
        ("δοκιμή", [(0, "δοκιμή")]),
        ("„ja”", [(0, '"'), (1, "ja"), (1, '"_close')]),
        ("café o’clock", [(0, "café"), (0, "o'clock")]),
        ("a_b", [(0, "a"), (0, "_"), (0, "b")]),
    ],
)
def test_clauses(spark, text, expected):
    assert clauses(spark, text) == expected


def test_quotes_alternate(spark):
    found = [t for _, t in clauses(spark, '"hi." she said. "go now." "')]
    assert [t for t in found if t.startswith('"')] == ['"', '"_close', '"', '"_close', '"']
    assert [c for c, _ in clauses(spark, 'a "b" c')] == [0, 0, 1, 1, 2]


def test_nfc_and_repair(spark):
    df = spark.createDataFrame([("café",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.nfc(F.col("t"))).collect()] == ["café", None]
    broken = "it’s “ok”".encode().decode("cp1252", "replace")
    df = spark.createDataFrame([("cafÃ© â€™s",), ("plain",), ("naïve…",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.repaired(F.col("t"))).collect()] == ["café 's", "plain", "naïve...", None]
    assert broken


def lex(text, split_names=False):
    tokens, lines = code.lexemes(text or "", split_names)
    return list(zip(code.clause_numbers(tokens, lines).tolist(), tokens, strict=True))


def test_code():
    assert lex("const n = 1;\nreturn n;") == [(0, t) for t in "const n = 1 ;".split()] + [(1, t) for t in "return n ;".split()]
    words = lambda text, **o: " ".join(t for _, t in lex(text, **o))
    assert words('s = "one two";') == words("s = /on+e/;") == words("s = /a[/]b/gi;") == words("s = /a\\/b/;") == "s = <str> ;"
    assert words("p !== q => r") == "p !== q => r" and words("if (p) { q }") == "if ( p ) { q }"
    assert words("let lineCount = 2;", split_names=True) == "let line count = 2 ;"
    assert words("a / b / c // d\n/* e */ return /x/g") == "a / b / c return <str>"
    assert words("f(x) / 2 / /y/ / 3") == "f ( x ) / 2 / <str> / 3" and words("/^x/.test(s)") == "<str> . test ( s )"
    assert lex("a +\nb\nc") == [(0, "a"), (0, "+"), (0, "b"), (1, "c")]
    assert lex(None) == lex("") == []


def one_by_one(text, split_names):
    """The same by a plain machine that takes one token after the other and remembers the last."""
    out, last, value, due, clause, at = [], None, False, False, 0, 0
    while at < len(text):
        rest = text[at:]
        if found := re.match(code.COMMENT + r"|[^\S\n]+", rest):
            at += found.end()
            continue
        if rest[0] == "\n":
            due = due or (last is not None and last not in [*code.LONG_OPERATORS, *code.SHORT_OPERATORS, *code.OPENING_BRACKETS])
            at += 1
            continue
        number, name = re.compile(code.NUMBER).match(text, at), re.match(code.NAME, rest)
        if found := re.match(code.STRING, rest) or (None if value else re.match(code.PATTERN, rest)):
            size, tokens, value = found.end(), [code.LITERAL], True
        elif number:
            size, tokens, value = len(number[0]), [number[0]], True
        elif name:
            size, tokens = name.end(), code.name_parts(name[0]) if split_names else [name[0].lower()]
            value = tokens[-1] not in code.WORDS_BEFORE_VALUES
        else:
            sign = next((x for x in code.LONG_OPERATORS if rest.startswith(x)), rest[0])
            size, tokens, value = len(sign), [sign], sign in (")", "]")
        for token in tokens:
            clause, due = clause + due, False
            out.append((clause, token))
        last, at = tokens[-1], at + size
        due = last in code.CLAUSE_ENDS
    return out


def test_code_against_one_token_after_the_other():
    rng = random.Random(1)
    bits = ["a", "b1", "return", "my_return", "fooBar", " ", " ", "\n", "\n", "/", "/", "/x/g", "// c\n", "/* a\nb */", "'s'", '"t', "`q`", "1", "2.5", "1abc", "(", ")", "[", "]", "{", "}", ";", "+", "===", ".", "é", "\\", "@", "/[a/b]/", "'", "*"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        for split_names in (False, True):
            assert lex(text, split_names) == one_by_one(text, split_names), text


def test_code_column(spark):
    df = spark.createDataFrame([("x = 1\ny",), (None,), ("",)], "t string").select(code.code_tokens(F.col("t")).alias("c"))
    assert [[tuple(x) for x in r.c] for r in df.collect()] == [[(0, 0, 3, "x"), (0, 1, 3, "="), (0, 2, 3, "1"), (1, 0, 1, "y")], [], []]


def test_names(spark):
    names = ["userName", "HTTPServer2", "snake_case", "LOUD_NAME", "ABC2d", "x2Y", "été", "__", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = [r[0] for r in df.select(tx.identifier_parts(F.col("n"))).collect()]
    assert found == [code.name_parts(n) for n in names]
    assert found[:5] == [["user", "name"], ["http", "server2"], ["snake", "case"], ["loud", "name"], ["abc", "2d"]]


def test_minified(spark):
    texts = ["[" + ",".join(map(str, range(2000))) + "]", "short\n" + "x" * 1500 + "\nshort", "\n".join(["y" * 200] * 20), "  \n\n", None, "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.is_minified(F.col("t"))).collect()] == [True, True, True, False, False, False]


def test_answers_programs_and_imports(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("so #### 1,234 and #### 5", tx.answer) == "1234"
    assert one("none", tx.answer) is None
    assert one("x\n```python\nprint(1)\n```\n```\ny\n```", tx.program) == "print(1)"
    assert one("  whole \n", tx.program) == "whole"
    assert one("# c\nimport a\n\nfrom b import c\nx = 1\nimport d", tx.imports) == "import a\nfrom b import c"
    parts = one("a <<2*3=6>>6 and <<x>> b", tx.calculation_parts)
    assert [tuple(p) for p in parts] == [("text", "a "), ("python", "2*3"), ("python_output", "6"), ("text", "6 and "), ("python", "x"), ("python_output", ""), ("text", " b")]


def test_calculator():
    assert calculate("1,000 * (2 + 3) / 4") == "1250.0"
    assert calculate("'strawberry'.count('r')") == "3"
    for bad in ("2**9", "__import__('os')", "open('x')", "1/0", "'a'.upper()", None, "("):
        assert calculate(bad) is None


def test_multiple_choice(spark):
    df = spark.createDataFrame([("q?", ["A", "B"], ["x", "y"])], "q string, l array<string>, c array<string>")
    prompt = df.select(tx.multiple_choice(F.col("q"), F.col("l"), F.col("c"))).first()[0]
    assert "=A\n" in prompt and "=B\n" in prompt


def test_common_prefix_and_suffix(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 3]), ([], [1]), ([1], [1])], "a array<int>, b array<int>")
    rows = df.select(tx.common_prefix(F.col("a"), F.col("b")), tx.common_suffix(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(2, 1), (0, 0), (1, 1)]


def test_prompts_for_schemas_and_continuations(spark):
    df = spark.createDataFrame([(["x", "y"], "z", " c \n", "d")], "o array<string>, e string, c string, d string")
    shots = F.array(F.struct(F.array(F.lit("p"), F.lit("q")).alias("contexts"), F.lit(1).alias("gold"), F.lit("r").alias("continuation")))
    one = F.array(F.struct(F.lit(" s ").alias("context"), F.lit("t").alias("continuation")))
    none = F.array().cast("array<struct<context:string,continuation:string>>")
    got = df.select(tx.schema_prompts(F.col("o"), F.col("e"), F.lit("-"), shots), tx.continuation_prompts(F.col("c"), F.col("d"), F.lit("\n "), one), tx.continuation_prompts(F.col("c"), F.col("d"), F.lit(" "), none)).first()
    assert list(got) == [["q-r\n\nx-z", "q-r\n\ny-z"], ["s\n t\n\nc", "s\n t\n\nc\n d"], ["c", "c d"]]
