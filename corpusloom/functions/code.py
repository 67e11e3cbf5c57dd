"""JavaScript and TypeScript as clause tokens.

A lexeme pattern cuts the text so that a slash needs no memory: a *value* (a name, number, literal or closing
bracket) takes the blanks, comments and line ends after it and a slash that follows them, which then can only
divide; any other slash begins a regular expression if it can. Clauses are numbered afterwards for the whole
text at once, from what each token and the gap before it say. Runs as an Arrow UDF.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lexical patterns and token classes of the language.
COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
STRING = r'"(?:\\(?s:.)|[^"\\])*"|' + r"'(?:\\(?s:.)|[^'\\])*'|" + r"`(?:\\(?s:.)|[^`\\])*`"
PATTERN = r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[A-Za-z]*"
NUMBER = r"\b\d+(?:\.\d+)?(?:e[+-]?\d+)?\b"
NAME = r"(?:[^\W\d]|[$])[\w$]*"
LONG_OPERATORS = ["===", "!==", "==", "!=", "<=", ">=", "=>", "&&", "||", "??", "++", "--", "..."]
SHORT_OPERATORS = ["+", "-", "*", "/", "%", "=", "<", ">", "!", "&", "|", "^", "~", "?", ":", ".", ","]
OPENING_BRACKETS = ["(", "[", "{"]
CLAUSE_ENDS = [";", "{", "}"]
WORDS_BEFORE_VALUES = ["return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "do", "else", "yield", "await", "case"]
LITERAL = "<str>"

#: Where a name in ASCII falls into words: at signs, before a capital after small letters, before the last of several
#: capitals if a small letter follows it, and between capitals and digits.
WORD_EDGE = r"[_$]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Z][A-Z])(?=[0-9])"

_GAP = rf"(?:{COMMENT}|\s)+"
_LEXEME = re.compile(
    rf"(?P<gap>{_GAP})"
    rf"|(?P<value>(?P<string>{STRING})|{NUMBER}|(?P<name>{NAME})|[)\]])(?P<after>{_GAP})?(?P<divides>/(?![/*]))?"
    rf"|(?P<pattern>{PATTERN})"
    rf"|(?P<sign>{'|'.join(map(re.escape, LONG_OPERATORS))}|(?s:.))"
)
_AFTER = re.compile(rf"(?P<after>{_GAP})?(?P<divides>/(?![/*]))?")
_REMARK = re.compile(COMMENT)
_EDGE = re.compile(WORD_EDGE)


def name_parts(name: str) -> list[str]:
    """Lower-case words of a camelCase, snake_case or ACRONYMCase name; a name beyond ASCII, or of signs alone, stays whole."""
    words = [w.lower() for w in _EDGE.split(name) if w] if name.isascii() else []
    return words or [name.lower()]


def lexemes(text: str, split_names: bool = False) -> tuple[list[str], list[int]]:
    """Tokens, and the number of each one that has a line end before it."""
    tokens: list[str] = []
    lines: list[int] = []

    def gap(blank: str | None) -> None:
        if blank and "\n" in blank and "\n" in _REMARK.sub("", blank):
            lines.append(len(tokens))

    at = 0
    while found := _LEXEME.match(text, at):
        at, rest = found.end(), None
        if found["gap"]:
            gap(found["gap"])
        elif found["value"]:
            if found["string"]:
                tokens.append(LITERAL)
            elif found["name"]:
                tokens += name_parts(found["name"]) if split_names else [found["name"].lower()]
                if tokens[-1] in WORDS_BEFORE_VALUES:  # no value: what follows is read anew
                    at = found.end("value")
                    continue
            else:
                tokens.append(found["value"])
            rest = found
        elif found["pattern"]:
            tokens.append(LITERAL)
            rest = _AFTER.match(text, at)
            at = rest.end()
        else:
            tokens.append(found["sign"])
        if rest:
            gap(rest["after"])
            if rest["divides"]:
                tokens.append("/")
    return tokens, lines


def clause_numbers(tokens: list[str], lines: list[int]) -> np.ndarray:
    """The clause of each token: a new one after a clause end, and after a line end unless the token before wants more."""
    want_more = {*LONG_OPERATORS, *SHORT_OPERATORS, *OPENING_BRACKETS}
    opens = np.zeros(len(tokens) + 1, np.int64)
    opens[1:] = [t in CLAUSE_ENDS for t in tokens]
    opens[[i for i in lines if i and tokens[i - 1] not in want_more]] = 1
    return np.cumsum(opens[:-1])


RESULT = T.ArrayType(T.StructType([*[T.StructField(c, T.LongType()) for c in ("clause", "cpos", "clen")], T.StructField("tok", T.StringType())]))


def code_tokens(text: Column, split_names: bool = False) -> Column:
    """array<struct<clause, cpos, clen, tok>> of source code, as ``text.clause_tokens`` gives it of prose; a null or empty text has none."""

    def run(x: pa.Array) -> pa.Array:
        numbers, tokens, ends = [np.zeros((3, 0), np.int64)], [], [0]
        for value in x.to_pylist():
            own, lines = lexemes(value or "", split_names)
            clause = clause_numbers(own, lines)
            sizes = np.bincount(clause)  # every number has a token
            numbers.append(np.stack([clause, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)]))
            tokens += own
            ends.append(len(tokens))
        cells = pa.StructArray.from_arrays([*map(pa.array, np.concatenate(numbers, axis=1)), pa.array(tokens, pa.string())], names=RESULT.elementType.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(text)
