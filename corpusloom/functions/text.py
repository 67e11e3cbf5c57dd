"""Text functions as columns: clause tokens, identifiers, minified code, answers, programs and prompts.

Everything that regular expressions and array functions express stays in the JVM, row by row and without a
shuffle. The code lexer and the calculator carry state and run as Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.code import WORD_EDGE

# Token and clause patterns, and characters that are replaced before tokenizing.
TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
BREAKS = '.!?,;:"'
CURLY, STRAIGHT = "‘’“”„‟", "''" + '"' * 4
CLOSE_QUOTE = '"_close'
#: A noncharacter that stands for a closing quote while a text is cut; it never occurs in text that is interchanged.
_CLOSE = "﷐"


def prepared(text: Column) -> Column:
    """Normal form C, straight quotes and lower case. The closing mark's character counts as the one after it."""
    return F.lower(F.translate(nfc(text), CURLY + _CLOSE, STRAIGHT + chr(ord(_CLOSE) + 1)))


#: Characters among which are all that normal form C may change or join.
_MAY_CHANGE = r"[\x{300}-\x{1FFF}\x{2000}\x{2001}\x{2126}-\x{2FFF}\x{A000}-\x{ABFF}\x{D7B0}-\x{D7FF}\x{E000}-\x{10FFFF}]"


def nfc(text: Column) -> Column:
    """Unicode normal form C, which has no Spark function. Only texts with characters that it may change go to Python."""
    import pyarrow as pa

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in x.to_pylist()], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.coalesce(F.arrow_udf(run, "string")(F.when(text.rlike(_MAY_CHANGE), text)), text)


#: Characters that ``prepared`` replaces.
_REPLACED = list(zip(CURLY + _CLOSE, STRAIGHT + chr(ord(_CLOSE) + 1), strict=True))


#: TOKEN for Python, whose \w has the letters and numbers and the low line; ASCII texts have a faster one.
_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[^ \t\n\x0b\f\r\w]|_")
_ASCII_TOKENS = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*|[^ \t\n\x0b\f\ra-z0-9]")


def tokens_of(text: str) -> list[str]:
    """A text's tokens, for Python workers; quotes are all opening ones yet."""
    if text.isascii():
        return _ASCII_TOKENS.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    for old, new in _REPLACED:
        text = text.replace(old, new)
    return _TOKENS.findall(text.lower())


def clause_tokens(text: Column) -> Column:
    """array<struct<clause, cpos, clen, tok>> in text order.

    Tokens are words (with inner apostrophes) and single other characters. Quotes alternate between ``"`` and
    ``"_close`` over the document. A clause ends after any of ``. ! ? , ; : "`` or a closing quote. cpos is the
    place in the clause and clen its length.
    """
    # pairs of quotes, left to right: the second becomes the closing mark
    marked = F.regexp_replace(prepared(text), r'"([^"]*+)"', '"$1' + _CLOSE)
    ends = BREAKS + _CLOSE
    clauses = F.regexp_extract_all(marked, F.lit(f"[^{ends}]*+[{ends}]|[^{ends}]++"), F.lit(0))

    def tokens(clause: Column, i: Column) -> Column:
        found = F.regexp_extract_all(clause, F.lit(TOKEN), F.lit(0))
        return F.transform(F.transform(F.array(found), lambda x: F.struct(x.alias("x"), F.size(x).alias("n"))), lambda y: F.transform(y["x"], lambda t, j: F.struct(i.alias("clause"), j.alias("cpos"), y["n"].alias("clen"), F.when(t == _CLOSE, CLOSE_QUOTE).otherwise(t).alias("tok"))))[0]

    return F.flatten(F.transform(clauses, tokens))


def literal_replacements(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# What UTF-8 punctuation looks like when it's read as Windows-1252, in the order of replacement,
# and punctuation that becomes ASCII.
MISREAD = [("â€œ", '"'), ("â€\x9d", '"'), ("â€˜", "'"), ("â€™", "'"), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("â€", '"'), ("Â", "")]
SMART_PUNCTUATION = [("“", '"'), ("”", '"'), ("„", '"'), ("‘", "'"), ("’", "'"), ("‚", "'"), ("–", "-"), ("—", "-"), ("…", "..."), ("\u00a0", " ")]


def repaired(text: Column) -> Column:
    """Text that was UTF-8 but was read as Windows-1252 is read right as a whole, or else piece by piece; then smart
    punctuation becomes ASCII."""
    import pyarrow as pa

    def run(x: pa.Array) -> pa.Array:
        def fix(v: str | None) -> str | None:
            if v is None or v.isascii():
                return v
            try:
                return v.encode("cp1252").decode("utf-8")
            except UnicodeError:
                return v

        return pa.array([fix(v) for v in x.to_pylist()], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return literal_replacements(F.arrow_udf(run, "string")(text), MISREAD + SMART_PUNCTUATION)


def clean_tokens(tokens: Column) -> Column:
    """Trimmed lower-case tokens without blank ones."""
    return F.filter(F.transform(tokens, lambda t: F.lower(F.trim(t))), lambda t: t != "")


LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def is_minified(text: Column, longest: int = 1000, mean: int = 100) -> Column:
    """Whether some line that isn't blank has over ``longest`` characters, or they have over ``mean`` on average."""
    sizes = F.transform(F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""), lambda x: F.length(x).cast("long"))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    return (F.size(sizes) > 0) & ((F.coalesce(F.array_max(sizes), F.lit(0)) > longest) | (total > F.lit(mean) * F.size(sizes)))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: F.length(x).cast("long")))


def identifier_parts(name: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or ACRONYMCase name; a name beyond ASCII, or of signs alone, stays whole."""
    parts = F.filter(F.split(name, WORD_EDGE), lambda x: x != "")
    ascii_only = name.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only & (F.size(parts) > 0), F.transform(parts, F.lower)).otherwise(F.array(F.lower(name)))


def answer(text: Column) -> Column:
    """The number after the first ``#### ``, without commas; null if there is none."""
    return F.nullif(F.replace(F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1), F.lit(","), F.lit("")), F.lit(""))


def calculation_parts(text: Column) -> Column:
    """array<struct<kind, value>>: text between calculations, and for each ``<<expression=result>>`` both sides."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)<<[^<>]*>>|(?:(?!<<[^<>]*>>).)+"), F.lit(0))

    def typed(part: Column) -> Column:
        inner = F.substring(part, F.lit(3), F.length(part) - 4)
        pair = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
        left = F.when(F.contains(inner, F.lit("=")), F.substring(inner, F.lit(1), F.length(inner) - F.length(F.substring_index(inner, "=", -1)) - 1)).otherwise(inner)
        calculation = F.array(pair("python", left), pair("python_output", F.when(F.contains(inner, F.lit("=")), F.substring_index(inner, "=", -1)).otherwise(F.lit(""))))
        return F.when(F.startswith(part, F.lit("<<")) & F.endswith(part, F.lit(">>")), calculation).otherwise(F.array(pair("text", part)))

    return F.flatten(F.transform(parts, typed))


def program(text: Column) -> Column:
    """The first fenced code block, or the whole text; trimmed."""
    block = r"(?s)```(?:python)?\s*\n(.*?)\n```"
    return F.btrim(F.when(text.rlike(block), F.regexp_extract(text, block, 1)).otherwise(text), F.lit(" \n\t\r\x0b\x0c"))


def imports(text: Column) -> Column:
    """The import lines that a program begins with, up to the first other line."""
    all_lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    other = F.transform(F.sequence(F.lit(1), F.size(all_lines)), lambda i: F.when((F.element_at(all_lines, i) != "") & ~F.element_at(all_lines, i).rlike(r"^(import |from |#)"), i))
    first = F.coalesce(F.array_min(F.filter(other, lambda i: i.isNotNull())), F.size(all_lines) + 1)
    return F.array_join(F.filter(F.slice(all_lines, F.lit(1), first - 1), lambda x: x.rlike(r"^(import |from )")), "\n")


def multiple_choice(question: Column, letters: Column, choices: Column) -> Column:
    """A question with lettered choices; the letter comes after the choice, next to the line's end."""
    options = F.array_join(F.zip_with(letters, choices, lambda a, c: F.concat(F.lit("- "), c, F.lit("="), a, F.lit("\n"))), "")
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), options, F.lit("\nRespond only with the letter of the correct answer."))


def few_shot(examples: Column, final: Column, between: str = "\n\n") -> Column:
    """Example prompts and the final one."""
    return F.array_join(F.concat(examples, F.array(final)), between)


def _shots(examples: Column, final: Column) -> Column:
    """Each example and a blank line, then the final prompt."""
    return F.concat(F.array_join(F.transform(examples, lambda e: F.concat(e, F.lit("\n\n"))), ""), final)


def schema_prompts(contexts: Column, continuation: Column, delimiter: Column, examples: Column) -> Column:
    """A prompt for each context, with the same continuation; examples are (contexts, gold, continuation)."""
    shown = F.transform(examples, lambda e: F.concat(F.get(e["contexts"], e["gold"]), delimiter, e["continuation"]))
    return F.transform(contexts, lambda c: _shots(shown, F.concat(c, delimiter, continuation)))


def continuation_prompts(context: Column, continuation: Column, delimiter: Column, examples: Column) -> Column:
    """The prompt without and with the continuation; contexts are trimmed, and the first one has no blanks at its end,
    so that it is the beginning of the second. examples are (context, continuation)."""
    blank = r"^\s+|\s+$"
    shown = F.transform(examples, lambda e: F.concat(F.regexp_replace(e["context"], blank, ""), delimiter, e["continuation"]))
    begun = F.concat(F.regexp_replace(context, blank, ""), delimiter)
    return F.array(F.regexp_replace(_shots(shown, begun), r"\s+$", ""), _shots(shown, F.concat(begun, continuation)))


def common_prefix(a: Column, b: Column) -> Column:
    """Entries that two arrays have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    short = F.slice(same, F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))
    at = F.array_position(short, F.lit(False))
    return F.when(F.least(F.size(a), F.size(b)) == 0, F.lit(0)).when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def option_spans(options: Column) -> Column:
    """array<struct<first, last>> for options given as id lists with a common beginning: where each one's own part lies."""
    start = F.aggregate(F.slice(options, F.lit(2), F.size(options)), F.size(F.element_at(options, 1)), lambda n, o: F.least(n, common_prefix(F.element_at(options, 1), o)))
    return F.transform(options, lambda o: F.struct(start.alias("first"), F.size(o).alias("last")))


def context_spans(contexts: Column) -> Column:
    """The same for contexts with a common end: where the common part lies in each."""
    tail = F.aggregate(F.slice(contexts, F.lit(2), F.size(contexts)), F.size(F.element_at(contexts, 1)), lambda n, c: F.least(n, common_suffix(F.element_at(contexts, 1), c)))
    return F.transform(contexts, lambda c: F.struct((F.size(c) - tail).alias("first"), F.size(c).alias("last")))


def cropped(ids: Column, first: Column, last: Column, most: int) -> Column:
    """The last ``most`` ids, with the span moved along."""
    gone = F.greatest(F.size(ids) - most, F.lit(0))
    return F.struct(F.slice(ids, gone + 1, F.lit(most)).alias("ids"), (first - gone).alias("first"), (last - gone).alias("last"))
