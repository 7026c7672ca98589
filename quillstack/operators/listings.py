"""Flattened listings of brace languages read by modes: strings, templates, regular expressions and comments are each one piece.

One pattern cuts the code at its brackets and semicolons, one pass over what is cut carries the open brackets along.  It takes
listings that ``unmangle.unmangle`` leaves as they are: regular expressions, templates, block comments, heads and
calls with brackets at any depth.  What the pattern can't tell for sure is refused with a reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from .unmangle import is_flattened, is_output, keep_line_ends, language

#: Comments, Rust's with others inside (one level), quoted texts, templates whose inserts hold no braces.
COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
NESTED = r"/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*)|/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*))[^*/]*+)*+\*/)[^*/]*+)*+\*/"
QUOTED = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
TEMPLATE = r"`[^`\\$]*+(?:(?:\\.|\$\{[^{}`]*+\}|\$(?!\{))[^`\\$]*+)*+`"
#: A slash begins a regular expression where a value may begin: at the start, behind an operator or an opening bracket, behind some words.
VALUE = r"(?<=(?:^|[=(,:\[!&|?{;>+*%~^-]|\b(?:return|typeof|case|in|of|void|delete|throw|new|yield|await))\s{0,8})"
REGEX = r"(?=/)" + VALUE + r"/(?![*/])[^/\\\[\n]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/[A-Za-z]*+"
#: Rust: a lifetime is a name behind a quote that no quote follows; raw texts end at a quote with as many hashes.
LIFETIME = r"'[A-Za-z_]\w*+(?!')"
RAW = r"""b?r(#++)".*?"\2|b?r"[^"]*+\""""
SPACE, NAME = r"\s++", r"[\w$]++"
#: What begins like nothing else comes first; looking behind for a value is dear, and done at a slash only.
MODES = rf"""{COMMENT}|//.*|""\".*?""\"|{QUOTED}|{TEMPLATE}|{REGEX}"""
RUST_MODES = rf"{NESTED}|//.*|{RAW}|{LIFETIME}|{QUOTED}"
PIECE, RUST = rf"(?s)({NAME}|{SPACE}|{MODES}|=>|.)", rf"(?s)({RUST_MODES}|{NAME}|{SPACE}|=>|.)"
#: For the comparison and for doubts, all signs at which no other mode begins and no line is broken are one with their neighbours; white space, which a search passes over, parts them.
#: Not in Rust, where a name's letter may begin a raw text.
TOKEN, RUST_TOKEN = rf"(?s)([^\s\"'`/;{{}}]++|{MODES}|\S)", rf"(?s)({RUST_MODES}|{NAME}|=>|\S)"
#: Pieces up to a bracket or semicolon and with it; behind the last one, what is left.
STRETCH, RUST_STRETCH = rf"(?s)(?!\z)((?:[^\"'`/(){{}}\[\];]++|{MODES}|[\"'`/])*+[(){{}}\[\];]?+)", rf"(?s)(?!\z)((?:{RUST_MODES}|{NAME}|{SPACE}|[^(){{}}\[\];])*+[(){{}}\[\];]?+)"
BLANKS = " \t\r\n\f\x0b"


def _found(code: Column, lang: Column, pattern: str, rust: str) -> Column:
    return F.when(lang == "rust", F.regexp_extract_all(code, F.lit(rust), 1)).otherwise(F.regexp_extract_all(code, F.lit(pattern), 1))


def pieces(code: Column, lang: Column) -> Column:
    """Every sign of the code in one of its pieces, in order."""
    return _found(code, lang, PIECE, RUST)


def tokens(code: Column, lang: Column) -> Column:
    """The pieces but white space, those between breaks and blanks together."""
    return _found(code, lang, TOKEN, RUST_TOKEN)


def _lay(stretches: list[str]) -> str:
    """Stretches as a line a statement, indented by depth."""
    held, last, line, depth, out = [], "", "", 0, []  # open brackets, the sign before, the line so far

    def end(x: str) -> None:
        nonlocal depth
        if x := x.strip(" "):
            depth = max(0, depth - (x == "}"))
            out.append("    " * depth + x)
            depth += x.endswith("{")

    for p in stretches:
        sign, inside = p[-1:], bool(held) and held[-1] != "{"
        if sign == "{":
            told = p[:-1].rstrip(BLANKS)
            if not inside or told.endswith("=>") or (not told and last == ")"):
                held.append("{")
                end(line + p)
                line = ""
            else:
                held.append("v")
                line += p
        elif sign == "}" and not inside:
            end(line + p[:-1])
            end("}")
            line = ""
            held = held[:-1]
        elif sign == ";" and not inside:
            end(line + p)
            line = ""
        else:
            line += p
            if sign in ("(", "["):
                held.append(sign)
            elif sign in (")", "]", "}"):
                held = held[:-1]
        last = sign
    end(line)
    return "\n".join(out)


@cache
def _laid():
    @F.pandas_udf("string")
    def laid(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (part for b in batches for part in slices(b, b)):
            yield pd.Series([None if x is None else _lay(x.split("\n")) for x in s], index=s.index, dtype=object)

    return laid.asNondeterministic()  # or Spark might run it once more where its column is read


def laid_out(code: Column, lang: Column) -> Column:
    """Code of one line as a line a statement, indented by depth; semicolons inside round or square brackets end none.

    Braces open a block, inside round brackets only behind ``)`` or ``=>``: others there are values, which stay on their line.
    Null code stays null.
    """
    cut = F.when(lang == "rust", F.regexp_replace(code, RUST_STRETCH, "$1\n")).otherwise(F.regexp_replace(code, STRETCH, "$1\n"))
    return _laid()(cut)


def doubt(listed: Column, lang: Column) -> Column:
    """Why the tokens, each on a line of its own, can't be trusted, else null: a line comment (its end is lost on one line), an open quote, template or comment, a slash behind ``)`` or ``}``."""
    plain = F.when(listed.contains("\n/*"), F.regexp_replace(listed, r"\n/\*[^\n]++", "")).otherwise(listed)
    has = lambda text, *found: reduce(Column.__or__, [text.contains(x) for x in found])
    return (
        F.when(listed.contains("\n//"), "line comment").when(has(listed, '\n"\n', "\n`\n", "\n'\n"), "open quote")
        .when(has(plain, "\n/\n*", "*\n/\n"), "open comment").when((lang == "js") & has(plain, ")\n/\n", "}\n/\n"), "slash behind a bracket")
    )


def unmangle(df: DataFrame, code: str = "code") -> DataFrame:
    """df with language, result and skipped, as from ``unmangle.unmangle``, by modes.

    A result has the tokens of the input, one by one.  Null code has no language and stays null; code on several lines stays.
    """
    c, lang = F.col(code), F.col("language")
    braces = lang.isin("java", "js", "rust") & is_flattened(c)
    # One column a step, so that the patterns and the pass run once a listing; what is in doubt is not laid out.
    laid = df.withColumn("language", language(c)).withColumn("_tokens", F.when(braces, tokens(c, lang)))
    laid = laid.withColumn("_listed", F.concat(F.lit("\n"), F.array_join("_tokens", "\n"), F.lit("\n"))).withColumn("_doubt", doubt(F.col("_listed"), lang))
    laid = laid.withColumn("_new", laid_out(F.when(braces & F.col("_doubt").isNull(), c), lang)).withColumn("_again", tokens(F.col("_new"), lang))
    skipped = (
        F.when(lang.isNull(), "no known language").when(is_output(c), "program output").when(~is_flattened(c), "not flattened").when(~lang.isin("java", "js", "rust"), "no layout for this language")
        .otherwise(F.coalesce(F.col("_doubt"), F.when(~F.col("_again").eqNullSafe(F.col("_tokens")), "tokens would change")))
    )
    out = laid.withColumn("skipped", skipped)
    return out.withColumn("result", F.when(F.col("skipped").isNull(), keep_line_ends(c, F.col("_new"))).otherwise(c)).drop("_tokens", "_listed", "_doubt", "_new", "_again")
