"""Program listings that conversion has flattened to one line: found, and broken at their statements again.

Column expressions only.  The layout is the plain one: a line per statement,
indented by brace depth.  A result is taken only if it has the input's tokens;
otherwise the code stays as it was, with a reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import LANGUAGES
from .markdown import blocks

#: What a paragraph of each language shows: a pattern, how often it must occur, and words of which every match holds one (in small letters where the pattern takes any).
SIGNS = {
    "sql": (r"(?i)\b(select\s.+\sfrom|insert\s+into|create\s+table|update\s.+\sset)\b", 1, ("select", "insert", "create", "update")),
    "rust": (r"\b(fn\s+\w+\s*\(|let\s+mut\b|impl\s+\w+|pub\s+(fn|struct|enum))", 1, ("fn", "mut", "impl", "pub")),
    "java": (r"\b(public|private|protected)\s+(static\s+)?(class|void|int|String)\b|System\.out\.", 1, ("public", "private", "protected", "System.out.")),
    "js": (r"\b(const|let|var)\s+\w+\s*=|=>|\bfunction\s*\w*\(|console\.log\(", 1, ("const", "let", "var", "=>", "function", "console.log(")),
    "python": (r"(?m)^\s*(def\s+\w+\(.*\):|import\s+\w+|from\s+\w+\s+import\b|print\()", 1, ("def", "import", "print(")),
}


def language(code: Column) -> Column:
    """The first language whose signs the code shows, else null.  Code without a pattern's words is not searched for it, which takes longer."""
    out = None
    for name, (pattern, least, words) in SIGNS.items():
        hit = code.rlike(pattern) if least == 1 else F.regexp_count(code, F.lit(pattern)) >= least
        text = F.lower(code) if pattern.startswith("(?i)") else code
        hit = reduce(Column.__or__, [text.contains(w) for w in words]) & hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_flattened(code: Column) -> Column:
    return (F.trim(code) != "") & ~F.trim(code).contains("\n")


def is_output(code: Column) -> Column:
    """Program output: a prompt or a ruled table, left as it is."""
    return code.rlike(r"^\s*(>>>|\$ |C:\\>)|\+-{3,}\+")


def broken(code: Column) -> Column:
    """A line per statement: breaks after ; { and }, outside for-heads and quotes, indented by depth."""
    kept = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\([^()]*\))"""
    pieces = F.regexp_extract_all(code, F.lit(kept + r"""|[;{}]|[^;{}"'(]+|."""), 0)
    cut = F.array_join(F.transform(pieces, lambda p: F.when(p == ";", ";\n").when(p == "{", "{\n").when(p == "}", "\n}\n").otherwise(p)), "")
    rows = F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # One pass carries the depth along with the lines laid out so far.
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("out"))

    def put(a: Column, x: Column) -> Column:
        at = F.greatest(F.lit(0), a["d"] - F.when(x.startswith("}"), 1).otherwise(0))
        return F.struct((at + F.when(x.endswith("{"), 1).otherwise(0)).alias("d"), F.array_append(a["out"], F.concat(F.repeat(F.lit("    "), at), x)).alias("out"))

    return F.aggregate(rows, start, put, lambda a: F.array_join(a["out"], "\n"))


#: Strings, numbers, words and single signs; white space between them doesn't count, inside strings it does.
TOKEN = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[\w$]+|[^\s\w$])"""


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN), 1)


def aliases() -> dict[str, list[str]]:
    """The languages that a step takes: its names as fences and options spell them."""
    return {step: [step, *LANGUAGES.get({"js": "javascript"}.get(step, step), [step])[1:], *(["javascript"] if step == "js" else [])] for step in SIGNS}


def step_language(label: Column) -> Column:
    """The step that a fence's or an option's language goes to, else null."""
    pairs = [x for step, names in aliases().items() for name in dict.fromkeys(names) for x in (F.lit(name), F.lit(step))]
    return F.try_element_at(F.create_map(*pairs), F.lower(label))


def without_markup(code: Column) -> Column:
    """Emphasis, code marks and escapes that a converter put into a listing, dropped; underscores inside words stay."""
    c = F.regexp_replace(code, r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*", "$1")
    c = F.regexp_replace(c, r"(?<![\w*])_(?=\S)([^_\n]+?)(?<=\S)_(?!\w)", "$1")
    return F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+.!<>|-])", "$1")


def paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, sort_order, start_line, text: the paragraphs that may hold listings; fences, headings, lists, tables and quotes are left as they are."""
    return blocks(pages).where("block_type = 'paragraph'").select("page_id", "sort_order", "start_line", F.col("markdown").alias("text"))


def keep_line_ends(before: Column, after: Column) -> Column:
    """after with CRLF line ends where before has them."""
    return F.when(before.contains("\r\n"), F.regexp_replace(after, r"\r?\n", "\r\n")).otherwise(after)


#: Where a slash begins a regular expression, not a division; for-heads with brackets inside brackets; comments.
REGEX_LITERAL = r"(?:^|[=(,:\[!&|?{};>]|\breturn|\btypeof|\bcase)\s*/(?![/*])"
DEEP_HEAD = r"\bfor\s*\([^()]*\([^()]*\("


def unmangle(df: DataFrame, code: str = "code") -> DataFrame:
    """df with language, result and skipped: why the code was left unchanged, null where it was laid out.

    A result has the tokens of the input, one by one.  Code with template
    literals, comments, regular expressions or a for-head with calls inside
    calls stays: these hold signs at which a line must not be broken.
    """
    laid = df.withColumns({"language": language(F.col(code)), "_new": broken(F.col(code))})
    skipped = (
        F.when(F.col("language").isNull(), "no known language").when(is_output(F.col(code)), "program output").when(~is_flattened(F.col(code)), "not flattened").when(~F.col("language").isin("java", "js", "rust"), "no layout for this language")
        .when(F.col(code).contains("`") | F.col(code).contains("/*") | F.col(code).rlike(r"(?<![:\"'])//"), "template or comment").when(F.col(code).rlike(REGEX_LITERAL), "regular expression").when(F.col(code).rlike(DEEP_HEAD), "deep brackets").when(tokens(F.col("_new")) != tokens(F.col(code)), "tokens would change")
    )
    return laid.withColumn("skipped", skipped).withColumn("result", F.when(F.col("skipped").isNull(), F.col("_new")).otherwise(F.col(code))).withColumn("result", keep_line_ends(F.col(code), F.col("result"))).drop("_new")


def best_profile(paragraphs: DataFrame, profiles: dict[str, str], text: str = "text") -> DataFrame:
    """The profile whose pattern most paragraphs of the whole corpus show; of equals the one named first."""
    counts = paragraphs.agg(*[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in profiles.items()])
    listed = counts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("profile"), F.col(n).alias("hits")) for n in profiles])).alias("place", "x"))
    return listed.select("place", "x.profile", "x.hits").withColumn("_r", F.row_number().over(Window.orderBy(F.desc("hits"), "place"))).where("_r = 1").select("profile", "hits")


def step_report(files: DataFrame) -> DataFrame:
    """folder, files, changed, skipped: per top-level folder. files: path, changed, skipped."""
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("files"), F.count_if("changed").alias("changed"), F.count("skipped").alias("skipped"))
