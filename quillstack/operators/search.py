"""Full-text search over blocks by a scan: postings, web-style queries, match, rank, best block, snippets; ``searchindex`` answers the same from an index.

Terms are runs of ASCII letters and digits, lower-cased, as they stand (no
stemming).  A block's rank is the number of its words that are required terms.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import first_per_group

TERM = "[a-z0-9]+"


@dataclass
class WebQuery:
    """Groups of alternatives that must all match; a term is one word or a phrase of several."""

    groups: list[list[list[str]]] = field(default_factory=list)
    excluded: list[list[str]] = field(default_factory=list)


def parse_query(text: str, most: int = 200, term: str = TERM) -> WebQuery:
    """``"a phrase"``, ``a or b``, ``-not``; cut to 200 characters first. ``term`` is what a word looks like; text is in compatibility form."""
    out, join = WebQuery(), False
    for minus, quoted, bare in regex.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', unicodedata.normalize("NFKC", text.strip()[:most])):
        words = regex.findall(term, (quoted or bare).lower())
        if not minus and not quoted and bare.lower() == "or":
            join = bool(out.groups)
        elif words and minus:
            out.excluded.append(words)
        elif words:
            if join:
                out.groups[-1].append(words)
            else:
                out.groups.append([words])
            join = False
    return out


def with_terms(blocks: DataFrame, text: str = "line") -> DataFrame:
    return blocks.withColumn("terms", F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1))


def postings(blocks: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """keys, term, tf, positions: the inverted index."""
    each = with_terms(blocks, text).select(*keys, F.posexplode("terms").alias("position", "term"))
    return each.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def _has(words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains("terms", words[0])
    line = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
    return line.contains(" " + " ".join(words) + " ")


def matches(query: WebQuery) -> Column:
    need = [reduce(lambda a, b: a | b, [_has(w) for w in g]) for g in query.groups]
    return reduce(lambda a, b: a & b, need + [~_has(w) for w in query.excluded], F.lit(bool(query.groups)))


def rank(query: WebQuery) -> Column:
    words = sorted({w for g in query.groups for p in g for w in p})
    return F.size(F.filter("terms", lambda t: t.isin(words)))


def best_blocks(blocks: DataFrame, query: WebQuery) -> DataFrame:
    """section_id, line_no, line, rank of each section's best matching block, the first of equals."""
    hits = with_terms(blocks).where(matches(query)).withColumn("rank", rank(query))
    return first_per_group(hits, ["section_id"], [F.desc("rank"), F.asc("line_no")]).drop("terms")


def damped(score: Column) -> Column:
    """Contents and index sections mention everything and rank last."""
    return score * F.when(F.col("role").isin("toc", "index"), 0.1).otherwise(1.0)


def marked(line: Column, words: list[str]) -> Column:
    """The line escaped for HTML with its matching words marked."""
    from ..functions.text import html_escape

    return F.regexp_replace(html_escape(line), r"(?i)\b(" + "|".join(words) + r")\b", "<mark>$1</mark>")
