"""Full-text search by an inverted index: analyser, postings, ranked match over postings alone, headlines.

The index has one row for each term of each block, made inside the block's row
without a shuffle.  Written once, each file sorted by term, it answers a query
from the row groups of the query's own terms; texts are read again only for the rows that
are shown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.stemming import STOP_WORDS, stem
from .search import TERM, WebQuery

START, END = "\u0002", "\u0003"
#: Saturation and length weight of the rank (Okapi BM25).
K1, B = 1.2, 0.75
#: Places that a worker holds before it hands them on.
PLACES = 1 << 17
_WORD, _STOP = re.compile(TERM), frozenset(STOP_WORDS)


def analysed(text: str, stems: bool = True) -> list[tuple[str, int]]:
    """term and place of every word that is indexed, in order: lower-case ASCII words and numbers, without stop words, as stems."""
    words = enumerate(_WORD.findall(text.lower()))
    return [(stem(w) if stems else w, i) for i, w in words if w not in _STOP]


def _posted(keys: int, stems: bool):
    """A row for each term of each text, in flat Arrow columns; the texts stand behind the keys."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms, ends, places, lengths = [], [], [0], [], []

            def batch() -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))  # noqa: B023
                own = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(keys)]  # noqa: B023
                out = pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.string()), lists, pa.array(lengths, pa.int32())], [*b.schema.names[:keys], "term", "places", "length"])  # noqa: B023
                for x in (rows, terms, places, lengths):  # noqa: B023
                    x.clear()
                ends[:] = [0]  # noqa: B023
                return out

            for r, text in enumerate(b.column(keys)):
                at: dict[str, list[int]] = {}
                for term, i in analysed(text.as_py() or "", stems):
                    at.setdefault(term, []).append(i)
                n = sum(map(len, at.values()))
                for term, p in at.items():
                    rows.append(r)
                    terms.append(term)
                    places += p
                    ends.append(len(places))
                    lengths.append(n)
                if len(places) > PLACES:
                    yield batch()
            if rows:
                yield batch()

    return posted


def index(blocks: DataFrame, keys: list[str], text: str = "line", stems: bool = True) -> DataFrame:
    """keys, term, tf, places, length (indexed words of the block): the inverted index. Null and empty texts have no row."""
    given = blocks.select(*keys, F.col(text).alias("_text"))
    more = StructType().add("term", StringType()).add("places", ArrayType(IntegerType())).add("length", IntegerType())
    each = given.mapInArrow(_posted(len(keys), stems), StructType([*given.schema.fields[:-1], *more.fields]))
    return each.select(*keys, "term", F.size("places").alias("tf"), "places", "length")


def statistics(index: DataFrame, keys: list[str]) -> tuple[int, float]:
    """Blocks in the index and their mean length: kept with a written index."""
    one = index.groupBy(*keys).agg(F.first("length").alias("length")).agg(F.count("*"), F.avg("length")).first()
    return one[0], one[1] or 0.0


def _prepared(query: WebQuery, stems: bool) -> WebQuery:
    """The query's words as the index holds them; a stop word inside a phrase leaves its place ('') and those around it go."""

    def kept(phrase: list[str]) -> list[str]:
        words = ["" if w in _STOP else stem(w) if stems else w for w in phrase]
        some = [i for i, w in enumerate(words) if w]
        return words[some[0] : some[-1] + 1] if some else []

    groups = [[k for k in map(kept, g) if k] for g in query.groups]
    return WebQuery([g for g in groups if g], [k for k in map(kept, query.excluded) if k])


def search(index: DataFrame, keys: list[str], query: WebQuery, blocks: int, mean: float, stems: bool = True) -> DataFrame:
    """keys, rank of every block that matches: BM25 over the query's terms, from their postings alone.

    A phrase's words must follow each other, any one word in a stop word's place.
    """
    q = _prepared(query, stems)
    words = sorted({w for g in q.groups for p in g for w in p if w})
    asked = sorted({*words, *(w for p in q.excluded for w in p if w)})
    if not words:
        return index.select(*keys, F.lit(0.0).alias("rank")).where(F.lit(False))
    hits = index.where(F.col("term").isin(asked))
    by = hits.groupBy(*keys).agg(F.max("length").alias("_l"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_p"))
    df = {r["term"]: r["n"] for r in hits.where(F.col("term").isin(words)).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a word of the query

    def places(w: str) -> Column:
        return F.coalesce(F.try_element_at("_p", F.lit(w)), F.array().cast("array<int>"))

    def moved(w: str, back: int) -> Column:
        return F.transform(places(w), lambda x: x - back)

    def has(phrase: list[str]) -> Column:
        return F.size(reduce(F.array_intersect, [moved(w, k) for k, w in enumerate(phrase) if w])) > 0

    need = [reduce(lambda a, b: a | b, [has(p) for p in g]) for g in q.groups] + [~has(p) for p in q.excluded]
    rank = F.lit(0.0)
    for w in words:
        tf = F.size(places(w)).cast("double")
        idf = F.log(F.lit(1.0) + (F.lit(float(blocks)) - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))
        rank = rank + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_l") / F.lit(max(mean, 1e-9))))
    return by.where(reduce(lambda a, b: a & b, need)).select(*keys, rank.alias("rank"))


def headline(text: Column, query: WebQuery, most: int = 30, stems: bool = True) -> Column:
    """The run of at most ``most`` words with the most words of the query (the first of equals), its matches between two control characters."""
    q = _prepared(query, stems)
    wanted = frozenset(w for g in q.groups for p in g for w in p if w)

    @F.pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str:
            words = (t or "").split()
            bare = [m.group() if (m := _WORD.search(w.lower())) else "" for w in words]
            hit = [(stem(b) if stems else b) in wanted for b in bare]
            n = best = sum(hit[:most])
            start = 0
            for i in range(most, len(words)):
                n += hit[i] - hit[i - most]
                if n > best:
                    best, start = n, i - most + 1
            return " ".join(START + w + END if h else w for w, h in zip(words[start : start + most], hit[start : start + most], strict=True))

        for s in batches:
            yield s.map(one)

    return shown(text)


def plain(snippet: Column) -> Column:
    return F.regexp_replace(F.coalesce(snippet, F.lit("")), f"[{START}{END}]", "")


def marked(snippet: Column) -> Column:
    """A headline escaped for HTML, its matches in mark elements."""
    from ..functions.text import html_escape

    return F.replace(F.replace(html_escape(F.coalesce(snippet, F.lit(""))), F.lit(START), F.lit("<mark>")), F.lit(END), F.lit("</mark>"))


def quote_places(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """quotes with start: where each is first found in its text, from 0; null where it isn't (it is kept, unplaced)."""
    at = F.when(F.col("quote") != "", F.expr("instr(_text, quote)"))
    return quotes.join(texts.select(key, F.col("text").alias("_text")), key, "left").withColumn("start", F.when(at > 0, at - 1)).drop("_text")
