"""Code blocks through analysers by language, with a status for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import language

#: Facts of one snippet: name, kind, first line from 1.
Analyser = Callable[[str], list[tuple[str, str, int]]]


class Registry:
    """Analysers by language id; a language has one."""

    def __init__(self):
        self._by: dict[str, Analyser] = {}

    def add(self, languages: list[str], analyser: Analyser) -> None:
        for name in languages:
            if name in self._by:
                raise ValueError(f"{name} has an analyser")
            self._by[name] = analyser

    def get(self, name: str | None) -> Analyser | None:
        return self._by.get(name) if name else None


def analyse(blocks: DataFrame, registry: Registry) -> DataFrame:
    """blocks (lang, code, start_line, fenced) with status, facts and problem.

    unanalysed: no language; unsupported: no analyser for it; parse_error: the
    analyser failed, problem says how; else analysed.  A fact's line is the
    file's.  Null code is empty.
    """
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema]
    named = blocks.withColumn("_id", language(F.col("lang")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            status, facts, problems = [], [], []
            for name, label, code, start, fenced in zip(df["_id"], df["lang"], df["code"], df["start_line"], df["fenced"], strict=True):
                analyser, found, problem = registry.get(name if isinstance(name, str) else None), [], None
                if not isinstance(label, str) or not label:
                    state = "unanalysed"
                elif analyser is None:
                    state = "unsupported"
                else:
                    try:
                        found, state = [{"name": n, "kind": k, "line": int(start) + bool(fenced) + line - 1} for n, k, line in analyser(code or "")], "analysed"
                    except Exception as e:  # noqa: BLE001 - an analyser's failure is a result of its block
                        state, problem = "parse_error", str(e)
                status.append(state)
                facts.append(found)
                problems.append(problem)
            yield df.drop(columns="_id").assign(status=status, facts=facts, problem=problems)

    return named.mapInPandas(run, ", ".join([*columns, "status string", "facts array<struct<name: string, kind: string, line: int>>", "problem string"]))
