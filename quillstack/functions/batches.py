"""What a Python worker holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters of text whose rows are made and handed on at once: Python's objects take many times the text.
CHARS = 1 << 20


def slices(s: pd.Series | pd.DataFrame, text: pd.Series) -> Iterator[pd.Series | pd.DataFrame]:
    """s in order in slices of about ``CHARS`` characters of its texts, of one row at least."""
    begun = held = 0
    for i, x in enumerate(text):
        n = 0 if x is None else len(x)
        if i > begun and held + n > CHARS:
            yield s.iloc[begun:i]
            begun, held = i, 0
        held += n
    yield s.iloc[begun:]
