"""Words of whole texts, and what each distinct word counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from meterfold.llm.common import text_or_empty

#: A word is a run of characters other than these white-space characters; symbols as the rules name them.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = frozenset("#*$%&|<>")
#: What each word's code holds, in this order.
CHARS, UPPER, LETTERS, DIGITS, SYMBOL, SHOUTS, BAR = range(7)
FIELDS = 7


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))


def word_codes(distinct: list[str]) -> list[bytes]:
    """Characters, upper-case letters, letters, digits, symbols and exclamation marks of each word, and if it is a bar."""
    out = np.zeros((len(distinct), FIELDS), dtype="<u4")
    for k, w in enumerate(distinct):
        if w.isalpha():
            n = len(w)
            up = 0 if w.islower() else n if w.isupper() else sum(map(str.isupper, w))
            out[k] = n, up, n, 0, 0, 0, 0
        else:
            out[k] = len(w), sum(map(str.isupper, w)), sum(map(str.isalpha, w)), sum(map(str.isdigit, w)), sum(c in SYMBOLS for c in w), w.count("!"), w == "|"
    raw = out.tobytes()
    return [raw[k : k + 4 * FIELDS] for k in range(0, len(raw), 4 * FIELDS)]


def repeated_window_words(index: np.ndarray, offsets: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each list that lie in a window of so many words which the list holds twice or more."""
    n = len(index)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n < width:
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    # windows get exact numbers: the number of a window of k + 1 words is that of its first k with the last one
    span = int(index.max()) + 1
    number = index.astype(np.int64)
    for k in range(1, width):
        pairs = number[: n - k] * span + index[k:]
        number = np.unique(pairs, return_inverse=True)[1]
    inside = rows[: n - width + 1] == rows[width - 1 :]
    own = rows[: n - width + 1] * (int(number.max()) + 1) + number
    _, place, count = np.unique(own[inside], return_inverse=True, return_counts=True)
    again = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(inside)[count[place] >= 2]
    np.add.at(again, starts, 1)
    np.add.at(again, starts + width, -1)
    covered = np.cumsum(again[:n]) > 0
    return np.bincount(rows[covered], minlength=len(offsets) - 1)
