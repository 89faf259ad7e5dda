"""Periodic runs of words: stretches that repeat with a smallest period and that no neighbouring word extends.

Every run has a Lyndon root, for one of the two orders of an alphabet, that reaches from a position to its next smaller suffix.
So the Lyndon arrays of a text, of the order and of its reverse, name all candidates. They are made from left to right over the
words themselves, which are only compared: no suffix structure, no hash. How far the two suffixes of an edge agree is what
comparisons cost; what lies inside the stretch matched furthest to the right so far is taken over from there.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value

#: A run has at least so many words, and so many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_edges(words: Sequence, less: Callable, least_exponent: int = LEAST_EXPONENT) -> Iterator[tuple[int, int, int]]:
    """(start, period, match): positions whose next smaller suffix is `period` further on and agrees with theirs for `match`
    words, where that can be a run's first root: at most period - 1 words of the run are before it."""
    n, more = len(words), least_exponent - 2
    before, after, reach, back = [-1] * n, [n] * n, [0] * n, [0] * n
    left = right = end = 0  # words[left:] and words[right:] agree up to `end`, the furthest so far, and not there
    for j in range(1, n):
        x, i, popped, last = words[j], j - 1, j, 0  # last: how far the suffixes of `popped` and j agree
        while i >= 0:
            y = words[i]
            if x == y:
                match = min(last, back[popped]) or 1  # of i and j, from i and popped, popped and j: just that unless these are equal
                if j < end and (not last or back[popped] == last):
                    by = right - left
                    if j - i == by and i >= left:
                        match = max(match, end - j)
                    elif i >= right:  # both are in the second copy: the same edge was met in the first
                        a, b = i - by, j - by
                        match = max(match, min(reach[a] if after[a] == b else back[b] if before[b] == a else 1, end - j))
                to = j + match
                while to < n and words[to] == words[i + to - j]:
                    to += 1
                if to > end:
                    left, right, end = i, j, to
                match = to - j
                if to < n and not less(words[to], words[i + match]):
                    back[j] = match
                    break
                after[i], reach[i], last = j, match, match
                if match > more * (j - i):
                    yield i, j - i, match
            elif less(x, y):
                last = 0
            else:
                break
            popped, i = i, before[i]
        before[j] = i


def periodic_runs(words: Sequence, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least least_length words and least_exponent (2 or more) periods, by start, then
    period."""
    found = {}
    for less in (operator.lt, operator.gt):
        for i, period, match in lyndon_edges(words, less, least_exponent):
            end = i + period + match
            if (end, period) in found:
                continue
            start = i
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            found[end, period] = start
    out = [(start, end - start, period) for (end, period), start in found.items() if end - start >= max(least_length, least_exponent * period)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; of ties the one with the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(id_col, n_words, runs, strongest, collapsed), one row per row of docs; positions count the text's words from 0.

    No shuffle: texts are searched where they are read, one at a time, in memory that is linear in the longest. A null, empty or
    blank text has no words, no runs, a null strongest run and an empty collapsed text. Ids may be null, repeated or of any type,
    equal rows give equal results, an empty table gives an empty one, and other columns are left out whatever their names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words bigint, runs {RUNS}, strongest struct<start: bigint, length: bigint, period: bigint>, collapsed string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    keys = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, all_runs, best, texts = [], [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: by space and tab to carriage return
                runs = periodic_runs(words, least_length, least_exponent)
                top = strongest(runs)
                counts.append(len(words))
                all_runs.append([dict(zip(keys, r, strict=True)) for r in runs])
                best.append(top and dict(zip(keys, top, strict=True)))
                texts.append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
            columns = [pa.array(v, arrow.field(k).type) for k, v in (("n_words", counts), ("runs", all_runs), ("strongest", best), ("collapsed", texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


by_value(__name__)
