"""Token counts that follow edits.

A byte-level BPE tokenizer splits a text into pre-tokens by a pattern and encodes each apart, so a document's count is a sum over
pre-tokens. TokenTree keeps them in slots of SLOT pre-tokens (length and count of each) under a segment tree of sums. An edit
finds the pre-token before the touched region by descending the tree, splits the new text from there on until a border falls
together with an old one behind the edit, encodes only these pre-tokens, puts them in the slot, and updates the sums on the
paths to the root. One pre-token of context before the region is enough: a match looks at most two characters past its end.

Documents carry their tree as a packed column, so later edits need the text and the tree, not a new count.

Nulls: a null text is an empty one, of 0 tokens; a null edit column leaves the text as it is; places beyond the text are moved
into it. Rows that repeat are rows of their own. An empty table gives an empty result. Other columns stay; `tree`, `n_tokens`,
`n_pieces`, `n_encoded` and the edited text replace columns of their names. Texts of any length are taken whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_value

SLOT = 64
#: Counts of so many distinct pre-tokens are remembered by a task; beyond it the table starts anew.
REMEMBERED = 250_000
#: Rows handled at once.
ROWS = 512


class Counter:
    """Splits by the pattern and counts the tokens of a pre-token."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        compiled = regex.compile(pattern)
        self.find, self.pieces = compiled.finditer, compiled.findall
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def split(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        for m in self.find(text, start):
            yield m.span()


class TokenTree:
    """Sums of characters and tokens over slots of pre-tokens, as a heap: node k has the children 2k and 2k + 1."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None):
        if sizes is None:
            sizes = np.full(-(-len(lengths) // SLOT), SLOT, np.int64)
            if len(sizes):
                sizes[-1] = len(lengths) - SLOT * (len(sizes) - 1)
        ends = np.cumsum(sizes)
        self.slots = [(lengths[e - s : e], counts[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.width = 1 << (len(self.slots) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + len(self.slots)] = [int(a.sum()) for a, _ in self.slots]
        self.tokens[self.width : self.width + len(self.slots)] = [int(b.sum()) for _, b in self.slots]
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        pieces = counter.pieces(text)
        return cls(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(counter.count, pieces), np.int64, len(pieces)))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def pieces(self) -> int:
        return sum(len(a) for a, _ in self.slots)

    def locate(self, at: int) -> tuple[int, int, int]:
        """(slot, index in it, start) of the pre-token that holds character at, or the last one."""
        if at >= self.chars[1]:
            at = max(0, int(self.chars[1]) - 1)
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at - start >= self.chars[k]:
                start += int(self.chars[k])
                k += 1
        ends = np.cumsum(self.slots[k - self.width][0])
        i = min(int(np.searchsorted(ends, at - start, side="right")), max(0, len(ends) - 1))
        return k - self.width, i, start + (int(ends[i - 1]) if i else 0)

    def _set(self, slot: int, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.slots[slot] = (lengths, counts)
        k = slot + self.width
        self.chars[k], self.tokens[k] = lengths.sum(), counts.sum()
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, new: str, at: int, end: int, size: int, counter: Counter) -> int:
        """new: the text in which size characters stand for those of at to end in the old one. Returns how many pre-tokens were encoded."""
        slot, i, start = self.locate(max(0, at - 2))
        if i or slot:  # one more before it
            slot, i, start = self.locate(max(0, start - 1))
        shift = size - (end - at)
        old_slot, old_i, old = slot, i, start  # walks over the old pre-tokens: old is the start of the one at (old_slot, old_i)
        lengths: list[int] = []
        counts: list[int] = []
        done = False
        for a, b in counter.split(new, start):
            while old_slot < len(self.slots) and (old < end or old + shift < a):
                if old_i == len(self.slots[old_slot][0]):
                    old_slot, old_i = old_slot + 1, 0
                    continue
                old += int(self.slots[old_slot][0][old_i])
                old_i += 1
            if old_slot < len(self.slots) and old >= end and old + shift == a and a >= at + size:
                done = True
                break
            lengths.append(b - a)
            counts.append(counter.count(new[a:b]))
        if not done:
            old_slot, old_i = len(self.slots) - 1, len(self.slots[-1][0])
        head, tail = self.slots[slot], self.slots[old_slot]
        own = (np.concatenate([head[0][:i], lengths, tail[0][old_i:]]).astype(np.int64), np.concatenate([head[1][:i], counts, tail[1][old_i:]]).astype(np.int64))
        for k in range(slot + 1, old_slot + 1):
            self._set(k, own[0][:0], own[1][:0])
        self._set(slot, *own)
        if len(own[0]) > 16 * SLOT:  # deal the pre-tokens to slots anew
            self.__init__(np.concatenate([a for a, _ in self.slots]), np.concatenate([b for _, b in self.slots]))
        return len(lengths)

    def pack(self) -> bytes:
        sizes = np.array([len(self.slots), *(len(a) for a, _ in self.slots)], "<u4")
        rows = [np.concatenate([s[k] for s in self.slots]).astype("<u4") for k in (0, 1)]
        return sizes.tobytes() + rows[0].tobytes() + rows[1].tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> TokenTree:
        raw = np.frombuffer(data, "<u4").astype(np.int64)
        sizes, rest = raw[1 : raw[0] + 1], raw[raw[0] + 1 :]
        return cls(rest[: len(rest) // 2], rest[len(rest) // 2 :], sizes)


def vocabulary(file: str | None = None, pattern: str | None = None) -> tuple[str, dict[bytes, int]]:
    """The split pattern and the ranks of a byte-level BPE vocabulary file."""
    if file is None or pattern is None:
        import public_tokenizers

        file, pattern = file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(file, "rb") as f:
        return pattern, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _mapped(rows: DataFrame, new: list[T.StructField], each: Callable, made: Callable[[], Counter]) -> DataFrame:
    """rows and the columns new, which each(row of the batch as dict, counter) gives; columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in new]
    left = [c for c in rows.columns if c not in names]
    used = [c for c in rows.columns]
    plain = rows.toDF(*(f"c{k}" for k in range(len(used))))  # names with dots don't get through Arrow functions
    schema = T.StructType([*(plain.schema[used.index(c)] for c in left), *new])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = made()
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            out = each({c: batch.column(used.index(c)) for c in used}, counter)
            yield pa.RecordBatch.from_arrays([*(batch.column(used.index(c)) for c in left), *(pa.array(v, arrow.field(n).type) for n, v in zip(names, out, strict=True))], schema=arrow)

    return plain.mapInArrow(run, schema).toDF(*left, *names)


def _shared_counter(rows: DataFrame, file: str | None, pattern: str | None) -> Callable[[], Counter]:
    held = rows.sparkSession.sparkContext.broadcast(vocabulary(file, pattern))  # as long as the vocabulary
    return lambda: Counter(*held.value)


def with_trees(docs: DataFrame, text_col: str = "text", file: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with tree (packed), n_pieces and n_tokens."""

    def each(columns: dict, counter: Counter) -> tuple:
        trees, pieces, tokens = [], [], []
        for text in columns[text_col].to_pylist():
            tree = TokenTree.of(text or "", counter)
            trees.append(tree.pack())
            pieces.append(tree.pieces)
            tokens.append(tree.total)
        return trees, pieces, tokens

    new = [T.StructField("tree", T.BinaryType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return _mapped(docs, new, each, _shared_counter(docs, file, pattern))


def edited(docs: DataFrame, at_col: str, end_col: str, insert_col: str, text_col: str = "text", file: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs of with_trees() after one edit a row: the characters from at to end give way to the inserted ones. text_col, tree, n_pieces
    and n_tokens are the new ones; n_encoded tells how many pre-tokens were encoded."""

    def each(columns: dict, counter: Counter) -> tuple:
        out: tuple[list, ...] = ([], [], [], [], [])
        rows = zip(*(columns[c].to_pylist() for c in (text_col, "tree", at_col, end_col, insert_col)), strict=True)
        for text, data, at, end, insert in rows:
            text, tree, encoded = text or "", TokenTree.unpack(data), 0
            if at is not None and end is not None and insert is not None:
                at = min(max(0, at), len(text))
                end = min(max(at, end), len(text))
                text = text[:at] + insert + text[end:]
                encoded = tree.edit(text, at, end, len(insert), counter)
            for column, value in zip(out, (text, tree.pack(), tree.pieces, tree.total, encoded), strict=True):
                column.append(value)
        return out

    new = [T.StructField(text_col, T.StringType()), T.StructField("tree", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_pieces", "n_tokens", "n_encoded"))]
    return _mapped(docs, new, each, _shared_counter(docs, file, pattern))


by_value(__name__)
