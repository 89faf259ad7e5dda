"""BPE encoding and decoding through a table of distinct words.

Tokenizers of this kind lower-case and split a text into pre-tokens ("words" here) that are encoded apart from each other, so
each distinct word needs encoding once. Three steps, each a written table or one shuffle:

1. split: tasks part their texts into chunks of about CHUNK_CHARS. A chunk keeps its sequence of word numbers (the body) and
   deals its distinct words to buckets by hash. A number is position in the bucket times buckets plus bucket, with frequent
   words first, so the sequence packs well.
2. encode: the lists of one bucket, of all chunks, meet in one task, which encodes each distinct word when it first comes and
   sends every chunk the ids of its words. A word has one row per chunk at most, however frequent it is.
3. join: body and ids of a chunk meet again, and ids are put in place by position. For decoding, the ids of every distinct word
   are joined with the table (id, piece), which is sent to all tasks: it is as long as the vocabulary, and LARGEST_VOCABULARY
   at most. The pieces of a document are joined by one space, for a tokenizer file without a decoder.

Memory: a chunk (one text at least), packed, WORDS words of it spelled out, and REMEMBERED_CHARS of the distinct words of a
bucket; there are as many buckets as shuffle partitions.

Nulls: a null text is an empty one, without ids and decoded as an empty text; a null id is kept. Rows that repeat are rows of
their own. An empty table gives an empty result. Other columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, written

CHUNK_CHARS = 8_000_000
#: Characters of the distinct words that a task of step 2 remembers.
REMEMBERED_CHARS = 2_000_000
#: Documents split, and words put in place, at once.
ROWS, WORDS = 256, 1 << 17
#: Pieces that may be broadcast, some 10 bytes each.
LARGEST_VOCABULARY = 1 << 20
#: Of compression.
LEVEL = 9


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Beyond the Latin letters and common punctuation.
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]").search


class Splitter:
    """A text's pre-tokens, by the normalizer and pattern in a tokenizer file: NFC, lower case by character, white space dropped."""

    def __init__(self, spec: dict):
        import regex

        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("this tokenizer file splits texts in another way")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.pattern = split["pattern"]["Regex"]
        self.exact = None
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile(f"({'|'.join(special)})") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special and "<|" in text and len(parts := self.special.split(text)) > 1:
            out: list[str] = []
            for k, part in enumerate(parts):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _library(self, text: str) -> list[str]:
        """For scripts whose character classes may differ between libraries."""
        if self.exact is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self.exact = (normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True))
        lower, split = self.exact
        return [word for word, _ in split.pre_tokenize_str(lower.normalize_str(text))]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _OTHER(text):
                return self._library(text)
            text = unicodedata.normalize("NFC", text)
        return self.words(text.lower())


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


#: Numbers below ONE are packed in one byte, the next 63 * 256 in two, all others in five.
ONE, TWO = 192, 192 + 63 * 256


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as three streams: first bytes, second bytes of the middle ones, and the large ones."""
    n = numbers.astype("<u4")
    middle, large = (n >= ONE) & (n < TWO), n >= TWO
    head = np.where(large, 255, np.where(middle, ONE + ((n - ONE) >> 8), n)).astype(np.uint8)
    streams = [zstandard.compress(x.tobytes(), LEVEL) for x in (head, ((n[middle] - ONE) & 255).astype(np.uint8), n[large])]
    return struct.pack("<2I", *map(len, streams[:2])) + b"".join(streams)


def _unpack(data: bytes) -> np.ndarray:
    a, b = struct.unpack_from("<2I", data)
    head, second, large = (zstandard.decompress(x) for x in (data[8 : 8 + a], data[8 + a : 8 + a + b], data[8 + a + b :]))
    n = np.frombuffer(head, np.uint8).astype(np.uint32)
    middle, wide = (n >= ONE) & (n < 255), n == 255
    n[middle] = ((n[middle] - ONE) << 8) + ONE + np.frombuffer(second, np.uint8)
    n[wide] = np.frombuffer(large, "<u4")
    return n


def _pack_ids(ids: np.ndarray) -> bytes:
    """As two streams: the lower halves, then the upper ones, which are 0 for all but large vocabularies."""
    low, high = (zstandard.compress(x.tobytes(), LEVEL) for x in (ids.astype("<u2"), (ids >> 16).astype("<u2")))
    return struct.pack("<I", len(low)) + low + high


def _unpack_ids(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    low, high = (np.frombuffer(zstandard.decompress(x), "<u2").astype(np.int32) for x in (data[4 : 4 + n], data[4 + n :]))
    return low | (high << 16)


def _pack_lines(lines: list[str]) -> bytes:
    return zstandard.compress("\n".join(lines).encode("utf-8", "surrogatepass"), LEVEL)


def _unpack_lines(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass").split("\n")


def _split(spec: str, buckets: int, schema: pa.Schema, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter, task, made = Splitter(json.loads(spec)), TaskContext.get().partitionId(), 0
        numbers, ids, counts, body, chars = _Numbers(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = list(numbers)
            sequence = np.concatenate(body) if body else np.zeros(0, np.uint32)
            often = np.argsort(-np.bincount(sequence, minlength=len(words)), kind="stable")
            lists: list[list[str]] = [[] for _ in range(buckets)]
            new = np.zeros(len(words), np.uint32)
            for k in often.tolist():
                b = zlib.crc32(words[k].encode("utf-8", "surrogatepass")) % buckets
                new[k] = len(lists[b]) * buckets + b
                lists[b].append(words[k])
            used = [b for b in range(buckets) if lists[b]]
            chunk, n = f"{task}-{made}", len(used)
            return pa.RecordBatch.from_arrays([
                pa.array([chunk] * (n + 1), pa.string()), pa.array([-1, *used], pa.int32()),
                pa.array([_pack(new[sequence]), *(_pack_lines(lists[b]) for b in used)], pa.binary()),
                pa.array([ids] + [None] * n, schema.field("ids").type), pa.array([counts] + [None] * n, pa.list_(pa.int32())),
            ], schema=schema)

        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = splitter(text or "")
                    ids.append(key)
                    counts.append(len(found))
                    body.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    chars += len(text or "") + 50
                    if chars >= chunk_chars:
                        yield flush()
                        made += 1
                        numbers, ids, counts, body, chars = _Numbers(), [], [], [], 0
        if ids:
            yield flush()

    return run


def _encode(spec: str, remembered: int):
    """Lists of words to lists of their ids: lengths, then ids. A bucket's words are all remembered while they have at most
    `remembered` characters together; where they have more, a word may be encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer, normalizers

        tokenizer, known, chars = Tokenizer.from_str(spec), {}, 0
        tokenizer.normalizer = normalizers.Sequence([])  # words are normalized as parts of their texts
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                words = _unpack_lines(data)
                if chars > remembered:
                    known, chars = {}, 0
                new = [w for w in words if w not in known]
                for k in range(0, len(new), 500):
                    part = new[k : k + 500]
                    for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                        chars += len(w)
                found = [known[w] for w in words]
                lengths = np.fromiter(map(len, found), np.uint32, len(found)) >> 2
                out.append(struct.pack("<I", len(head := _pack(lengths))) + head + _pack_ids(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), batch.column(3), batch.column(4)], schema=batch.schema)

    return run


class Pieces:
    """The table (id, piece) with its pieces as bytes, each followed by one space."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted(rows)
        spelled = [piece.encode("utf-8", "surrogatepass") + b" " for _, piece in rows]
        self.ids = np.array([n for n, _ in rows], np.int64)
        self.ends = np.cumsum([len(p) for p in spelled], dtype=np.int64)
        self.lengths = np.array([len(p) for p in spelled], np.int64)
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The join of ids with the table: the row of each."""
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (at.max() >= len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("an id has no piece")
        return at

    def joined(self, rows: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of rows that end at `ends`: their pieces, one space between two."""
        lengths = self.lengths[rows]
        lengths[ends[np.diff(ends, prepend=0) > 0] - 1] -= 1
        to = np.cumsum(lengths)
        size = int(to[-1]) if len(to) else 0
        take = np.arange(size) + np.repeat((self.ends - self.lengths)[rows] - (to - lengths), lengths)
        offsets = np.concatenate([[0], np.concatenate([[0], to])[ends]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(self.data[take]))


def _join(held, buckets: int, schema: pa.Schema):
    """Body and ids of a chunk to its documents."""

    def run(table: pa.Table) -> pa.Table:
        pieces: Pieces = held.value
        bucket, data = table.column("bucket").to_pylist(), table.column("data").to_pylist()
        at = bucket.index(-1)
        sequence, counts = _unpack(data[at]), np.array(table.column("counts")[at].as_py(), np.int64)
        size = int(sequence.max()) + 1 if len(sequence) else 0
        lengths, starts, flat, total = np.zeros(size, np.int32), np.zeros(size, np.int64), [], 0
        for b, d in zip(bucket, data, strict=True):
            if b < 0:
                continue
            (head,) = struct.unpack_from("<I", d)
            own = _unpack(d[4 : 4 + head]).astype(np.int32)
            flat.append(_unpack_ids(d[4 + head :]))
            n = np.arange(len(own)) * buckets + b
            lengths[n], starts[n] = own, total + np.cumsum(own) - own
            total += len(flat[-1])
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        rows = pieces.rows(ids).astype(np.int32)  # of distinct words, once each
        borders = np.concatenate([[0], np.cumsum(counts)])
        docs, out, first = table.column("ids")[at].values, [], 0
        while first < len(counts):  # some documents at a time
            last = max(first + 1, int(np.searchsorted(borders, borders[first] + WORDS, side="right")) - 1)
            part = sequence[borders[first] : borders[last]]
            length = lengths[part].astype(np.int64)
            ends = np.cumsum(length)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[part] - (ends - length), length)
            of_docs = np.concatenate([[0], ends])[borders[first + 1 : last + 1] - borders[first]]
            if len(take) >= 2**31:
                raise ValueError("a document has too many tokens for one Arrow list")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], of_docs]), pa.int32()), pa.array(ids[take]))
            texts = pieces.joined(rows[take], of_docs).cast(schema.field("decoded").type)
            out.append(pa.RecordBatch.from_arrays([docs.slice(first, last - first), lists, texts], schema=schema))
            first = last
        return pa.Table.from_batches(out, schema=schema)

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, chunk_chars: int = CHUNK_CHARS, remembered: int = REMEMBERED_CHARS) -> DataFrame:
    """Rows (id_col, ids array<int>, decoded string), one per row of docs."""
    spark = docs.sparkSession
    with open(file or tokenizer_file(), encoding="utf-8") as f:
        spec = f.read()
    parsed = json.loads(spec)
    if parsed.get("decoder"):
        raise ValueError("this tokenizer file has a decoder of its own")
    vocabulary = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    if len(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError("this vocabulary is too long to be sent to every task")
    pieces = spark.sparkContext.broadcast(Pieces([(n, piece) for piece, n in vocabulary.items()]))

    from pyspark.sql.pandas.types import to_arrow_schema

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = docs.schema[id_col].dataType.simpleString()
    split_schema = f"chunk string, bucket int, data binary, ids array<{id_type}>, counts array<int>"
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    lists = docs.select(id_col, text_col).mapInArrow(_split(spec, buckets, arrow(split_schema), chunk_chars), split_schema)
    lists = written(lists, "bpe-words")
    encoded = lists.where("bucket >= 0").repartition(buckets, "bucket").mapInArrow(_encode(spec, remembered), split_schema)
    out = f"id {id_type}, ids array<int>, decoded string"
    joined = encoded.unionByName(lists.where("bucket < 0")).groupBy("chunk").applyInArrow(_join(pieces, buckets, arrow(out)), out)
    return joined.select(F.col("id").alias(id_col), "ids", "decoded")


by_value(__name__)
