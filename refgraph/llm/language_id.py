"""Language identification with a bidirectional gated recurrent network over bytes.

Two GRUs read a segment of SEGMENT bytes, one forwards and one backwards; at every byte both states give the probabilities of
the languages, so every position has a label. The probabilities of all positions of a text are averaged, and the text's
language is the largest average; that average is its score. The network is trained in numpy by backpropagation through time
on labelled windows, on the driver: a bounded sample of SAMPLE rows per language, each a window of WINDOW characters from a place
that a hash picks. Predictions go through every byte of every text, segment by segment in batches of bounded size.

Nulls: a null text, and one without a letter, is `und` with score 0. Rows without a label or text are never learned from.
Without any labelled text every text is `und`. Very long texts are read whole, in pieces. Ties: of equal averages the first
language by name wins. Rows that repeat are predicted alike. An empty table gives an empty result. Other columns are kept,
whatever their names, but for lang_pred and score, which are replaced. The driver holds one row per label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

SEGMENT, HIDDEN = 64, 8
#: Bounds of the training sample.
SAMPLE, WINDOW = 256, 2000
STEPS, BATCH, RATE = 200, 256, 0.02
ROWS = 4096
UNKNOWN = "und"
#: A text whose score lies above chance by less than this part of the way to 1 is taken for none of the languages.
LEAST_EXCESS = 0.13


class Network:
    """The weights: for each direction the gates' tables by byte (x) and matrices by state (h), and the output layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.w: dict[str, np.ndarray] = {"out_b": np.zeros(len(languages), np.float32), "out": rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)}
        for d in "fb":
            for gate in "rzn":
                self.w[f"{d}x{gate}"] = rng.normal(0, 0.5, (256, HIDDEN)).astype(np.float32)
                self.w[f"{d}h{gate}"] = rng.normal(0, 0.4, (HIDDEN, HIDDEN)).astype(np.float32)
            self.w[f"{d}xz"] += 1  # starts by remembering

    def _run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, rows, HIDDEN) over x (time, rows) of bytes; in direction b from the end."""
        w = self.w
        time = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        states = np.empty((*x.shape, HIDDEN), np.float32)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for t in time:
                r, z = (1 / (1 + np.exp(-(np.take(w[f"{d}x{g}"], x[t], axis=0) + h @ w[f"{d}h{g}"]))) for g in "rz")
                inner = h @ w[f"{d}hn"]
                n = 2 / (1 + np.exp(-2 * (np.take(w[f"{d}xn"], x[t], axis=0) + r * inner))) - 1
                if keep is not None:
                    keep.append((t, h, r, z, n, inner))
                h = n + z * (h - n)
                states[t] = h
        return states

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, rows, languages) at every byte of x (time, rows)."""
        both = np.concatenate([self._run("f", x), self._run("b", x)], axis=2)
        return _softmax(both @ self.w["out"] + self.w["out_b"])

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for x (time, rows) whose positions under mask all have the language y (rows)."""
        w, kept = self.w, {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, kept[d]) for d in "fb"], axis=2)
        p = _softmax(both @ w["out"] + w["out_b"])
        scale = mask / mask.sum()
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * scale).sum())
        p[:, rows, y] -= 1
        delta = (p * scale[:, :, None]).astype(np.float32)
        flat = delta.reshape(-1, delta.shape[2])
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"], g["out_b"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        back = delta @ w["out"].T
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, r, z, n, inner in reversed(kept[d]):
                dh = dh + part[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                di = dn * r
                for gate, at_x, at_h in (("n", dn, di), ("z", dz, dz), ("r", dr, dr)):
                    np.add.at(g[f"{d}x{gate}"], x[t], at_x)
                    g[f"{d}h{gate}"] += h.T @ at_h
                dh = dh * z + di @ w[f"{d}hn"].T + dz @ w[f"{d}hz"].T + dr @ w[f"{d}hr"].T
        return loss, g


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, SEGMENT) bytes, the text of each row and its length; the last row of a text is filled up with zeros."""
    n = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
    x = np.frombuffer(b"".join(t.ljust(k * SEGMENT, b"\0") for t, k in zip(texts, n.tolist(), strict=True)), np.uint8).reshape(-1, SEGMENT)
    of = np.repeat(np.arange(len(texts)), n)
    lengths = np.full(len(x), SEGMENT)
    lengths[np.cumsum(n)[n > 0] - 1] = [len(t) - (k - 1) * SEGMENT for t, k in zip(texts, n.tolist(), strict=True) if k]
    return x, of, lengths


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 0) -> Network:
    """Adam on batches that hold each language about as often."""
    languages = sorted(set(labels))
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    if not languages:
        return net
    x, of, lengths = _segments([t.encode("utf-8", "replace") for t in texts])
    y = np.array([languages.index(v) for v in labels], np.int64)[of]
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    by = [rows for rows in by if len(rows)]
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for k in range(1, steps + 1 if by else 1):
        rows = np.concatenate([rng.choice(rows, max(1, BATCH // len(by))) for rows in by])
        at = np.ascontiguousarray(x[rows].T)
        mask = (np.arange(SEGMENT)[:, None] < lengths[rows]).astype(np.float32)
        _, g = net.step(at, y[rows], mask)
        rate = RATE * (1 - 0.9 * k / steps)
        for name, w in net.w.items():
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v[name] = 0.99 * v[name] + 0.01 * g[name] ** 2
            w -= rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)
    return net


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most 2 x sample windows per language, by a hash of the ids."""
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    lot = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col(lang_col) == k, F.lit(sample / n)) for k, n in counts.items()), F.lit(0.0))
    at = F.pmod(F.xxhash64(id_col, F.lit("place")), F.greatest(F.lit(1), F.char_length(text_col) - WINDOW)).cast("int")
    picked = usable.where(lot < share).select(F.substring(text_col, at + 1, F.lit(WINDOW)).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("order"))
    rows = sorted(picked.orderBy("order").limit(2 * sample * max(1, len(counts))).collect(), key=lambda r: (r["lang"], r["order"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def pooled(net: Network, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text, through all its bytes."""
    total = np.zeros((len(texts), max(1, len(net.languages))))
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]

    def feed(group: list[tuple[int, bytes]]) -> None:
        x, of, lengths = _segments([t for _, t in group])
        of = np.array([k for k, _ in group])[of]
        for a in range(0, len(x), ROWS):
            p = net.positions(np.ascontiguousarray(x[a : a + ROWS].T))
            p *= (np.arange(SEGMENT)[:, None] < lengths[a : a + ROWS])[:, :, None]
            np.add.at(total, of[a : a + ROWS], p.sum(axis=0))

    if net.languages:
        group, size, most = [], 0, 4 << 20
        for k, t in enumerate(raw):
            for a in range(0, len(t), most):
                group.append((k, t[a : a + most]))
                size += len(group[-1][1])
                if size >= most:
                    feed(group)
                    group, size = [], 0
        if group:
            feed(group)
    mean = total / np.maximum(1, [len(t) for t in raw])[:, None]
    best = mean.argmax(axis=1)
    known = [bool(net.languages) and any(map(str.isalpha, t)) for t in texts]
    return [net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], [float(min(1.0, m[b])) if k else 0.0 for m, b, k in zip(mean, best.tolist(), known, strict=True)]


def identify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score as last columns; columns of these names are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    left = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(left)))  # names with dots don't get through Arrow functions
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow, at = to_arrow_schema(schema), left.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = pooled(net, [t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=arrow)

    return rows.mapInArrow(run, schema).toDF(*left, "lang_pred", "score")


def least_score(languages: int, excess: float = LEAST_EXCESS) -> float:
    """The score below which a text is rejected, by the number of languages: with one none is, as every score is 1."""
    chance = 1 / max(1, languages)
    return chance + excess * (1 - chance) if languages > 1 else 0.0


def recognised(docs: DataFrame, net: Network, text_col: str = "text", excess: float = LEAST_EXCESS) -> DataFrame:
    """The rows of docs in a language of the network, without those that it rejects: `und`, or a score below least_score()."""
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(len(net.languages), excess))
    named = [f"c{k}" for k in range(len(docs.columns))]  # lang_pred and score may be columns of docs
    return identify(docs.toDF(*named), net, named[docs.columns.index(text_col)]).where(good).select(*named).toDF(*docs.columns)


def held_out(id_col: str) -> Column:
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network trained on the documents that are not held out."""
    texts, labels = training_sample(docs.where(~F.coalesce(held_out(id_col), F.lit(True))), id_col, text_col, lang_col)
    return train(texts, labels)


by_value(__name__)
