"""Join of texts whose five-word shingle sets have a Jaccard similarity of at least 0.8, as connected classes.

Equal sets are one entity from the start, so copies never meet. For the others:

1. count: all shingles of all documents are counted in one table of hashed counters (fixed size). It only orders shingles,
   those of low counters first, and picks centres; results do not depend on it.
2. contraction: entities with an equal minimum of their rehashed shingles are held against one of them, the centre, whose
   shingles are the most frequent (of a text and its edited copies, the text itself). Those linked are one class; those that
   share half of their shingles at least are one cluster. KEYS hashes, one after the other, each entity against one centre a
   hash. So large clusters of near copies shrink to few classes before their members are listed.
3. tiles: two similar sets share a shingle among the first |set| - ceil(0.8 |set|) + 1 of each in any common order; with rare
   ones first, boilerplate is reached only by sets that are made of it. Sets that share such a shingle and lie in the same or
   the next size band form a tile (bands grow by 1.25, so similar sets are never further apart). A tile inside one cluster is
   left out, as every cluster of several classes is a group as a whole. Other tiles with the same smallest member are put
   together as one group: whatever pair has a tile has a group.
4. stars: every member is compared with one member of one of its groups. Groups that still hold several classes name another
   member in a second round.
5. blocks: in the groups that remain, all pairs of members of different classes are held against each other in blocks of
   bitmaps: bits of one set that the other lacks bound the overlap from above, and only pairs that stay possible go on.

Every comparison first bounds the overlap by bit counts and then intersects the sorted hash arrays. Classes come from
contraction of the links: by joins, or in one task while they are few. No pair inside a class is made once the class is known, nothing is capped, and
a group of any size is spread: tiles by shingle, stars by member, blocks by block pair.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer words than a shingle has make one shingle. Shingles stand as
64-bit hashes. A set is known by 64 bits of its digest, and by 64 more where two sets share these.

Nulls: a null text, or one without words, has an empty set and is linked with nothing; a null id is never the smallest of its
class unless alone. Very long texts are hashed whole, in pieces. Ties: of equal smallest ids there is one class id. Rows that
repeat have equal sets and so are linked. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, by_value, join_hot, written

SHINGLE = 5
#: Similarity 0.8 as a fraction.
NUM, DEN = 80, 100
#: Counters of the shingle table: 2 to this power, 4 bytes each.
COUNTER_BITS = 22
PARTS = 32
STAR_ROUNDS = 2
#: Hashes by which entities meet before tiles are made, and the similarity, as a fraction, that makes one cluster.
KEYS, NEAR_NUM, NEAR_DEN = 3, 1, 2
#: A key, or a group, of more than one part in so many of all entities, or members, finds its centre by broadcast.
HOT = 1024
#: Bits of a bitmap for each shingle, at least.
BITS = 12
BLOCK = 1024
#: Up to so many entities' hashes are broadcast to pick their texts (8 bytes each); more are joined by shuffle.
BROADCAST_ENTITIES = 200_000
#: Up to so many links (16 bytes each) are joined to classes by one task; more by rounds of joins.
LINKS_OF_ONE_TASK = 1_000_000
#: Documents hashed at once.
ROWS = 1024
#: Comparisons made at once, and sets that a task remembers between them.
SLICE, REMEMBERED = 256, 2048
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 18

_U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 3
_WEIGHTS = _rng.integers(1, 2**62, SHINGLE + 1, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = _rng.integers(1, 2**63, KEYS, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            row = np.full(max(n, 2 * PIECE), base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and their places."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _table(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[: len(raw)], out=run[1:])
    return mixed((run[ends] - run[starts]) * down[starts]), starts


def _long_words(data: bytes) -> np.ndarray:
    """Hashes of the words of one long text, piece by piece; pieces end after white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            while cut <= at and end < len(data):  # a word longer than a piece
                end = min(len(data), end + PIECE)
                cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            end = cut if cut > at and end < len(data) else end
        out.append(_words(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    total = words[:n] * _WEIGHTS[0]
    for k in range(1, SHINGLE):
        total = total + words[k : k + n] * _WEIGHTS[k]
    return mixed(total)


def _set(words: np.ndarray) -> np.ndarray:
    if len(words) == 0:
        return words
    if len(words) < SHINGLE:
        return mixed((words * _WEIGHTS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _WEIGHTS[SHINGLE] * _U(len(words)))
    return np.unique(_windows(words))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted shingle set of each text. Short texts are hashed together."""
    k = 0
    while k < len(texts):
        if len(texts[k]) >= PIECE:
            yield _set(_long_words(texts[k].lower()))
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and size + len(texts[end]) < PIECE:
            size += len(texts[end]) + 1
            end += 1
        hashes, starts = _words(b"\n".join(texts[k:end]).lower())
        borders = np.cumsum([0] + [len(t) + 1 for t in texts[k:end]])
        at = np.searchsorted(starts, borders)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield _set(hashes[a:b])
        k = end


def entity(shingles: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _edges(most: int) -> np.ndarray:
    """Lower ends of the size bands up to a size."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * DEN // NUM)))
    return np.array(edges, np.int64)


EDGES = _edges(1 << 40)


def band(size: int) -> int:
    return int(np.searchsorted(EDGES, size, side="right")) - 1


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order of their counters, then by hash."""
    n = len(shingles) - -(-len(shingles) * NUM // DEN) + 1
    return shingles[np.lexsort((shingles, counts))[:n]]


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A hashed bitmap of at least BITS bits per shingle, a power of 2 long."""
    bits = 1 << max(6, (BITS * max(1, len(shingles)) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(shingles & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set at a smaller length."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def possible(n_a: int, bits_a: np.ndarray, n_b: int, bits_b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """False if bit counts rule out that the sets are similar."""
    words = min(len(bits_a), len(bits_b))
    a, b = folded(bits_a, words), folded(bits_b, words)
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return similar(n_a, n_b, most, num, den)


def similar(n_a: int, n_b: int, shared: int, num: int = NUM, den: int = DEN) -> bool:
    return den * shared >= num * (n_a + n_b - shared)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTER_BITS, np.int32)
    for batch in _slices(batches):
        for s in shingle_sets(_texts(batch, 0)):
            np.add.at(counts, (s & _U(len(counts) - 1)).astype(np.int64), 1)
    for k, part in enumerate(counts.reshape(PARTS, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(part.astype(np.int64).tobytes(), 1)], pa.binary())], names=["part", "counts"])


def _add_counts(table: pa.Table) -> pa.Table:
    """The counters of a part, summed, on a scale of logarithms: thousandths of the power of 2."""
    total = sum(np.frombuffer(zstandard.decompress(c), np.int64) for c in table.column("counts").to_pylist())
    scaled = (np.log2(total + 1.0) * 1000).astype("<u2")
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zstandard.compress(scaled.tobytes(), 1)], pa.binary())})


def _sets(held, schema: pa.Schema):
    """Rows (id, of, n, ent, more, keys, rank, text packed); more: further bits of the set's digest; rank: how frequent its
    shingles are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zstandard.decompress(held.value), np.uint16)
        mask = _U(len(counts) - 1)
        for batch in _slices(batches):
            texts = _texts(batch, 1)
            ns, ents, keys, ranks = [], [], [], []
            for s in shingle_sets(texts):
                ns.append(len(s))
                ents.append(entity(s))
                keys.append([int(mixed(s ^ seed).min().view(np.int64)) for seed in _SEEDS] if len(s) else None)
                ranks.append(int(counts[(s & mask).astype(np.int64)].mean() * 16) if len(s) else 0)
            packed = [zstandard.compress(t, 1) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array([e for e, _ in ents], pa.int64()), pa.array([m for _, m in ents], pa.int64()),
                pa.array(keys, schema.field("keys").type), pa.array(ranks, pa.int32()), pa.array(packed, pa.binary()),
            ], schema=schema)

    return run


def _prefixes(held, buckets: int, schema: pa.Schema):
    """Rows (ent, cluster, text packed) to packed prefixes by bucket: shingles, entities, bands, and where an entity's cluster is
    not itself its place and its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zstandard.decompress(held.value), np.uint16)
        mask, n_buckets = _U(len(counts) - 1), _U(buckets)
        for batch in _slices(batches):
            ents, clusters = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 1))
            tokens, sizes = [], []
            for s in shingle_sets([zstandard.decompress(t) for t in batch.column(2).to_pylist()]):
                tokens.append(prefix(s, counts[(s & mask).astype(np.int64)]))
                sizes.append(band(len(s)))
            if not tokens:
                continue
            length = np.array(list(map(len, tokens)))
            token, owner, size, cluster = np.concatenate(tokens), np.repeat(ents, length), np.repeat(np.array(sizes, np.uint8), length), np.repeat(clusters, length)
            bucket = ((token >> _U(20)) % n_buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, owner, size, cluster, bucket = token[order], owner[order], size[order], cluster[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            used = [b for b in range(buckets) if ends[b + 1] > ends[b]]
            data = []
            for b in used:
                t, o, z, c = (x[ends[b] : ends[b + 1]] for x in (token, owner, size, cluster))
                at = np.flatnonzero(c != o).astype(np.uint32)
                data.append(len(t).to_bytes(4, "little") + t.tobytes() + o.tobytes() + z.tobytes() + at.tobytes() + c[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary())], schema=schema)

    return run


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    token, owner, size = np.frombuffer(data, np.uint64, n, 4), np.frombuffer(data, np.int64, n, 4 + 8 * n), np.frombuffer(data, np.uint8, n, 4 + 16 * n)
    m = (len(data) - 4 - 17 * n) // 12
    cluster = owner.copy()
    cluster[np.frombuffer(data, np.uint32, m, 4 + 17 * n)] = np.frombuffer(data, np.int64, m, 4 + 17 * n + 4 * m)
    return token, owner, size, cluster


def tiles(token: np.ndarray, owner: np.ndarray, size: np.ndarray, cluster: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, entity, low) of all tiles with a low member (of the tile's own band) and another. High members are of the next
    band. Tiles inside one cluster are left out."""
    order = np.lexsort((owner, size, token))
    token, owner, size, cluster = token[order], owner[order], size[order].astype(np.int64), (owner if cluster is None else cluster)[order]
    twice = np.zeros(len(token), bool)
    if len(token) > 1:
        same = token[1:] == token[:-1]
        twice[1:] |= same
        twice[:-1] |= same
    token, owner, size, cluster = token[twice], owner[twice], size[twice], cluster[twice]
    low = mixed(token + (size.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    high = mixed(token + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    tile = np.concatenate([low, high[size > 0]])
    member = np.concatenate([owner, owner[size > 0]])
    cluster = np.concatenate([cluster, cluster[size > 0]])
    is_low = np.concatenate([np.ones(len(low), bool), np.zeros(int((size > 0).sum()), bool)])
    order = np.lexsort((member, ~is_low, tile))
    tile, member, is_low, cluster = tile[order], member[order], is_low[order], cluster[order]
    if len(tile) == 0:
        return tile.view(np.int64), member, is_low
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    length = np.diff(np.concatenate([first, [len(tile)]]))
    several = np.minimum.reduceat(cluster, first) < np.maximum.reduceat(cluster, first)
    good = np.repeat(several & is_low[first], length)
    return tile[good].view(np.int64), member[good], is_low[good]


def _group(schema: pa.Schema):
    """Packed prefixes of a bucket to rows (grp, ent): the smallest member of a tile, and each member."""

    def run(table: pa.Table) -> pa.Table:
        tile, member, _ = tiles(*map(np.concatenate, zip(*map(_unpacked, table.column("data").to_pylist()), strict=True)))
        if not len(tile):
            return pa.table([pa.array([], pa.int64())] * 2, schema=schema)
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        least = np.repeat(np.minimum.reduceat(member, first), np.diff(np.concatenate([first, [len(tile)]])))
        order = np.lexsort((member, least))
        least, member = least[order], member[order]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (member[1:] != member[:-1])])
        return pa.table([pa.array(least[new], pa.int64()), pa.array(member[new], pa.int64())], schema=schema)

    return run


def _mark(schema: pa.Schema):
    """Rows (ent, text) to (ent, n, bits, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = list(shingle_sets([zstandard.decompress(t) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), batch.column(1)], schema=schema)

    return run


def _bound(schema: pa.Schema, num: int, den: int):
    """Rows (a, b, n_a, bits_a, n_b, bits_b): the pairs that bit counts leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, bits_a, n_b, bits_b = (c.to_pylist() for c in batch.columns)
            left = [k for k in range(len(a)) if possible(n_a[k], np.frombuffer(bits_a[k], np.uint64), n_b[k], np.frombuffer(bits_b[k], np.uint64), num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in left], pa.int64()), pa.array([b[k] for k in left], pa.int64())], schema=schema)

    return run


def _compare(schema: pa.Schema, num: int, den: int):
    """Rows (a, b, text_a, text_b): the pairs (a, b, linked) as similar as num / den, by intersection of the sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sets(ent: list[int], text: list[bytes]) -> list[np.ndarray]:
            new = {e: t for e, t in zip(ent, text, strict=True) if e not in held}
            held.update(zip(new, shingle_sets([zstandard.decompress(t) for t in new.values()]), strict=True))
            return [held[e] for e in ent]

        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                a, b, text_a, text_b = (c.to_pylist() for c in whole.slice(k, SLICE).columns)
                if len(held) > REMEMBERED:
                    held.clear()
                found = []
                for x, y, s, t in zip(a, b, sets(a, text_a), sets(b, text_b), strict=True):
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    if similar(len(s), len(t), shared, num, den):
                        found.append((x, y, similar(len(s), len(t), shared)))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.bool_())], schema=schema)

    return run


def _block(schema: pa.Schema):
    """Rows (grp, p, q, side, ent, class, n, bits) in order of (grp, p, q), at most two blocks each: the pairs of different
    classes that bit counts leave possible. side: 0 of block p, 1 of block q, 2 if they are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def pairs() -> pa.RecordBatch:
            side, ent, cls, n = (np.array([r[c] for r in held]) for c in ("side", "ent", "class", "n"))
            bits = [np.frombuffer(r["bits"], np.uint64) for r in held]
            width = min(map(len, bits))
            field = np.stack([folded(x, width) for x in bits])
            j, out_a, out_b = np.flatnonzero(side != 0), [], []
            for x in np.flatnonzero(side != 1).tolist():
                ys = j[j > x] if side[x] == 2 else j
                ys = ys[cls[ys] != cls[x]]
                mine = n[x] - np.bitwise_count(field[x] & ~field[ys]).sum(axis=1).astype(np.int64)
                theirs = n[ys] - np.bitwise_count(field[ys] & ~field[x]).sum(axis=1).astype(np.int64)
                most = np.minimum(mine, theirs)
                for y in ys[DEN * most >= NUM * (n[x] + n[ys] - most)].tolist():
                    if possible(int(n[x]), bits[x], int(n[y]), bits[y]):
                        out_a.append(max(ent[x], ent[y]))
                        out_b.append(min(ent[x], ent[y]))
            return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (at := (row["grp"], row["p"], row["q"])) != key:
                    if held:
                        yield pairs()
                    held, key = [], at
                held.append(row)
        if held:
            yield pairs()

    return run


def _united(schema: pa.Schema):
    """All links (a, b) to (node, class), class being the smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.setdefault(top, top) != top:
                top = up[top]
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], schema=schema)

    return run


def contracted(links: DataFrame, schema: pa.Schema, one_task: int = LINKS_OF_ONE_TASK) -> DataFrame:
    """Classes (node, class) of the nodes in links (a, b). Links that are few, which is checked, are united in one task.
    Otherwise nodes take their smallest neighbour, and the links between what they took are contracted again, until none is
    left. class is a node of the class, the same for all of it."""
    if links.limit(one_task + 1).count() <= one_task:
        return written(links.select("a", "b").repartition(1).mapInArrow(_united(schema), "node long, class long"), "links-classes")
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("class", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        taken = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("from"), F.least("a", "least").alias("to")), "links-taken")
        labels = labels.join(taken, labels["class"] == taken["from"], "left").select("node", F.coalesce("to", "class").alias("class"))
        labels = written(labels, "links-classes")
        moved = edges.join(taken.withColumnsRenamed({"from": "a", "to": "to_a"}), "a").join(taken.withColumnsRenamed({"from": "b", "to": "to_b"}), "b")
        edges = written(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).where("a <> b").distinct(), "links")
    return labels


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = STAR_ROUNDS, block: int = BLOCK, one_task: int = LINKS_OF_ONE_TASK) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, class, of), one per row of docs: the smallest id of the class, the class (null for an
    empty set), and a hash of the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.encode(text_col, "utf-8").alias("text"), F.xxhash64(text_col).alias("of"))

    counts = rows.select("text").mapInArrow(_count, "part int, counts binary").groupBy("part").applyInArrow(_add_counts, "part int, counts binary")
    parts = {r["part"]: zstandard.decompress(r["counts"]) for r in counts.collect()}  # 4 M counters of 2 bytes, whatever the input
    held = spark.sparkContext.broadcast(zstandard.compress(b"".join(parts[k] for k in range(PARTS)) if parts else bytes(2 << COUNTER_BITS), 1))
    del parts

    sets_schema = f"id {docs.schema[id_col].dataType.simpleString()}, of long, n long, ent long, more long, keys array<long>, rank int, text binary"
    sets = written(rows.mapInArrow(_sets(held, arrow(sets_schema)), sets_schema), "join-sets")
    clash = written(sets.groupBy("ent").agg(F.min("more").alias("x"), F.max("more").alias("y")).where("x <> y").select("ent"), "join-clashes")
    if not clash.isEmpty():  # different sets that share 64 bits
        apart = sets.join(clash.withColumn("clash", F.lit(True)), "ent", "left")
        sets = written(apart.withColumn("ent", F.when(F.col("clash"), F.xxhash64("ent", "more")).otherwise(F.col("ent"))).select(*sets.columns), "join-sets")
    known = sets.select("id", "of", "n", "ent")

    def signatures(wanted: DataFrame, name: str) -> DataFrame:
        """Rows (ent, n, bits, text) of the entities in wanted, in buckets by entity."""
        few = wanted.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
        found = sets.where("n > 0").select("ent", "text").join(F.broadcast(wanted) if few else wanted, "ent", "left_semi")
        schema = "ent long, n long, bits binary, text binary"
        found = found.mapInArrow(_mark(arrow(schema)), schema).groupBy("ent").agg(*(F.first(c).alias(c) for c in ("n", "bits", "text")))
        return bucketed(found, name, "ent")

    pair_schema, found_schema = "a long, b long", "a long, b long, linked boolean"

    def both(pairs: DataFrame, table: DataFrame, *values: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("ent").alias(side), *(F.col(v).alias(f"{v}_{side}") for v in values)), side)
        return pairs.select("a", "b", *(f"{v}_{side}" for side in ("a", "b") for v in values))

    def verified(pairs: DataFrame, marks: DataFrame, name: str, num: int = NUM, den: int = DEN) -> DataFrame:
        left = written(both(pairs, marks, "n", "bits").mapInArrow(_bound(arrow(pair_schema), num, den), pair_schema), f"{name}-possible")
        return written(both(left, marks, "text").mapInArrow(_compare(arrow(found_schema), num, den), found_schema), f"{name}-links")

    def labelled(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
        """Adds the class of column's node, itself where it has none."""
        own = labels.select(F.col("node").alias("__node"), F.col("class").alias("__class"))
        return df.join(own, df[column] == own["__node"], "left").withColumn(out, F.coalesce("__class", column)).drop("__node", "__class")

    node_schema = arrow("node long, class long")
    ents = sets.where("n > 0").groupBy("ent").agg(F.first("n").alias("n"), F.first("rank").alias("rank"), F.first("keys").alias("keys"))
    ents = written(ents, "join-entities")
    meetings, often = [], F.col("size") * HOT > F.lit(ents.count())  # fewer than HOT keys
    for k in range(KEYS):
        keyed = ents.select("ent", "n", "rank", F.col("keys")[k].alias("key"))
        named = keyed.groupBy("key").agg(F.max(F.struct("rank", F.negative("ent").alias("minus"), "ent", "n")).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
        size_fits = (NEAR_DEN * F.least("n", "m.n") >= NEAR_NUM * F.greatest("n", "m.n")) & (F.col("ent") != F.col("m.ent"))
        meetings.append(join_hot(keyed, named, ["key"], often).where(size_fits).select("ent", F.col("m.ent").alias("centre"), F.lit(k).alias("k")))
    met = written(reduce(DataFrame.union, meetings), "join-met")
    marks = signatures(met.select("ent").union(met.select("centre")).distinct(), "join-met")
    classes = spark.createDataFrame([], "node long, class long")
    links, near, tested = (spark.createDataFrame([], pair_schema) for _ in range(3))
    for k in range(KEYS):
        pairs = labelled(labelled(met.where(F.col("k") == k), classes, "ent", "own"), classes, "centre", "other").where("own <> other")
        pairs = pairs.select(F.greatest("ent", "centre").alias("a"), F.least("ent", "centre").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, f"join-met{k}")
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs)
        new = verified(pairs, marks, f"join-met{k}", NEAR_NUM, NEAR_DEN)
        links, near = links.union(new.where("linked").select("a", "b")), near.union(new.select("a", "b"))
        classes = contracted(links, node_schema, one_task)
    clusters = contracted(near, node_schema, one_task)

    prefix_schema, group_schema = "bucket int, data binary", "grp long, ent long"
    whole = sets.where("n > 0").groupBy("ent").agg(F.first("text").alias("text"))
    tokens = labelled(whole, clusters, "ent", "cluster").select("ent", "cluster", "text").mapInArrow(_prefixes(held, buckets, arrow(prefix_schema)), prefix_schema)
    members = tokens.groupBy("bucket").applyInArrow(_group(arrow(group_schema)), group_schema)
    inside = clusters.select(F.xxhash64("class").alias("grp"), F.col("node").alias("ent"))  # mixed ones stay below
    members = labelled(written(members.union(inside).distinct(), "join-groups"), classes, "ent", "class")
    left = _several(members, 0, "join-left")
    marks = signatures(left.select("ent").distinct(), "join")

    for k in range(star_rounds + 1):
        if k:
            left = _several(labelled(left.select("grp", "ent"), classes, "ent", "class"), k, f"join-left{k}")
        if left.isEmpty():
            break
        if k < star_rounds:
            pairs = left.where("ent <> m.ent and class <> m.class").select("ent", F.col("m.ent").alias("other"))
            # a member of many groups is held against one other a round, so a round makes no more pairs than there are members
            pairs = pairs.groupBy("ent").agg(F.min_by("other", F.xxhash64("other", F.lit(k)) if k else F.col("other")).alias("other"))
            pairs = pairs.select(F.greatest("ent", "other").alias("a"), F.least("ent", "other").alias("b")).distinct()
        else:
            pairs = _blocks(left, marks, block, arrow(pair_schema), pair_schema).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), f"join-pairs{k}")
        tested = tested.union(pairs)
        links = links.union(verified(pairs, marks, f"join-pairs{k}").select("a", "b"))
        classes = contracted(links, node_schema, one_task)

    least = labelled(known.where("n > 0").groupBy("ent").agg(F.min("id").alias("least")), classes, "ent", "class")
    joined = least.join(least.groupBy("class").agg(F.min("least").alias("component_id")), "class").select(F.col("ent").alias("__ent"), "component_id", "class")
    out = known.join(joined, (known["ent"] == joined["__ent"]) & (known["n"] > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "class", "of")


def _several(members: DataFrame, k: int, name: str) -> DataFrame:
    """The members (grp, ent, class) of groups with more than one class, and m, the member (ent, class) that the group names in
    round k. Rows of large groups find them by broadcast: there are fewer than HOT such groups."""
    total = members.count()
    pick = F.min_by(F.struct("ent", "class"), F.xxhash64("grp", "ent", F.lit(k)) if k else F.col("ent"))
    found = members.groupBy("grp").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("size"), pick.alias("m"))
    found = written(found.where("least <> most").select("grp", "m", "size"), f"{name}-groups")
    return written(join_hot(members, found, ["grp"], F.col("size") * HOT > total).select("grp", "ent", "class", "m"), name)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class the row of the smallest id stays (of several, one), and every row
    without words. A class of which no row has an id keeps one row."""
    classes = written(jaccard_classes(docs, id_col, text_col).toDF("id", "n", "component", "class", "of"), "join-classes")
    first = classes.where("n > 0").where(F.col("id").eqNullSafe(F.col("component"))).groupBy("class").agg(F.min("of").alias("kept_of"), F.first("id").alias("kept_id"))
    kept = first.select("kept_id", "kept_of", F.lit(False).alias("empty")).union(classes.where("n = 0").select("id", "of", F.lit(True)).distinct())
    kept = written(kept, "join-kept")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    marked = marked.withColumns({"id": F.col("doc").getField(id_col), "of": F.xxhash64(F.col("doc").getField(text_col))})
    out = marked.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("of") == F.col("kept_of")))
    if not classes.groupBy("id", "of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.where("not empty").dropDuplicates(["id", "of"]).union(out.where("empty"))
    return out.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def _blocks(left: DataFrame, marks: DataFrame, block: int, schema: pa.Schema, ddl: str) -> DataFrame:
    """The possible pairs of different classes in groups, by pairs of blocks of a group; a block meets itself once."""
    sizes = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = join_hot(left.select("grp", "ent", "class"), sizes, ["grp"], F.col("blocks") * (block * HOT) > F.lit(left.count())).withColumn("own", F.pmod(F.xxhash64("ent"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("grp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.cast("int").alias("side"), "ent", "class")
    held = dealt.join(marks.select("ent", "n", "bits"), "ent").repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q")
    return held.mapInArrow(_block(schema), ddl)


by_value(__name__)
