"""Conversation structure repair: the cheapest edits that turn a conversation's rows into an alternation of user and assistant,
after a system row at most.

The grammar of role initials, (s?(ua)+)?, is an automaton of four states. A recursive query of DuckDB walks it, inside batches
that Spark deals out by hash: each step takes one turn of all conversations of a batch, and keeps the least cost, and of equal
costs the least audit, of each state. A conversation is walked in pieces of FAN turns, from every state a piece may start in, so
that the pieces of a long one are walked by many tasks; then pieces are walked as turns were, FAN at a time, until one is left.
That is exact: of two audits with equal costs and states none is the beginning of the other, so what follows never changes their
order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refgraph.operators.reference import placed

from .common import by_value, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # what edits cost, and a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, by role initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an end in a state still costs, and its edits.
ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
LEGAL = ("su", "ua", "au")

#: Turns of a piece, and pieces of the next level's; rows that a query of DuckDB takes at once.
FAN, ROWS = 256, 32_768
MOVES = "array<struct<entry: int, state: int, cost: bigint, audit: string>>"

#: Each step's moves join what the step before has reached; a key of (piece, entry, state) holds its latest row alone.
WALK = """
with recursive walk(piece, entry, state, pos, cost, audit) using key (piece, entry, state) as (
  select piece, entry, entry, 0, 0::bigint, '' from lengths, (values (0), (1), (2), (3)) s(entry)
  union
  select piece, entry, state, pos, best.cost, best.audit from (
    select w.piece, w.entry, m.state, w.pos + 1 as pos, min({'cost': w.cost + m.cost, 'audit': w.audit || m.audit}) as best
    from walk w join moves m on m.piece = w.piece and m.pos = w.pos + 1 and m.entry = w.state group by all))
select piece, list({'entry': entry, 'state': state, 'cost': cost, 'audit': audit} order by entry, state) as moves
from walk join lengths using (piece) where pos = n group by piece order by piece"""


def moves(initial: str, fault: str | None) -> list[tuple[int, int, int, str]]:
    """(entry, state, cost, audit): the best ways from state to state over one row, with rows inserted before it."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for entry, inserted in product(range(4), ("", "u", "a", "ua", "au")):
        state = entry
        for x in inserted:
            state = NEXT.get((state, x))
        if state is None:
            continue
        ways = [(state, DELETE, "D")]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED * (fault == "truncated")
            ways += [(NEXT.get((state, initial)), KEEP + more, "K"), *((NEXT.get((state, x)), REROLE + more, "R") for x in "ua")]
        for to, cost, letter in ways:
            if to is not None:
                way = (cost + INSERT * len(inserted), "I" * len(inserted) + letter)
                out[entry, to] = min(way, out.get((entry, to), way))
    return [(entry, to, *way) for (entry, to), way in sorted(out.items())]


FAULTS = (None, "blank", "duplicate", "truncated")
#: A row's class is the place of its fault in FAULTS times 4, plus that of its initial in INITIALS; other initials are the last.
INITIALS = "sua?"


def _walk(arrow: pa.Schema):
    """Items of pieces, sorted by piece and numbered from 1 in it, to one row a piece. The last column has an item's class, or its
    moves. Pieces are taken together up to ROWS items; a piece has FAN at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import numpy as np

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        static = [(k * 4 + i, *m) for k, fault in enumerate(FAULTS) for i, x in enumerate(INITIALS) for m in moves(x, fault)]
        con.register("static", pa.table(dict(zip(("class", "entry", "state", "cost", "audit"), map(list, zip(*static, strict=True)), strict=True))))

        def walked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            at = table.column("at").to_numpy()
            first = np.flatnonzero(at == 1)
            piece = np.cumsum(at == 1) - 1
            con.register("lengths", pa.table({"piece": np.arange(len(first)), "n": np.diff(np.append(first, len(at)))}))
            items = pa.table({"piece": piece, "pos": at, "item": table.column("item")})
            con.register("items", items)
            if pa.types.is_list(items.schema.field("item").type):
                con.execute("create or replace temp table moves as select piece, pos, m.entry, m.state, m.cost, m.audit from (select piece, pos, unnest(item) as m from items)")
            else:
                con.execute("create or replace temp table moves as select piece, pos, s.entry, s.state, s.cost, s.audit from items join static s on s.class = item")
            found = pa.table(con.execute(WALK).to_arrow_table())
            kept = table.take(first)
            out = pa.table({"id": kept.column("id"), "n": kept.column("n"), "seg": kept.column("seg"), "moves": found.column("moves")})
            yield from out.cast(arrow).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(table.column("at").to_numpy() == 1)[-1])
            if last:
                yield from walked(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from walked(pa.Table.from_batches(held))

    return run


def _level(items: DataFrame) -> DataFrame:
    """(id, n, seg, at, item) to (id, n, seg, moves), a row for each id and seg."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"id {items.schema['id'].dataType.simpleString()}, n bigint, seg bigint, moves {MOVES}"
    arrow = to_arrow_schema(items.sparkSession.createDataFrame([], schema).schema)
    dealt = items.repartition(F.struct("id"), F.col("seg")).sortWithinPartitions("id", "seg", "at")
    return dealt.mapInArrow(_walk(arrow), schema)


def cheapest(items: DataFrame, longest: int) -> DataFrame:
    """(id, cost, audit) from items (id, n, pos, class): rows numbered from 1 in their conversation of n, `longest` at most."""
    cut = lambda c: (F.floor((c - 1) / FAN).cast("long").alias("seg"), ((c - 1) % FAN + 1).cast("long").alias("at"))
    open_, size, whole = items.select("id", "n", *cut(F.col("pos")), F.col("class").alias("item")), FAN, []
    while True:
        pieces = _level(open_)
        if size >= longest:
            whole.append(pieces)
            break
        pieces = written(pieces, "repair-pieces")
        whole.append(pieces.where(F.col("n") <= size))
        open_ = pieces.where(F.col("n") > size).select("id", "n", *cut(F.col("seg") + 1), F.col("moves").alias("item"))
        size *= FAN
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)

    def ended(m: Column) -> Column:
        cost, audit = F.lit(None).cast("long"), F.lit(None).cast("string")
        for state, (more, letters) in ENDS.items():
            cost, audit = F.when(m["state"] == state, m["cost"] + more).otherwise(cost), F.when(m["state"] == state, F.concat(m["audit"], F.lit(letters))).otherwise(audit)
        return F.struct(cost.alias("cost"), audit.alias("audit"))

    best = F.array_min(F.transform(F.filter("moves", lambda m: m["entry"] == START), ended))
    return found.select("id", best.alias("best")).select("id", "best.cost", "best.audit")


@dataclass
class Repair:
    #: (id, n, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has rows.
    summary: DataFrame
    #: (id, pos, role, text): the rows that were looked at, numbered from 1 in their conversation.
    rows: DataFrame


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Faults and cheapest edits of each conversation.

    Rows are numbered over ranges of the whole order, faults found by joins on those numbers, and pieces walked by hash, so no
    conversation has to fit into a task; its audit, a letter a row, is one string. Rows are in the order of turn (nulls first), role,
    text. Null roles and texts count as one space, an empty role has no initial and fits nowhere; a null conversation is one,
    repeated rows are duplicates, an empty table gives none, and other columns are left out whatever their names."""
    one = rows.select(rows[f"`{conv_col}`"].alias("id"), rows[f"`{turn_col}`"].alias("turn"), F.coalesce(rows[f"`{role_col}`"], F.lit(" ")).alias("role"), F.coalesce(rows[f"`{text_col}`"], F.lit(" ")).alias("text"))
    order = written(placed(one, [F.asc_nulls_first("id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]), "repair-order")
    starts = order.groupBy(F.struct("id").alias("key")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    starts = written(starts, "repair-starts")
    firsts = order.groupBy(F.struct("id").alias("key"), "role", "text").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    ended = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(ended == "", "blank").when(F.col("new").isNull(), "duplicate").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    flagged = order.join(firsts, "place", "left").withColumns({"key": F.struct("id"), "initial": initial, "fault": fault})
    numbered = flagged.join(starts.select("key", "first", "n"), "key").withColumn("pos", F.col("place") - F.col("first") + 1)
    numbered = written(numbered.select("id", "place", "pos", "n", "role", "text", "initial", "fault"), "repair-rows")

    before = numbered.select((F.col("place") + 1).alias("place"), F.col("initial").alias("was"))
    pairs = numbered.where("pos > 1").select("id", "place", "initial").join(before, "place").where(~F.concat("was", "initial").isin(*LEGAL))
    illegal = pairs.groupBy(F.struct("id").alias("key")).agg(F.count(F.lit(1)).alias("illegal"))
    faults = numbered.groupBy(F.struct("id").alias("key")).agg(*(F.count_if(F.col("fault") == x).alias(x) for x in FAULTS[1:]))

    code = F.lit(0)
    for k, x in enumerate(FAULTS[1:], 1):
        code = F.when(F.col("fault") == x, 4 * k).otherwise(code)
    at = F.lit(3)
    for k, x in enumerate(INITIALS[:3]):
        at = F.when(F.col("initial") == x, k).otherwise(at)
    longest = starts.agg(F.max("n")).first()[0] or 0
    found = cheapest(numbered.select("id", "n", "pos", (code + at).alias("class")), longest).select(F.struct("id").alias("key"), "cost", "audit")
    summary = starts.join(faults, "key").join(found, "key").join(illegal, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return Repair(summary.select("key.id", "n", zero("gaps"), "blank", "duplicate", "truncated", zero("illegal"), "cost", "audit"), numbered.select("id", "pos", "role", "text"))


def _edited(pairs: Iterator[tuple], done) -> Iterator[tuple[object, str, str, str]]:
    """(id, edit, role, text) of what is left, from (id, pos, role, text) sorted by both; at pos 0, text is the audit. done(id) is
    called when a conversation ends."""
    audit, at, made, shift, now, open_ = "", 0, 0, 0, None, False

    def added(edit: str, role: str | None, text: str) -> tuple:
        nonlocal made, shift
        shift = shift or int(made == 0 and edit == "K" and role[:1] == "s")
        made += 1
        return now, edit, ("user", "assistant")[(made - 1 - shift) % 2] if edit != "K" else role, text

    for id_, pos, role, text in pairs:
        if pos == 0:
            if open_:
                yield from (added("I", None, "") for _ in audit[at:])
                done(now)
            audit, at, made, shift, now, open_ = text, 0, 0, 0, id_, True
            continue
        while audit[at] == "I":
            yield added("I", None, "")
            at += 1
        edit, at = audit[at], at + 1
        if edit != "D":
            yield added(edit, role, text)
    if open_:
        yield from (added("I", None, "") for _ in audit[at:])
        done(now)


def digests(found: Repair) -> DataFrame:
    """(id, repaired_sha256): of each conversation's repaired rows, role:text, joined by newlines. Rows pass in order through the
    task of their conversation, which holds one of them and the hash: the digest of one string can't be made in parts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"id {found.rows.schema['id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = to_arrow_schema(found.rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, state = [], [], [hashlib.sha256(), False]

        def done(id_) -> None:
            ids.append(id_)
            out.append(state[0].hexdigest())
            state[:] = hashlib.sha256(), False

        def pairs():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(ids, arrow.field(0).type), pa.array(out, pa.string())], schema=arrow)
            ids.clear(), out.clear()
            return made

        for _, _, role, text in _edited(pairs(), done):
            state[0].update(("\n" * state[1] + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            state[1] = True
            if len(ids) >= 10_000:
                yield flush()
        if ids:
            yield flush()

    return _streamed(found).mapInArrow(run, schema)


def repaired(found: Repair) -> DataFrame:
    """(id, step, edit, role, text): the rows of each conversation after its edits, numbered from 1; K kept, R given another role,
    I inserted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"id {found.rows.schema['id'].dataType.simpleString()}, step bigint, edit string, role string, text string"
    arrow = to_arrow_schema(found.rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, step, chars = [], 0, 0

        def done(_) -> None:
            nonlocal step
            step = 0

        def pairs():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

        for id_, edit, role, text in _edited(pairs(), done):
            step, chars = step + 1, chars + len(text)
            made.append((id_, step, edit, role, text))
            if len(made) >= 10_000 or chars >= 1 << 22:
                yield flush()
                made, chars = [], 0
        if made:
            yield flush()

    return _streamed(found).mapInArrow(run, schema)


def _streamed(found: Repair) -> DataFrame:
    """The rows of each conversation in order, its audit before them."""
    audits = found.summary.select("id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    return audits.unionByName(found.rows).repartition(F.struct("id")).sortWithinPartitions("id", "pos")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as a fault-injecting test wants them, by crc32 of `conversation:turn` (a null is one space) modulo 20: 0 is left out, 1
    loses its text, 2 its full stops, exclamation and question marks, 3 comes twice, 4 is the user's."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name(conv_col), F.lit(":"), name(turn_col)), "utf-8")) % 20
    got = rows.select(rows[f"`{conv_col}`"].alias("conv_id"), rows[f"`{turn_col}`"].alias("turn"), name(role_col).alias("role"), name(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return got.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


by_value(__name__)
