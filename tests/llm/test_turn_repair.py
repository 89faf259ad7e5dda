import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from refgraph.llm import turn_repair
from refgraph.llm.queries import op11_turn_repair
from refgraph.llm.turn_repair import damaged, digests, repair, repaired

GRAMMAR = re.compile("(s?(ua)+)?")
INITIALS = {"user": "u", "assistant": "a"}


def faults(rows):
    """[(role, text, fault)]"""
    seen, out = set(), []
    for role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def ways(role, text, fault):
    yield 2, "D", None
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        yield more, "K", (role, text)
        yield 1 + more, "R", ("user", text)
        yield 1 + more, "R", ("assistant", text)


SLOTS = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]


def brute(rows):
    """(cost, audit, kept rows) by trying everything."""
    best = None
    for slots in product(SLOTS, repeat=len(rows) + 1):
        base = 5 * sum(map(len, slots))
        if best and base > best[0]:
            continue
        for chosen in product(*(list(ways(*r)) for r in rows)):
            cost, audit, kept = base, "", []
            for k, inserted in enumerate(slots):
                kept += [(r, "") for r in inserted]
                audit += "I" * len(inserted)
                if k < len(rows):
                    cost += chosen[k][0]
                    audit += chosen[k][1]
                    kept += [chosen[k][2]] if chosen[k][2] else []
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(r[:1] for r, _ in kept)) and all(r for r, _ in kept):
                best = (cost, audit, kept)
    return best


def plain(rows):
    """The same by one pass over all states of a conversation, whole histories kept."""
    reach = {"": (0, "", [])}  # by the initials so far, cut to what matters
    cut = lambda s: "" if s == "" else "s" if s == "s" else s[-1]
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(to, state, cost, audit, kept):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, kept)

    def insertions(at):
        for _ in range(2):
            for s, (cost, audit, kept) in list(at.items()):
                for r in ("user", "assistant"):
                    if r[0] in allowed[s]:
                        put(at, cut(s + r[0]), cost + 5, audit + "I", [*kept, (r, "")])
        return at

    for row in rows:
        to = {}
        for s, (cost, audit, kept) in insertions(reach).items():
            for more, letter, left in ways(*row):
                if left is None:
                    put(to, s, cost + more, audit + letter, kept)
                elif left[0][:1] and left[0][:1] in allowed[s]:
                    put(to, cut(s + left[0][0]), cost + more, audit + letter, [*kept, left])
        reach = to
    return min((v for s, v in insertions(reach).items() if s in ("", "a")), key=lambda v: v[:2])


def expected(rows):
    """rows: (turn, role, text) of a conversation, in order."""
    marked = faults([(r, t) for _, r, t in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, kept = plain(marked)
    count = lambda f: sum(x[2] == f for x in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), kept


def conversations(seed, sizes):
    r, out = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.5 else ("user", "assistant")[turn % 2]
            out.append((conv, turn + r.randrange(2) if r.random() < 0.9 else None, role, r.choice(["One.", "Two!", "half", " ", "", None, "Three? \n", f"Text {turn}."])))
    return out


def ordered(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in by.items()}


def test_plain_equals_trying_everything():
    r = random.Random(5)
    for _ in range(150):
        rows = faults([(r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["A.", "b", "C.", ""])) for _ in range(r.randrange(3))])
        assert plain(rows) == brute(rows)
    for rows in ([("system", "A."), ("user", "B."), ("system", "C.")], [("assistant", "a"), ("user", "B."), ("user", "c")]):
        assert plain(faults(rows)) == brute(faults(rows))


@pytest.mark.parametrize(("fan", "held"), [(256, 32_768), (2, 5)])
def test_repair(spark, monkeypatch, fan, held):
    monkeypatch.setattr(turn_repair, "FAN", fan)
    monkeypatch.setattr(turn_repair, "ROWS", held)
    rows = conversations(fan, [1, 2, 3, 4, 5, 8, 13, 21, 30, 2, 6, 7])
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (99, None, None, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, place string, n string, `a.b` string")
    found = repair(df)
    got = {r["id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in found.summary.collect()}
    sha = {r["id"]: r["repaired_sha256"] for r in digests(found).collect()}
    want = {c: expected(v) for c, v in ordered(rows).items()}
    assert {c: (*v, sha[c]) for c, v in got.items()} == {c: v[0] for c, v in want.items()}
    made = {}
    for r in sorted(repaired(found).collect(), key=lambda r: r["step"]):
        made.setdefault(r["id"], []).append((r["role"], r["text"]))
    assert made == {c: v[1] for c, v in want.items() if v[1]}


def test_empty_and_names(spark):
    df = spark.createDataFrame([], "c string, k int, who string, said string")
    found = repair(df, "c", "k", "who", "said")
    assert found.summary.count() == digests(found).count() == repaired(found).count() == 0
    odd = spark.createDataFrame([("x", 1, "user", "A."), ("x", 2, "assistant", "B. " * 200_000)], "`c.d` string, `k.l` int, who string, said string")
    assert [(r["id"], r["cost"], r["audit"]) for r in repair(odd, "c.d", "k.l", "who", "said").summary.collect()] == [("x", 0, "KK")]


def test_query(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kept = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: expected(v)[0] for c, v in ordered(kept).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = op11_turn_repair(spark, data)
    assert dict(got.dtypes) == dict.fromkeys(columns[:6], "bigint") | {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"}
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in got.collect()} == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert len({v[6] for v in want.values()}) > 5


def test_damage_of_nulls(spark):
    kind = lambda c: zlib.crc32(f"{' ' if c is None else c}: ".encode()) % 20
    some = next(c for c in range(100) if kind(c) > 4)
    df = spark.createDataFrame([(None, None, None, None), (some, None, None, "a.")], "conv_id long, turn long, role string, text string")
    want = {0: [], 1: [(None, None, " ", "")], 2: [(None, None, " ", " ")], 3: [(None, None, " ", " ")] * 2, 4: [(None, None, "user", " ")]}
    got = [tuple(r) for r in damaged(df).collect()]
    assert sorted(got, key=repr) == sorted([*want.get(kind(None), [(None, None, " ", " ")]), (some, None, " ", "a.")], key=repr)
