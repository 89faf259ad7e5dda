"""Scanning texts for secrets: three fixed patterns, and a battery of randomness tests over long tokens.

Base spans come from the patterns, leftmost and without overlap per kind. On top of them, long tokens of letters and digits
that no base span touches are candidates. The smallest alphabet that a candidate fits (hex, base 32, base 36, base 64) is its
encoding. Under the null hypothesis that it is written language three tests are made: the chi-squared distance of its
characters from an even spread over the alphabet (language repeats few letters; random tokens stay near even), the runs of one
character class (language stays in a class), and the serial correlation of neighbouring code points (which random tokens do
not have; more than SERIAL_Z deviations rule a candidate out, whatever the other two say). The deviations shrink with length, so a longer token needs
less per character. The summed z-scores give a p-value, and the Benjamini-Hochberg rule over all candidates of a length
class, run on a histogram of p-values, bounds the share of false discoveries by RATE.

Spans are (kind, start, end) in code points, end exclusive. Nulls: a null text is an empty one. Very long texts are scanned
whole; time grows about with the number of spans to the power 1.5. Ties: spans of one start stand by kind. Rows that repeat are
rows of their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

# The base patterns, their kinds in order, and what a match needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Candidates: tokens of so many characters with letters and digits, that stand alone.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
RATE = 0.01
#: Of written language: how often two characters are equal, and three; how often the character class changes.
REPEAT, REPEAT_3, CHANGE = 0.066, 0.0059, 0.1
SERIAL_Z = 4.0
#: Spans gathered at once.
CHUNK = 64


def _spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, match>>: the pieces between matches give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) == 0, F.array().cast("array<struct<start:int,end:int,match:string>>")).otherwise(_placed(found, F.split(text, pattern, -1)))


def _chunks(items: Column) -> Column:
    """items in runs of CHUNK: what is gathered run by run is not copied as a whole at every item."""
    return let(items, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, CHUNK)))


def _placed(found: Column, pieces: Column) -> Column:
    """The places of matches, of which there is one at least: first where each chunk begins, then inside the chunks."""
    pairs = F.transform(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("match")), lambda p: F.struct(F.char_length(p["piece"]).alias("gap"), F.char_length(p["match"]).alias("size"), p["match"].alias("match"))
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + p["gap"] + p["size"])
    starts = lambda chunks: F.aggregate(chunks, first, lambda acc, chunk: F.struct((acc["at"] + length(chunk)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def inside(chunk: Column, at: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            end = begin + p["size"]
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["match"].alias("match")))).alias("spans"))

        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("spans")), step, lambda acc: acc["spans"])

    return let(_chunks(pairs), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), inside)))


def _free(found: DataFrame) -> DataFrame:
    """Keeps of candidates those that no span of base touches. A candidate looks into those chunks of base that reach over it."""
    none = F.array().cast("array<struct<low:int,high:int,spans:array<struct<start:int,kind:int,end:int>>>>")
    reach = lambda c: F.struct(F.array_min(F.transform(c, lambda b: b["start"])).alias("low"), F.array_max(F.transform(c, lambda b: b["end"])).alias("high"), c.alias("spans"))
    chunks = let(F.col("base"), lambda base: F.when(F.size(base) == 0, none).otherwise(F.transform(_chunks(base), reach)))
    over = lambda low, high, c: (low < c["end"]) & (c["start"] < high)
    touched = lambda c, chunks: F.exists(chunks, lambda k: over(k["low"], k["high"], c) & F.exists(k["spans"], lambda b: over(b["start"], b["end"], c)))
    free = lambda chunks: F.filter("candidates", lambda c: c["match"].rlike("[0-9]") & c["match"].rlike("[A-Za-z]") & ~touched(c, chunks))
    return found.withColumn("candidates", let(chunks, free))


def _kinds(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _fold(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + of(x))


def _class(code: Column) -> Column:
    return F.when(code.between(48, 57), 0).when(code.between(65, 90), 1).when(code.between(97, 122), 2).otherwise(3)


def tested(candidates: Column) -> Column:
    """candidates: array<struct<start, end, match>>; gives array<struct<start, end, length, p>>. Each step is a pass of its own
    over the array, so that what it builds on is made once."""

    def coded(c: Column) -> Column:
        m = c["match"]
        size = F.when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(m.rlike("^[A-Z2-7]+=*$"), 32).when(m.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).otherwise(64)
        codes = F.transform(F.split(m, ""), lambda x: F.ascii(x))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), codes.alias("codes"), size.cast("double").alias("alphabet"), F.char_length(m).cast("double").alias("n"))

    def centred(c: Column) -> Column:
        return F.struct(*(c[k].alias(k) for k in ("start", "end", "codes", "alphabet", "n")), (_fold(c["codes"], lambda x: x) / c["n"]).alias("mean"), F.sequence(F.lit(0), F.size(c["codes"]) - 2).alias("pairs"))

    def measured(c: Column) -> Column:
        at = lambda i: F.get(c["codes"], i)
        squares = _fold(F.array_distinct(c["codes"]), lambda x: F.pow(F.size(F.filter(c["codes"], lambda y: y == x)).cast("double"), F.lit(2.0)))
        spread = _fold(c["codes"], lambda x: F.pow(x - c["mean"], F.lit(2.0)))
        lagged = _fold(c["pairs"], lambda i: (at(i) - c["mean"]) * (at(i + 1) - c["mean"]))
        changes = _fold(c["pairs"], lambda i: (_class(at(i)) != _class(at(i + 1))).cast("double"))
        return F.struct(
            *(c[k].alias(k) for k in ("start", "end", "alphabet", "n")), (c["alphabet"] * squares / c["n"] - c["n"]).alias("chi"),
            changes.alias("changes"), (F.sqrt(c["n"]) * F.abs(F.when(spread > 0, lagged / spread).otherwise(F.lit(1.0)))).alias("serial"),
        )

    def judged(c: Column) -> Column:
        n, a = c["n"], c["alphabet"]
        likely = a * (1 + (n - 1) * REPEAT) - n
        deviation = a * F.sqrt(2 * REPEAT * (1 - REPEAT) * (n - 1) / n + 4 * (n - 1) * (REPEAT_3 - REPEAT * REPEAT))
        runs = (c["changes"] - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
        z = F.greatest(F.lit(0.0), ((likely - c["chi"]) / deviation + runs) / F.sqrt(F.lit(2.0)))
        tail = 0.5 * F.exp(-0.717 * z - 0.416 * z * z)  # of the normal distribution, closely
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), n.cast("int").alias("length"), F.when(c["serial"] > SERIAL_Z, F.lit(1.0)).otherwise(tail).alias("p"))

    for step in (coded, centred, measured, judged):
        candidates = F.transform(candidates, step)
    return candidates


def _length_class(length: Column) -> Column:
    return F.when(length < 28, 0).when(length < 40, 1).otherwise(2)


def thresholds(found: DataFrame, rate: float) -> dict[int, float]:
    """Per length class the largest p that is let through: Benjamini-Hochberg over bins of a tenth of a decade, at most 3 x 400."""
    bins = found.select(F.explode("candidates").alias("c")).groupBy(_length_class(F.col("c.length")).alias("k"), F.least(F.lit(400), F.floor(-10 * F.log10("c.p"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    limits: dict[int, float] = {}
    totals: dict[int, int] = {}
    rows = bins.collect()
    for r in rows:
        totals[r["k"]] = totals.get(r["k"], 0) + r["n"]
    for k, total in totals.items():
        reached = 0
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: -r["bin"]):
            reached += r["n"]
            p = 10 ** (-r["bin"] / 10)
            if p * total / reached <= rate:
                limits[k] = max(limits.get(k, 0.0), p)
    return limits


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Rows (id_col, n_assign, n_access, n_hex, base, spans), one per row of docs; base and spans are texts of kind:start:end."""
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = text.select("id", _spans(F.col("text"), ASSIGN).alias("assign"), _spans(F.col("text"), ACCESS).alias("access"), _spans(F.col("text"), HEX).alias("hex"), _spans(F.col("text"), CANDIDATE).alias("candidates"))
    found = found.withColumns({
        "assign": F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= LEAST_ASSIGN),
        "access": F.filter("access", lambda s: F.char_length(s["match"]) >= LEAST_ACCESS),
    })
    base = F.array_sort(F.concat(_kinds(F.col("assign"), "assign"), _kinds(F.col("access"), "access"), _kinds(F.col("hex"), "hex")))
    found = found.select("id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"), "candidates")
    found = _free(found)
    found = written(found.withColumn("candidates", tested(F.col("candidates"))), "secret-spans")

    limits = thresholds(found, rate)
    passes = lambda c: F.coalesce(*(F.when(_length_class(c["length"]) == k, c["p"] <= p) for k, p in limits.items()), F.lit(False))
    random = _kinds(F.filter("candidates", passes), "random")
    return found.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", joined(F.col("base")).alias("base"), joined(F.concat("base", random)).alias("spans"))
