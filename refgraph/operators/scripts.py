"""Scripts that run other scripts and steps of workflows, as relations, and excerpts cut by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refgraph.sources.commands import DEEPEST, RUNNERS

#: A word of a command: what stands between white space, `& | ; ( )`, with quotes and escapes in it.
_WORD = r"""(?s)(?:\\.|'(?:[^'\\]|\\.)*'?|"(?:[^"\\]|\\.)*"?|[^\s&|;()\\'"])+"""
BINARY = "[binary]"
MOST_LINES, MOST_BYTES = 20, 16_384


def command_words(command: Column) -> Column:
    """The words of a command without quotes and escapes, nor `#` at their start; of quotes within quotes both go."""
    found = F.regexp_extract_all(command, F.lit(_WORD), F.lit(0))
    plain = F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, "^#+", ""), r"""(?s)\\(.)|['"]""", "$1"))
    return F.filter(plain, lambda w: w != "")


def script_calls(scripts: DataFrame, owner: str = "package", name: str = "script", command: str = "command") -> DataFrame:
    """(owner, script, at, callee): the scripts that a command starts through a package manager, by the number of the word that names
    the manager. Names that are no script of the owner are among them. A null command calls nothing."""
    words = scripts.select(F.col(owner).alias("owner"), F.col(name).alias("script"), command_words(F.col(command)).alias("w"))

    def called(word: Column, k: Column) -> Column:
        runner = F.regexp_extract(word, r"([^/\\]*)$", 1)
        rest = F.slice("w", k + F.when(runner == "corepack", 3).otherwise(2), F.size("w"))
        first = F.get(rest, F.lit(0))
        after = F.slice(rest, F.lit(2), F.size("w"))
        named = F.when(runner == "yarn", F.when(first == "run", after).otherwise(rest)).when(first.isin("run", "run-script"), after)
        target = F.get(F.filter(named, lambda x: ~F.startswith(x, F.lit("-"))), F.lit(0))
        return F.struct(k.cast("int").alias("at"), F.when(runner.isin(*sorted(RUNNERS)), target).alias("callee"))

    return words.select("owner", "script", F.explode(F.transform("w", called)).alias("c")).select("owner", "script", "c.at", "c.callee").where("callee is not null")


def nested_scripts(scripts: DataFrame, owner: str = "package", name: str = "script", command: str = "command", deepest: int = DEEPEST) -> DataFrame:
    """(owner, root, script, depth, path, cycle): the scripts that each script starts, itself (depth 0) and through others, down to
    `deepest`, with the way there. A script that is on its own way is named once more, as a cycle, and not followed.

    `deepest` joins of a fixed plan, each on (owner, script); calls are written once. Scripts are unique in their owner."""
    from .tables import written

    known = scripts.select(F.col(owner).alias("owner"), F.col(name).alias("script")).where("script is not null")
    calls = script_calls(scripts, owner, name, command).select("owner", "script", "callee").distinct()
    calls = written(calls.join(known.withColumnRenamed("script", "callee"), ["owner", "callee"], "left_semi"), "script-calls")
    level = known.select("owner", F.col("script").alias("root"), "script", F.array("script").alias("path"), F.lit(False).alias("cycle"))
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, deepest + 1):
        seen = F.array_contains("path", F.col("callee"))
        level = level.where("not cycle").join(calls, ["owner", "script"]).select("owner", "root", F.col("callee").alias("script"), F.concat("path", F.array("callee")).alias("path"), seen.alias("cycle"))
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.select(F.col("owner").alias(owner), "root", "script", "depth", "path", "cycle")


def bounded_excerpt(data: Column, lines: int = MOST_LINES, most: int = MOST_BYTES) -> Column:
    """The first lines of bytes or a text, in `most` bytes at most: cut after a whole character, \\r\\n as \\n, without a last newline.
    BINARY where what is cut out has a NUL or is no UTF-8. Null stays null; only the first `most` bytes are looked at."""
    head = F.substring(data.cast("binary"), 1, most)
    byte_for_byte = "ISO-8859-1"

    def cut(bytes_: Column) -> Column:
        first = F.substring_index(bytes_, "\n", lines)
        return F.struct(first.alias("first"), (F.char_length(first) < F.char_length(bytes_)).alias("ended"))

    def read(c: Column) -> Column:
        first = c["first"]
        tail = F.regexp_extract(first, r"(?:[\u00C2-\u00DF]|[\u00E0-\u00EF][\u0080-\u00BF]?|[\u00F0-\u00F4][\u0080-\u00BF]{0,2})\z", 0)  # of a character that was cut
        taken = F.encode(first, byte_for_byte).cast("string")
        shorter = F.encode(F.left(first, F.char_length(first) - F.char_length(tail)), byte_for_byte).cast("string")
        text = F.when(F.is_valid_utf8(taken), taken).when(~c["ended"] & (tail != "") & F.is_valid_utf8(shorter), shorter)
        return F.when(~F.contains(first, F.lit("\x00")), F.when(c["ended"], F.concat(text, F.lit("\n"))).otherwise(text))

    text = _let(_let(F.decode(head, byte_for_byte), cut), read)
    return F.when(data.isNotNull(), F.coalesce(_let(F.replace(text, F.lit("\r\n"), F.lit("\n")), lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.char_length(t) - 1)).otherwise(t)), F.lit(BINARY)))


def _let(value: Column, body) -> Column:
    """body(value) with value made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_lines(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, line): the lines of texts, numbered from 0. A null or empty text has none."""
    text = F.regexp_replace(F.col(text_col), r"\r?\n\z", "")
    split = F.when(F.col(text_col) != "", F.split(text, r"\r?\n", -1))
    return texts.select(F.col(id_col).alias("id"), F.posexplode(split).alias("pos", "line"))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")


def run_steps(lines: DataFrame) -> DataFrame:
    """(id, pos, command, folder): the `run:` lines of workflows, read by lines and indents, from (id, pos, line) without gaps.

    A value that begins with `|` or `>` is the block of lines below that are indented further, blank ones too; run lines in it are
    its text. folder is the `working-directory:` of the same step, the lines around that are not indented less, from an item on
    to the next item.

    A line ends the blocks of the indents that it does not exceed, so where blocks end, and what they hold, are questions to
    windows over (id, indent): each line is there once for each indent that blocks of its text have. Blocks are nested by
    construction, so a run line counts where it is in none."""
    indent = F.char_length(F.regexp_extract("line", r"^(\s*)", 1))
    body = F.regexp_replace("line", r"^\s+", "")
    value = lambda key: F.when(body.rlike(rf"^(?:- )?{key}:"), F.regexp_replace(body, rf"(?s)^(?:- )?{key}:", ""))
    rows = lines.select("id", "pos", "line", indent.alias("indent"), (F.trim(body) == "").alias("blank"), F.startswith(body, F.lit("- ")).alias("item"), F.regexp_replace(value("run"), r"^\s+", "").alias("run"), value("working-directory").alias("folder"))
    rows = rows.withColumn("block", F.coalesce(F.col("run").rlike("^[|>]"), F.lit(False)))

    def levelled(df: DataFrame, levels: DataFrame) -> DataFrame:
        return df.join(levels.select("id", F.col("indent").alias("level")).distinct(), "id")

    def before(what: Column, keys: list[str]) -> Column:
        return F.last(what, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))

    def after(what: Column, keys: list[str]) -> Column:
        return F.first(what, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(1, Window.unboundedFollowing))

    at = ["id", "level"]
    ends_it = ~F.col("blank") & (F.col("indent") <= F.col("level"))
    ranks = levelled(rows, rows.where("block")).where(ends_it | F.col("run").isNotNull())
    ranks = ranks.withColumns({"within": before(F.when(ends_it, F.col("block") & (F.col("indent") == F.col("level"))), at), "end": after(F.when(ends_it, F.col("pos")), at)})
    inner = ranks.where("run is not null and indent > level and within").select("id", "pos").distinct()
    own = ranks.where("block and indent = level").select("id", "pos", F.coalesce("end", F.lit(2147483647)).alias("end"))
    runs = rows.where("run is not null").join(inner, ["id", "pos"], "left_anti").select("id", "pos", "indent", "run", "block")

    blocks = runs.where("block").join(own, ["id", "pos"]).select("id", "pos", F.struct(F.col("pos").alias("start"), "end").alias("b"))
    held = rows.select("id", "pos", "line").join(blocks, ["id", "pos"], "left").withColumn("in", before(F.col("b"), ["id"])).where("pos < in.end")
    texts = held.groupBy("id", F.col("in.start").alias("pos")).agg(F.expr("listagg(concat(regexp_replace(line, '^\\\\s+|\\\\s+$', ''), '\n'), '') within group (order by pos)").alias("text"))

    first, last = F.col("item") | (F.col("indent") < F.col("level")), (F.col("indent") < F.col("level")) | (F.col("item") & (F.col("indent") == F.col("level")))
    mine = F.col("mine") & (F.col("indent") == F.col("level"))
    marked = rows.join(runs.select("id", "pos", F.lit(True).alias("mine")), ["id", "pos"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    steps = levelled(marked, runs).where(first | mine)
    steps = steps.withColumns({"above": before(F.when(first, F.struct("pos", "item")), at), "below": after(F.when(last, F.col("pos")), at)}).where(mine)
    begins = F.coalesce(F.when(F.col("above.item"), F.col("above.pos")).otherwise(F.col("above.pos") + 1), F.lit(0))
    steps = steps.select("id", F.col("pos").alias("of"), begins.alias("pos"), F.coalesce("below", F.lit(2147483647)).alias("below"), F.lit(None).cast("string").alias("folder"))
    named = rows.where("folder is not null").select("id", F.lit(None).cast("int").alias("of"), "pos", F.lit(None).cast("int").alias("below"), "folder")
    follow = Window.partitionBy("id").orderBy("pos", F.col("of").isNull()).rowsBetween(0, Window.unboundedFollowing)
    found = steps.unionByName(named).withColumn("next", F.first(F.when(F.col("folder").isNotNull(), F.struct("pos", "folder")), ignorenulls=True).over(follow)).where("of is not null")
    folder = F.when(F.col("next.pos") < F.col("below"), _unquoted(F.regexp_replace("next.folder", r"^\s+|\s+$", "")))
    found = found.select("id", F.col("of").alias("pos"), folder.alias("folder"))
    command = F.when(F.col("block"), F.coalesce("text", F.lit(""))).otherwise(_unquoted(F.col("run")))
    return runs.join(texts, ["id", "pos"], "left").join(found, ["id", "pos"]).select("id", "pos", command.alias("command"), "folder")
