"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .chat_format import format_chats, format_turns, read_back
from .common import documents, let, words
from .exact_dedup import exact_dedup
from .fingerprint import containment, fingerprint_edits, likeness, spelled
from .jaccard_join import jaccard_classes
from .language_id import held_out, identify, learned
from .line_dedup import line_dedup
from .mixing import mix
from .periodic_runs import find_runs
from .secret_scan import scan
from .sharding import shard
from .token_counts import edited, with_trees
from .turn_repair import damaged, digests, repair


#: op5 edits so many characters of each text.
EDIT = 16


def _sha(text: str | Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_words: what each of a document's draws gives, shard:words, in the order of passes and shards."""
    drawn = F.array_join(F.transform("copies", lambda c: F.concat(c["shard"].cast("string"), F.lit(":"), c["words"].cast("string"))), ",")
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_draws"), drawn.alias("shard_words"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", _sha("base").alias("base_sha256"), "spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, and after an edit: EDIT characters from its middle on give way to its first EDIT ones."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = with_trees(docs).withColumnsRenamed({"n_tokens": "tokens_before", "n_pieces": "pieces_before"})
    middle = F.floor(F.char_length("text") / 2)
    found = edited(counted.withColumns({"at": middle, "end": middle + EDIT, "insert": F.left("text", F.lit(EDIT))}), "at", "end", "insert")
    return found.select("doc_id", F.col("tokens_before").alias("n_tokens"), F.col("pieces_before").alias("n_pieces"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_pieces").alias("n_pieces_edited"), "n_encoded")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", _sha("edited").alias("edited_sha256"), spelled("sketch").alias("fingerprint"), spelled("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("held_by_edited"), containment("sketch", "next_sketch").alias("held_by_next"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", _sha("text").alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(documents(spark, sf_dir))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(ids).alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(rows))
    key = F.struct("id").alias("key")
    every = rows.select(F.struct(F.col("conv_id").alias("id")).alias("key")).distinct()
    got = every.join(found.summary.select(key, "*"), "key", "left").join(digests(found).select(key, "repaired_sha256"), "key", "left")
    longs = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select(F.col("key.id").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", _sha(F.lit(""))).alias("repaired_sha256"))


#: What the texts of conversation -1 say, between the control strings of another template.
SPOOFED = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPOOFED).alias("text"))
    found = read_back(format_chats(format_turns(rows.unionByName(added))))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(told).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), _sha("learned").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the id, the words repeat from some word on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(documents(spark, sf_dir)))
    top = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    exponent = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, exponent, _sha(listed).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_mixing, op4_secret_scan, op5_token_counts, op6_fingerprint, op7_line_dedup, op8_bpe, op9_exact_dedup, op10_sharding, op11_turn_repair, op12_chat_format, op13_periodic_runs)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ESCAPED = r"regexp_replace(coalesce({}, ''), '([<\[])(\\*)(\|(?:turn|end|image|audio|document)\|>|/?s>|/?INST\])', '\1\2\\\3', 'g')"

ORACLE_SQL = {
    "op3_mixing": r"""
with rows as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size,
         md5('0:' || coalesce(doc_id::varchar, '')) as key
  from documents),
sizes as (select source, sum(size)::bigint as source_size from rows group by source),
placed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, row_number() over (order by source nulls last) as place from sizes),
running as (
  select *, sum(3 * source_size) over (order by 3 * source_size / weight, place) - 3 * source_size as capped,
         sum(weight) over (order by 3 * source_size / weight, place) - weight as passed, sum(source_size) over () as total, sum(weight) over () as weights
  from placed),
leveled as (select *, (total - capped)::double / (weights - passed)::double as level from running),
targeted as (
  select source, source_size,
         least(3.0 * source_size, coalesce(max(level) over (), 0.0) * weight)::double as target
  from leveled),
passes as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole, row_number() over (order by source nulls last) as place from targeted),
quotas as (select *, round(target - whole * source_size)::bigint as rest from passes),
bits as (select greatest(10, case when count(*) // 16384 > 0 then floor(log2(count(*) // 16384)) + 1 else 0 end)::int as bits from rows),
placed_rows as (
  select r.*, q.place, q.source_size, q.target, q.whole, q.rest, sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows unbounded preceding) - r.size as before,
    ('0x' || left(r.key, 8))::bigint >> (32 - bits) as block
  from rows r join quotas q on r.source is not distinct from q.source, bits),
blocks as (
  select place, block, min(before) as before, any_value(whole) as whole, any_value(rest) as rest, row_number() over (partition by place order by block) - 1 as block_rank, count(*) over (partition by place) as n_blocks
  from placed_rows group by place, block),
halves0 as (
  select place, unnest(range((max(whole * n_blocks) + count(*) filter (where before < rest))::bigint)) as item, 0 as low, 16 as high from blocks group by place),
halves1 as (
  select place, item, case when left_ then low else (low + high) // 2 end as low, case when left_ then (low + high) // 2 else high end as high from (
    select *, row_number() over (partition by low, high order by md5('0:' || low || ':' || high || ':' || place || ':' || item), place, item) <= count(*) over (partition by low, high) // 2 as left_ from halves0)),
halves2 as (
  select place, item, case when left_ then low else (low + high) // 2 end as low, case when left_ then (low + high) // 2 else high end as high from (
    select *, row_number() over (partition by low, high order by md5('0:' || low || ':' || high || ':' || place || ':' || item), place, item) <= count(*) over (partition by low, high) // 2 as left_ from halves1)),
halves3 as (
  select place, item, case when left_ then low else (low + high) // 2 end as low, case when left_ then (low + high) // 2 else high end as high from (
    select *, row_number() over (partition by low, high order by md5('0:' || low || ':' || high || ':' || place || ':' || item), place, item) <= count(*) over (partition by low, high) // 2 as left_ from halves2)),
halves4 as (
  select place, item, case when left_ then low else (low + high) // 2 end as low, case when left_ then (low + high) // 2 else high end as high from (
    select *, row_number() over (partition by low, high order by md5('0:' || low || ':' || high || ':' || place || ':' || item), place, item) <= count(*) over (partition by low, high) // 2 as left_ from halves3)),
runs as (select place, low as shard, sum(count(*)) over (partition by place order by low) - count(*) as first, count(*) as n from halves4 group by place, low),
draws as (select place, shard, unnest(range(first::bigint, (first + n)::bigint)) as draw from runs),
copies as (
  select p.*, d.draw // b.n_blocks as pass, shard, case when d.draw // b.n_blocks < p.whole then size else least(size, greatest(0, p.rest - p.before)) end as words
  from placed_rows p join blocks b using (place, block) join draws d on d.place = p.place and d.draw % b.n_blocks = b.block_rank)
select p.doc_id, p.size, p.source_size, p.target, coalesce(sum(words), 0)::bigint as taken, count(*) filter (where words <> 0) as n_draws,
       coalesce(string_agg(c.shard || ':' || words, ',' order by pass, c.shard) filter (where words <> 0), '') as shard_words
from placed_rows p left join copies c using (doc_id) group by p.doc_id, p.size, p.source_size, p.target""",
    "op7_line_dedup": rf"""
with split as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split),
common as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, c.key is not null and k.doc_id <> c.keeper as dropped from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id""",
    "op12_chat_format": rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{SPOOFED}' union all select -1, 1, 'assistant', '{SPOOFED}'),
written as (
  select *, '<|turn|>' || {_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} || chr(10)
    || regexp_replace(regexp_replace(regexp_replace({_ESCAPED.format("text")}, '!\[[^\]\[]*\]\([^()\s]+\.(?i:png|jpe?g|gif|webp)\)', '<|image|>', 'g'),
         '!\[[^\]\[]*\]\([^()\s]+\.(?i:wav|mp3|ogg|flac)\)', '<|audio|>', 'g'), '!\[[^\]\[]*\]\([^()\s]+\)', '<|document|>', 'g')
    || '<|end|>' || chr(10) as piece from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, piece)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, piece) filter (where role = 'assistant'), '')) as loss_sha256, sum(length(piece))::bigint as formatted_chars
from written group by conv_id""",
    "op9_exact_dedup": f"""
with norm as (select doc_id, {_LOWER} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from norm""",
}
