"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import (
    chat_format, chat_repair, decontaminate, html_extract, language_id, mixing, near_dedup, periodic_runs, pii, quality,
    token_records, toxicity, va_search,
)
from treeledger.llm.common import crc_fold, read


def op1_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id, v from v where vec_id % 50 = 0),
p as (
  select q.vec_id as query_id, q.v as query_v, c.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (
  select query_id, cast(row_number() over (partition by query_id, query_v order by score desc, vec_id) as integer) as rank, vec_id, score
  from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("shards").alias("draws"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, model), toxicity.THRESHOLD)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _judged(quality.score(docs, model), quality.THRESHOLD)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    read_back = chat_format.parse_chats(chat_format.format_chats(rows.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return read_back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP9_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\e') as et,
         replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\e'), ': ', '\m') as er
  from c),
g as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as t,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as l,
         cast(sum(14 + length(er) + length(et)) as bigint) as formatted_chars,
         string_agg(case when role in ('system', 'user', 'assistant') then left(role, 1) else 'x' end, '' order by turn nulls first, role, text) as shape
  from e group by conv_id)
select conv_id, n_turns, sha256(t) as turns_sha256, cast(length(l) as bigint) as loss_chars, sha256(l) as loss_sha256,
       formatted_chars, regexp_full_match(shape, 's?(ua)+') as valid
from g
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(read(spark, sf_dir, "documents"))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damage(read(spark, sf_dir, "conversations")))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda z: cast(ascii(z) as bigint))), lambda c, b: {bits}), 4294967295)"


def _repair_sql() -> str:
    """States z0 to z3 hold the cheapest edits (c), their letters (a) and what they write (r) up to a row; a step closes
    them under inserts and takes the next row."""

    def best(*of: str) -> str:
        return f"list_sort(list_filter([{', '.join(of)}], lambda x: x.c is not null))[1]"

    def more(z: str, cost: str, edit: str, row: str) -> str:
        return f"{{'c': {z}.c + {cost}, 'a': {z}.a || {edit}, 'r': {z}.r || {row}}}"

    said = lambda role: f"chr(10) || {role} || ':' || text"
    z2 = best("s2", *[more(s, "3", "'I'", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")])
    keep = lambda z, own, name: (
        f"case when not gone then case when i = '{own}' then {more(z, 't', chr(39) + 'K' + chr(39), said('role'))} "
        + (f"else {more(z, '(t + 3)', chr(39) + 'R' + chr(39), said(chr(39) + name + chr(39)))} " if name else "")
        + "end end"
    )
    drop = lambda z: more(z, "4", "'D'", "''")
    z3 = best("s3", more("z2", "3", "'I'", "chr(10) || 'assistant:'"))
    closed = lambda of: f"select *, {z3} as z3 from (select *, s0 as z0, s1 as z1, {z2} as z2 from ({of}))"
    next_row = "select p.*, m.role, m.text, m.i, m.gone, m.t from steps p join marked m on p.conv_id is not distinct from m.conv_id and m.n = p.n + 1"
    last = "select s.* from steps s join counts c on s.conv_id is not distinct from c.conv_id and s.n = c.rows"
    return f"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc32_sql("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as code
  from conversations),
hurt as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from src, unnest(range(case when code = 3 then 2 else 1 end)) as t(k) where code <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from hurt),
judged as (
  select *, left(role, 1) as i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as solid,
         row_number() over (partition by conv_id, role, text order by n) > 1 as again,
         lag(left(role, 1)) over (partition by conv_id order by n) || left(role, 1) as pair
  from numbered),
marked as (
  select *, solid = '' as blank, solid <> '' and again as dup, solid <> '' and not again and right(solid, 1) not in ('.', '!', '?') as cut,
         solid = '' or again as gone, case when right(solid, 1) in ('.', '!', '?') then 0 else 3 end as t
  from judged),
counts as (
  select conv_id, count(*) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
         count(*) filter (where dup) as duplicate, count(*) filter (where cut) as truncated,
         count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id),
steps as (
  select conv_id, cast(0 as bigint) as n, {{'c': 0, 'a': '', 'r': ''}} as s0, cast(null as struct(c integer, a varchar, r varchar)) as s1,
         cast(null as struct(c integer, a varchar, r varchar)) as s2, cast(null as struct(c integer, a varchar, r varchar)) as s3 from counts
  union all
  select conv_id, n + 1, {drop('z0')}, {best(drop('z1'), keep('z0', 's', ''))},
         {best(drop('z2'), *[keep(z, 'u', 'user') for z in ('z0', 'z1', 'z3')])}, {best(drop('z3'), keep('z2', 'a', 'assistant'))}
  from ({closed(next_row)})),
ends as (select conv_id, {best('z0', 'z3')} as e from ({closed(last)}))
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(e.c, 0) as bigint) as cost, coalesce(e.a, '') as audit, sha256(coalesce(substr(e.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id
left join ends x on o.conv_id is not distinct from x.conv_id
"""


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_va_search": op1_va_search,
        "op2_decontaminate": op2_decontaminate,
        "op3_near_dedup": op3_near_dedup,
        "op4_html_extract": op4_html_extract,
        "op5_mixing": op5_mixing,
        "op6_pii": op6_pii,
        "op7_language_id": op7_language_id,
        "op8_toxicity": op8_toxicity,
        "op9_chat_format": op9_chat_format,
        "op10_quality": op10_quality,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_chat_repair": op12_chat_repair,
        "op13_token_records": op13_token_records,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_va_search": OP1_SQL, "op9_chat_format": OP9_SQL, "op12_chat_repair": _repair_sql()}
