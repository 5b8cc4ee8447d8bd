"""The registered queries of the training-data operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, hilbert_shards, language_id, mixing, ngram_join, nn_descent, packing, periodic_runs, pii, quality_classifier, quality_rules, token_counts, toxicity
from .common import read_table

#: The key of the registered query and pipeline, so that their results repeat. A deployment passes its own.
QUERY_KEY = "pseudonym-key"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_report(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_report(read_table(spark, sf_dir, "embeddings"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"), QUERY_KEY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.conversation_report(read_table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_report(read_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_ngram_join, op3_quality_rules, op4_toxicity, op5_best_fit_packing, op6_token_counts, op7_nn_descent, op8_hilbert_shards, op9_pii, op10_language_id, op11_conversation_repair, op12_periodic_runs, op13_quality_classifier)
}

#: All pairs that share a shingle, by exact sets of words.
NGRAM_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) < 5 then [words] else [words[i:i + 4] for i in range(1, len(words) - 3)] end) as shingle
      from d where len(words) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
ids as (select doc_id, dense_rank() over (order by shingle) as g from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from ids a join ids b using (g) where a.doc_id != b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 1000 * common >= 800 * (x.n + y.n - common)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b)
select doc_id, min(reach.b) as class_id, (select count(*) from links where links.a = doc_id) as n_links
from documents join reach on reach.a = doc_id group by doc_id
"""

#: All distances, summed in the order of the components.
NEAREST_SQL = """
with fit as (select distinct vec_id, embedding::double[] as v from embeddings where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select * from fit where len(v) = (select len(v) from fit group by 1 order by count(*) desc, 1 desc limit 1)),
d as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) as score
      from u q join u c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
k as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d)
select query_id, rank::int as rank, vec_id, score from k where rank <= 10
"""


#: The table of crc32's steps, and crc32 of a text by it.
CRC_STEPS = "steps as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as steps)"


def crc_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: (instr('123456789ABCDEF', p[1]) * 16 + instr('123456789ABCDEF', p[2]))::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


def repair_sql() -> str:
    """The cheapest edits and their letters by a fold from the last turn to the first, a state's least (cost, letters) each."""
    cost = lambda c, a: f"{{'c': ({c})::bigint, 'a': {a}}}"
    onward = (3, 3, 4, 3)
    option = lambda to, letter, c, when: cost(f"case when {when} then v[{to}].c + {c} else 1000000000 end", f"'{letter}' || v[{to}].a")
    moves = []
    for s in range(1, 5):
        kept = {1: "r = 0", 2: "false", 3: "false", 4: "false"}[s]
        to_user, to_assistant = "r = 1" if s != 3 else "false", "r = 2" if s == 3 else "false"
        moves.append(
            f"list_min([{option(s, 'D', '4', 'true')}, {option(onward[s - 1], 'R', '3 + 3 * kind', 'kind < 2')}, {option(2, 'K', '3 * kind', f'kind < 2 and {kept}')}, "
            f"{option(3, 'K', '3 * kind', f'kind < 2 and {to_user}')}, {option(4, 'K', '3 * kind', f'kind < 2 and {to_assistant}')}])"
        )
    step = f"[{', '.join(moves)}]".replace("kind", "(x[1].c // 4)").replace(" r = ", " x[1].c % 4 = ")
    for _ in range(3):
        step = f"list_transform([{step}], lambda w: [" + ", ".join(f"list_min([w[{s}], {cost(f'w[{onward[s - 1]}].c + 3', f"'I' || w[{onward[s - 1]}].a")}])" for s in range(1, 5)) + "])[1]"
    end = "[" + ", ".join(cost(c, f"'{a}'") for c, a in ((0, ""), (6, "II"), (3, "I"), (0, ""))) + "]"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with {CRC_STEPS},
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, steps),
m as (select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case k when 3 then 2 else 1 end)) as copy from d where k <> 0),
o as (select *, rtrim(text, {blanks}) as bare, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again, instr('sua', left(role, 1)) as role_at from m),
t as (select *, case when bare = '' then 2 when again > 1 then 3 when right(bare, 1) in ('.', '!', '?') then 0 else 1 end as kind, case when role = '' or role_at = 0 then 3 else role_at - 1 end as r,
  lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from o),
f as (select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps, count_if(kind = 2) as blank, count_if(kind = 3) as duplicate, count_if(kind = 1) as truncated,
  count_if(i > 1 and pair not in ('su', 'ua', 'au')) as illegal, list_reduce(list_prepend({end}, list([{cost("case when kind = 3 then 8 else kind * 4 end + r", "''")}] order by i desc)), lambda v, x: {step})[1] as best from t group by conv_id),
l as (select conv_id, best.a as audit, unnest(range(1, length(best.a) + 1)) as j from f),
e as (select *, audit[j] as letter, length(replace(audit[1:j], 'I', '')) as i, length(replace(audit[1:j], 'D', '')) as place from l),
w as (select e.*, role, text, max(case when letter = 'K' and place = 1 and left(role, 1) = 's' then 1 else 0 end) over (partition by e.conv_id) as ahead
  from e left join t on t.conv_id is not distinct from e.conv_id and t.i = e.i and letter <> 'I'),
p as (select conv_id, string_agg(case when letter = 'K' then role when (place - ahead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j) as told from w where letter <> 'D' group by conv_id)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(told, '')) as repaired_sha256
from (select distinct conv_id from conversations) as ids left join f on f.conv_id is not distinct from ids.conv_id left join p on p.conv_id is not distinct from ids.conv_id
"""


#: Every diagonal of equal words, from the places where six words repeat; of stretches of the same extent the smallest period stays.
RUNS_SQL = rf"""
with {CRC_STEPS},
h as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, {crc_sql("coalesce(doc_id::varchar, '')")} as h from documents, steps),
a as (select *, len(words) as n, (h // 10) % greatest(len(words), 1) as a, 3 + (h // 10) % 8 as more from h),
d as (select row_number() over () as row, doc_id, n, case when h % 10 = 0 and n > 0 then list_concat(words[1:a], list_transform(range(a, n), lambda i: words[a + (i - a) % (1 + (n - a) // more) + 1])) else words end as words from a),
w as (select row, i, words[i + 1:i + 6] as six from (select row, words, n, unnest(range(n - 5)) as i from d where n >= {periodic_runs.LEAST})),
pairs as (select row, y.i as i, y.i - x.i as lag from w x join w y using (row, six) where x.i < y.i),
islands as (select row, lag, i, i - row_number() over (partition by row, lag order by i) as island from pairs),
s as (select row, lag, min(i) - lag as start, count(*) + 5 + lag as length from islands group by row, lag, island having count(*) + 5 + lag >= greatest({periodic_runs.LEAST}, 2 * lag)),
r as (select row, start, length, min(lag) as period from s group by row, start, length),
gone as (select distinct row, unnest(range(start + period, start + length)) as i from r),
words as (select row, unnest(words) as word, unnest(range(n)) as i from d),
kept as (select row, string_agg(word, ' ' order by i) as text from words anti join gone using (row, i) group by row),
told as (select row, count(*) as n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'l': -length, 's': start, 'p': period}}) as top, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by row)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.s::bigint as start, top.l::bigint as length, top.p::bigint as period, (1000 * top.l // top.p)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256 from d left join told using (row) left join kept using (row)
"""


def shard_sql(shards: int = 16) -> str:
    """Law ``rows`` along the curve, crc32 by its table of steps, for tables of one sub-bucket (up to SUB_ROWS documents)."""
    bits = hilbert_shards.BITS
    crc = lambda text: f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: (instr('123456789ABCDEF', p[1]) * 16 + instr('123456789ABCDEF', p[2]))::bigint)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""  # noqa: E731
    return f"""
with steps as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as steps),
names as (select name, {crc("name")} % {1 << bits} as level from (select coalesce(source, '') as name from documents union select coalesce(lang, '') from documents), steps),
d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
t as (select text, {crc("text")} as text_crc32 from (select distinct text from d), steps),
c as (select doc_id, size, text_crc32, {hilbert_shards.curve(3, bits)}[(s.level * {1 << bits} + l.level) * {1 << bits} + least(floor(log2(size)), {(1 << bits) - 1})::bigint + 1] as place
  from d join t using (text) join names s on s.name = source join names l on l.name = lang),
r as (select *, row_number() over (order by place, doc_id, text_crc32) - 1 as rank, count(*) over () // {shards} as each, count(*) over () % {shards} as more from c),
k as (select *, case when rank < more * (each + 1) then rank // (each + 1) else more + (rank - more * (each + 1)) // greatest(each, 1) end as shard from r)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, row_number() over (partition by shard order by rank) - 1 as slot, null::int as grown_shard from k
"""


ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.mix_sql(),
    "op2_ngram_join": NGRAM_SQL,
    "op3_quality_rules": quality_rules.quality_sql(),
    "op7_nn_descent": NEAREST_SQL,
    "op8_hilbert_shards": shard_sql(),
    "op11_conversation_repair": repair_sql(),
    "op12_periodic_runs": RUNS_SQL,
}
