"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are bit operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: str) -> tuple[int, int, int]:
    """n_words, n_dup_lines, n_repeat_words. Splitting bytes splits at ASCII white space alone."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, again = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                again += 1
            elif line and not line.isspace():
                seen.add(line)
    return len(words), again, repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each document, one row for each input row.

    A null text counts as empty, which measures 0 throughout; whole texts of any length are read. Columns
    other than doc_id and text are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure_text(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), cols[0], b.column(2), b.column(3), *cols[1:]], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    text = F.coalesce(F.col("text"), F.lit(""))
    length = lambda c: F.length(c).cast("bigint")
    counted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (length(text) - length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
    )
    return counted.mapInArrow(run, f"doc_id long, {MEASURES}")


@dataclass(frozen=True)
class Rule:
    """A rule has a name and a condition, in integers, under which a document fails."""

    name: str
    fails: str


#: A rule's bit is its place here; new rules are added at the end, so old ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 5 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document; the other rules are only recorded."""

    version: str
    rejecting: tuple[str, ...] = field(default_factory=tuple)

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in self.rejecting)


POLICIES = {p.version: p for p in (Policy("v1", BASE), Policy("v2", (*BASE, "symbols", "long_words", "short_words")))}
CURRENT = "v2"


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = F.lit(0).cast("bigint")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits: bit i is set where rule i fails."""
    return measured(docs).withColumn("fail_bits", fail_bits(rules))


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rejecting rule of the policy fails. No text is read again."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablation(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rejecting rule: documents that fail it, fail it alone, and are kept without it.

    Documents are first counted by their masked bits, of which there are at most 2**rules and far
    fewer in fact, so rules multiply counts and not documents.
    """
    mask = policy.mask(rules)
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in rules]
    each = F.explode(F.array([F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in policy.rejecting]))
    rows = counts.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return rows.groupBy("rule").agg(total(has)("n_fail"), total(alone)("n_fail_alone"), total(alone | (F.col("bits") == 0))("n_kept_without"))


def quality_report(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger under a policy, with ``base_failed`` for the rules that every policy holds."""
    led = apply_policy(ledger(docs), POLICIES[version])
    base = Policy("base", BASE).mask()
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(base)) != 0)


def quality_sql(version: str = CURRENT) -> str:
    """``quality_report`` for DuckDB."""
    bits = " + ".join(f"(case when {r.fails} then {1 << i} else 0 end)" for i, r in enumerate(RULES))
    mask, base = POLICIES[version].mask(), Policy("base", BASE).mask()
    return rf"""
with d as (select doc_id, coalesce(text, '') as body, row_number() over () as row_id from documents),
w as (select row_id, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words from d),
lines as (select row_id, unnest(string_split(body, chr(10))) as line from d),
dup as (select row_id, sum(n - 1)::bigint as n_dup_lines from (
    select row_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by row_id),
win as (select row_id, unnest(range(1, len(words) - 3)) as pos, words from w where len(words) >= 5),
grams as (select row_id, pos, words[pos:pos + 4] as gram from win),
twice as (select row_id, pos from (select row_id, pos, count(*) over (partition by row_id, gram) as n from grams) where n > 1),
rep as (select row_id, count(distinct pos + i)::bigint as n_repeat_words from twice, range(5) as r(i) group by row_id),
m as (
  select w.doc_id, len(words)::bigint as n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(body, '{SYMBOLS}'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join dup using (row_id) left join rep using (row_id)),
b as (select *, ({bits})::bigint as fail_bits from m)
select *, (fail_bits & {mask}) = 0 as kept, (fail_bits & {base}) != 0 as base_failed from b
"""
