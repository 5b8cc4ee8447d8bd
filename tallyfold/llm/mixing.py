"""Mixing sources to target weights: raking of sampling rates under the cap of 1, then calibrated sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unit_hash, write_table

#: Sweeps of the raking, and the power that tempers present shares into default targets.
SWEEPS, TEMPER = 8, 0.7
#: The share of all tokens that the mix is to have.
KEEP = 0.6
#: Up to so many cells the raking runs in one task and the rates are broadcast.
FEW_CELLS = 50_000
SALTS = 32
DIMS = ("source", "lang", "topic")
NONE = "(none)"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def register_topic(text: Column, tokens: Column) -> Column:
    """The default topic: the register of a text, by the first rule that holds."""
    return (
        F.when(text.contains("|"), "table")
        .when(text.contains("###") | text.contains("$$$") | text.contains("%%%"), "noise")
        .when(text.contains("@") | text.contains("="), "records")
        .when(tokens < 150, "brief")
        .otherwise("prose")
    )


def goals(cells: DataFrame, dim: str, target: DataFrame | float, budget: float, few: bool = True) -> DataFrame:
    """(dim, have, share, goal): tokens that each value of a dimension has and shall have in a mix of ``budget`` tokens.

    A goal is the value's share of the budget, but never more than it has; what scarce values lack the others get, in
    proportion to their shares. target: a table (value, share) or the power that tempers present shares. Values
    that a table leaves out have the share 0. Few values are put in the order in which they run out, where the level
    (tokens a unit of share) rises as long as values are capped and falls after; many are capped round by round.
    """
    have = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("have"))
    if isinstance(target, DataFrame):
        share = target.select(F.col(target.columns[0]).alias(dim), F.col(target.columns[1]).cast("double").alias("share"))
        values = have.join(share, dim, "left").fillna(0.0, ["share"])
    else:
        values = have.withColumn("share", F.when(F.col("have") > 0, F.pow("have", F.lit(float(target)))).otherwise(0.0))
    if few:
        order = Window.orderBy(F.col("have") / F.col("share"), dim)
        before = F.coalesce(F.sum("have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
        at = values.where("share > 0").coalesce(1).select(dim, ((F.lit(float(budget)) - before) / rest).alias("_at"))
        at = values.join(at, dim, "left").coalesce(1).withColumn("_level", F.coalesce(F.max("_at").over(Window.partitionBy()), F.lit(0.0)))
        return at.withColumn("goal", F.least("have", F.col("share") * F.col("_level"))).drop("_at", "_level")
    values = write_table(values, "mix-values")
    level, capped = 0.0, -1
    while True:
        # Tokens a unit of share, such that what is not capped yet takes up the rest of the budget.
        over = F.col("have") <= F.col("share") * level
        row = values.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("have"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~over, F.col("share"))), F.lit(0.0)).alias("left")).first()
        if row["n"] == capped or row["left"] <= 0:
            break
        capped, level = row["n"], max(level, (budget - row["taken"]) / row["left"])
    return values.withColumn("goal", F.least("have", F.col("share") * level))


def _held(w: DataFrame, dim: str, few: bool) -> DataFrame:
    """``w`` with ``_held``, the tokens that the value of each cell now gets."""
    kept = F.sum(F.col("tokens") * F.col("rate"))
    if few:
        return w.withColumn("_held", kept.over(Window.partitionBy(dim)))
    return _spread(w, w.groupBy(dim).agg(kept.alias("_held")), [dim])


def _spread(w: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """A join of many rows with one row a key: broadcast while that is small, else salted, so a frequent key is dealt to many tasks."""
    values = write_table(values, "mix-side")
    if values.count() <= FEW_CELLS:
        return w.join(F.broadcast(values), keys)
    salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return w.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def rake(cells: DataFrame, targets: dict[str, DataFrame | float], sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """Sampling rates of cells, of at most 1, with which expected tokens meet the ``goals`` of each dimension.

    cells: the dimensions' columns and ``tokens``. Every cell starts at the rate ``keep``. Each step scales the rates of one value's cells
    to the value's goal and cuts them at 1; a sweep does so for every dimension, and the sweeps after make up for what
    was cut. A value that no goal is left for gets the rate 0. Without any tokens all rates are 1.
    """
    row = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).first()
    few, total = row["n"] <= FEW_CELLS, float(row["tokens"] or 0)
    w = (cells.coalesce(1) if few else cells).withColumn("rate", F.lit(float(keep)) if total else F.lit(1.0))
    if not total:
        return w.select(*targets, "tokens", "rate")
    for dim, target in targets.items():
        goal = goals(cells, dim, target, keep * total, few).select(dim, F.col("goal").alias(f"_goal_{dim}"))
        w = w.join(F.broadcast(goal), dim) if few else _spread(w, goal, [dim])
    w = w.coalesce(1) if few else write_table(w, "mix-raked")
    for _ in range(sweeps):
        for dim in targets:
            goal = F.col(f"_goal_{dim}")
            w = _held(w, dim, few).withColumn("rate", F.when(F.col("_held") > 0, F.least(F.lit(1.0), F.col("rate") * goal / F.col("_held"))).otherwise(F.col("rate"))).drop("_held")
        w = w if few else write_table(w, "mix-raked")
    return w.select(*targets, "tokens", "rate")


def tagged(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with ``_mx_source``, ``_mx_lang``, ``_mx_topic`` and ``_mx_tokens``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_mx_tokens", token_count(text))
    named = {"_mx_source": F.coalesce(F.col("source"), F.lit(NONE)), "_mx_lang": F.coalesce(F.col("lang"), F.lit(NONE))}
    return out.withColumns(named | {"_mx_topic": F.coalesce(topic, F.lit(NONE)) if topic is not None else register_topic(text, F.col("_mx_tokens"))})


def cell_rates(tags: DataFrame, targets: dict | None = None, sweeps: int = SWEEPS, keep: float = KEEP) -> DataFrame:
    """Source, language, topic, tokens and rate of every cell of tagged documents."""
    if not 0 < keep <= 1:
        raise ValueError("keep must be above 0 and at most 1")
    cells = tags.groupBy(*[F.col(f"_mx_{d}").alias(d) for d in DIMS]).agg(F.sum("_mx_tokens").alias("tokens"))
    return write_table(rake(write_table(cells, "mix-cells"), targets or {d: TEMPER for d in DIMS}, sweeps, keep), "mix-rates")


def sampled(tags: DataFrame, rates: DataFrame, seed: str = "mix") -> DataFrame:
    """Tagged documents with ``_mx_rate`` and ``_mx_kept``."""
    named = rates.select(*[F.col(d).alias(f"_mx_{d}") for d in DIMS], F.col("rate").alias("_mx_rate"))
    out = _spread(tags, named, [f"_mx_{d}" for d in DIMS])
    draw = unit_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return out.withColumn("_mx_kept", draw < F.col("_mx_rate"))


def mix(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, sweeps: int = SWEEPS, keep: float = KEEP, seed: str = "mix") -> DataFrame:
    """The sampled documents, with the columns of ``docs``.

    A document is kept with its cell's probability min(1, raked rate): the expected tokens are ``keep`` of all tokens and have the
    target shares of source, language and topic, as far as there are tokens for them (``shortfalls`` says where not). Sampling compares
    the rate with a hash of seed and id, so a repeated id shares one fate, and reruns agree. A null source, language
    or topic is the value "(none)"; null and empty texts have no tokens and their cell's rate. An empty table gives none.
    targets: for each dimension a table (value, share) or a power that tempers present shares. topic: any column;
    without one the register of the text stands in.
    """
    tags = tagged(docs, topic)
    return sampled(tags, cell_rates(tags, targets, sweeps, keep), seed).where("_mx_kept").select(*docs.columns)


def mix_report(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, sweeps: int = SWEEPS, keep: float = KEEP, seed: str = "mix") -> DataFrame:
    """One row for each document: its cell, tokens, rate and whether ``mix`` keeps it. Texts are read once."""
    tags = write_table(tagged(docs, topic).select("doc_id", *[f"_mx_{d}" for d in DIMS], "_mx_tokens"), "mix-tags")
    out = sampled(tags, cell_rates(tags, targets, sweeps, keep), seed)
    return out.select("doc_id", *[F.col(f"_mx_{d}").alias(d) for d in DIMS], F.col("_mx_tokens").alias("n_tokens"), F.round("_mx_rate", 6).alias("rate"), F.col("_mx_kept").alias("kept"))


def shortfalls(docs: DataFrame, dim: str, target: DataFrame | float = TEMPER, topic: Column | None = None, keep: float = KEEP, **options) -> DataFrame:
    """value, have, share, wanted, goal and expected tokens of each value of a dimension, and what it lacks of its share.

    lacking is above 0 for values with too little data; goal less expected is what the raking left open.
    """
    tags = tagged(docs, topic)
    targets = {d: TEMPER for d in DIMS} | options.pop("targets", {}) | {dim: target}
    cells = cell_rates(tags, targets, keep=keep, **options)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    values = goals(cells, dim, target, keep * total, cells.count() <= FEW_CELLS)
    shares = values.agg(F.sum("share")).first()[0] or 1.0
    wanted = F.col("share") / shares * (keep * total)
    got = cells.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("rate")).alias("expected"))
    return values.join(got, dim).select(F.col(dim).alias("value"), "have", (F.col("share") / shares).alias("share"), wanted.alias("wanted"), "goal", "expected", F.greatest(F.lit(0.0), wanted - F.col("goal")).alias("lacking"))


def mix_sql(sweeps: int = SWEEPS, temper: float = TEMPER, keep: float = KEEP, seed: str = "mix") -> str:
    """The same as ``mix_report`` with default options, for DuckDB."""
    steps, last = [], "c0"
    for s in range(sweeps):
        for dim in DIMS:
            name = f"s{s}_{dim}"
            held = f"sum(tokens * rate) over (partition by {dim})"
            steps.append(f"{name} as (select * replace (case when {held} > 0 then least(1.0, rate * g_{dim} / {held}) else rate end as rate) from {last})")
            last = name
    # Values in the order in which they run out: the level rises as long as values are capped, and falls after.
    levels = ", ".join(
        f"""v_{d} as (select {d}, sum(tokens) as have, case when sum(tokens) > 0 then pow(sum(tokens), {temper}) else 0 end as share from cells group by {d}),
u_{d} as (select *, ({keep} * (select sum(have) from v_{d}) - coalesce(sum(have) over (order by have / share, {d} rows between unbounded preceding and 1 preceding), 0)) / sum(share) over (order by have / share, {d} rows between current row and unbounded following) as level from v_{d} where share > 0),
g_{d} as (select v_{d}.{d}, least(have, share * coalesce((select max(level) from u_{d}), 0)) as goal from v_{d})"""
        for d in DIMS
    )
    joined = " ".join(f"join g_{d} on g_{d}.{d} = cells.{d}" for d in DIMS)
    return f"""
with counted as (
  select doc_id, coalesce(text, '') as body, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as n_tokens
  from documents),
tagged as (
  select doc_id, source, lang, n_tokens,
         case when contains(body, '|') then 'table'
              when contains(body, '###') or contains(body, '$$$') or contains(body, '%%%') then 'noise'
              when contains(body, '@') or contains(body, '=') then 'records'
              when n_tokens < 150 then 'brief' else 'prose' end as topic
  from counted),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens from tagged group by all),
{levels},
c0 as (select cells.*, {keep}::double as rate, {', '.join(f'g_{d}.goal as g_{d}' for d in DIMS)} from cells {joined}),
{', '.join(steps)},
rates as (select source, lang, topic, rate as r from {last})
select doc_id, source, lang, topic, n_tokens::bigint as n_tokens, round(r, 6) as rate,
       ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {16**13}.0::double < r as kept
from tagged join rates using (source, lang, topic)
"""
