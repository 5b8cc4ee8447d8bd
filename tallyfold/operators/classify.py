"""The rule cascade for pairs of facts, and plausibility flags of single ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, values_equal
from ..functions.periods import UNKNOWN
from ..schemas import FORWARD_LOOKING, MEASURED, VIEW

SURE, UNSURE = 0.9, 0.5
#: What the rules read of a fact.
RULED = ["id", "unit", "value_num", "period_key", "estimate_type", "basis_key", "attributed_to", "evidence_verified", "publication_date"]


def _rule(verdict: str, final: bool, dimension: str, hypothesis: str, winner: Column | None = None) -> Column:
    return F.struct(
        F.lit(verdict).alias("verdict"),
        F.lit("final" if final else "pending_llm").alias("status"),
        F.lit(dimension).alias("dimension"),
        F.lit(hypothesis).alias("hypothesis"),
        F.lit(None).cast("long").alias("winner_fact_id") if winner is None else winner.alias("winner_fact_id"),
    )


def cascade(a, b) -> Column:
    """The first rule that holds for two comparable facts. ``a`` and ``b`` give columns by name."""
    equal = values_equal(a("value_num"), b("value_num"), a("unit"))
    both = lambda name, values: a(name).isin(*values) & b(name).isin(*values)
    either = lambda name, values: a(name).isin(*values) | b(name).isin(*values)
    dates = a("publication_date"), b("publication_date")
    newer = F.when(dates[0] > dates[1], a("id")).when(dates[0] < dates[1], b("id"))
    labels_differ = a("estimate_type") != b("estimate_type")
    bases_differ = (a("basis_key") != "") & (b("basis_key") != "") & (a("basis_key") != b("basis_key"))
    one_attributed = a("attributed_to").isNull() != b("attributed_to").isNull()
    return (
        F.when(either("period_key", [UNKNOWN]), _rule("unresolved", False, "period", "period of a fact is unclear"))
        .when(a("period_key") != b("period_key"), _rule("context_explained", True, "period", "values cover different periods"))
        .when(one_attributed & equal, _rule("corroborates", True, "attribution", "third-party figure matches"))
        .when(one_attributed, _rule("unresolved", False, "attribution", "attributed figure differs from first-party"))
        .when(labels_differ & equal, _rule("corroborates", True, "estimate_type", "same value despite different labels"))
        .when(labels_differ & either("estimate_type", FORWARD_LOOKING), _rule("context_explained", True, "estimate_type", "forecast or budget vs measurement"))
        .when(labels_differ & newer.isNotNull() & both("estimate_type", MEASURED), _rule("superseded", True, "vintage", "later publication revises the period", newer))
        .when(labels_differ, _rule("superseded", False, "vintage", "revision suspected; publication order unclear"))
        .when(bases_differ & equal, _rule("corroborates", False, "basis", "measurement bases differ"))
        .when(bases_differ, _rule("unresolved", False, "basis", "measurement bases differ"))
        .when(equal, _rule("corroborates", True, "none", "same period, basis and value"))
        .otherwise(_rule("contradicts", False, "value", "same period and basis, values differ"))
    )


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Relations of pairs of facts, given as a_ and b_ columns of RULED. Pairs that cannot be compared give none.

    A relation is half as sure unless both facts' evidence is verified.
    """
    a, b = (lambda p: lambda name: F.col(f"{p}_{name}"))("a"), (lambda p: lambda name: F.col(f"{p}_{name}"))("b")
    fit = pairs.where((a("unit") == b("unit")) & a("value_num").isNotNull() & b("value_num").isNotNull())
    ruled = fit.withColumn("_rule", cascade(a, b))
    sure = F.when(F.col("_rule.status") == "final", SURE).otherwise(UNSURE)
    verified = a("evidence_verified") & b("evidence_verified")
    return ruled.select(
        a("id").alias("fact_a_id"),
        b("id").alias("fact_b_id"),
        "_rule.verdict",
        "_rule.status",
        F.lit("rule").alias("method"),
        "_rule.dimension",
        "_rule.hypothesis",
        F.when(verified, sure).otherwise(sure / 2).alias("confidence"),
        "_rule.winner_fact_id",
    )


def as_pairs(ids: DataFrame, facts: DataFrame, columns: list[str] = VIEW) -> DataFrame:
    """Pairs (a_id, b_id) with both facts' columns."""
    for p in ("a", "b"):
        ids = ids.join(facts.select(*[F.col(c).alias(f"{p}_{c}") for c in columns]), f"{p}_id")
    return ids


def plausibility_flags(estimate_type: Column, unit: Column, value: Column, period_end: Column, publication: Column, known_scale: Column) -> Column:
    """Flags of a fact, in fixed order; they are shown and reject nothing."""
    late = estimate_type.isin(*MEASURED) & (period_end > F.date_add(publication, 31))
    flags = [
        F.when(late, "period_after_publication"),
        F.when((unit == "percent") & (F.abs(value) > 1000), "percent_out_of_range"),
        F.when(unit.isin(*MONEY) & ~known_scale, "scale_missing_for_currency"),
    ]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())
