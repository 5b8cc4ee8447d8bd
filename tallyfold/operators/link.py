"""Linking facts across documents: rules, tie-outs, and recorded judgements of what rules leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DIMENSIONS, VIEW
from ..tables import stored
from .block import MOST_PARTNERS, build_candidates, candidates_of, paired
from .classify import RULED, as_pairs, classify_pairs
from .postings import Index, candidates, groups
from .tieout import arithmetic_edges, derived_relations

PAIR = ["fact_a_id", "fact_b_id"]
MOST_ATTEMPTS = 3


def fact_views(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """The slice that linking reads: no duplicates, no facts without a number, with publication dates."""
    some = facts.where(~F.coalesce("is_duplicate", F.lit(False)) & F.col("value_num").isNotNull())
    dated = some.drop("publication_date").join(documents.select("document_id", "publication_date"), "document_id")
    return dated.select(*VIEW)


def rule_pass(views: DataFrame, unpaired: DataFrame, existing: DataFrame, most: int | None = MOST_PARTNERS) -> DataFrame:
    """New relations of the facts in ``unpaired`` (id) with all facts of ``views``.

    Pairs in ``existing`` are left as they are, so a second pass adds nothing and a new document pairs only its own facts. A
    rule's relation comes before a tie-out's for the same pair. Old facts are read, but paired only as far as the
    cap of new facts' partners asks for, and only groups with a new fact are tied out.
    """
    new = unpaired.select("id")
    old = existing.select(*PAIR)
    if not views.join(new, "id", "left_anti").limit(1).count():
        new = None
    if most is None:
        rows = paired(views, RULED, new)
    else:
        pairs = build_candidates(views, most) if new is None else candidates_of(views, new, most)
        rows = as_pairs(stored(pairs.select("a_id", "b_id"), "candidates"), views, RULED)  # stored, so that few pairs do not have all facts shuffled
    if new is not None:  # only relations of new facts can be among those that are made; mostly there are none yet
        either = [old.join(new.select(F.col("id").alias(c)), c, "left_semi") for c in PAIR]
        old = stored(either[0].unionByName(either[1]), "related")
    related = old.limit(1).count() > 0
    if related:
        rows = rows.join(old.select(F.col("fact_a_id").alias("a_id"), F.col("fact_b_id").alias("b_id")), ["a_id", "b_id"], "left_anti")
    ruled = classify_pairs(rows).withColumn("explanation", F.col("hypothesis"))
    derived = derived_relations(arithmetic_edges(views, new))
    derived = stored(derived.join(old, PAIR, "left_anti") if related else derived, "derived")
    if derived.limit(1).count():
        ruled = stored(ruled, "ruled")
        derived = derived.join(ruled.select(*PAIR), PAIR, "left_anti")
    return ruled.unionByName(derived)


def indexed_rule_pass(index: Index, new: DataFrame, live: DataFrame, most: int | None = MOST_PARTNERS) -> DataFrame:
    """The relations of ``rule_pass`` for new facts (VIEW) that an index holds already, from the facts of their entities and groups alone."""
    pairs, facts = candidates(index, new, live, most)
    ruled = classify_pairs(as_pairs(pairs.select("a_id", "b_id"), facts, RULED)).withColumn("explanation", F.col("hypothesis"))
    derived = derived_relations(arithmetic_edges(stored(groups(index, new, live), "groups"), new))
    return ruled.unionByName(derived.join(ruled.select(*PAIR), PAIR, "left_anti"))


def adjudicate(relations: DataFrame, judgements: DataFrame, facts: DataFrame) -> DataFrame:
    """Open relations settled by recorded judgements; all columns of ``relations`` and attempts.

    judgements: fact_a_id, fact_b_id, verdict, dimension, explanation, confidence, winner ("a", "b" or "none") and error (null if there
    is a verdict). A relation without a judgement stays open and spends no attempt. An error spends one; at
    MOST_ATTEMPTS the relation has failed and keeps the rules' verdict. Confidence is halved unless both
    facts are verified. A dimension outside the vocabulary is "none".
    """
    verified = lambda p: facts.select(F.col("id").alias(f"fact_{p}_id"), F.col("evidence_verified").alias(f"_v{p}"))
    told = judgements.select(*PAIR, *[F.col(c).alias(f"_j_{c}") for c in ("verdict", "dimension", "explanation", "confidence", "winner", "error")], F.lit(True).alias("_j"))
    rows = relations if "attempts" in relations.columns else relations.withColumn("attempts", F.lit(0))
    # Only open relations meet judgements and facts; the others stay as they are.
    closed = rows.where(~F.coalesce(F.col("status") == "pending_llm", F.lit(False)))
    rows = rows.where("status = 'pending_llm'").join(told, PAIR, "left").join(verified("a"), "fact_a_id", "left").join(verified("b"), "fact_b_id", "left")
    waiting = (F.col("status") == "pending_llm") & F.col("_j").isNotNull()
    settled, failed = waiting & F.col("_j_error").isNull(), waiting & F.col("_j_error").isNotNull()
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    sure = F.col("_j_confidence") / F.when(F.coalesce(F.col("_va") & F.col("_vb"), F.lit(False)), 1).otherwise(2)
    winner = F.when(F.col("_j_winner") == "a", F.col("fact_a_id")).when(F.col("_j_winner") == "b", F.col("fact_b_id"))
    new = {
        "verdict": F.col("_j_verdict"),
        "dimension": F.when(F.col("_j_dimension").isin(*DIMENSIONS), F.col("_j_dimension")).otherwise("none"),
        "explanation": F.col("_j_explanation"),
        "confidence": sure,
        "winner_fact_id": winner,
        "method": F.lit("llm"),
        "status": F.lit("final"),
    }
    out = {c: F.when(settled, v).otherwise(F.col(c)) for c, v in new.items()}
    out["status"] = F.when(settled, "final").when(failed & (attempts >= MOST_ATTEMPTS), "failed").otherwise(F.col("status"))
    columns = [*relations.columns, *([] if "attempts" in relations.columns else ["attempts"])]
    return closed.select(*columns).unionByName(rows.withColumns(out | {"attempts": attempts}).select(*columns))


def counts_by(relations: DataFrame, *columns: str) -> DataFrame:
    return relations.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
