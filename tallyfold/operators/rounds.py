"""Requests that are asked again: with half the facts where an answer overflowed, and once more with the error where it was malformed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENVELOPE
from ..sources.memo import request_key
from ..tables import stored

#: The facts that a page may be asked for at first and at least, and what an error says if an answer was too long.
MOST_FACTS, LEAST_FACTS, OVERFLOW = 40, 3, "tool_use_failed"
MALFORMED, REDUCED = "llm_json", "fact_cap_reduced"


def envelope_error(response: Column) -> Column:
    """What is wrong with a page's answer, null if it can be read."""
    read = F.from_json(response, ENVELOPE)
    return F.when(read.getField("facts").isNull(), "facts: a list is missing")


def worded(request: Column | str, cap: Column | str, previous: Column | str, wrong: Column | str) -> Column:
    """The text of a call: the request, how many facts it may give, and the answer before with its error if that was malformed."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    again = F.when(c(wrong).isNotNull(), F.concat(F.lit("\nthe answer before was not valid: "), c(wrong), F.lit("\nit was: "), F.coalesce(c(previous), F.lit(""))))
    return F.concat(c(request), F.lit("\nat most "), c(cap).cast("string"), F.lit(" facts"), F.coalesce(again, F.lit("")))


def asked_in_rounds(requests: DataFrame, ask: Callable[[DataFrame], DataFrame], wrong: Callable[[Column], Column] = envelope_error, most: int = MOST_FACTS, least: int = LEAST_FACTS) -> DataFrame:
    """All columns of ``requests`` (request, model, purpose and whatever names a row) with response, error, cap and calls.

    ask: what ``memo.answers`` makes of (key, model, purpose, request and more columns): the same rows with response and error, equal ones asked once. Each round asks all that is open at once
    and is stored, so a lost executor repeats a round and no earlier one. An answer that overflowed is asked for half as many facts, down to
    ``least``, from the start; a malformed one once more with its error, then it is llm_json. Other errors end a row as they are. As the cap halves
    and a cap has two calls at most, rounds are few and known before.
    """
    own = requests.columns
    aside = [c for c in own if c in ("key", "request")]
    state = {"_cap": F.lit(most), "_calls": F.lit(0), "_wrong": F.lit(None).cast("string"), "_previous": F.lit(None).cast("string")}
    open_rows, done, caps = requests.withColumns(state), None, [most]
    while caps[-1] > least:
        caps.append(max(least, caps[-1] // 2))
    for _ in range(2 * len(caps)):
        # The rows are the calls, so they are shuffled once a round; a call's text goes to the model only.
        named = open_rows.withColumnsRenamed({c: f"_own_{c}" for c in aside}).withColumn("request", worded("_own_request", "_cap", "_previous", "_wrong")).drop("_previous")
        told = ask(named.withColumn("key", request_key(F.col("purpose"), F.col("request")))).withColumnsRenamed({"response": "_response", "error": "_error"})
        both = told.drop("key", "request").withColumnsRenamed({f"_own_{c}": c for c in aside})
        overflow = F.coalesce(F.col("_error").contains(OVERFLOW), F.lit(False))
        bad = F.when(F.col("_error").isNull(), wrong(F.col("_response")))
        again = (overflow & (F.col("_cap") > least)) | (bad.isNotNull() & F.col("_wrong").isNull())
        both = stored(both.withColumns({"_overflow": overflow, "_bad": bad, "_again": again, "_calls": F.col("_calls") + 1}), "round")
        ended = both.where("not _again").select(*own, F.when(F.expr("_error is null and _bad is null"), F.col("_response")).alias("response"), F.coalesce("_error", F.when(F.col("_bad").isNotNull(), MALFORMED)).alias("error"), F.col("_cap").alias("cap"), F.col("_calls").alias("calls"))
        done = ended if done is None else done.unionByName(ended)
        smaller = F.greatest(F.lit(least), F.floor(F.col("_cap") / 2)).cast("int")
        open_rows = both.where("_again").select(*own, F.when(F.col("_overflow"), smaller).otherwise(F.col("_cap")).alias("_cap"), "_calls", F.when(~F.col("_overflow"), F.col("_bad")).alias("_wrong"), F.when(~F.col("_overflow"), F.col("_response")).alias("_previous"))
        if open_rows.limit(1).count() == 0:
            break
    return done


def reduced_failures(asked: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """Failures of pages (document_id, page_index) whose answers came with a smaller cap, and may so lack facts."""
    some = asked.where((F.col("cap") < most) & F.col("response").isNotNull())
    handled = F.concat(F.lit("asked again for "), F.col("cap").cast("string"), F.lit(" facts at most; the page may hold more"))
    return some.select("document_id", "page_index", F.lit("extract").alias("stage"), F.lit(REDUCED).alias("kind"), F.lit("the answer was longer than a model may give").alias("message"), handled.alias("handled"))
