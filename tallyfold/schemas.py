"""Schemas and closed vocabularies of the fact layer."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the layer.
ESTIMATE_TYPES = ["actual", "provisional", "revised", "advance_estimate", "budget", "projection", "target", "scenario", "third_party", "unknown"]
FORWARD_LOOKING = ["budget", "projection", "target", "scenario"]
MEASURED = ["actual", "provisional", "revised", "advance_estimate", "unknown"]
VALUE_KINDS = ["number", "text", "range"]
QUOTE_SOURCES = ["text", "image"]
#: Verdicts, gravest first.
SEVERITY = ["contradicts", "unresolved", "superseded", "context_explained", "corroborates", "derived"]
DIMENSIONS = ["period", "estimate_type", "basis", "unit", "vintage", "attribution", "value", "none"]

_s, _d = T.StringType(), T.DoubleType()

#: A candidate fact as a model returns it.
CANDIDATE = T.StructType(
    [
        T.StructField(n, k)
        for n, k in [
            ("entity", _s), ("attribute", _s), ("value", _s), ("value_kind", _s), ("unit", _s), ("scale", _s), ("period", _s), ("period_start", _s),
            ("period_end", _s), ("estimate_type", _s), ("measurement_basis", _s), ("attributed_to", _s), ("quote", _s), ("quote_source", _s), ("confidence", _d), ("notes", _s),
        ]
    ]
)
#: A page's answer. Its facts stay text, so that one bad fact spoils only itself.
ENVELOPE = "page_kind string, facts array<string>, problems array<string>"

#: What a model says of a document.
DOCUMENT_META = T.StructType([T.StructField(n, _s) for n in ("title", "publisher", "publication_date", "document_type")] + [T.StructField("fiscal_year_start_month", T.IntegerType())])

#: What linking needs of a fact.
VIEW = ["id", "document_id", "entity_key", "attribute_key", "value_num", "unit", "period_key", "estimate_type", "basis_key", "attributed_to", "evidence_verified", "publication_date"]

RELATIONS = "fact_a_id long, fact_b_id long, verdict string, status string, method string, dimension string, hypothesis string, confidence double, winner_fact_id long, explanation string"
