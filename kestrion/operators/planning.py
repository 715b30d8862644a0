"""Query plans: validation, overrides, parsing of a planner's reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kestrion.functions import text
from kestrion.functions.jsontext import first_object

#: The domains of the two enumerations.
DOC_TYPES = ("contract", "plan", "convention", "meta")
LANGUAGES = ("go", "rust", "scala", "proto", "openapi", "helm", "markdown", "unknown")
LISTS = ("projects", "type_names", "topics", "doc_types", "languages")
REPLY = "skip BOOLEAN, " + ", ".join(f"{x} ARRAY<STRING>" for x in LISTS)


def known_values(values: Column, domain: tuple[str, ...]) -> Column:
    """Trimmed, lower-cased values of the domain, in order; others dropped."""
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), text.label_value)
    return F.filter(cleaned, lambda x: x.isin(*domain))


def sanitize(plans: DataFrame, doc_types: tuple[str, ...] = DOC_TYPES, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    return plans.withColumn("doc_types", known_values(F.col("doc_types"), doc_types)).withColumn("languages", known_values(F.col("languages"), languages))


def override(plans: DataFrame, overrides: DataFrame) -> DataFrame:
    """Plans with each list replaced by the override's of the same query, where that isn't empty."""
    o = overrides.select("query_id", *(F.col(x).alias(f"__{x}") for x in LISTS))
    joined = plans.join(o, "query_id", "left")
    for x in LISTS:
        joined = joined.withColumn(x, F.when(F.size(f"__{x}") > 0, F.col(f"__{x}")).otherwise(F.col(x)))
    return joined.drop(*(f"__{x}" for x in LISTS))


def parse_replies(replies: DataFrame) -> DataFrame:
    """query_id, status (ok, skip or malformed) and the lists from (query_id, reply): the first JSON object in the reply; `skip` wins over any list."""
    parsed = replies.withColumn("__json", first_object(F.col("reply"))).withColumn("__plan", F.from_json("__json", REPLY, {"mode": "PERMISSIVE"}))
    broken = F.col("__json").isNull() | F.from_json("__json", "MAP<STRING,STRING>").isNull()
    skip = F.coalesce(F.col("__plan.skip"), F.lit(False))
    out = parsed.withColumn("status", F.when(broken, "malformed").when(skip, "skip").otherwise("ok"))
    empty = F.array().cast("array<string>")
    return sanitize(out.select("query_id", "status", *(F.when(F.col("status") == "ok", F.coalesce(F.col(f"__plan.{x}"), empty)).otherwise(empty).alias(x) for x in LISTS)))


def parse_classifications(replies: DataFrame) -> DataFrame:
    """path, doc_type, language, error from (path, reply): an unknown document type is an error, an unknown language is `unknown`."""
    parsed = replies.withColumn("__json", first_object(F.col("reply"))).withColumn("__c", F.from_json("__json", "doc_type STRING, language STRING"))
    doc_type, language = text.label_value(F.col("__c.doc_type")), text.label_value(F.col("__c.language"))
    good = F.coalesce(doc_type.isin(*DOC_TYPES), F.lit(False))
    error = F.when(F.col("__json").isNull(), "no JSON object in the reply").when(~good, F.concat(F.lit("unknown document type: "), F.coalesce(doc_type, F.lit("none"))))
    return parsed.select("path", F.when(good, doc_type).alias("doc_type"), F.when(good, F.when(language.isin(*LANGUAGES), language).otherwise("unknown")).alias("language"), error.alias("error"))
