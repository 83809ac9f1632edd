"""Model replies: decode, coerce, filter, and merge behind the rule findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions import variant as V
from hunkwise.functions.steps import computed_once
from hunkwise.schemas import SEVERITIES

MIN_CONFIDENCE = 0.70  # fixed value
UNREADABLE_SUMMARY = "Failed to parse LLM response."  # fixed value


# the fields read from an item; each stays a VARIANT, so that its JSON type is known
ITEM_DDL = """struct<file variant, line_start variant, line_end variant, symbol_name variant, severity variant,
    title variant, message variant, suggested_fix variant, confidence_score variant>"""


def decode_replies(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``reply_status``, ``summary`` and ``items`` (array of structs, NULL where an item is no object).

    ``ok``; ``not_json``: text that is no JSON; ``bad_shape``: JSON whose top level is no object or whose
    findings are no array. Replies that are not ``ok`` yield no items and go to :func:`quarantine`.
    """
    V.last_key_wins(responses)
    reply = F.try_parse_json(F.col(raw))
    parts = computed_once(responses, "reply", F.struct(
        reply.isNotNull().alias("is_json"),
        F.try_variant_get(reply, "$", "struct<summary variant, findings variant>").alias("top"),
        F.try_variant_get(reply, "$.findings", f"array<{ITEM_DDL}>").alias("items")))
    top, items = F.col("reply.top"), F.col("reply.items")
    ok_shape = top.isNotNull() & (top["findings"].isNull() | items.isNotNull())
    status = F.when(~F.col("reply.is_json"), "not_json").when(ok_shape, "ok").otherwise("bad_shape")
    return parts.withColumns({
        "reply_status": status,
        "summary": F.when(~F.col("reply.is_json"), UNREADABLE_SUMMARY)
        .when(ok_shape, F.coalesce(V.as_(top["summary"], "string"), F.lit(""))),
        "items": F.when(ok_shape, items),
    }).drop("reply")


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.where("reply_status <> 'ok'").drop("items")


def explode_items(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item with its place in the reply (``item_ord``). Items that are no objects are skipped."""
    return decoded.select(*keys, F.posexplode("items").alias("item_ord", "item")).where("item IS NOT NULL")


def _as_text(leaf: Column, default: str) -> Column:
    """Python's ``str()`` of the field: a missing key takes the default, null becomes ``None``."""
    return (
        F.when(leaf.isNull(), default)
        .when(V.is_null(leaf), "None")
        .when(V.kind(leaf) == "BOOLEAN", F.initcap(V.as_(leaf, "string")))
        .otherwise(V.as_(leaf, "string"))
    )


def severity(leaf: Column) -> Column:
    lowered = F.lower(V.as_(leaf, "string"))
    return F.when(lowered.isin([s[0] for s in SEVERITIES]), lowered).otherwise("medium")


def confidence(leaf: Column) -> Column:
    """Missing is 1.0; numbers, quoted numbers and booleans are read; anything else is null."""
    kind, quoted = V.kind(leaf), V.as_(leaf, "string")
    return (
        F.when(leaf.isNull(), F.lit(1.0))
        .when(V.is_number(kind), V.as_(leaf, "double"))
        .when(kind == "BOOLEAN", V.as_(leaf, "boolean").cast("double"))
        .when((kind == "STRING") & quoted.rlike(V.FLOAT_TEXT), F.trim(quoted).try_cast("double"))
    )


def _line_number(leaf: Column) -> Column:
    """Python's ``int()``: 12.7 is 12, ``"7"`` is 7, ``"12.7"`` and null are unreadable."""
    kind, quoted = V.kind(leaf), V.as_(leaf, "string")
    return (
        F.when(kind == "BIGINT", V.as_(leaf, "bigint"))
        .when(V.is_number(kind), V.as_(leaf, "double").cast("bigint"))
        .when(kind == "BOOLEAN", V.as_(leaf, "boolean").cast("bigint"))
        .when((kind == "STRING") & quoted.rlike(V.INTEGER_TEXT), F.trim(quoted).try_cast("bigint"))
    ).try_cast("int")


def line_start(item: Column) -> Column:
    leaf = item["line_start"]
    return F.when(leaf.isNull(), F.lit(1)).otherwise(_line_number(leaf))


def line_end(item: Column) -> Column:
    leaf = item["line_end"]
    return F.when(leaf.isNull(), line_start(item)).otherwise(_line_number(leaf))


def _is_text_or_null(leaf: Column) -> Column:
    return leaf.isNull() | V.is_null(leaf) | (V.kind(leaf) == "STRING")


def model_findings(items: DataFrame, keys: list[str]) -> DataFrame:
    """Typed findings of confidence 0.70 to 1; an item with an unreadable field is dropped alone."""
    item = F.col("item")
    typed = F.struct(
        _as_text(item["file"], "unknown").alias("file"),
        line_start(item).alias("line_start"),
        line_end(item).alias("line_end"),
        V.text(item["symbol_name"]).alias("symbol_name"),
        severity(item["severity"]).alias("severity"),
        _as_text(item["title"], "Review Finding").alias("title"),
        _as_text(item["message"], "").alias("message"),
        V.text(item["suggested_fix"]).alias("suggested_fix"),
        confidence(item["confidence_score"]).alias("confidence_score"),
    )
    readable = items.where(_is_text_or_null(item["suggested_fix"]) & _is_text_or_null(item["symbol_name"]))
    rows = computed_once(readable, "typed", typed).select(*keys, "item_ord", "typed.*")
    return rows.where(
        F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
        & F.col("confidence_score").between(MIN_CONFIDENCE, 1.0)
    )


def merge_findings(rule_findings: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Rule findings, then the model findings at places (file, line) no rule and no earlier item has taken.

    ``keys`` are the review and the category. The taken places come from one aggregation over both origins:
    it combines on the map side, so a place named by very many items does not gather anywhere.
    """
    place = [*keys, "file", "line_start"]
    rest = [c for c in model.columns if c not in place]
    taken = rule_findings.select(*place, F.lit(-1).alias("arrival"), *[
        F.lit(None).cast(model.schema[c].dataType).alias(c) for c in rest])
    seen = taken.unionByName(model.withColumn("arrival", F.col("item_ord")))
    first = seen.groupBy(*place).agg(
        F.min("arrival").alias("arrival"), F.min_by(F.struct(*rest), F.col("arrival")).alias("first"))
    kept = first.where("arrival >= 0").select(*place, *[F.col(f"first.{c}").alias(c) for c in rest])
    return rule_findings.unionByName(kept, allowMissingColumns=True)
