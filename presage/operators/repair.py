"""Lenient reading of extraction records: what can be mended is, the rest costs one field, never the row.

A record is JSON text with a list of predictions. Records, predictions and
nested objects may be wrapped in a lone "properties" object or written as JSON
once more inside a string. The reading is one projection over VARIANT values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The words each field may hold
ALLOWED = {
    "report_kind": ("level", "change"),
    "tone": ("approve", "neutral", "alarm"),
    "evidence_class": ("reported_fact", "cited_probability", "cited_share", "reporting", "opinion"),
    "consensus_view": ("expects_yes", "expects_no", "divided"),
    "level": ("high", "medium", "low"),
    "trap": ("negation", "numeric_comparison", "entity_or_event_mismatch", "tone_vs_content", "inference_needed", "conflicting_signals"),
}


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a VARIANT; null for a missing or null value."""
    return F.nullif(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit("VOID"))


def part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def mended(rows: DataFrame, source: str, target: str, unwrap: bool = True) -> DataFrame:
    """``target``: the value read from JSON text inside a string, if that is an object, and the inner object of a lone "properties" object; any other value as it is."""
    text = F.when(kind(F.col(source)) == "STRING", F.try_parse_json(F.try_variant_get(source, "$", "string")))
    rows = rows.withColumn("_text", text).withColumn("_plain", F.when(kind(F.col("_text")) == "OBJECT", F.col("_text")).otherwise(F.col(source)))
    if not unwrap:
        return rows.withColumn(target, F.col("_plain")).drop("_text", "_plain")
    alone = (kind(F.col("_plain")) == "OBJECT") & (F.size(F.map_keys(F.try_variant_get("_plain", "$", "map<string,variant>"))) == 1)
    rows = rows.withColumn("_inner", F.when(alone, part(F.col("_plain"), "properties")))
    return rows.withColumn(target, F.when(kind(F.col("_inner")) == "OBJECT", F.col("_inner")).otherwise(F.col("_plain"))).drop("_text", "_plain", "_inner")


def word(v: Column, k: Column, allowed: Sequence[str]) -> Column:
    """One of the allowed words, or null; ``k`` is the value's kind."""
    text = F.when(k == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(text.isin(*allowed), text)


def number(v: Column, k: Column) -> Column:
    """A number, or a string that reads as one; else null."""
    return F.when(~k.isin("OBJECT", "ARRAY"), F.try_variant_get(v, "$", "double"))


def repaired_predictions(rows: DataFrame, key: str, raw: str, numbers: Sequence[str] = ("stance", "certainty"),
                         words: Sequence[str] = ("tone", "evidence_class", "report_kind")) -> DataFrame:
    """One row per prediction: its fields, ``faults`` (fields given up) and ``mended`` (fields or levels read in spite of damage).

    A record that is no JSON object, or whose predictions are no list, gives one
    row with a null ``pos`` and the fault "record" or "predictions"; an empty
    list gives none. A prediction that is no object keeps its row with the
    fault "prediction". JSON with a repeated key counts as no JSON.
    """
    v = mended(rows.select(key, F.try_parse_json(raw).alias("_raw")), "_raw", "_v")
    v = v.withColumn("_list", part(F.col("_v"), "predictions")).withColumns({
        "_record": F.coalesce(kind(F.col("_v")) == "OBJECT", F.lit(False)), "_listed": F.coalesce(kind(F.col("_list")) == "ARRAY", F.lit(False))})
    each = F.when(F.col("_listed"), F.try_variant_get("_v", "$.predictions", "array<variant>")).otherwise(F.array(F.lit(None).cast("variant")))
    v = v.select(key, "_raw", "_v", "_record", "_listed", F.posexplode_outer(each).alias("_pos", "_p")).filter("not _listed or _pos is not null")
    v = mended(v, "_p", "_q")
    p, record, has_list = F.col("_q"), F.col("_record"), F.col("_listed")
    # every value and its kind is a column before it is looked at, as each is looked at many times
    names = [*numbers, *words]
    v = v.withColumns({"_f_consensus_view": part(F.col("_v"), "consensus_view"), "_nested": part(p, "reader_confidence"), **{f"_f_{n}": part(p, n) for n in names}})
    v = mended(v, "_nested", "_c", unwrap=False)
    v = v.withColumns({f"_f_{n}": part(F.col("_c"), n) for n in ("level", "trap")})
    v = v.withColumns({"_object": F.coalesce(kind(p) == "OBJECT", F.lit(False)), "_k_c": kind(F.col("_c")), "_k_nested": kind(F.col("_nested")),
                       **{f"_k_{n}": kind(F.col(f"_f_{n}")) for n in ("consensus_view", "level", "trap", *names)}})
    of = lambda n: (F.col(f"_f_{n}"), F.col(f"_k_{n}"))
    v = v.withColumns({f"_w_{n}": word(*of(n), ALLOWED[n]) for n in ("consensus_view", "level", "trap", *words)} | {f"_w_{n}": number(*of(n)) for n in numbers})
    fault: Callable[[str], Column] = lambda n: F.col(f"_k_{n}").isNotNull() & F.col(f"_w_{n}").isNull()
    v = v.withColumn("_sure", F.coalesce(F.col("_k_c") == "OBJECT", F.lit(False)) & F.col("_w_level").isNotNull() & ~fault("trap"))
    named: Callable[[Mapping[str, Column]], Column] = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    faults = {"record": ~record, "predictions": record & ~has_list, "prediction": has_list & ~F.col("_object")}
    faults |= {n: fault(n) for n in ("consensus_view", *names)} | {"reader_confidence": F.col("_k_c").isNotNull() & ~F.col("_sure")}
    changed: Callable[[Column, Column], Column] = lambda a, b: F.coalesce(F.to_json(a) != F.to_json(b), F.lit(False))
    amended = {"record": record & changed(F.col("_raw"), F.col("_v")), "prediction": F.col("_object") & changed(F.col("_p"), p)}
    amended |= {n: (F.col(f"_k_{n}") == "STRING") & F.col(f"_w_{n}").isNotNull() for n in numbers}
    amended["reader_confidence"] = (F.col("_k_nested") == "STRING") & F.col("_sure")
    confidence = F.when(F.col("_sure"), F.struct(F.col("_w_level").alias("level"), F.col("_w_trap").alias("trap")))
    return v.select(key, F.when(has_list, F.col("_pos")).alias("pos"), F.col("_w_consensus_view").alias("consensus_view"), *[F.col(f"_w_{n}").alias(n) for n in names],
                    confidence.alias("reader_confidence"), named(faults).alias("faults"), named(amended).alias("mended"))
