"""Human edits: overlay on the master table, merge, upsert and diff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import schemas
from hireatlas.functions.text import filled, ordered_tags, sorted_tags
from hireatlas.operators.filters import FilterSpec, describe, predicate

FIELDS = schemas.EDIT_FIELDS


def latest_per_id(overlay: DataFrame) -> DataFrame:
    """One overlay row per id: the one updated last."""
    order = F.struct(F.coalesce("updated_at", F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS])
    columns = [c for c in overlay.columns if c != "business_id"]
    picked = overlay.groupBy("business_id").agg(F.max_by(F.struct(*columns), order).alias("_o"))
    return picked.select("business_id", "_o.*")


def apply_overlay(master: DataFrame, overlay: DataFrame) -> DataFrame:
    """Effective view: overlay values win where present; effective industry and tags are derived."""
    edits = latest_per_id(overlay).select("business_id", *[F.col(c).alias(f"_o_{c}") for c in FIELDS])
    joined = master.join(edits, "business_id", "left")

    def pick(name: str) -> Column:
        base = F.col(name) if name in master.columns else F.lit(None)
        return F.coalesce(F.col(f"_o_{name}"), base)

    out = joined.withColumns({c: pick(c) for c in FIELDS if c != "hide_flag"} | {"hide_flag": F.coalesce(pick("hide_flag"), F.lit(False))})
    base_industry = F.col("industry") if "industry" in master.columns else F.lit("")
    base_tags = F.col("tags") if "tags" in master.columns else F.lit(None).cast("string")
    tags = F.array_except(F.array_union(sorted_tags(base_tags), sorted_tags("tags_add")), sorted_tags("tags_remove"))
    return out.withColumns(
        {
            "industry_effective": F.coalesce(F.when(filled("industry_override").isNotNull(), F.col("industry_override")), base_industry),
            "tags_effective": F.array_sort(tags),
        }
    ).drop(*[f"_o_{c}" for c in FIELDS])


def view_meta(
    master: DataFrame, overlay: DataFrame, spec: FilterSpec, date_master: str | None = None, date_diff: str | None = None
) -> DataFrame:
    """One row: table sizes before and after the filter, snapshot dates and whether they differ."""
    view = apply_overlay(master, overlay)
    counted = view.agg(F.count("*").alias("rows_master"), F.count_if(predicate(spec, view.columns)).alias("rows_filtered"))
    return counted.select(
        "rows_master",
        overlay.agg(F.count("*")).scalar().alias("rows_curation"),
        "rows_filtered",
        F.lit(date_master).cast("string").alias("date_master"),
        F.lit(date_diff).cast("string").alias("date_diff"),
        F.lit(bool(date_master and date_diff and date_master != date_diff)).alias("mismatch"),
        F.lit("; ".join(describe(spec))).alias("active_filters"),
    )


def merge_edits(batches: list[DataFrame]) -> DataFrame:
    """One edit per id out of ordered batches; the last batch that has a field decides it.

    A batch carries ``present``, the array of field names that were really edited.
    """
    tagged = [b.withColumn("_seq", F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(DataFrame.unionByName, tagged).where(filled("business_id").isNotNull())

    def last(name: str) -> Column:
        # A null sequence number is ignored by max_by, so only batches with the field compete.
        return F.max_by(name, F.when(F.array_contains("present", name), F.col("_seq"))).alias(name)

    return rows.groupBy(filled("business_id").alias("business_id")).agg(
        *[last(f) for f in FIELDS], F.array_sort(F.array_distinct(F.flatten(F.collect_set("present")))).alias("present")
    )


def upsert(overlay: DataFrame, edits: DataFrame, *, source_master: str | None, updated_by: str, updated_at: str | None = None) -> DataFrame:
    """Overlay with the edits applied: an edited id gets all six fields, other rows stay.

    Of several edits of an id the last one by ``seq`` counts; without that column, the greatest row.
    """
    whole = F.struct(*FIELDS)
    known = edits.withColumn("business_id", filled("business_id"))
    rank = F.struct("seq", whole) if "seq" in edits.columns else whole
    edits = known.groupBy("business_id").agg(F.max_by(whole, rank).alias("_e")).select("business_id", "_e.*")
    new = edits.where(filled("business_id").isNotNull()).select(
        filled("business_id").alias("business_id"),
        *[F.array_join(ordered_tags(f), ";").alias(f"_e_{f}") if f.startswith("tags_") else F.col(f).alias(f"_e_{f}") for f in FIELDS],
        F.lit(True).alias("_edited"),
    )
    joined = overlay.join(new, "business_id", "full")
    edited = F.coalesce("_edited", F.lit(False))

    def chosen(name: str) -> Column:
        return F.when(edited, F.col(f"_e_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(
        "business_id",
        *[chosen(f) for f in FIELDS],
        F.when(edited & F.lit(updated_at).isNotNull(), F.lit(updated_at)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(edited, F.lit(updated_by)).otherwise(F.col("updated_by")).alias("updated_by"),
        F.when(edited, F.coalesce(F.lit(source_master), "source_master")).otherwise(F.col("source_master")).alias("source_master"),
    )


def edit_diff_rows(before: DataFrame, after: DataFrame, key: str = "business_id", fields: list[str] | None = None) -> DataFrame:
    """Ids in both tables with the list of fields that differ; unchanged ids are left out."""
    names = fields or FIELDS
    pairs = before.select(key, F.struct(*names).alias("_b")).join(after.select(key, F.struct(*names).alias("_a")), key)
    changed = [F.when(~F.col(f"_b.{f}").eqNullSafe(F.col(f"_a.{f}")), F.lit(f)) for f in names]
    return pairs.select(key, F.array_compact(F.array(*changed)).alias("changed_fields")).where(F.size("changed_fields") > 0)


def edit_diff(before: DataFrame, after: DataFrame, key: str = "business_id", fields: list[str] | None = None) -> DataFrame:
    """One row: changes per field and changed rows."""
    names = fields or FIELDS
    rows = edit_diff_rows(before, after, key, names)
    return rows.agg(
        *[F.count_if(F.array_contains("changed_fields", f)).alias(f) for f in names], F.count("*").alias("changed_rows_count")
    )


def edit_examples(before: DataFrame, after: DataFrame, key: str = "business_id", limit: int = 5) -> DataFrame:
    return edit_diff_rows(before, after, key).orderBy(key).limit(limit)
