"""Comparing shapes and deciding whether a run may write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.model import DEFAULT_DRIFT, DRIFT_POLICIES
from harvestline.operators.resume import RUN


def shape_diff(observed: DataFrame, accepted: DataFrame) -> DataFrame:
    """What each run's shape added, removed and changed.

    ``observed``: ``(source_id, run_id, path, type)``; ``accepted``:
    ``(source_id, path, type)``.  A run that observed nothing is not compared.
    """
    runs = observed.select(*RUN).distinct()
    before = runs.join(accepted, "source_id").select(
        *RUN, "path", F.col("type").alias("old"), F.lit(1).alias("was")
    )
    now = observed.select(*RUN, "path", F.col("type").alias("new"))
    both = now.join(before, [*RUN, "path"], "full_outer")
    new, old, path = F.col("new"), F.col("old"), F.col("path")
    changed = F.concat(path, F.lit("("), old, F.lit("->"), new, F.lit(")"))
    return both.groupBy(*RUN).agg(
        F.sort_array(F.collect_list(F.when(old.isNull(), path))).alias("added"),
        F.sort_array(F.collect_list(F.when(new.isNull(), path))).alias("removed"),
        F.sort_array(F.collect_list(F.when(old != new, changed))).alias("changed"),
        F.count("was").alias("accepted_paths"),
    )


def is_empty(added: Column, removed: Column, changed: Column) -> Column:
    """P1"""
    return (F.size(added) == 0) & (F.size(removed) == 0) & (F.size(changed) == 0)


def is_breaking(removed: Column, changed: Column) -> Column:
    """A removed or retyped field breaks, a new one does not."""
    return (F.size(removed) > 0) | (F.size(changed) > 0)


def change_text(added: Column, removed: Column, changed: Column) -> Column:
    """``added a,b; removed c; changed d(x->y)``, empty parts left out."""

    def part(word: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{word} "), F.array_join(names, ",")))

    return F.concat_ws(
        "; ", part("added", added), part("removed", removed), part("changed", changed)
    )


def judge(diff: DataFrame, policies: DataFrame) -> DataFrame:
    """Verdict per run: ``accept``, ``warn`` or ``reject`` with its error.

    ``policies``: ``(source_id, drift)``.  A source with nothing accepted yet
    never drifts.  An unknown policy is refused once there is a change to judge.
    """
    joined = diff.join(policies, "source_id", "left")
    added, removed, changed = F.col("added"), F.col("removed"), F.col("changed")
    empty = is_empty(added, removed, changed)
    breaking = is_breaking(removed, changed)
    policy = F.coalesce(F.col("drift"), F.lit(""))
    text = change_text(added, removed, changed)
    verdict = (
        F.when(empty | (F.col("accepted_paths") == 0) | policy.isin("", "Ignore"), "accept")
        .when(policy == "Warn", "warn")
        .when((policy == "EvolveAdditive") & ~breaking, "accept")
        .otherwise("reject")
    )
    judged = joined.select(
        *diff.columns,
        policy.alias("drift"),
        empty.alias("unchanged"),
        breaking.alias("breaking"),
        text.alias("change_text"),
        verdict.alias("verdict"),
    )
    # What a refused run says.
    error = F.when(
        F.col("verdict") == "reject",
        F.when(
            F.col("drift") == "EvolveAdditive",
            F.concat(
                F.lit("record shape changed in a non-additive way: "), F.col("change_text")
            ),
        )
        .when(F.col("drift") == "Fail", F.concat(F.lit("record shape changed: "), F.col("change_text")))
        .otherwise(F.format_string('unsupported schema drift policy "%s"', F.col("drift"))),
    )
    # End of fixed values.
    return judged.withColumn("drift_error", error)


def policies(specs: DataFrame) -> DataFrame:
    """Drift policy of each source with the default filled in."""
    return specs.select(
        "source_id",
        F.coalesce(F.nullif(F.col("drift"), F.lit("")), F.lit(DEFAULT_DRIFT)).alias("drift"),
    )


def known_policy(policy: Column) -> Column:
    return policy.isin(*DRIFT_POLICIES)


def adopt_shape(
    accepted: DataFrame, observed: DataFrame, succeeded: DataFrame, keys: Sequence[str] = RUN
) -> DataFrame:
    """A successful run's non-empty shape replaces the accepted one, whatever the policy.

    ``succeeded``: ``(source_id, run_id)``, at most one run a source.  Sources
    that succeeded with no records keep what they had.
    """
    winners = observed.join(succeeded.select(*keys), list(keys), "left_semi").select(
        "source_id", "path", "type"
    )
    kept = accepted.join(winners.select("source_id").distinct(), "source_id", "left_anti")
    return kept.select("source_id", "path", "type").unionByName(winners)


def parse_accepted(documents: DataFrame) -> DataFrame:
    """P10: accepted shapes out of stored JSON ``{"fields": {path: type}}``.

    A missing or corrupt document counts as nothing accepted.
    """
    fields = F.from_json("document", "struct<fields:map<string,string>>")["fields"]
    return documents.select("source_id", F.explode(fields).alias("path", "type"))


def format_accepted(accepted: DataFrame) -> DataFrame:
    """Accepted shapes as one JSON document a source, the inverse of ``parse_accepted``."""
    return accepted.groupBy("source_id").agg(
        F.to_json(
            F.struct(
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "type")))).alias(
                    "fields"
                )
            )
        ).alias("document")
    )
