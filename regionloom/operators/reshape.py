"""Moving values between boundary versions through a weighted crosswalk.

Data rows are added up by code before anything joins them, so a code that most rows share costs one
row. A crosswalk's rows are packed per source code (its fan-out is small) and joined once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_cell, not_blank, number_text, strict_double

NO_TARGET = "no target in the crosswalk"
NO_WEIGHTS = "split without weights: choose a rule (area, population…)"
BAD_SUM = "weights do not sum to 1"


@dataclass
class Reshaped:
    rows: DataFrame  # code, values...
    conflicts: DataFrame  # from, targets, reason, n_rows
    summary: DataFrame  # direct, weighted, conflicts


def crosswalk_rows(table: DataFrame, from_column: str, to_column: str, weight_column: str | None = None) -> DataFrame:
    """(from, to, weight) of a text table; rows without both codes go, a bad weight fails."""
    weight = F.lit(None).cast("double")
    if weight_column:
        raw = not_blank(F.col(weight_column))
        value = strict_double(raw)
        bad = raw.isNotNull() & value.isNull()
        weight = F.when(bad, F.raise_error(F.concat(F.lit("weight is not a number: "), raw)).cast("double")).otherwise(value)
    rows = table.select(not_blank(F.col(from_column)).alias("from"), not_blank(F.col(to_column)).alias("to"), weight.alias("weight"))
    return rows.where("`from` is not null and `to` is not null")


def default_weight_column(columns: Sequence[str]) -> str | None:
    return "weight" if "weight" in columns else None


def _packed(crosswalk: DataFrame) -> DataFrame:
    pos = F.col("pos") if "pos" in crosswalk.columns else F.lit(0)
    target = F.struct(pos.alias("pos"), F.col("to").alias("to"), F.col("weight").alias("weight"))
    return crosswalk.groupBy("from").agg(
        F.array_sort(F.collect_list(target)).alias("targets"),
        F.count(F.lit(1)).alias("n"),
        F.count("weight").alias("n_weights"),
        F.sum("weight").alias("sum"),
    )


def _outcome(complete: bool) -> Column:
    w = F.element_at("targets", 1)["weight"]
    bad_sum = F.isnan("sum") | (F.abs(F.col("sum") - 1.0) > 1e-3)
    return (
        F.when(F.col("n").isNull(), F.lit(NO_TARGET if complete else "direct"))
        .when((F.col("n") == 1) & (w.isNull() | (F.abs(w - 1.0) < 1e-6)), "direct")
        .when(F.col("n_weights") < F.col("n"), NO_WEIGHTS)
        .when(bad_sum, BAD_SUM)
        .otherwise("weighted")
    )


def reshape(data: DataFrame, values: Sequence[str], crosswalk: DataFrame, complete: bool = False, code: str = "code") -> Reshaped:
    """Values of `data` (code, values...) on the codes of `crosswalk` (from, to, weight[, pos]).

    A code without a crosswalk row stays as it is, or is a conflict if `complete`. One row without
    weight (or with weight 1) moves all. Several rows need weights that sum to 1; each takes its own
    share. Conflicting codes contribute nothing; counters count data rows.
    """
    by_code = data.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("from"))
    added = by_code.agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_rows"))
    judged = added.join(_packed(crosswalk), "from", "left").withColumn("outcome", _outcome(complete))
    good = judged.where(F.col("outcome").isin("direct", "weighted"))
    own = F.array(F.struct(F.lit(0).alias("pos"), F.col("from").alias("to"), F.lit(1.0).alias("weight")))
    target = F.explode(F.when(F.col("n").isNull(), own).otherwise(F.col("targets"))).alias("t")
    share = F.when(F.col("outcome") == "direct", 1.0).otherwise(F.col("t.weight"))
    moved = good.select("outcome", *values, target).select(F.col("t.to").alias("code"), *[(F.col(v) * share).alias(v) for v in values])
    rows = moved.groupBy("code").agg(*[F.sum(v).alias(v) for v in values])
    conflict = ~F.col("outcome").isin("direct", "weighted")
    targets = F.coalesce(F.array_join(F.transform("targets", lambda t: t["to"]), " "), F.lit(""))
    conflicts = judged.where(conflict).select("from", targets.alias("targets"), F.col("outcome").alias("reason"), "n_rows")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_rows"))), F.lit(0)).cast("long")
    summary = judged.agg(
        count(F.col("outcome") == "direct").alias("direct"), count(F.col("outcome") == "weighted").alias("weighted"), count(conflict).alias("conflicts")
    )
    return Reshaped(rows, conflicts, summary)


def numeric_columns(table: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Columns of a text table with cells, all of whose cells are numbers."""
    names = [c for c in table.columns if c not in skip]
    if not names:
        return []
    cell = {c: not_blank(F.col(c)) for c in names}
    found = table.agg(
        *[F.count(cell[c]).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count(strict_double(cell[c])).alias(f"k{i}") for i, c in enumerate(names)],
    ).first()
    return [c for i, c in enumerate(names) if found[f"n{i}"] and found[f"n{i}"] == found[f"k{i}"]]


def reshape_table(table: DataFrame, code_column: str, columns: Sequence[str] | None, crosswalk: DataFrame, complete: bool = False) -> Reshaped:
    """`reshape` of a text table: named columns, or all numeric ones; a cell that is no number fails."""
    columns = list(columns or numeric_columns(table, [code_column]))
    if not columns:
        raise ValueError("no numeric columns to reshape: name them")

    def value(c: str) -> Column:
        number = strict_double(F.col(c))
        return F.when(number.isNull(), F.raise_error(F.concat(F.lit(f"{c}: not a number: "), F.coalesce(F.col(c), F.lit("")))).cast("double")).otherwise(number)

    data = table.select(not_blank(F.col(code_column)).alias("code"), *[F.col(c) for c in columns]).where("code is not null")
    return reshape(data.select("code", *[value(c).alias(c) for c in columns]), columns, crosswalk, complete)


def reshaped_csv(result: Reshaped, code_name: str, values: Sequence[str]) -> DataFrame:
    """One text line a code, in order of code, values rounded to 1e-9."""
    line = F.concat_ws(",", F.col("code"), *[number_text(F.col(v)) for v in values])
    return result.rows.orderBy("code").select(line.alias(",".join([code_name, *values])))


def conflicts_csv(result: Reshaped) -> DataFrame:
    """One text line a value that needs a decision: from, targets, reason, in order of from."""
    cells = [F.coalesce(csv_cell(F.col(c)), F.lit("")) for c in ("from", "targets", "reason")]
    return result.conflicts.orderBy("from").select(F.concat_ws(",", *cells).alias("from,targets,reason"))


def crosswalk_csv(crosswalk: DataFrame) -> DataFrame:
    """One text line a crosswalk row (from, to, weight), in order of from and to; no weight is 1. Weights below 0.0001 have an exponent."""
    value = F.round(F.coalesce(F.col("weight"), F.lit(1.0)), 9)
    tiny = F.regexp_replace(F.format_string("%.5e", value), r"\.?0*e", "e")
    weight = F.when((F.abs(value) < 1e-4) & (value != 0), tiny).otherwise(number_text(value))
    line = F.concat_ws(",", csv_cell(F.col("from")), csv_cell(F.col("to")), weight)
    return crosswalk.orderBy("from", "to").select(line.alias("from,to,weight"))
