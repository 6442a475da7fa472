"""Multi-step plans (UDF-1..3).

A plan is a list of steps ``{"op": name, "args": {...}, "input": table or
[tables], "output": name}``.  Steps are folded into one lazy plan, so Catalyst
optimises the whole chain at once.  Steps that read their input more than once
(``STATISTICS``) would run all steps before them every time: such an input is
written once (``freeze``) before the first step that needs it, and every later
step starts from there.  Positional steps in one order (slices, positional
drops, ordered fills) share one sorted and written table.  Operators are looked up by name in a registry; no code
strings are executed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import aggregate, analytics, charts, cleaning, joins, selection, transform
from ..order import freeze, positions_of
from ..schema import OperatorError

REGISTRY: dict[str, Callable] = {
    # selection
    "select_columns": selection.select_columns, "rename_columns": selection.rename_columns,
    "reorder_columns": selection.reorder_columns, "filter_rows": selection.filter_rows,
    "sort_data": selection.sort_data, "head_rows": selection.head_rows,
    "tail_rows": selection.tail_rows, "slice_rows": selection.slice_rows,
    "sample_rows": selection.sample_rows, "nlargest": selection.nlargest,
    "nsmallest": selection.nsmallest,
    # cleaning
    "drop_rows": cleaning.drop_rows, "drop_missing": cleaning.drop_missing,
    "fill_missing": cleaning.fill_missing, "replace_values": cleaning.replace_values,
    "clean_strings": cleaning.clean_strings, "remove_outliers": cleaning.remove_outliers,
    # transform
    "pivot_table": transform.pivot_table, "melt_unpivot": transform.melt_unpivot,
    "one_hot_encode": transform.one_hot_encode, "apply_custom": transform.apply_custom,
    "create_interaction": transform.create_interaction, "scale_numeric": transform.scale_numeric,
    "bin_numeric": transform.bin_numeric, "create_date_features": transform.create_date_features,
    # aggregates
    "group_by_agg": aggregate.group_by_agg, "describe_stats": aggregate.describe_stats,
    "value_counts": aggregate.value_counts, "corr_matrix": aggregate.corr_matrix,
    "having_filter": aggregate.having_filter,
    # analytics
    "growth_pct": analytics.growth_pct, "rolling": analytics.rolling,
    "running_total": analytics.running_total, "best_row_per_group": analytics.best_row_per_group,
    # charts
    "chart_data": charts.chart_data, "histogram": charts.histogram,
    # joins
    "merge_tables": joins.merge_tables, "concat_tables": joins.concat_tables,
}


# Operators that take statistics of their input before they use it.
STATISTICS = {"fill_missing", "remove_outliers", "pivot_table", "one_hot_encode", "scale_numeric", "bin_numeric",
              "describe_stats", "corr_matrix", "histogram", "sample_rows"}


def run_steps(tables: dict[str, DataFrame], steps: list[dict],
                 registry: dict[str, Callable] | None = None) -> dict[str, DataFrame]:
    """UDF-3: apply the steps in order; later steps see earlier outputs."""
    reg = registry or REGISTRY
    env = dict(tables)
    made: set[str] = set()  # tables that steps have made and nothing has written yet
    for i, step in enumerate(steps):
        name = step.get("op")
        if name not in reg:
            raise OperatorError(f"step {i}: unknown operator '{name}'")
        inputs = step.get("input", "current")
        args = dict(step.get("args", {}))
        if (name in STATISTICS and isinstance(inputs, str) and inputs in made and inputs in env
                and positions_of(env[inputs], args.get("order_by")) is None):
            env[inputs] = freeze(env[inputs], "step")
            made.discard(inputs)
        if isinstance(inputs, (list, tuple)):
            missing = [t for t in inputs if t not in env]
            if missing:
                raise OperatorError(f"step {i}: unknown table(s) {missing}")
            if name == "concat_tables":
                result = reg[name]([env[t] for t in inputs], **args)
            else:
                result = reg[name](*[env[t] for t in inputs], **args)
        else:
            if inputs not in env:
                raise OperatorError(f"step {i}: unknown table '{inputs}'")
            result = reg[name](env[inputs], **args)
        if isinstance(result, tuple):  # operators returning (table, info)
            result = result[0]
        output = step.get("output", inputs if isinstance(inputs, str) else f"step_{i}")
        env[output] = result
        made.add(output)
    return env


def transform_with(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """UDF-2 re-aimed: a user callable on a DataFrame (no code strings)."""
    out = fn(df)
    if not isinstance(out, DataFrame):
        raise OperatorError("the callable must return a DataFrame")
    return out
