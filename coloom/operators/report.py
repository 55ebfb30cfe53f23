"""Tables for a paper, from small result frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators.metrics import delta_to_baseline

MAX_ROWS = 1000


def latex_table(
    df: DataFrame,
    columns: Sequence[tuple[str, str, str]],
    caption: str,
    label: str,
    note: str | None = None,
) -> str:
    """A booktabs table.  ``columns`` lists (column, heading, format spec).

    The frame is a result table; more than 1,000 rows are refused.
    """
    rows = df.select(*[f"`{c}`" for c, _, _ in columns]).limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError("too many rows for a printed table")
    body = [" & ".join(cell(v, spec) for v, (_, _, spec) in zip(r, columns)) + r" \\" for r in rows]
    head = " & ".join(rf"\textbf{{{h}}}" for _, h, _ in columns) + r" \\"
    lines = [
        r"\begin{table}[t]",
        r"\centering",
        rf"\caption{{{caption}}}",
        rf"\label{{{label}}}",
        rf"\begin{{tabular}}{{l{'c' * (len(columns) - 1)}}}",
        r"\toprule",
        head,
        r"\midrule",
        *body,
        r"\bottomrule",
        r"\end{tabular}",
    ]
    if note:
        lines.append(rf"\par\footnotesize {note}")
    return "\n".join([*lines, r"\end{table}", ""])


def cell(value, spec: str) -> str:
    if value is None:
        return "--"
    return format(value, spec) if spec else str(value).replace("_", r"\_")


def metrics_table(results: DataFrame, metrics: Sequence[str], by: str = "AUC-ROC") -> str:
    """Scores per model, best first."""
    ordered = results.orderBy(results[f"`{by}`"].desc(), "model")
    columns = [("model", "Method", "")] + [(m, m, ".4f") for m in metrics]
    return latex_table(ordered, columns, "Classification performance.", "tab:main")


def ablation_table(results: DataFrame, baseline: str, metrics: Sequence[str], caption: str, label: str) -> str:
    """Scores per variant with the signed difference to the baseline row."""
    shown = delta_to_baseline(results, baseline, metrics).orderBy(F.desc("`AUC-ROC`"), "variant")
    text = {
        m: F.when(F.col(f"`{m}`").isNull(), None).when(F.col("variant") == baseline, F.format_string("%.4f", F.col(f"`{m}`"))).otherwise(
            F.format_string("%.4f (%+.4f)", F.col(f"`{m}`"), F.col(f"`d_{m}`"))
        )
        for m in metrics
    }
    columns = [("variant", "Variant", "")] + [(m, m, "") for m in metrics]
    return latex_table(shown.select("variant", *[e.alias(m) for m, e in text.items()]), columns, caption, label)


def venue_table(ranking: DataFrame) -> str:
    columns = [
        ("rank", "Rank", "d"),
        ("venue", "Venue", ""),
        ("avg_risk", "Avg. risk", ".4f"),
        ("n_cases", "Cases", "d"),
        ("n_provinces", "Provinces", "d"),
    ]
    return latex_table(ranking.orderBy("rank"), columns, "Venue risk ranking.", "tab:venue")


def contrast_table(contrast: DataFrame) -> str:
    columns = [
        ("metric", "Metric", ""),
        ("mean_1", "Mean (flagged)", ".4f"),
        ("std_1", "SD", ".4f"),
        ("mean_0", "Mean (others)", ".4f"),
        ("std_0", "SD", ".4f"),
        ("p_value", "p", ".4f"),
        ("cohens_d", "d", ".4f"),
    ]
    return latex_table(contrast.orderBy("metric"), columns, "Network position by group.", "tab:group")


def change_table(change: DataFrame) -> str:
    columns = [
        ("metric", "Metric", ""),
        ("pre", "Before", ".6f"),
        ("post", "After", ".6f"),
        ("change_pct", "Change (percent)", "+.1f"),
    ]
    return latex_table(change.orderBy("metric"), columns, "Network before and after the cut-over.", "tab:change")
