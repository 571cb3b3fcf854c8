"""Result grids and their renderings as Markdown and LaTeX."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .significance import holm

DASH = "—"


def consolidated(tables: dict[str, DataFrame], canonical: dict[str, str]) -> DataFrame:
    """One long grid of each stage's canonical model; columns that a table lacks are NULL."""
    out = None
    for stage, model in canonical.items():
        if stage in tables:
            part = tables[stage].where(F.col("model") == model).withColumn("stage", F.lit(stage))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_holm(grid: DataFrame, p: str = "dm_p_vs_stage1", target: str = "dv", segment: str = "test", stages: tuple[str, ...] = ()) -> DataFrame:
    """The grid with Holm's correction over horizons within (stage, split, dataset) for the confirmatory cells."""
    chosen = (F.col("target") == target) & (F.col("segment") == segment) & (F.col("stage").isin(*stages) if stages else F.lit(True))
    name = p.replace("dm_p", "holm_p")
    own = holm(grid.where(chosen), ["stage", "split", "dataset"], p, name)
    return own.unionByName(grid.where(~F.coalesce(chosen, F.lit(False))), allowMissingColumns=True)


def cell_text(value: Column, p: Column | None = None, level: float = 0.05) -> Column:
    """Three decimals, a star if p is below the level, a dash if missing."""
    star = F.when(p < level, "*").otherwise("") if p is not None else F.lit("")
    return F.when(value.isNull(), DASH).otherwise(F.concat(F.format_string("%.3f", value), F.coalesce(star, F.lit(""))))


def report_grid(cells: DataFrame, rows: list[str], horizons: tuple[int, ...], value: str = "r2_oos", p: str | None = None) -> DataFrame:
    """(rows, tau_3, ...): one line for each model with a text cell for each horizon."""
    text = cell_text(F.col(value), F.col(p) if p else None)
    return cells.groupBy(*rows).agg(*(F.coalesce(F.max(F.when(F.col("horizon") == h, text)), F.lit(DASH)).alias(f"tau_{h}") for h in horizons))


def suffix_label(name: Column, labels: dict[str, str]) -> Column:
    """A model's label from the longest suffix that its name ends with, else the name."""
    out: Column = name
    for suffix in sorted(labels, key=len):  # the longest is tested first
        out = F.when(F.endswith(name, F.lit(suffix)), F.lit(labels[suffix])).otherwise(out)
    return out


def tex_escaped(text: str) -> str:
    """text with every character that LaTeX reads as a command made plain."""
    escapes = {"\\": r"\textbackslash{}"} | {c: "\\" + c for c in "&%$#_{}"}
    return "".join(escapes.get(c, c) for c in text)


def render_markdown(grid: DataFrame, title: str) -> str:
    """A small grid as a Markdown table."""
    rows = [[str(x) for x in r] for r in grid.orderBy(*grid.columns).collect()]  # a report's few lines
    lines = [f"## {title}", "", "| " + " | ".join(grid.columns) + " |", "|" + "---|" * len(grid.columns), *("| " + " | ".join(r) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def render_latex(grid: DataFrame, caption: str) -> str:
    """A small grid as a LaTeX table."""
    rows = [[tex_escaped(str(x)).replace(DASH, "---") for x in r] for r in grid.orderBy(*grid.columns).collect()]
    body = "\n".join("  " + " & ".join(r) + r" \\" for r in rows)
    head = " & ".join(tex_escaped(c) for c in grid.columns)
    return f"\\begin{{table}}\n\\caption{{{tex_escaped(caption)}}}\n\\begin{{tabular}}{{{'l' * len(grid.columns)}}}\n\\toprule\n  {head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def gate(cells: DataFrame, better: str, worse: str, metric: str = "mse", by: tuple[str, ...] = ("horizon",), allowed: int = 0) -> DataFrame:
    """One row (cells, wins, passes): whether a model has the smaller error in all cells but the allowed number."""
    sides = cells.groupBy(*by).agg(F.max(F.when(F.col("model") == better, F.col(metric))).alias("a"), F.max(F.when(F.col("model") == worse, F.col(metric))).alias("b"))
    counts = sides.agg(F.count("*").alias("cells"), F.count_if(F.col("a") < F.col("b")).alias("wins"))
    return counts.withColumn("passes", F.col("cells") - F.col("wins") <= allowed)


def view_specs(spark: SparkSession, **dimensions: tuple[str, ...]) -> DataFrame:
    """Every combination of the given values, one row a view, numbered in the order given."""
    rows = [(i, *values) for i, values in enumerate(product(*dimensions.values()))]  # a report's few views
    return spark.createDataFrame(rows, "view int, " + ", ".join(f"`{d}` string" for d in dimensions))


#: The columns of every result table, and the type of each.
RESULT_COLUMNS = {
    "dataset": "string", "split": "string", "target": "string", "horizon": "int", "model": "string", "segment": "string", "n": "long",
    "mse": "double", "mae": "double", "r2_oos": "double", "spearman_q": "double", "seed_std": "double",
    "dm_p_vs_persistence": "double", "dm_p_vs_har": "double", "dm_p_vs_stage1": "double",
}


def result_rows(cells: DataFrame, **fixed: str) -> DataFrame:
    """Metric cells as rows of the result table: ``fixed`` gives constant columns, what neither has is NULL."""

    def column(name: str, kind: str) -> Column:
        value = F.lit(fixed[name]) if name in fixed else F.col(name) if name in cells.columns else F.lit(None)
        return value.cast(kind).alias(name)

    return cells.select(*(column(n, k) for n, k in RESULT_COLUMNS.items()))
