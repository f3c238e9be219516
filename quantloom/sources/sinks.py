"""Where results go: tables with an optional mirror, a bundle of paths, and reports in markdown."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.constants import ALL_FACTORS, INDICATOR_FACTORS, INDUSTRY_FACTORS


@dataclass(frozen=True)
class OutputPaths:
    """Places of a run's results under one folder; ``scope`` keeps periods, segments and experiments apart."""

    root: str
    mirror: str | None = None
    scope: str = ""

    def at(self, name: str, mirror: bool = False) -> str:
        base = self.mirror if mirror else self.root
        return "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate(y for y in (base, self.scope, name) if y))

    def scoped(self, *parts: str) -> OutputPaths:
        return OutputPaths(self.root, self.mirror, "/".join(p for p in (self.scope, *parts) if p))


def experiment_scope(rest_cap: float | None = None, industry_cap: bool = True, group_cap: float | None = None, macro_timing: bool = False, leverage: float | None = None) -> str:
    """A folder name that says what a run did differently."""
    parts = [f"rest{rest_cap * 100:g}" if rest_cap is not None else "", "" if industry_cap else "noindcap", f"restcap{group_cap * 100:g}" if group_cap is not None else "", "macrotiming" if macro_timing else "", f"longshort{(leverage - 1) * 100:g}" if leverage is not None else ""]
    return "_".join(p for p in parts if p)


def save(df: DataFrame, paths: OutputPaths, name: str, kind: str = "parquet", partition: list[str] | None = None) -> list[str]:
    """Write a table, and again under the mirror if there is one. Returns the places."""
    out = []
    for mirror in [False, True] if paths.mirror else [False]:
        writer = df.write.mode("overwrite")
        writer = writer.partitionBy(*partition) if partition else writer
        where = paths.at(name, mirror)
        writer.option("header", True).csv(where) if kind == "csv" else writer.parquet(where)
        out.append(where)
    return out


def labelled_summary(summary: DataFrame, order: list[str] = ALL_FACTORS) -> DataFrame:
    """A factor summary with each factor's type, in the order of reports."""
    kind = F.when(F.col("factor").isin(INDUSTRY_FACTORS), "Industry").when(F.col("factor").isin(INDICATOR_FACTORS), "Indicator").otherwise("Style")
    at = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("factor"))
    return summary.withColumn("type", kind).withColumn("_at", F.when(at > 0, at).otherwise(len(order) + 1)).orderBy("_at", "factor").drop("_at")


def save_regression(tables: dict[str, DataFrame], summary: DataFrame, paths: OutputPaths) -> list[str]:
    """Factor returns with the number of rows behind them, fits, residuals, flagged rows and the summary."""
    n = tables["r2_daily"].select("date", "n")
    out = save(tables["factor_returns"].join(F.broadcast(n), "date"), paths, "factor_returns")
    for name in ("r2_daily", "residuals_long", "flagged"):
        out += save(tables[name], paths, name)
    return out + save(labelled_summary(summary), paths, "summary", "csv")


def markdown_table(rows: Iterable[Iterable[object]], header: list[str]) -> str:
    body = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|") for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [header, ["---"] * len(header), *body])


def report(title: str, verdicts: DataFrame, sections: dict[str, DataFrame] | None = None) -> str:
    """Verdicts first, then tables; all are small (checks and summaries)."""
    rows = [tuple(r) for r in verdicts.collect()]
    counts = {v: sum(r[verdicts.columns.index("verdict")] == v for r in rows) for v in ("PASS", "WARN", "FAIL", "INFO")}
    out = [f"# {title}", "", ", ".join(f"{n} {v}" for v, n in counts.items() if n), "", markdown_table(rows, verdicts.columns)]
    for name, df in (sections or {}).items():
        out += ["", f"## {name}", "", markdown_table((tuple(r) for r in df.collect()), df.columns)]
    return "\n".join(out) + "\n"
