"""Prediction tables, fold membership and report exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.staging import publish
from labelloom.operators.integrity import content_digest, digest_changes

PREDICTION_SCHEMA = (
    "system string, seed int, fold int, uid string, y int, "
    "logits array<float>, probs array<float>, task string, split string"
)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by task and split, so selectors never open a test file."""
    df.write.mode(mode).partitionBy("task", "split").parquet(path)


def read_predictions(spark: SparkSession, path: str, task: str | None = None,
                     split: str | None = None) -> DataFrame:
    df = spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    if task is not None:
        df = df.filter(F.col("task") == task)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


def write_membership(folds_long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long fold membership ``(fold, part, uid)``, one folder per fold."""
    folds_long.write.mode(mode).partitionBy("fold").parquet(path)


def read_membership(spark: SparkSession, path: str, folds: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.schema("part string, uid string, fold int").parquet(path)
    return df if folds is None else df.filter(F.col("fold").isin(*folds))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.csv(path, header=True, mode=mode)


def table_digests(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """``(name, n_rows, fp_sum, fp_xor)`` of stored tables (name -> Parquet path), to be kept beside them."""
    out = None
    for table, where in sorted(tables.items()):
        t = spark.read.parquet(where)
        d = content_digest(t, sorted(t.columns)).withColumn("name", F.lit(table))
        out = d if out is None else out.unionByName(d)
    return out


def add_dataset(frozen: dict[str, str], recorded: DataFrame, name: str, df: DataFrame, path: str) -> DataFrame:
    """Store one more table beside frozen ones, which must have the digests recorded when they were frozen, before and after
    (runs jobs).  Returns the digests of all of them, the new one's included.

    ``frozen``: table name -> Parquet path; ``recorded``: a stored :func:`table_digests`.  An existing table of that name
    stops the call, and so does a frozen table without a recorded digest.
    """
    spark = df.sparkSession

    def prove() -> None:
        changed = {r.name for r in digest_changes(recorded, table_digests(spark, frozen), ["name"]).collect()}  # one row a table
        changed |= set(frozen) - {r.name for r in recorded.select("name").collect()}
        if changed:
            raise RuntimeError("frozen tables changed: " + ", ".join(sorted(changed)))

    prove()
    if not publish(df, path, files=None):
        raise RuntimeError(f"{name} is already stored at {path}")
    prove()
    return table_digests(spark, {**frozen, name: path})


def markdown_table(rows: Sequence[Row], columns: dict[str, Callable[[Row], str]]) -> str:
    """A Markdown table: one column per title, each cell made by its function."""
    head = [list(columns), ["---"] * len(columns)]
    body = [[cell(r) for cell in columns.values()] for r in rows]
    return "\n".join("|" + "|".join(f" {c} " for c in line) + "|" for line in head + body)


def _number(value: float | None, digits: int = 4) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}"


def markdown_report(task: str, systems: DataFrame, comparisons: DataFrame | None = None) -> str:
    """Markdown of the (report-sized) system and comparison tables, best macro-F1 first."""
    ranked = systems.orderBy(F.desc("macro_f1_mean"), "system").collect()
    place = {r.system: i for i, r in enumerate(ranked, start=1)}
    columns: dict[str, Callable[[Row], str]] = {
        "rank": lambda r: str(place[r.system]), "system": lambda r: r.system, "runs": lambda r: str(r.n_runs)}
    for title in ("accuracy", "macro_precision", "macro_recall", "macro_f1"):
        columns[f"{title} (sd)"] = lambda r, c=title: f"{_number(r[c + '_mean'])} ({_number(r[c + '_sd'])})"
    columns["macro_f1 from"] = lambda r: _number(r.macro_f1_lo)
    columns["macro_f1 to"] = lambda r: _number(r.macro_f1_hi)
    parts = [f"# Task {task}", "## Systems", markdown_table(ranked, columns)]
    if comparisons is not None:
        by_run = lambda r: "; ".join(_number(x.p) for x in r.mcnemar or [])
        parts += ["## Declared comparisons", markdown_table(comparisons.orderBy("a", "b").collect(), {
            "first": lambda r: r.a, "second": lambda r: r.b, "mean difference": lambda r: _number(r.mean_diff),
            "corrected t, p": lambda r: _number(r.p), "Holm, p": lambda r: _number(r.p_holm),
            **({"McNemar by run, p": by_run} if "mcnemar" in comparisons.columns else {})})]
    return "\n\n".join(parts) + "\n"


def write_report(task: str, report: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Report tables as JSON, one folder each, and the Markdown summary beside them (runs jobs)."""
    for name, df in report.items():
        df.write.mode(mode).json(f"{path}/{task}/{name}")
    systems = report["systems"]
    spark = systems.sparkSession
    # The stored tables are read back, so that nothing is computed twice.
    stored = {n: spark.read.schema(df.schema).json(f"{path}/{task}/{n}") for n, df in report.items()}
    text = markdown_report(task, stored["systems"], stored.get("comparisons"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/{task}/markdown")
