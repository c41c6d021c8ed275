"""Reports for a reader: sections of tables as Markdown, or as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.trails import markdown

#: Rows of a report: it is numbered and written in one piece, since it is to be read.
MOST = 10_000


def _section(part: int, name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Heading, names of columns, rule and rows; rows stand in order of their columns."""
    spark = df.sparkSession
    head = [f"## {name}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    shown = df.select(F.lit(1).alias("kind"), F.struct(*columns).alias("key"), markdown(df, columns).alias("line"))
    at = F.row_number().over(Window.orderBy("kind", "key"))
    rows = shown.withColumn("n", at + len(head)).select(F.lit(part).alias("part"), "n", "line")
    first = spark.createDataFrame([(part, n, line) for n, line in enumerate(head, 1)], "part int, n int, line string")
    return first.unionByName(rows)


def report_lines(title: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(part, n, line) of a Markdown report; a table of more than ``MOST`` rows is no report and refused."""
    if not sections:
        raise ValueError("a report has a section")
    out = None
    for part, (name, (df, columns)) in enumerate(sections.items(), 1):
        if df.limit(MOST + 1).count() > MOST:
            raise ValueError(f"{name} has more than {MOST} rows")
        lines = _section(part, name, df, columns)
        out = lines if out is None else out.unionByName(lines)
    spark: SparkSession = out.sparkSession
    return spark.createDataFrame([(0, 1, f"# {title}")], "part int, n int, line string").unionByName(out)


def write_markdown(path: str, title: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """One text file in the folder ``path``, with a blank line before each section."""
    lines = report_lines(title, sections).withColumn("line", F.when((F.col("n") == 1) & (F.col("part") > 0), F.concat(F.lit("\n"), "line")).otherwise(F.col("line")))
    lines.repartition(1).sortWithinPartitions("part", "n").select("line").write.mode("overwrite").text(path)


def write_json(path: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """A JSON object a row, with its section's name; of any size."""
    for part, (name, (df, columns)) in enumerate(sections.items()):
        df.select(F.lit(name).alias("section"), *columns).write.mode("overwrite" if part == 0 else "append").json(path)
