"""Reading CSV text, saving data sets with their profile, validation tables, previews."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tabscout.errors import TabularError
from tabscout.functions.scalars import quoted, sanitize_numeric
from tabscout.operators.profile import profile

# Accepted delimiters in order of preference, and the preview bound.
DELIMITERS = (",", ";", "\t", "|")
MAX_PREVIEW = 200


def line_traits(spark: SparkSession, path: str) -> DataFrame:
    """One pass over the lines: how many have how many of each delimiter (kind = its place in DELIMITERS), hold bytes
    that are not UTF-8 (kind -1) or an odd number of quotes (kind -2)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bare = F.regexp_replace("value", '"[^"]*"', "")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    seen = [
        *[F.struct(F.lit(i).alias("kind"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("per_line"))
          for i, d in enumerate(DELIMITERS)],
        F.struct(F.lit(-1).alias("kind"), (~F.is_valid_utf8("value")).cast("int").alias("per_line")),
        F.struct(F.lit(-2).alias("kind"), (quotes % 2).alias("per_line")),
    ]
    return lines.select(F.explode(F.array(*seen)).alias("s")).groupBy("s.kind", "s.per_line").agg(F.count(F.lit(1)).alias("lines"))


def usual_counts(traits: DataFrame) -> DataFrame:
    """Per delimiter: its most usual count per line and the share of lines agreeing."""
    best = traits.filter("kind >= 0").groupBy("kind").agg(
        F.max(F.struct("lines", "per_line")).alias("m"), F.sum("lines").alias("all_lines"))
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    return best.select(
        F.col("kind").alias("preference"), F.get(names, F.col("kind")).alias("delimiter"), F.col("m.per_line").alias("per_line"),
        (F.col("m.lines") / F.col("all_lines")).alias("agreement"))


def delimiter_counts(spark: SparkSession, path: str) -> DataFrame:
    return usual_counts(line_traits(spark, path))


def csv_layout(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """Delimiter, encoding, and whether quoted values hold line breaks, all from one pass."""
    traits = line_traits(spark, path).collect()  # a row for each number of delimiters in a line
    table = spark.createDataFrame([tuple(r) for r in traits], "kind int, per_line int, lines bigint")
    best = usual_counts(table).filter("per_line > 0").orderBy(F.desc("agreement"), F.desc("per_line"), "preference").first()
    flagged = {r["kind"] for r in traits if r["per_line"] and r["kind"] < 0}
    return best["delimiter"] if best else ",", "ISO-8859-1" if -1 in flagged else "UTF-8", -2 in flagged


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter most lines agree on; a comma when nothing stands out."""
    return csv_layout(spark, path)[0]


def pick_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line holds bytes that are not, then Latin-1."""
    return csv_layout(spark, path)[1]


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV with a header; delimiter, encoding, line breaks in quotes and types are worked out from the file.

    Files with quoted line breaks can't be split, so each is read by one task; others are split as usual.
    """
    try:
        found, encoding, spans_lines = csv_layout(spark, path)
        df = spark.read.csv(
            path, header=True, inferSchema=True, sep=sep or found, encoding=encoding,
            multiLine=spans_lines, escape='"', ignoreLeadingWhiteSpace=False,
        )
    except AnalysisException as err:
        raise TabularError("UNPARSEABLE_FILE", f"That file cannot be read as CSV: {err.desc if hasattr(err, 'desc') else err}") from err
    return require_rows(df)


def require_rows(df: DataFrame) -> DataFrame:
    if not df.columns or df.limit(1).count() == 0:
        raise TabularError("EMPTY_DATASET", "The table has no rows or no columns.")
    return df


def save_dataset(df: DataFrame, folder: str) -> str:
    """Write data and profile under a fresh id; nothing is ever overwritten."""
    dataset_id = f"ds_{uuid.uuid4().hex[:10]}"
    base = f"{folder.rstrip('/')}/{dataset_id}"
    df.write.mode("errorifexists").parquet(f"{base}/data")
    saved = df.sparkSession.read.parquet(f"{base}/data")
    profile(saved).write.mode("errorifexists").parquet(f"{base}/profile")
    return dataset_id


def load_dataset(spark: SparkSession, folder: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    base = f"{folder.rstrip('/')}/{dataset_id}"
    return spark.read.parquet(f"{base}/data"), spark.read.parquet(f"{base}/profile")


def preview(df: DataFrame, order: list[str], rows: int = 50) -> DataFrame:
    """The first rows by ``order``, NaN and infinities blanked. At most 200."""
    if not 1 <= rows <= MAX_PREVIEW:
        raise TabularError("INVALID_LIMIT", f"Ask for 1 to {MAX_PREVIEW} rows.")
    return sanitize_numeric(df.orderBy(*[F.col(quoted(c)) for c in order]).limit(rows))


def write_validation(df: DataFrame, path: str, as_csv: bool = False) -> None:
    """Held-out rows; Parquet keeps text such as "01" as text, CSV is for download."""
    writer = df.write.mode("errorifexists")
    if as_csv:
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
