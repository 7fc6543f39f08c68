"""Sources and sinks: labelled / unlabelled text CSVs, prediction runs,
word-vector text files.

All readers take an explicit schema (no inference pass). Texts may hold
commas, quotes and newlines, so CSVs are written with quote/escape '"' and
read with ``multiLine``; leading and trailing blanks are kept on write.
Writers never ``coalesce(1)``: a table is a folder of part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LABELLED_SCHEMA = "id LONG, keyword STRING, location STRING, text STRING, target INT"
UNLABELLED_SCHEMA = "id LONG, keyword STRING, location STRING, text STRING"
PREDICTION_SCHEMA = "id LONG, target INT"

_READ_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
_WRITE_OPTS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, paths, schema: str) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).options(**_READ_OPTS).csv(paths)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_WRITE_OPTS).csv(path)


def read_labelled(spark: SparkSession, paths, schema: str = LABELLED_SCHEMA, cols=("text", "target")) -> DataFrame:
    """Labelled texts, projected to (text, target) by default."""
    return read_csv(spark, paths, schema).select(*cols)


def read_unlabelled(spark: SparkSession, paths, schema: str = UNLABELLED_SCHEMA, cols=("text", "id")) -> DataFrame:
    """Unlabelled texts, projected to (text, id) by default."""
    return read_csv(spark, paths, schema).select(*cols)


def run_name(path_col):
    """Run name of a prediction file: the folder a part file sits in, or
    the file name, without '.csv'."""
    p = F.regexp_replace(path_col, r"/part-[^/]*$", "")
    last = F.element_at(F.split(p, "/"), -1)
    return F.regexp_replace(last, r"\.csv$", "")


def read_prediction_runs(spark: SparkSession, paths, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """S3: many prediction files in ONE scan, tagged with their run name from
    the file path. A path listed twice is read twice (counts twice)."""
    df = read_csv(spark, paths, schema)
    return df.select(run_name(F.col("_metadata.file_path")).alias("run"), *df.columns)


def write_predictions(df: DataFrame, path: str, key: str = "id", target: str = "target") -> None:
    """(id, target) with a header, one part file per task."""
    write_csv(df.select(key, target), path)


def write_misclassified(df: DataFrame, path: str) -> None:
    """The error table as CSV, quoting kept so a read-back equals it."""
    write_csv(df, path)


def read_word_vectors(spark: SparkSession, paths, dim: int | None = None) -> DataFrame:
    """Word vectors in the text format (first line 'count dim', then
    'token v1 ... vd' per line) -> (tok, vec ARRAY<FLOAT>). The header line is
    recognised by its field count, so the files can be split freely."""
    lines = spark.read.text(paths)
    parts = F.split(F.rtrim(F.col("value")), " ")  # some writers end every line with a space
    # only the header has two fields that are whole numbers; any other line of the wrong width fails the job
    header = F.rtrim(F.col("value")).rlike(r"^\d+ \d+$")
    wanted = ~header & (F.rtrim(F.col("value")) != "")
    if dim is not None:  # guarded by `wanted` itself: Spark may evaluate it ahead of the filter
        parts = F.when(F.size(parts) == dim + 1, parts).when(wanted, F.raise_error(
            F.concat(F.lit("a word vector of the wrong width: "), parts[0])))
    body = lines.where(wanted).select(parts.alias("p"))
    return body.select(F.col("p")[0].alias("tok"),
                       F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def write_word_vectors(df: DataFrame, path: str, tok: str = "tok", vec: str = "vec") -> None:
    """Write (tok, vec) in the text format; the 'count dim' header line is a
    separate one-line part file (count and dim are two scalars, taken as the
    rows are written: ``df`` is computed once)."""
    counted = Observation()
    df = df.observe(counted, F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d"))
    body = df.select(F.concat_ws(" ", F.col(tok),
                                 F.array_join(F.transform(vec, lambda x: x.cast("float").cast("string")), " "))
                     .alias("value"))
    body.write.mode("overwrite").text(path)
    stats = counted.get
    df.sparkSession.createDataFrame([(f"{stats['n']} {stats['d']}",)], "value STRING") \
        .write.mode("append").text(path)
