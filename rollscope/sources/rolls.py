"""Reading and writing roll files, dimensions and corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rollscope.sources import schemas


def read_rolls(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType = schemas.ROLL,
    columns: Sequence[str] | None = None,
    glob: str = "*.csv*",
    recursive: bool = False,
    malformed: str = "DROPMALFORMED",
) -> DataFrame:
    """CSV rolls of one layout, plain or gzipped, with a header; unneeded columns are pruned by the scan.

    `glob='*.tab'` reads the renamed kind, `recursive` a tree of unpacked archives, and `malformed='PERMISSIVE'`
    keeps broken rows with nulls. A gzip file is one task's work; repartition after it where files are few.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", malformed)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .csv(path if isinstance(path, str) else list(path))
    )
    return rows.select(*columns) if columns else rows


def read_with_malformed(spark: SparkSession, path: str, schema: StructType = schemas.ROLL, glob: str = "*.csv*", header: bool = True) -> DataFrame:
    """The columns of the schema, `file`, and `malformed`: the text of a row that does not fit the schema, else null.

    Such rows have as many of the columns as could be read. The scan takes all columns, as a row can only then be told to fit.
    """
    rows = (
        spark.read.schema(StructType([*schema.fields, StructField("malformed", StringType())]))
        .option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("columnPruning", False)
        .csv(path)
    )
    # Spark refuses scans of the malformed text alone, in which every row would seem to fit; so it is tied to the others.
    tied = F.when(F.length(F.concat_ws("", *schema.names)) >= 0, F.col("malformed"))
    return rows.withColumns({"malformed": tied, "file": F.col("_metadata.file_path")})


def malformed_counts(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n_good, n_malformed) of what `read_with_malformed` gives, by file unless otherwise said."""
    bad = F.col("malformed").isNotNull()
    return rows.groupBy(*(by or ("file",))).agg(F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_malformed"))


def path_tokens(path: Column | None = None) -> Column:
    """The parts of a file name between `-`, `_`, `:`, `+`, `.` and blanks."""
    path = F.col("_metadata.file_path") if path is None else path
    return F.split(F.element_at(F.split(path, "/"), -1), r"[-_:+. ]")


def with_state_from_path(df: DataFrame, unsupported: Sequence[str] = ()) -> DataFrame:
    """Adds `state`, the first part of the file name, and drops files of unsupported states and Gujarati copies.

    A `guj` part anywhere but first marks a copy.
    """
    parts = path_tokens()
    state = F.get(parts, F.lit(0))
    copy = F.array_contains(F.slice(parts, 2, 1 << 10), "guj")
    return df.filter(~copy & ~state.isin(list(unsupported))).withColumn("state", state)


def reconcile_roll(df: DataFrame, variant: str) -> DataFrame:
    """One of the layouts `plain`, `named`, `t13n`, `delhi` as the plain one."""
    if variant == "named":
        df = df.withColumnRenamed("name", "elector_name")
    elif variant == "t13n":
        df = df.drop("elector_name", "father_or_husband_name").withColumnsRenamed(
            {"elector_name_t13n": "elector_name", "father_or_husband_name_t13n": "father_or_husband_name"}
        )
    elif variant == "delhi":
        df = df.select(
            F.col("name").alias("elector_name"),
            F.coalesce("father's name", "husband's name").alias("father_or_husband_name"),
            *(c for c in df.columns if c not in schemas.ROLL_DELHI.names),
        )
    elif variant != "plain":
        raise ValueError(f"unknown layout {variant}")
    return df


def union_rolls(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def with_row_order(rows: DataFrame, name: str = "seq") -> DataFrame:
    """Adds the number of a row, from 0, in the order of files by path, of blocks in a file and of rows in a block.

    Rows are counted per block, and the blocks' counts, few rows, are summed up. The scan must be the last step before it.
    """
    block = ["_path", "_start"]
    placed = rows.withColumns({"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*block).orderBy("_id")))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*block).agg(F.count("*").alias("_n")).select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return inside.join(offsets, block).withColumn(name, F.col("_before") + F.col("_at") - 1).drop(*block, "_id", "_at", "_before")


def state_languages(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The state and language dimension with its row order as `seq`; its file, or files in the order of their names, is a parameter."""
    rows = spark.read.schema(schemas.STATE_LANGUAGES).option("header", True).option("quote", '"').option("recursiveFileLookup", recursive).csv(path)
    return with_row_order(rows)


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small text file in order."""
    return [row.value for row in spark.read.text(path).collect() if row.value]


def read_character_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of character to number as rows (char, code)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("char", "code"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus table; callers cache it if they use it often."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = None, compress: bool = True, mode: str = "errorifexists") -> None:
    """CSV with a header, gzipped on demand, in one folder a value of `by` if given."""
    writer = df.write.mode(mode).option("header", True)
    if compress:
        writer = writer.option("compression", "gzip")
    if by:
        writer = writer.partitionBy(by)
    writer.csv(path)


def write_corpus(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_files(spark: SparkSession, paths: Sequence[str], schema: StructType, out: str) -> None:
    """Many files of one layout as one table, appended to."""
    spark.read.schema(schema).option("header", True).csv(list(paths)).write.mode("append").parquet(out)


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """A bounded read."""
    return df.limit(n)
