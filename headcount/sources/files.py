"""Survey files, lookup files and result tables. No schema is ever inferred."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.functions.columns import literal, name, null_codes, with_exprs

_CONTACTS = [f"{kind}_{age}" for kind in ("f2f", "phys", "hh") for age in ("0_4", "5_17", "18_69", "70")]
_REASONS = [f"isolation_reason_{i}" for i in range(1, 8)]


def _columns(kind: T.DataType, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


SURVEY_SCHEMA = T.StructType(
    _columns(T.LongType(), ["respondent_id"])
    + _columns(T.IntegerType(), ["generation", "survey_year", "survey_month", "survey_day", "age_years", "sex"])
    + _columns(T.IntegerType(), ["ethnicity", "lives_abroad"])
    + _columns(T.LongType(), _CONTACTS)
    + _columns(T.IntegerType(), ["had_covid", "isolation", "isolation_days", *_REASONS, "hcw", "keyworker", "soc_code"])
    + _columns(T.StringType(), ["soc_title"])
)

# Codes stay text so that prefixes of them are the broader groups.
LOOKUP_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("SOC2010Major", "SOC2010SubMajor", "SOC2010Minor", "soc_code", "soc_title")
    ]
)

CODEBOOK_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("code", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("is_missing", T.BooleanType()),
        T.StructField("ord", T.IntegerType()),
    ]
)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None, fmt: str | None = None
) -> DataFrame:
    """A table with a given schema, from Parquet or CSV. ``columns`` narrows the scan.

    A file that lacks a wanted column stops the read; it would otherwise read as no answer at all.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    wanted = schema if columns is None else T.StructType([schema[c] for c in columns])
    if fmt == "csv":
        # A cell that does not parse must stop the read, not turn into a missing answer.
        reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        return reader.format(fmt).load(path).select(*wanted.names)
    there = spark.read.format(fmt).load(path).columns
    if absent := [c for c in wanted.names if c not in there]:
        raise ValueError(f"{path} has no column {', '.join(absent)}; it has {', '.join(there)}")
    return spark.read.schema(wanted).format(fmt).load(path)


def null_missing(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """NULL where a column holds a code that the codebook marks as missing, column by column.

    The codebook is as long as the questionnaire has codes; its missing ones come to the driver.
    """
    codes: dict[str, list[int]] = {}
    for r in codebook.filter("is_missing AND code IS NOT NULL").select("column", "code").distinct().collect():
        codes.setdefault(r["column"], []).append(r["code"])
    return with_exprs(df, {c: null_codes(name(c), sorted(codes[c])) for c in df.columns if c in codes})


def codebook_levels(codebook: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The labels of some columns in the codebook's order, missing codes left out: what a design takes as level lists.

    A label of several codes stands where its first one does. The first label of a column is its reference.
    """
    known = codebook.filter(F.col("column").isin(list(columns)) & F.col("label").isNotNull() & ~F.coalesce("is_missing", F.lit(False)))
    rows = known.groupBy("column", "label").agg(F.min("ord").alias("ord")).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r["ord"] is None, r["ord"], r["label"])):
        out[r["column"]].append(r["label"])
    return out


def read_survey(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SURVEY_SCHEMA,
    columns: Sequence[str] | None = None,
    fmt: str | None = None,
    codebook: DataFrame | None = None,
) -> DataFrame:
    """One row per respondent, from Parquet or CSV. ``columns`` narrows the scan.

    With a codebook, each column's own missing codes become NULL.
    """
    df = read_table(spark, path, schema, columns, fmt)
    return df if codebook is None else null_missing(df, codebook)


def read_lookup(
    spark: SparkSession, path: str, schema: T.StructType = LOOKUP_SCHEMA, fmt: str | None = None
) -> DataFrame:
    """Occupation index: codes and titles, all text."""
    return read_table(spark, path, schema, fmt=fmt)


def read_codebook(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Code labels, one row per (column, code)."""
    return read_table(spark, path, CODEBOOK_SCHEMA, fmt=fmt)


class TooManyRejects(ValueError):
    """More rows than allowed do not parse. ``counts`` has the rejected rows by column."""

    def __init__(self, path: str, rejected: int, rows: int, counts: dict[str, int]):
        by_column = ", ".join(f"{c}: {n}" for c, n in sorted(counts.items()))
        super().__init__(f"{rejected} of {rows} rows of {path} do not parse ({by_column})")
        self.counts = counts


#: The reason of a row that has not the number of cells that the schema has.
WHOLE_RECORD = "(record)"


def read_with_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SURVEY_SCHEMA,
    limit: float = 0.01,
    columns: Sequence[str] | None = None,
    fmt: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows of a file that parse, and those that do not; together they are the file.

    Every cell is read as it stands and converted by itself. A reject has ``record``, its text (a CSV
    line with too many or too few cells) or its cells as JSON, and ``reasons``, the columns whose cells
    are not of their type. If more than ``limit`` of the rows are rejects, ``TooManyRejects`` says
    how many by column. The count is one pass over the file; both results read it again.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    corrupt = "CAST(NULL AS STRING)"
    if fmt == "csv":
        text = T.StructType([*[T.StructField(c, T.StringType()) for c in schema.names], T.StructField("_corrupt", T.StringType())])
        reader = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        raw, corrupt = reader.option("columnNameOfCorruptRecord", "_corrupt").csv(path), "_corrupt"
    else:
        raw = spark.read.format(fmt).load(path)
        if absent := [c for c in schema.names if c not in raw.columns]:
            raise ValueError(f"{path} has no column {', '.join(absent)}; it has {', '.join(raw.columns)}")
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    wrong = [f"CASE WHEN {name(c)} IS NOT NULL AND try_cast({name(c)} AS {kind}) IS NULL THEN {literal(c)} END" for c, kind in kinds.items()]
    reasons = f"CASE WHEN {corrupt} IS NOT NULL THEN array({literal(WHOLE_RECORD)}) ELSE filter(array({', '.join(wrong)}), x -> x IS NOT NULL) END"
    checked = raw.selectExpr("*", f"{reasons} AS _reasons")
    rejects = checked.filter("size(_reasons) > 0").selectExpr(
        f"coalesce({corrupt}, to_json(struct({', '.join(name(c) for c in kinds)}))) AS record", "_reasons AS reasons"
    )
    found = checked.selectExpr("explode_outer(_reasons) AS reason", "size(_reasons) AS k").groupBy("reason", "k").count().collect()
    # A row with k reasons is listed k times; a good one once, with k = 0.
    rows = sum(r["count"] / max(r["k"], 1) for r in found)
    rejected = sum(r["count"] / r["k"] for r in found if r["k"])
    if rejected > limit * rows:
        counts: dict[str, int] = {}
        for r in found:
            if r["k"]:
                counts[r["reason"]] = counts.get(r["reason"], 0) + r["count"]
        raise TooManyRejects(path, round(rejected), round(rows), counts)
    good = checked.filter("size(_reasons) = 0")
    good = good.selectExpr(*[f"try_cast({name(c)} AS {kinds[c]}) AS {name(c)}" for c in (columns or kinds)])
    return good, rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """``column``, ``n``: rejected rows by the column at fault."""
    return rejects.selectExpr("explode(reasons) AS column").groupBy("column").agg(F.count("*").alias("n"))


def _place(spark: SparkSession, path: str):
    """A path as Hadoop names it, and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this job has written for itself."""
    place, files = _place(spark, path)
    files.delete(place, True)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a result table as Parquet.

    An overwrite writes all files beside the old result, under a name that readers of the folder skip,
    and then changes names: a job that fails leaves the old rows, and a table may be
    written over the path that it is read from. Between the two changes of names, which a file
    system with folders makes at once, the path is not there for a moment.
    """
    if mode != "overwrite":
        df.write.mode(mode).parquet(path)
        return
    spark, version = df.sparkSession, uuid.uuid4().hex
    target, files = _place(spark, path)
    new, old = (_place(spark, f"{target.getParent().toString()}/.{target.getName()}.{kind}-{version}")[0] for kind in ("new", "old"))
    try:
        df.write.parquet(new.toString())
        there = files.exists(target)
        if there and not files.rename(target, old):
            raise OSError(f"cannot set the old result in {path} aside")
        if not files.rename(new, target):
            if there:
                files.rename(old, target)
            raise OSError(f"cannot publish the result in {path}")
    finally:
        files.delete(new, True)
    files.delete(old, True)
