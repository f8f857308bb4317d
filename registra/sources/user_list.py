"""The list of third parties to check: CSV or Parquet, every column text."""

from __future__ import annotations

import csv
import itertools
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.operators.held import held

DELIMITERS = ",;\t|"
SNIFFED_LINES = 20


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter that the first lines agree on. A list of one column has none, which a comma stands for."""
    lines = [row.value for row in spark.read.text(path).limit(SNIFFED_LINES).collect()]
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=DELIMITERS).delimiter
    except csv.Error as unclear:
        if any(d in line for line in lines for d in DELIMITERS):
            raise ValueError(f"{path}: the first {SNIFFED_LINES} lines fit no delimiter; name it with `delimiter`") from unclear
        return ","


def _read_csv(spark: SparkSession, path: str, has_header: bool, separator: str, multi_line: bool) -> DataFrame:
    """Parse the list in one pass, writing it to the run's folder, and raise where the pass has lost cells.

    Cells are lost by rows with more cells than columns and by quotes left open by a line's end. The reader is given one column more
    than the list has, so that each good record counts as short and comes with its raw text: a record without it has exactly one
    cell too many, and the others are counted with quoted cells taken out. The counts are observed while the cells are written, so
    the files are parsed once, and a record is the largest value, also with `multi_line`.
    """
    options = {"header": has_header, "sep": separator, "multiLine": multi_line, "escape": '"'}
    headed = spark.read.csv(path, inferSchema=False, **options)
    names = headed.columns
    if not names:  # a file without any line
        return headed
    taken = {name.lower() for name in names}
    more, raw = (next(n for n in (f"_{i}{kind}" for i in itertools.count()) if n not in taken) for kind in ("more", "raw"))
    fields = T.StructType([T.StructField(n, T.StringType()) for n in (*names, more, raw)])
    parsed = spark.read.csv(path, schema=fields, mode="PERMISSIVE", columnNameOfCorruptRecord=raw, **options)
    cut = re.escape(separator)
    bare = F.regexp_replace(F.regexp_replace(F.col(raw), "[\\r\\n]+$", ""), rf'(?m)(^|{cut})"[^"]*+(?:""[^"]*+)*+"', "$1")
    damage = Observation(f"damage-{uuid.uuid4().hex}")
    # Short columns of flags pass the observation; the text itself ends in this projection.
    judged = parsed.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("cells"),
        # The added column is asked for too; a reader spared it would compare with the list's own columns.
        (F.col(more).isNotNull() | F.col(raw).isNull() | (F.size(F.split(bare, cut, -1)) > len(names))).alias("wide"),
        F.coalesce(bare.rlike(rf'(?m)(?:^|{cut})"'), F.lit(False)).alias("open"),
    ).observe(damage, F.count_if("wide").alias("wide"), F.count_if("open").alias("open"))
    cells = held(judged.select("cells"), "list").select("cells.*")
    found = damage.get
    if found["open"]:
        hint = "" if multi_line else "; cells with line breaks need `multi_line=True`"
        raise ValueError(f"{path}: {found['open']} lines leave a quote open{hint}")
    if found["wide"]:
        raise ValueError(f"{path}: {found['wide']} rows have more than {len(names)} cells; the delimiter read is {separator!r}")
    return cells


def numbered_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"column_{i}" for i in range(1, len(df.columns) + 1)])


def blank_to_null(df: DataFrame) -> DataFrame:
    # Spark's trim() removes plain blanks only; tabs and line ends count as blank here too.
    return df.select(
        *[F.when(~F.col(f"`{c}`").rlike(r"^\s*$"), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """White-space cells become null and rows with nothing left are dropped."""
    return blank_to_null(df).na.drop("all")


def read_user_list(
    spark: SparkSession,
    path: str,
    has_header: bool = True,
    delimiter: str | None = None,
    ignore_blank_rows: bool = True,
    multi_line: bool = False,
    require_rows: bool = True,
) -> DataFrame:
    """Read a list. `multi_line` allows line breaks inside quotes but makes a CSV file unsplittable.

    Short CSV rows are filled with nulls. Rows with cells beyond the columns and quotes left open are errors.

    With `ignore_blank_rows=False` rows of empty cells stay; lines of white space only never reach us,
    Spark's CSV reader skips them.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        stored = spark.read.parquet(path)
        df = stored.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in stored.columns])
    else:
        separator = delimiter or sniff_delimiter(spark, path)
        df = _read_csv(spark, path, has_header, separator, multi_line)
        if not has_header:
            df = numbered_columns(df)
    if ignore_blank_rows:
        df = drop_blank_rows(df)
    if require_rows and df.isEmpty():
        raise ValueError(f"no row left in {path} once blank rows are ignored")
    return df
