"""Reading tables: encodings, column names, year folders and the wide rate table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.columns import number

# Charsets Spark reads without further ado; others need its compatibility switch.
_PLAIN_CHARSETS = {"UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "ISO-8859-1", "US-ASCII"}
_JAVA_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}


def allow_charsets(spark: SparkSession) -> None:
    """Let this session read and write legacy charsets such as EUC-KR."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_table_smart(spark: SparkSession, path: str | Sequence[str], encodings: Sequence[str] = tuple(fv.TEXT_ENCODINGS),
                     schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Read CSV files in the first encoding that decodes all of their text.

    One distributed scan over the raw bytes tells whether they are valid UTF-8, replacement characters included. For
    other encodings bytes that cannot be read come out as U+FFFD, so each is a scan that stops at the first of them.
    Quoted line breaks are read as part of a value; without them, `multi_line=False` lets large files be split.
    """
    candidates = list(dict.fromkeys(_JAVA_NAMES.get(e.lower(), e) for e in encodings))
    paths = [path] if isinstance(path, str) else list(path)
    for charset in candidates:
        if charset not in _PLAIN_CHARSETS:
            allow_charsets(spark)
        scan = "ISO-8859-1" if charset == "UTF-8" else charset
        raw = spark.read.option("sep", "\u0001").option("quote", "").option("encoding", scan).schema("line string").csv(paths)
        # ISO-8859-1 keeps every byte, so encoding the line again gives the bytes of the file.
        bad = (~F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string")) if charset == "UTF-8"
               else F.contains("line", F.lit("\ufffd")))
        if not raw.where(bad).limit(1).count():
            reader = spark.read.option("header", True).option("encoding", charset).option("multiLine", multi_line)
            reader = reader.option("escape", '"')
            return (reader.schema(schema) if schema else reader).csv(paths)
    raise ValueError(f"no encoding of {list(encodings)} reads {paths}")


def resolve_column(df: DataFrame, candidates: Sequence[str], what: str = "column") -> str:
    """First candidate the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} among {list(candidates)}; the table has {df.columns}")


DATE_FORMATS = ("yyyy/M/d", "yyyyMMdd", "yyyy.M.d", "yyyy-M-d")


def normalize_date(df: DataFrame, column: str | None = None, name: str = "date", strict: bool = False) -> DataFrame:
    """Rename the date column and read it as a date, in any of the usual spellings. Order is left to the windows that
    need it. A text that is no date becomes missing, or with `strict` stops the job."""
    source = column or resolve_column(df, fv.DATE_COLUMNS, "date column")
    renamed = df if source == name else df.withColumnRenamed(source, name)
    if dict(renamed.dtypes)[name] != "string":
        return renamed.withColumn(name, F.to_date(F.col(name).try_cast("timestamp")))
    text = F.trim(F.col(name))
    # Eight digits are a day, not a year beyond 9999.
    plain = F.when(~F.rlike(text, F.lit("^[0-9]{8}$")), text.try_cast("timestamp"))
    day = F.to_date(F.coalesce(plain, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]))
    if strict:
        unread = day.isNull() & (text != "")
        day = F.when(unread, F.raise_error(F.concat(F.lit("no date: "), text))).otherwise(day)
    return renamed.withColumn(name, day)


def parse_years(text: str) -> list[int]:
    """Years of a list such as `2014-2016,2019`, sorted and unique."""
    years: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        if part:
            first, _, last = part.partition("-")
            years.update(range(int(first), int(last or first) + 1))
    return sorted(years)


def read_years(spark: SparkSession, path: str, years: str | Sequence[int], fmt: str = "parquet") -> DataFrame:
    """Chosen years of a table partitioned by year; other folders are not listed in the scan."""
    wanted = parse_years(years) if isinstance(years, str) else list(years)
    return spark.read.format(fmt).load(path).where(F.col("year").isin(wanted))


def union_years(dfs: Sequence[DataFrame]) -> DataFrame:
    """Loose yearly tables as one; columns some of them lack are missing values."""
    result = dfs[0]
    for df in dfs[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def read_spread(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table for work that is heavy per row: a scan with fewer parts than cores is spread out.

    Large tables have more parts than cores and are read as they lie, without a shuffle.
    """
    scan = spark.read.format(fmt).load(path)
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_columns(spark: SparkSession, path: str, cols: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.format(fmt).load(path).select(*cols)


def load_rate_table(df: DataFrame, item: str = fv.RATE_ITEM_COLUMN, items: dict[str, str] | None = None,
                    first: int = 4, date_format: str = fv.RATE_DATE_FORMAT) -> DataFrame:
    """Wide rates (one column per month) as one row per month with a column per wanted item.

    The first row of each item counts. A table without the item column is taken to be long already.
    """
    if item not in df.columns:
        return normalize_date(df)
    items = fv.RATE_ITEMS if items is None else items
    months = df.columns[first:]
    chosen = df.where(F.col(item).isin(list(items))).withColumn("_row", F.monotonically_increasing_id())
    single = chosen.groupBy(item).agg(*[F.min_by(F.col(f"`{m}`"), "_row").alias(m) for m in months])
    long = single.select(item, F.explode(F.array(*[
        F.struct(F.lit(m).alias("month"), F.col(f"`{m}`").cast("string").alias("rate")) for m in months])).alias("_m"))
    day = F.to_date(F.try_to_timestamp(F.col("_m.month"), F.lit(date_format)))
    return (
        long.select(item, day.alias("date"), number("_m.rate").alias("rate"))
        .groupBy("date").pivot(item, list(items)).agg(F.first("rate"))
        .withColumnsRenamed(items)
    )


def date_spine(df: DataFrame, column: str, name: str = "date") -> DataFrame:
    """Every calendar day between the first and the last date of a column."""
    ends = df.agg(F.to_date(F.min(column)).alias("lo"), F.to_date(F.max(column)).alias("hi"))
    return ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias(name))


def date_range(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    """Every day between two yyyymmdd dates."""
    days = F.sequence(F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(name))
