"""CSV datasets of the retail model: explicit schemas, header dispatch, malformed-row policy.

A dataset folder is read recursively; every file has its own header line. ``mode`` is Spark's:
FAILFAST stops at a malformed row, DROPMALFORMED skips it, PERMISSIVE keeps it and puts the raw
line in ``_corrupt``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

CORRUPT = "_corrupt"


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (p.split(":") for p in spec.split())])


class _Lazy(dict):
    """Schemas parsed on first use: parsing a type string may need a running session."""

    def __getitem__(self, name: str) -> T.StructType:
        value = super().__getitem__(name)
        if isinstance(value, str):
            value = _schema(value)
            self[name] = value
        return value


#: user_id arrives as "13060.0", so it is read as a double and narrowed afterwards.
SCHEMAS = _Lazy(
    transactions="transaction_id:string store_id:int payment_method_id:int voucher_id:string user_id:double original_amount:double discount_applied:double final_amount:double created_at:timestamp_ntz",
    transaction_items="transaction_id:string item_id:int quantity:int unit_price:double subtotal:double created_at:timestamp_ntz",
    menu_items="item_id:int item_name:string category:string price:double is_seasonal:boolean available_from:date available_to:date",
    stores="store_id:int store_name:string street:string postal_code:string city:string state:string latitude:double longitude:double",
    users="user_id:long gender:string birthdate:date registered_at:timestamp_ntz",
)

#: Typed original columns that a cleaned copy of each dataset keeps.
WIDE = {
    "transactions": ["transaction_id", "store_id", "user_id", "original_amount", "final_amount", "created_at"],
    "transaction_items": ["transaction_id", "item_id", "quantity", "unit_price", "subtotal", "created_at"],
    "menu_items": ["item_id", "item_name", "category", "price"],
    "stores": ["store_id", "store_name", "city", "state"],
    "users": ["user_id", "birthdate", "registered_at"],
}

#: Result files as they are written, without a header.
RESULT_SCHEMAS = _Lazy(
    query_1="transaction_id:string final_amount:double",
    query_2_best_selling="year_month:string item_name:string sellings_qty:long",
    query_2_most_profits="year_month:string profit_sum:double item_name:string",
    query_3="year_half:string store_name:string tpv:double",
    query_4="store_name:string birthdate:date",
)


def dataset_of(header: str) -> str:
    """The dataset whose header line this is; ValueError if none."""
    names = header.strip().split(",")
    for name in SCHEMAS:
        if SCHEMAS[name].names == names:
            return name
    raise ValueError(f"unknown header: {header!r}")


def detect(spark: SparkSession, path: str) -> str:
    """The dataset of a folder by the header of its files; ValueError if it is unknown, or if they differ. Only the
    lines that begin as a header does are collected, and each kind of them once."""
    first = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    starts = [",".join(SCHEMAS[n].names[:2]) for n in SCHEMAS]
    heads = first.filter(F.col("value").rlike("^(" + "|".join(starts) + "),")).distinct().limit(len(starts) + 1).collect()
    found = {dataset_of(r.value) for r in heads}
    if len(found) != 1:
        raise ValueError(f"{path} holds {', '.join(sorted(found)) or 'no known header'}")
    return found.pop()


def _options(mode: str) -> dict[str, object]:
    return {
        "header": True, "recursiveFileLookup": True, "pathGlobFilter": "*.csv", "enforceSchema": False, "mode": mode,
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd",
    }


def read_dataset(spark: SparkSession, path: str | list[str], name: str, mode: str = "FAILFAST") -> DataFrame:
    """All CSV files under ``path`` (one folder or several) with the full typed schema of ``name``."""
    schema, options = SCHEMAS[name], _options(mode)
    if mode.upper() == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options |= {"columnNameOfCorruptRecord": CORRUPT, "enforceSchema": True}
    return spark.read.schema(schema).options(**options).csv(path)


def quarantine(spark: SparkSession, path: str | list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a dataset and, apart, its malformed lines with the file and the block of it that they are
    in: ``file, block_start, line``. The files are parsed once; both parts are then read from a table in
    the shared folder that is divided by ``malformed``."""
    parsed = read_dataset(spark, path, name, "PERMISSIVE")
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start")
    parsed = parsed.select("*", *where, F.col(CORRUPT).isNotNull().cast("int").alias("malformed"))
    kept = written(parsed, "parsed", ["malformed"])
    bad = kept.filter("malformed = 1").select("file", "block_start", F.col(CORRUPT).alias("line"))
    return kept.filter("malformed = 0").select(*SCHEMAS[name].names), bad


def stream_dataset(spark: SparkSession, path: str, name: str, files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """The streaming twin: new files in the folder are the increments, so each holds whole lines. A micro-batch
    takes so many files at most or, with ``bytes_per_trigger``, files of about so many bytes (one at least)."""
    limit = {"maxBytesPerTrigger": bytes_per_trigger} if bytes_per_trigger else {"maxFilesPerTrigger": files_per_trigger}
    options = _options("DROPMALFORMED") | limit
    return spark.readStream.schema(SCHEMAS[name]).options(**options).csv(path)


def in_years(df: DataFrame, column: str, years: Sequence[int]) -> DataFrame:
    """Rows whose time is in one of the years, as ranges of the column itself, so that they reach the file scan."""
    kind, found = df.schema[column].dataType, F.lit(False)
    for year in sorted(set(years)):
        if year - 1 not in years:
            last = year
            while last + 1 in years:
                last += 1
            first, end = (F.lit(f"{y:04d}-01-01").cast(kind) for y in (year, last + 1))
            found = found | (F.col(column) >= first) & (F.col(column) < end)
    return df.filter(found)


def transactions(df: DataFrame) -> DataFrame:
    """Columns the reports need, with the calendar parts of ``created_at``."""
    at = F.col("created_at")
    return df.select(
        "transaction_id", F.year(at).alias("year"), "store_id", F.col("user_id").cast("long").alias("user_id"),
        F.month(at).alias("month"), F.hour(at).alias("hour"), "final_amount",
    )


def transaction_items(df: DataFrame) -> DataFrame:
    at = F.col("created_at")
    return df.select("item_id", F.year(at).alias("year"), F.month(at).alias("month"), "subtotal", "quantity")


def menu_items(df: DataFrame) -> DataFrame:
    return df.select("item_id", "item_name")


def stores(df: DataFrame) -> DataFrame:
    return df.select("store_id", "store_name")


def users(df: DataFrame) -> DataFrame:
    return df.select("user_id", "birthdate")


def wide(df: DataFrame, name: str) -> DataFrame:
    """The cleaned, typed columns of a dataset (what a sanitised copy holds)."""
    out = df.select(*WIDE[name])
    return out.withColumn("user_id", F.col("user_id").cast("long")) if name == "transactions" else out


def read_sanitised(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read back a headerless CSV copy that was written from :func:`wide`."""
    types = {f.name: f.dataType for f in SCHEMAS[name]} | ({"user_id": T.LongType()} if name == "transactions" else {})
    return spark.read.schema(T.StructType([T.StructField(c, types[c]) for c in WIDE[name]])).csv(path)


def read_result(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Read back one report file set written by :mod:`millrace.sinks`."""
    return spark.read.schema(RESULT_SCHEMAS[query]).csv(path)
