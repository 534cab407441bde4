"""Readers of the domain tables, with explicit schemas and column maps.

Each reader takes paths that Spark can open; a path that isn't there fails when the table is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cohortry.functions.text import share, thousands
from cohortry.operators.filters import fully_known, other_factors, priced, text_filter
from cohortry.operators.pyramid import clean_ages

#: The files' headers (blanks inside and at the ends count) and our column names.
SALES_1400 = {
    "نام شرکت تولید کننده": "manufacturer_company_name",
    "نام شرکت تامین کننده": "supplier_company_name",
    "نام صاحب برند": "brand_owner",
    "توزیع کننده": "supplier",
    "کشور تولید  کننده": "manufacturer_country",
    "نام برند": "brand_name",
    "نام لاتین برند": "brand_latin_name",
    "نام ژنریک": "generic_name",
    "نام ماده موثره": "active_ingredient",
    "تعداد فروش (بسته)": "count_of_package_sold",
    "تعداد در بسته": "count_in_package",
    "فروش عددی": "sale_count",
    "فروش ریالی مصرف کننده": "sale_amount",
    "کد ژنریک": "generic_code",
    "OTC": "otc",
    "بیولوژیک": "biologic",
    "ATC Code": "atc_code",
}
SALES_1399 = {
    "صاحب پروانه": "brand_owner",
    "توزیع کننده": "supplier",
    "نام فرآورده (برند)": "brand_name",
    "تولیدی/وارداتی": "import_or_manufactured",
    "کشور تولید کننده": "manufacturer_country",
    "تحت لیسانس": "licensed",
    "نام ژنریک": "generic_name",
    "کد ژنریک": "generic_code",
    "ماده موثره": "active_ingredient",
    "تعداد فروش (بسته)": "count_of_package_sold",
    "تعداد در بسته": "count_in_package",
    "فروش عددی ": "sale_count",
    "فروش ریالی مصرف کننده ": "sale_amount",
    "OTC": "otc",
    "بیولوژیک": "biologic",
    "ATC Code": "atc_code",
    "IRC": "irc",
}
SHIPMENTS = {
    "جی ال ان توزیع کننده": "distributor_gln",
    "نام توزیع کننده": "distributor_name",
    "جی ال ان داروخانه": "pharmacy_gln",
    "نام داروخانه": "pharmacy_name",
    "تلفن ثابت داروخانه ": "pharmacy_phone",
    "شماره موبایل موسس داروخانه": "pharmacy_founder_mobile",
    "آدرس  داروخانه": "pharmacy_address",
    "نوع فرآورده": "product_type",
    "کد فرآورده": "product_code",
    "نام برند": "brand_name",
    "کد ژنریک": "generic_code",
    "نام ژنریک": "generic_name",
    "سری ساخت": "batch_number",
    "تاریخ رویداد": "event_date",
    "نام مالک فرآورده": "product_owner_name",
    "نام تامین کننده": "supplier_name",
    "تعداد در بسته": "units_per_package",
    "تعداد بسته ارسال شده": "packages_sent",
    "مجموع ارسال شده": "total_units_sent",
    "ارزش ریالی": "monetary_value",
    "استان": "province",
    "شهرستان": "county",
    "شهر": "city",
    "دانشگاه": "university",
}
SALES_2023 = {
    "نام شرکت پخش": "supplier",
    "نام صاحب برند": "brand_owner",
    "نام شرکت تامین کننده": "supplier_company_name",
    "نام شرکت تولید کننده": "manufacturer_company_name",
    "کد IRC محصول": "irc_code",
    "نام لاتین برند": "brand_latin_name",
    "نام برند": "brand_name",
    "نام لاتین فهرست": "index_latin_name",
    "کد ژنریک": "generic_code",
    "نام ژنریک": "generic_name",
    "تعداد فروش (بسته)": "count_of_package_sold",
    "تعداد در بسته": "count_in_package",
    "فروش عددی": "sale_count",
    "فروش ریالی ( مبتنی بر قیمت مصرف کننده)": "sale_amount",
    "OTC": "otc",
    "بیولوژیک": "biologic",
    "تحت لیسانس": "licensed",
    "کد ATC": "atc_code",
    "کشور تولید کننده": "manufacturer_country",
    "ثابت/فهرست": "constant",
    "تولیدی/وارداتی": "imported_manufactured",
    "ثبتی/فوریتی": "emergency_registered",
}
#: Shipment columns that no query uses.
SHIPMENT_EXTRAS = [
    "city", "county", "province", "university", "pharmacy_address", "distributor_gln", "event_date", "product_type",
    "pharmacy_founder_mobile", "pharmacy_phone", "pharmacy_name", "batch_number", "pharmacy_gln", "distributor_name",
]
AGE_BINS = ["0-4", "5-13", "14-18", "19-44", "45+"]
COUNTS = ["count_of_package_sold", "count_in_package", "sale_count", "units_per_package", "packages_sent", "total_units_sent"]
AMOUNTS = ["sale_amount", "monetary_value"]


#: Blanks around headers and cells count; quotes inside quotes are doubled. A file is one task only where quoted cells hold
#: line ends (``multiline``).
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
REJECTED = "_rejected"


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Known columns renamed, others as they are; counts become LONG and amounts DOUBLE."""
    df = df.withColumnsRenamed(names)
    kinds = {c: F.col(c).cast("long") for c in COUNTS if c in df.columns}
    return df.withColumns(kinds | {c: F.col(c).cast("double") for c in AMOUNTS if c in df.columns})


def csv_schema(spark: SparkSession, path: str, names: dict[str, str], required: Sequence[str] = (), multiline: bool = False) -> StructType:
    """The schema of a file's own header: counts LONG, amounts DOUBLE, all else STRING, whatever the cells hold. A header
    without one of the ``required`` columns (by our names) is an error."""
    header = spark.read.options(**CSV, multiLine=multiline).csv(path).columns
    lacking = sorted(set(required) - {names.get(c, c) for c in header})
    if lacking:
        raise ValueError(f"{path} has no column for {', '.join(lacking)}")
    kinds = dict.fromkeys(COUNTS, LongType()) | dict.fromkeys(AMOUNTS, DoubleType())
    return StructType([StructField(c, kinds.get(names.get(c, c), StringType())) for c in header])


def read_checked(
    spark: SparkSession, path: str, names: dict[str, str], required: Sequence[str] = (), multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file, or a folder of files of one header, that fit its schema, with our names; and what was
    rejected: file, record (as it stands) and its first cell. A record is rejected if it has too few or too many cells, or
    text where a count or an amount belongs; an empty cell is null."""
    schema = csv_schema(spark, path, names, required, multiline)
    texts = StructType([StructField(c, StringType()) for c in schema.names])
    df = spark.read.schema(texts.add(REJECTED, StringType())).options(
        **CSV, multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED, columnPruning=False
    ).csv(path)
    # casts are made here, so that what is rejected doesn't depend on the columns that a query goes on to use
    cells = {c: F.col(f"`{c}`") for c in schema.names}
    typed = {f.name: cells[f.name].try_cast(f.dataType) for f in schema.fields if not isinstance(f.dataType, StringType)}
    bad = F.col(REJECTED).isNotNull()
    for c, value in typed.items():
        bad = bad | (cells[c].isNotNull() & value.isNull())
    rows = df.filter(~bad).select(*[typed.get(c, cells[c]).alias(names.get(c, c)) for c in schema.names])
    record = F.coalesce(REJECTED, F.to_csv(F.struct(*cells.values()), {"escape": '"'}))
    return rows, df.filter(bad).select(F.col("_metadata.file_path").alias("file"), record.alias("record"), cells[schema.names[0]].alias("first_cell"))


def read_table(spark: SparkSession, path: str | Sequence[str], names: dict[str, str], multiline: bool = False) -> DataFrame:
    """Parquet, or CSV with a header, read with the header's schema; a CSV record that doesn't fit it is an error."""
    paths = [path] if isinstance(path, str) else list(path)
    if not paths[0].rstrip("/").endswith(".csv"):
        return renamed(spark.read.parquet(*paths), names)
    out = None
    for p in paths:  # each by its own header
        schema = csv_schema(spark, p, names, multiline=multiline)
        df = spark.read.schema(schema).options(**CSV, multiLine=multiline, mode="FAILFAST").csv(p).withColumnsRenamed(names)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_sales(spark: SparkSession, path_1400: str, path_1399: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, path_1400, SALES_1400), read_table(spark, path_1399, SALES_1399)


def read_shipments(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All parts in one table, without columns that no query uses; ``part`` is the number before the file's suffix."""
    out = None
    for path in paths:
        place = F.regexp_extract("_metadata.file_path", r"(\d+)\.\w+(?:/[^/]*)?$", 1).try_cast("int")
        df = read_table(spark, path, SHIPMENTS).withColumn("part", place)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.drop(*SHIPMENT_EXTRAS)


def read_sales_2023(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SALES_2023)


def read_summary(spark: SparkSession, path: str, count_column: str) -> DataFrame:
    return read_table(spark, path, {count_column: "sale_count"})


def cleaned_patient_ages(df: DataFrame) -> DataFrame:
    """Shares from percent texts, the other columns but Country from texts with thousands separators."""
    shares = [*AGE_BINS, "Age not known"]
    counts = [c for c in df.columns if c not in (*shares, "Country", "disease")]
    return df.withColumns({c: share(F.col(f"`{c}`")) for c in shares} | {c: thousands(F.col(f"`{c}`")) for c in counts})


def read_patient_ages(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One table for all diseases (disease -> path), cleaned, with only the rows of known age. Quoted names may hold
    newlines."""
    out = None
    for disease, path in paths.items():
        schema = csv_schema(spark, path, {}, ("Country", *AGE_BINS, "Age not known"), multiline=True)
        df = spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)
        total = next(c for c in df.columns if c.startswith("Total"))
        df = df.withColumnRenamed(total, "patients").withColumn("disease", F.lit(disease))
        out = df if out is None else out.unionByName(df)
    return fully_known(cleaned_patient_ages(out))


def age_shares(ages: DataFrame) -> DataFrame:
    """Long form: disease, Country, bin (from 0), share."""
    bins = F.posexplode(F.array(*[F.col(f"`{b}`") for b in AGE_BINS])).alias("bin", "share")
    return ages.select("disease", "Country", bins)


def read_pyramids(spark: SparkSession, paths: Sequence[str], drop_female: bool = True) -> DataFrame:
    """Population by age for the years in the files' names; the paths are given one by one."""
    df = spark.read.schema("Age string, M string, F string").csv(list(paths), header=True, enforceSchema=False)
    df = df.withColumn("year", F.regexp_extract("_metadata.file_name", r"(\d{4})", 1).cast("int"))
    return clean_ages(df, drop_female)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price list; ``N/A`` is null."""
    schema = csv_schema(spark, path, {}, ("price", "english_name"))
    return spark.read.schema(schema).options(**CSV, nullValue="N/A").csv(path)


def factor_prices(prices: DataFrame) -> DataFrame:
    """Strictly parsed prices above the threshold, for English names of the factor without its carrier."""
    return text_filter(priced(prices), [("english_name", "factor viii")], [("english_name", "von willebrand")])


def factor_names(sales: DataFrame) -> DataFrame:
    return other_factors(
        sales.select("index_latin_name", "brand_latin_name", "generic_name", "generic_code", "irc_code")
    )


def read_wide_matrix(df: DataFrame, scenario: str) -> DataFrame:
    """A square table (States, one column for each state, SUM) in long form: scenario, ord, from_state, to_state, prob.
    ``ord`` is the place of the from-state among the columns; the first state is the start."""
    states = [c for c in df.columns if c not in ("States", "SUM")]
    long = df.drop("SUM").unpivot("States", states, "to_state", "prob").withColumnRenamed("States", "from_state")
    place = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("from_state")).cast("int") - 1
    return long.select(F.lit(scenario).alias("scenario"), place.alias("ord"), "from_state", "to_state", "prob")
