"""Readers of master data, lookups, logs and documents. All columns stay text until they are cast on purpose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import normalize as N

SEPARATORS = (";", ",", "\t")


SAMPLE_CHARS = 2048

# the bytes of Windows-1252 that ISO-8859-1 reads as control characters, and what they stand for; five bytes stand for nothing
_C1 = [x for x in range(0x80, 0xA0) if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_CONTROLS, _MEANT = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")


def sample(spark: SparkSession, path: str) -> str:
    """The first SAMPLE_CHARS characters of a text file, comment lines left out; what is no UTF-8 is U+FFFD."""
    lines = spark.read.text(path).filter("value not like '#%'").limit(SAMPLE_CHARS // 8).collect()
    return "\n".join(x for x, in lines)[:SAMPLE_CHARS]


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The most frequent separator of the sample; of equal ones the first of SEPARATORS."""
    text = sample(spark, path)
    return max(SEPARATORS, key=lambda s: (text.count(s), -SEPARATORS.index(s)))


def western(text: Column) -> Column:
    """Text that was read as ISO-8859-1, as Windows-1252 where that has a character for every byte."""
    return F.when(text.rlike("[\\x81\\x8d\\x8f\\x90\\x9d]"), text).otherwise(F.translate(text, _CONTROLS, _MEANT))


def read_master(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], mandatory: Sequence[str], encoding: str | None = None) -> DataFrame:
    """A CSV file with logical column names. aliases: logical name to physical headers; other headers are lower-cased; ValueError if a mandatory one is missing. Without an encoding: UTF-8 if the sample is, else Windows-1252."""
    found = encoding or ("ISO-8859-1" if "\ufffd" in sample(spark, path) else "UTF-8")
    raw = spark.read.csv(path, sep=sniff_separator(spark, path), header=True, encoding=found, inferSchema=False, mode="DROPMALFORMED")
    logical = {h.lower(): name for name, headers in aliases.items() for h in (*headers, name)}
    bare = lambda c: c.removeprefix("\u00ef\u00bb\u00bf").lstrip("\ufeff").strip().lower()
    names = {c: logical.get(bare(c), bare(c)) for c in raw.columns}
    if lacking := [x for x in mandatory if x not in names.values()]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    value = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    return raw.select(*((western(value(c)) if found == "ISO-8859-1" and not encoding else value(c)).alias(n) for c, n in names.items()))


def last_wins(rows: DataFrame, key: str) -> DataFrame:
    """One row to each filled key, the last in the order of the file."""
    numbered = rows.filter(F.col(key) != "").withColumn("_n", F.monotonically_increasing_id())
    return numbered.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_n").alias("_row")).select("_row.*")


def load_masters(spark: SparkSession, paths: Mapping[str, str], aliases: Mapping[str, Mapping[str, Sequence[str]]], mandatory: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """customers, partners and materials, and sales if its path is given; of materials with one id the last counts. FileNotFoundError for the first that must be there and has no path."""
    if lacking := [x for x in ("customers", "partners", "materials") if not paths.get(x)]:
        raise FileNotFoundError(f"no path for {', '.join(lacking)}")
    out = {name: read_master(spark, path, aliases.get(name, {}), mandatory.get(name, ())) for name, path in paths.items() if path}
    return out | {"materials": last_wins(out["materials"], mandatory["materials"][0])}


def check_profile(rows: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """What is wrong with a table of profiles, which must be one row of these values."""
    found = rows.select(*expected).limit(2).collect()
    if len(found) != 1:
        return [f"{'no' if not found else 'more than one'} profile"]
    return [f"{k} is {found[0][k]!r}, not {v!r}" for k, v in expected.items() if (found[0][k] or "").strip() != v]


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of paths that do not exist in their file system."""
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    return [x for x in paths if not path_of(x).getFileSystem(conf).exists(path_of(x))]


def read_lookup(spark: SparkSession, path: str, key: str, value: str | None = None) -> DataFrame:
    """Key (upper case) and value of a small CSV file; # starts a comment; the last of equal keys wins."""
    raw = spark.read.csv(path, sep=sniff_separator(spark, path), header=True, comment="#", inferSchema=False)
    rows = raw.select(F.upper(F.trim(key)).alias(key), *([F.trim(value).alias(value)] if value else []))
    rows = rows.filter(F.col(key) != "")
    if value is None:
        return rows.distinct()
    numbered = rows.filter(F.col(value) != "").withColumn("_n", F.monotonically_increasing_id())
    return numbered.groupBy(key).agg(F.max_by(value, "_n").alias(value))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that do not parse go."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_postal_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postal, cities) and (city, postals), sorted sets, of a JSON array of {nom, codesPostaux}."""
    pairs = spark.read.schema("nom string, codesPostaux array<string>").json(path, multiLine=True).select(F.col("nom").alias("city"), F.explode("codesPostaux").alias("postal"))
    sets = lambda k, v: pairs.groupBy(k).agg(F.sort_array(F.collect_set(v)).alias("cities" if v == "city" else "postals"))
    return sets("postal", "city"), sets("city", "postal")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """path, content and sha256 of files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 200_000) -> DataFrame:
    """path, length and text of the files below path, of each the first most_bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", decoded(F.substring("content", 1, most_bytes)).alias("text"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if it is valid, else Windows-1252, else ISO-8859-1; a byte order mark goes."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), western(F.decode(content, "ISO-8859-1")))
    return F.regexp_replace(text, "^\ufeff", "")


def load_audit(rows: DataFrame, name: str, required: Sequence[str]) -> DataFrame:
    """One row: table, rows, missing columns, valid."""
    lacking = [c for c in required if c not in rows.columns]
    return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(",".join(lacking)).alias("missing"), F.lit(not lacking).alias("valid"))


# fixed values: the headers of a master file that make up a party
PARTY = {"name": "NAME", "street": "STRAS", "city": "ORT01", "postal": "PSTLZ", "country": "LAND1", "vat": "VAT_NR"}


def parties(rows: DataFrame, id_column: str, headers: Mapping[str, str] = PARTY, country: str = "FR") -> DataFrame:
    """id, name, street, city, postal (five digits filled up), country and vat (bare) of the rows of a master file; what a file lacks is empty, the country the given one."""
    have = {c.lower(): c for c in rows.columns}
    value = lambda c: F.trim(F.coalesce(F.col(f"`{have[c.lower()]}`").cast("string"), F.lit(""))) if c.lower() in have else F.lit("")
    made = {name: value(header) for name, header in headers.items()}
    made |= {"postal": N.postal_padded(made["postal"]), "vat": N.vat_key(made["vat"]), "country": F.coalesce(F.nullif(made["country"], F.lit("")), F.lit(country))}
    return rows.select(value(id_column).alias("id"), *(c.alias(name) for name, c in made.items()))


def as_partners(customers: DataFrame) -> DataFrame:
    """Customers as delivery partners of their own: soldto and the fields of a party but the VAT number."""
    return customers.select(F.col("id").alias("soldto"), *(c for c in customers.columns if c != "vat"))


def table_status(audits: Sequence[DataFrame]) -> DataFrame:
    """One row of several load_audit() rows: tables, all_valid, rows, and invalid, the names of those that are not."""
    out = audits[0]
    for more in audits[1:]:
        out = out.unionByName(more)
    return out.agg(F.count("*").alias("tables"), F.bool_and("valid").alias("all_valid"), F.sum("rows").alias("rows"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("valid"), F.col("table_name")))), ",").alias("invalid"))
