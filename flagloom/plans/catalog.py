"""Query catalogue on the driver tables.

Each query maps one or more operator ids to the driver's TPC-H-like tables
(stand-ins: ``part`` is the catalog, ``p_name`` its two-tag "genre" list,
``p_brand`` the region, ``p_type`` the category; ``orders`` are titles with a
date, ``o_orderstatus`` F = movie, O = TV show, P = neither, and
``o_orderpriority`` is the rating). Every query reads whole tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` is the same
result as DuckDB SQL over views of the same Parquet files. Column names match
exactly; integer counts are BIGINT on both sides; doubles that are compared
are rounded, and the SQL rounds the same decimal text Spark rounds, so ties
go the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagloom.functions.names import safe_name_col
from flagloom.functions.scalars import (
    extract_int,
    first_token,
    format_pct,
    format_thousands,
    parse_text_date,
    pct,
    split_tokens,
)
from flagloom import streaming
from flagloom.operators import aggregate as agg
from flagloom.operators import clean, columns, dedupe, derive, encode, metrics, ml, rank, reshape
from flagloom.operators.setops import union_all
from flagloom.plans import pipeline
from flagloom.session import scratch_path
from flagloom.sources import io

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a DataFrame, listed anew: rows appended since are seen."""
    return io.read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def rnd(expr: str, digits: int) -> str:
    """DuckDB rounding that agrees with Spark's ``round`` on doubles.

    Spark rounds HALF_UP on the double's shortest decimal text, so the oracle
    rounds that same text (DuckDB prints doubles shortest-round-trip too).
    """
    return f"CAST(round(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


# Fixed parameters of the stand-in queries.
TAG_SEP = " "
ADJECTIVES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]


# --------------------------------------------------------------------------
# Flagship: top tag per brand (ENC-2, RSH-1..3, AGG-2, WIN-1, WIN-2)
# --------------------------------------------------------------------------

TOP_TAG_SQL = """
WITH t AS (SELECT p_brand, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part),
c AS (SELECT p_brand, tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY p_brand, tag)
SELECT p_brand, tag, n FROM c
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, tag) = 1
"""


@query("top_tag_per_brand", TOP_TAG_SQL)
def top_tag_per_brand(spark, sf_dir):
    """Most frequent tag per brand; long form (explode), one scan, one shuffle
    of partially aggregated (brand, tag) counts, then a bounded window."""
    part = table(spark, sf_dir, "part")
    tags = part.select("p_brand", F.explode(F.array_distinct(split_tokens("p_name", TAG_SEP))).alias("tag"))
    counts = agg.count_by(tags, ["p_brand", "tag"], "n")
    return rank.top_n_per_group(counts, ["p_brand"], ["-n", "tag"], 1)


@query("top_tag_per_brand_flags", TOP_TAG_SQL)
def top_tag_per_brand_flags(spark, sf_dir):
    """The same answer through the wide form: data-derived tag vocabulary ->
    one flag per tag -> unpivot the set flags -> count -> rank."""
    part = table(spark, sf_dir, "part")
    vocab = encode.vocabulary_list(part, "p_name", sep=TAG_SEP)
    names = {v: f"tag_{i}" for i, v in enumerate(vocab)}
    wide = encode.multi_hot(part.select("p_brand", "p_name"), "p_name", vocab, sep=TAG_SEP, names=names)
    long = reshape.unpivot_flags(wide, ["p_brand"], list(names.values()), key="tag", value="v",
                                 labels={n: v for v, n in names.items()})
    counts = agg.count_by(long, ["p_brand", "tag"], "n")
    return rank.top_n_per_group(counts, ["p_brand"], ["-n", "tag"], 1)


# --------------------------------------------------------------------------
# Sources and sinks
# --------------------------------------------------------------------------

PART_SCHEMA = ("p_partkey bigint, p_name string, p_brand string, p_type string, "
               "p_size int, p_retailprice double")


HARD_TEXT_SQL = ("CASE p_partkey % 7 WHEN 0 THEN ' padded ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'say \"hi\", ok' "
                 "WHEN 4 THEN 'one' || chr(10) || 'two' WHEN 5 THEN ' N/A ' ELSE p_name END")


@query("csv_roundtrip", f"SELECT p_partkey, {HARD_TEXT_SQL} AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_roundtrip(spark, sf_dir):
    """Write ``part`` as CSV under the shared checkpoint folder, its names made
    padded, empty, null, quoted or of two lines, and read it back
    with an explicit schema (no inference pass)."""
    k = F.col("p_partkey") % 7
    hard = (F.when(k == 0, " padded ").when(k == 1, "").when(k == 2, None).when(k == 3, 'say "hi", ok')
            .when(k == 4, "one\ntwo").when(k == 5, " N/A ").otherwise(F.col("p_name")))
    path = io.write_table(table(spark, sf_dir, "part").withColumn("p_name", hard), scratch_path(spark, "csv"),
                          fmt="csv", max_records_per_file=1_000_000)
    return io.read_table(spark, path, fmt="csv", schema=PART_SCHEMA, multi_line=True)


@query("csv_inferred", """
SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
""")
def csv_inferred(spark, sf_dir):
    """CSV read with inferred types (SRC-1): the smallest that fit, so keys come back as int."""
    path = io.write_table(table(spark, sf_dir, "part"), scratch_path(spark, "csv"), fmt="csv")
    return io.read_table(spark, path, fmt="csv", infer=True)


@query("csv_n_files", "SELECT CAST(3 AS BIGINT) AS n_files, count(*) AS n_rows FROM part")
def csv_n_files(spark, sf_dir):
    """A chosen number of files (SNK-2), counted from what was written."""
    path = io.write_table(table(spark, sf_dir, "part"), scratch_path(spark, "csv"), fmt="csv", num_files=3)
    files = io.sink_manifest(spark, path, "csv", PART_SCHEMA)
    return files.agg(F.count("*").alias("n_files"), F.sum("rows").alias("n_rows"))


@query("sink_manifest", "SELECT p_type, true AS has_files, count(*) AS n_rows FROM part GROUP BY p_type")
def sink_manifest(spark, sf_dir):
    """Files of a set written in partition folders: for each folder, whether it
    has files and the rows they hold together."""
    path = io.write_table(table(spark, sf_dir, "part"), scratch_path(spark, "manifest"),
                          partition_by=["p_type"], max_records_per_file=5_000_000)
    files = io.sink_manifest(spark, path)
    return (files.groupBy(F.regexp_extract("file_path", "/p_type=([^/]+)/", 1).alias("p_type"))
            .agg((F.count("*") >= 1).alias("has_files"), F.sum("rows").alias("n_rows")))


@query("column_profile", """
WITH p AS (SELECT p_partkey, p_name, p_brand, nullif(p_type, 'PROMO') AS p_type,
                  nullif(p_size, 7) AS p_size, p_retailprice FROM part)
SELECT 'p_partkey' AS "column", count(*) FILTER (WHERE p_partkey IS NULL) AS n_null FROM p
UNION ALL SELECT 'p_name', count(*) FILTER (WHERE p_name IS NULL) FROM p
UNION ALL SELECT 'p_brand', count(*) FILTER (WHERE p_brand IS NULL) FROM p
UNION ALL SELECT 'p_type', count(*) FILTER (WHERE p_type IS NULL) FROM p
UNION ALL SELECT 'p_size', count(*) FILTER (WHERE p_size IS NULL) FROM p
UNION ALL SELECT 'p_retailprice', count(*) FILTER (WHERE p_retailprice IS NULL) FROM p
""")
def column_profile(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumns({
        "p_type": F.nullif(F.col("p_type"), F.lit("PROMO")),
        "p_size": F.nullif(F.col("p_size"), F.lit(7)),
    })
    return agg.profile_columns(part)


SCHEMA_ROWS = [(0, "p_partkey", "bigint"), (1, "p_name", "string"), (2, "p_brand", "string"),
               (3, "p_type", "string"), (4, "p_size", "int"), (5, "p_retailprice", "double")]


@query("schema_listing", "\nUNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS \"type\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM part"
    for i, c, t in SCHEMA_ROWS))
def schema_listing(spark, sf_dir):
    """Names, positions and types of ``part`` with each column's null count:
    the schema listing folded into the one-scan column profile (SRC-3)."""
    return agg.profile_columns(table(spark, sf_dir, "part"), with_types=True)


@query("preview_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 20")
def preview_rows(spark, sf_dir):
    return io.preview(table(spark, sf_dir, "part"), 20, order_by=["p_partkey"])


# --------------------------------------------------------------------------
# Projections and column management (PRJ-*)
# --------------------------------------------------------------------------

@query("projection_basic", """
SELECT o_orderkey, o_totalprice AS total_price, o_orderpriority,
       CAST(floor(o_totalprice) AS BIGINT) AS price_floor, 'orders' AS source,
       TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS prio_num
FROM orders
""")
def projection_basic(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    o = columns.add_columns(o, {
        "price_floor": F.floor("o_totalprice"),
        "source": F.lit("orders"),
        "prio_num": "try_cast(substring(o_orderpriority, 1, 1) AS INT)",
    })
    o = columns.drop_columns(o, ["o_orderstatus", "no_such_column"])
    return columns.rename(o, {"o_totalprice": "total_price"})


@query("select_present_cols", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def select_present_cols(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keep = columns.present(part, ["p_partkey", "p_brand", "no_such_column", "p_size", "gone"])
    return columns.select_matching(part, r"^p_[a-z]+$", exclude_prefixes=("p_name", "p_type", "p_brand"),
                                   keep=keep)


@query("safe_names", r"""
SELECT DISTINCT value,
  regexp_replace(regexp_replace(replace(trim(value), '&', 'and'), '[ /-]', '_', 'g'), '[.'',]', '', 'g') AS name
FROM (SELECT o_orderpriority || ' & ' || o_orderstatus || '''s.' AS value FROM orders)
""")
def safe_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.concat("o_orderpriority", F.lit(" & "), "o_orderstatus", F.lit("'s."))
    return o.select(v.alias("value")).distinct().withColumn("name", safe_name_col("value"))


# --------------------------------------------------------------------------
# Filters and predicates (FLT-*)
# --------------------------------------------------------------------------

def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("filter_equality_range", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
""")
def filter_equality_range(spark, sf_dir):
    """Equality + closed year range, written on the raw date column so both
    predicates reach the Parquet scan as pushed filters."""
    o = table(spark, sf_dir, "orders")
    cond = ((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= _ts("1996-01-01"))
            & (F.col("o_orderdate") < _ts("2000-01-01")))
    return o.where(cond).select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("yr"))


MAKER_SQL = ("CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN ' N/A ' "
             "WHEN 'ECONOMY' THEN 'Not Found' ELSE p_type END")


def _maker(part):
    t = F.col("p_type")
    return (F.when(t == "PROMO", F.lit(None)).when(t == "SMALL", F.lit(" N/A "))
             .when(t == "ECONOMY", F.lit("Not Found")).otherwise(t))


@query("missing_predicate", f"""
SELECT CASE WHEN maker IS NULL OR lower(trim(maker)) IN ('', 'not found', 'not_found', 'n/a')
            THEN 'Original' ELSE 'Licensed' END AS origin, count(*) AS n
FROM (SELECT {MAKER_SQL} AS maker FROM part) GROUP BY 1
""")
def missing_predicate(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    p = part.select(derive.missing_class(_maker(part)).alias("origin"))
    return agg.count_by(p, ["origin"])


@query("boolean_like", """
WITH p AS (SELECT p_name, p_brand,
  CASE WHEN p_size < 10 THEN ' TRUE ' WHEN p_size < 20 THEN 'false' ELSE 'x' END AS txt_flag,
  CAST(p_size AS VARCHAR) AS size_text, p_size > 25 AS big, p_size FROM part)
SELECT 'p_name' AS "column", coalesce(bool_or(lower(trim(p_name)) IN ('true', 'false')), false) AS is_boolean_like FROM p
UNION ALL SELECT 'p_brand', coalesce(bool_or(lower(trim(p_brand)) IN ('true', 'false')), false) FROM p
UNION ALL SELECT 'txt_flag', coalesce(bool_or(lower(trim(txt_flag)) IN ('true', 'false')), false) FROM p
UNION ALL SELECT 'size_text', coalesce(bool_or(lower(trim(size_text)) IN ('true', 'false')), false) FROM p
UNION ALL SELECT 'big', true
UNION ALL SELECT 'p_size', false
""")
def boolean_like(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        "p_name", "p_brand",
        F.when(s < 10, F.lit(" TRUE ")).when(s < 20, F.lit("false")).otherwise(F.lit("x")).alias("txt_flag"),
        s.cast("string").alias("size_text"), (s > 25).alias("big"), "p_size")
    return clean.boolean_like_columns(p)


@query("boolean_like_convert", """
SELECT p_name, p_brand,
  CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 0 ELSE NULL END AS txt_flag,
  CAST(p_size AS VARCHAR) AS size_text, CAST(p_size > 25 AS INTEGER) AS big, p_size
FROM part
""")
def boolean_like_convert(spark, sf_dir):
    """Detect the boolean-like columns, then turn exactly those into 0/1
    (FLT-7 then CLN-6, as one operator)."""
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        "p_name", "p_brand",
        F.when(s < 10, F.lit(" TRUE ")).when(s < 20, F.lit("false")).otherwise(F.lit("x")).alias("txt_flag"),
        s.cast("string").alias("size_text"), (s > 25).alias("big"), "p_size")
    converted, _ = clean.convert_boolean_like(p)
    return converted


# --------------------------------------------------------------------------
# Missing values, mapping, casts (CLN-*)
# --------------------------------------------------------------------------

@query("fill_string", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'Not found') AS o_orderstatus,
       coalesce(nullif(o_orderpriority, '5-LOW'), 'Not found') AS o_orderpriority,
       nullif(o_custkey, 7) AS o_custkey
FROM orders
""")
def fill_string(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
        F.nullif(F.col("o_custkey"), F.lit(7)).alias("o_custkey"))
    return clean.fill_strings(o)


@query("fill_map", """
SELECT o_orderkey, coalesce(nullif(CAST(year(o_orderdate) AS INTEGER), 1998), 2000) AS year_added,
       coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS prio
FROM orders
""")
def fill_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif(F.year("o_orderdate"), F.lit(1998)).alias("year_added"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("prio"))
    return clean.fill_values(o, {"year_added": 2000, "prio": "none"})


@query("fill_zero", """
SELECT p_partkey, coalesce(nullif(p_size, 7), 0) AS p_size,
       coalesce(CAST(CASE WHEN p_size = 8 THEN NULL ELSE p_size > 40 END AS INTEGER), 0) AS big
FROM part
""")
def fill_zero(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.nullif(s, F.lit(7)).alias("p_size"),
        F.when(s == 8, F.lit(None)).otherwise(s > 40).alias("big"))
    return clean.fill_zero(p, ["p_size", "big"])


@query("value_map", """
SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS o_orderpriority
FROM orders
""")
def value_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = clean.replace_values(o, {"F": "finished", "O": "open"}, subset=["o_orderstatus"])
    return clean.replace_values(o, {"1-URGENT": "urgent"})


@query("value_map_table", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%-%' THEN lower(substring(o_orderpriority, 3)) ELSE o_orderpriority END
  AS o_orderpriority FROM orders
""")
def value_map_table(spark, sf_dir):
    """Values mapped by a table that the data give (CLN-4), the join chosen by its bytes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    names = (o.where(F.col("o_orderpriority").contains("-"))
             .select(F.col("o_orderpriority").alias("code"), F.lower(F.substring("o_orderpriority", 3, 100)).alias("name"))
             .distinct())
    return clean.map_values_table(o, "o_orderpriority", names, "code", "name")


@query("bool_to_int", """
WITH p AS (SELECT p_partkey,
  CASE p_size % 5 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE ' WHEN 2 THEN '7' WHEN 3 THEN 'x' ELSE NULL END AS txt,
  p_size > 25 AS b, p_size % 2 AS i FROM part)
SELECT p_partkey,
  CASE WHEN lower(trim(txt)) = 'true' THEN 1 WHEN lower(trim(txt)) = 'false' THEN 0
       ELSE TRY_CAST(lower(trim(txt)) AS INTEGER) END AS txt,
  CAST(b AS INTEGER) AS b, CAST(i AS INTEGER) AS i
FROM p
""")
def bool_to_int(spark, sf_dir):
    s = F.col("p_size")
    m = s % 5
    txt = (F.when(m == 0, F.lit("true")).when(m == 1, F.lit(" FALSE ")).when(m == 2, F.lit("7"))
            .when(m == 3, F.lit("x")))
    p = table(spark, sf_dir, "part").select("p_partkey", txt.alias("txt"), (s > 25).alias("b"),
                                            (s % 2).alias("i"))
    return clean.bool_to_int(p, ["txt", "b", "i"])


@query("casts", """
SELECT o_orderkey AS key_double_src, TRY_CAST(o_orderpriority AS INTEGER) AS prio_raw,
       TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS prio_code,
       CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_orderkey AS DOUBLE) AS key_double
FROM orders
""")
def casts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key_double_src"), F.col("o_orderpriority").alias("prio_raw"),
        F.substring("o_orderpriority", 1, 1).alias("prio_code"), "o_custkey",
        F.col("o_orderkey").alias("key_double"))
    return clean.cast_columns(o, {"prio_raw": "int", "prio_code": "int", "o_custkey": "int",
                                  "key_double": "double"})


SEGMENT_VARIANTS_SQL = ("CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN upper(c_mktsegment) "
                        "ELSE ' ' || c_mktsegment || ' ' END")


def _segment_variants(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, s = F.col("c_custkey") % 3, F.col("c_mktsegment")
    v = F.when(k == 0, F.lower(s)).when(k == 1, F.upper(s)).otherwise(F.concat(F.lit(" "), s, F.lit(" ")))
    return c.select(v.alias("segment"))


@query("distinct_names", f"""
SELECT DISTINCT upper(substr(trim(v), 1, 1)) || lower(substr(trim(v), 2)) AS name
FROM (SELECT {SEGMENT_VARIANTS_SQL} AS v FROM customer)
""")
def distinct_names(spark, sf_dir):
    return clean.normalize_values(_segment_variants(spark, sf_dir), "segment")


@query("distinct_names_counts", f"""
SELECT count(v) AS raw_count, count(DISTINCT upper(substr(trim(v), 1, 1)) || lower(substr(trim(v), 2))) AS unique_count
FROM (SELECT {SEGMENT_VARIANTS_SQL} AS v FROM customer)
""")
def distinct_names_counts(spark, sf_dir):
    return clean.normalize_report(_segment_variants(spark, sf_dir), "segment")


# --------------------------------------------------------------------------
# Scalar functions (FN-*)
# --------------------------------------------------------------------------

@query("split_first_token", """
SELECT p_partkey, trim(string_split(p_name, ' ')[1]) AS first_tag,
  CASE trim(string_split(p_name, ' ')[1]) WHEN 'small' THEN 'tiny' WHEN 'large' THEN 'big'
       ELSE trim(string_split(p_name, ' ')[1]) END AS canonical,
  list_contains(string_split(p_name, ' '), 'gear') AS has_gear,
  list_contains([p_type], 'PROMO') AS is_promo
FROM part
""")
def split_first_token(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    p = p.withColumn("first_tag", first_token("p_name", TAG_SEP))
    p = encode.canonicalize(p, "p_name", TAG_SEP, {"small": "tiny", "large": "big"}, out="canonical")
    return p.select("p_partkey", "first_tag", "canonical",
                    F.array_contains(F.split("p_name", TAG_SEP), "gear").alias("has_gear"),
                    F.array_contains(F.array("p_type"), "PROMO").alias("is_promo"))


@query("explode_counts", """
SELECT tag AS value, count(*) AS n
FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part)
WHERE tag <> '' GROUP BY tag
""")
def explode_counts(spark, sf_dir):
    return encode.vocabulary(table(spark, sf_dir, "part"), "p_name", sep=TAG_SEP)


@query("regex_number", r"""
SELECT p_partkey,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN TRY_CAST(regexp_extract(p_brand, '#(\d+)', 1) AS INTEGER) END AS brand_no,
  CASE WHEN p_type = 'LARGE' THEN TRY_CAST(regexp_extract(p_size || ' Seasons', '(\d+)\s*Season', 1) AS INTEGER) END AS seasons
FROM part
""")
def regex_number(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    p = p.withColumn("season_text", F.concat(F.col("p_size").cast("string"), F.lit(" Seasons")))
    p = derive.extract_number(p, "p_brand", r"#(\d+)", "brand_no", when=F.col("p_type").isin("SMALL", "MEDIUM"))
    p = derive.extract_number(p, "season_text", derive.SEASONS_PATTERN, "seasons",
                              when=F.col("p_type") == "LARGE")
    return p.select("p_partkey", "brand_no", "seasons")


@query("regex_number_pages", r"""
SELECT page_id, TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS INTEGER) AS url_num FROM pages
""")
def regex_number_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract_int("url", r"/(\d+)").alias("url_num"))


TEXT_DATE_SQL = ("CASE o_orderstatus WHEN 'P' THEN 'Not found' "
                 "WHEN 'O' THEN ' ' || strftime(o_orderdate, '%B %-d, %Y') "
                 "ELSE strftime(o_orderdate, '%B %-d, %Y') END")


@query("text_dates", f"""
WITH t AS (SELECT o_orderkey, {TEXT_DATE_SQL} AS txt FROM orders)
SELECT o_orderkey, txt, CAST(try_strptime(trim(txt), '%B %-d, %Y') AS DATE) AS parsed,
       CAST(coalesce(year(try_strptime(trim(txt), '%B %-d, %Y')), 2000) AS INTEGER) AS year_added
FROM t
""")
def text_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s, d = F.col("o_orderstatus"), F.date_format("o_orderdate", "MMMM d, yyyy")
    txt = F.when(s == "P", F.lit("Not found")).when(s == "O", F.concat(F.lit(" "), d)).otherwise(d)
    o = o.select("o_orderkey", txt.alias("txt"))
    return o.withColumns({"parsed": parse_text_date("txt"),
                          "year_added": derive.year_with_default("txt", "MMMM d, yyyy", 2000)})


@query("growth_by_added_year", f"""
WITH t AS (SELECT {TEXT_DATE_SQL} AS txt FROM orders)
SELECT CAST(year(try_strptime(trim(txt), '%B %-d, %Y')) AS INTEGER) AS year_added, count(*) AS content_count
FROM t GROUP BY 1
""")
def growth_by_added_year(spark, sf_dir):
    """Titles per year of the added date parsed from text; unreadable dates
    form their own (null) year, nothing is dropped (FN-8..10, AGG-2)."""
    o = table(spark, sf_dir, "orders")
    s, d = F.col("o_orderstatus"), F.date_format("o_orderdate", "MMMM d, yyyy")
    txt = F.when(s == "P", F.lit("Not found")).when(s == "O", F.concat(F.lit(" "), d)).otherwise(d)
    years = o.select(F.year(parse_text_date(txt)).alias("year_added"))
    return rank.sort_by(agg.count_by(years, ["year_added"], "content_count"), ["year_added"])


@query("null_tests_round", f"""
SELECT o_orderkey,
  CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS bucket,
  nullif(o_orderstatus, 'P') IS NULL AS no_status,
  {rnd('CAST(o_custkey AS DOUBLE) / (o_orderkey + 1) * 100', 2)} AS cust_share
FROM orders
""")
def null_tests_round(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        F.when(p < 100000, F.lit("low")).when(p < 300000, F.lit("mid")).otherwise(F.lit("high")).alias("bucket"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).isNull().alias("no_status"),
        pct(F.col("o_custkey"), F.col("o_orderkey") + 1, 2).alias("cust_share"))


SHARE_SQL = f"""
WITH c AS (SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, count, {rnd('count / (SELECT sum(count) FROM c) * 100', 3)} AS percentage FROM c
"""


@query("share_of_total", SHARE_SQL)
def share_of_total(spark, sf_dir):
    return agg.share_of_total(table(spark, sf_dir, "orders"), ["o_orderpriority"], digits=3)


@query("formatted_share", f"""
WITH s AS ({SHARE_SQL})
SELECT o_orderpriority, count, percentage, printf('%.1f%%', {rnd('percentage', 1)}) AS label,
       format('{{:,}}', count) AS count_text
FROM s
""")
def formatted_share(spark, sf_dir):
    s = agg.share_of_total(table(spark, sf_dir, "orders"), ["o_orderpriority"], digits=3)
    return s.withColumns({"label": format_pct("percentage", 1), "count_text": format_thousands("count")})


# --------------------------------------------------------------------------
# Encoding (ENC-*)
# --------------------------------------------------------------------------

STATUS_KIND = {"movie": "F", "tv_show": "O"}


@query("indicator_flags", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS movie,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS tv_show
FROM orders
""")
def indicator_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encode.indicator(o, "o_orderstatus", STATUS_KIND).drop("o_orderstatus")


MULTI_HOT_TAGS = ["small", "red", "gear", "widget", "hot"]


def _tag_sql(tag: str) -> str:
    return f"coalesce(list_contains(string_split(p_name, ' '), '{tag}'), false)"


@query("multi_hot_tags", "SELECT p_partkey, " + ", ".join(
    f"{_tag_sql(t)} AS {t}" for t in MULTI_HOT_TAGS) + " FROM part")
def multi_hot_tags(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return encode.multi_hot(p, "p_name", MULTI_HOT_TAGS, sep=TAG_SEP, drop_source=True)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _prio_name(v: str) -> str:
    return v.replace("-", "_").replace(" ", "_")


@query("one_hot_bool", "SELECT o_orderkey, " + ", ".join(
    f"coalesce(o_orderpriority = '{v}', false) AS \"{_prio_name(v)}\"" for v in PRIORITIES) + " FROM orders")
def one_hot_bool(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return encode.one_hot(o, "o_orderpriority", as_type="boolean", drop_source=True)


@query("one_hot_int", "SELECT p_partkey, " + ", ".join(
    f"CAST(coalesce(p_type = '{v}', false) AS INTEGER) AS {v}" for v in PART_TYPES) + " FROM part")
def one_hot_int(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return encode.one_hot(p, "p_type", as_type="int", drop_source=True)


@query("decode_flags", "SELECT o_orderkey, CASE " + " ".join(
    f"WHEN o_orderpriority = '{v}' THEN '{v}'" for v in PRIORITIES[:-1]) + " ELSE 'Not_Found' END AS priority FROM orders")
def decode_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    wide = encode.one_hot(o, "o_orderpriority", vocab=PRIORITIES[:-1], as_type="int", drop_source=True)
    flags = {_prio_name(v): v for v in PRIORITIES[:-1]}
    return encode.decode_one_hot(wide, flags, "priority", default="Not_Found").select("o_orderkey", "priority")


@query("decoded_value_counts", "SELECT CASE " + " ".join(
    f"WHEN o_orderpriority = '{v}' THEN '{v}'" for v in PRIORITIES[:-1])
    + " ELSE 'Not_Found' END AS priority, count(*) AS count FROM orders GROUP BY 1")
def decoded_value_counts(spark, sf_dir):
    """Label rebuilt from its flags, then titles per label, most frequent
    first (ENC-7, AGG-3)."""
    return agg.value_counts(decode_flags(spark, sf_dir), "priority")


FLAG_COUNT_TAGS = ["small", "red", "ring", "widget", "hot", "gear"]


@query("flag_count_strict", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size > 10 AS INTEGER) + CAST(p_type = 'PROMO' AS INTEGER) END AS n
FROM part
""")
def flag_count_strict(spark, sf_dir):
    """Flag sum that is null when any flag is (``null_as_zero=False``)."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_type") == "PROMO").alias("promo"),
                                            F.when(F.col("p_size") % 5 != 0, F.col("p_size") > 10).alias("big"))
    return encode.row_flag_count(p, ["promo", "big"], "n", null_as_zero=False).select("p_partkey", "n")


@query("flag_count", f"""
WITH p AS (SELECT p_partkey, {' + '.join(f'CAST({_tag_sql(t)} AS INTEGER)' for t in FLAG_COUNT_TAGS)} AS n_tags FROM part)
SELECT p_partkey, n_tags,
  CASE WHEN n_tags > 1 THEN 'Multi-Country' WHEN n_tags = 1 THEN 'Single-Country' ELSE 'Unknown' END AS tag_class
FROM p
""")
def flag_count(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    wide = encode.multi_hot(p, "p_name", FLAG_COUNT_TAGS, sep=TAG_SEP, drop_source=True)
    wide = encode.row_flag_count(wide, FLAG_COUNT_TAGS, "n_tags")
    return wide.select("p_partkey", "n_tags", derive.count_class("n_tags").alias("tag_class"))


# --------------------------------------------------------------------------
# Derived features (DRV-*)
# --------------------------------------------------------------------------

LENGTH_SQL = """CASE WHEN p_type = 'SMALL' THEN
    CASE WHEN p_size * 3 < 30 THEN 'Short' WHEN p_size * 3 BETWEEN 30 AND 90 THEN 'Medium' ELSE 'Long' END
  WHEN p_type = 'LARGE' THEN
    CASE WHEN nullif(p_size % 5, 0) = 1 THEN 'One_Season' WHEN nullif(p_size % 5, 0) BETWEEN 2 AND 3 THEN 'Multi_Season'
         ELSE 'Long_Running' END
  ELSE 'Unknown' END"""


def _length_frame(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return derive.length_class(
        p, "length_class", movie_flag=F.col("p_type") == "SMALL", minutes=F.col("p_size") * 3,
        tv_flag=F.col("p_type") == "LARGE", seasons=F.nullif(F.col("p_size") % 5, F.lit(0)))


@query("length_class", f"SELECT p_partkey, {LENGTH_SQL} AS length_class FROM part")
def length_class(spark, sf_dir):
    return _length_frame(spark, sf_dir).select("p_partkey", "length_class")


@query("length_class_counts", f"SELECT {LENGTH_SQL} AS length_class, count(*) AS n FROM part GROUP BY 1")
def length_class_counts(spark, sf_dir):
    return agg.count_by(_length_frame(spark, sf_dir), ["length_class"])


DECADE_YEAR_SQL = "CAST(year(o_orderdate) + 25 - (o_orderkey % 6) * 15 AS INTEGER)"


@query("decade_class", f"""
WITH o AS (SELECT o_orderkey, {DECADE_YEAR_SQL} AS yr FROM orders)
SELECT o_orderkey, yr,
  CASE WHEN yr >= 2020 THEN '2020s' WHEN yr >= 1950 THEN CAST(CAST(floor(yr / 10) * 10 AS INTEGER) AS VARCHAR) || 's'
       ELSE 'Unknown' END AS decade
FROM o
""")
def decade_class(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    yr = (F.year("o_orderdate") + 25 - (F.col("o_orderkey") % 6) * 15).cast("int")
    return o.select("o_orderkey", yr.alias("yr")).withColumn("decade", derive.decade_label("yr"))


@query("period_split", """
SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'Before 1998' ELSE 'After 1998' END AS production_period,
       count(*) AS total_titles
FROM orders GROUP BY 1
""")
def period_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.select(derive.period_label(F.year("o_orderdate"), 1998, "Before 1998", "After 1998")
                 .alias("production_period"))
    return agg.count_by(p, ["production_period"], "total_titles")


@query("label_cast", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS label FROM orders")
def label_cast(spark, sf_dir):
    o = encode.indicator(table(spark, sf_dir, "orders"), "o_orderstatus", STATUS_KIND)
    return o.select("o_orderkey", derive.label_from_flag("movie").alias("label"))


# --------------------------------------------------------------------------
# Distinct and de-duplication (DDP-*)
# --------------------------------------------------------------------------

@query("distinct_projection", "SELECT DISTINCT lang, source FROM documents")
def distinct_projection(spark, sf_dir):
    return dedupe.distinct_rows(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("dup_report", """
SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows
FROM documents
""")
def dup_report(spark, sf_dir):
    return dedupe.dup_report(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("dedupe_documents", """
SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1
""")
def dedupe_documents(spark, sf_dir):
    return dedupe.dedupe(table(spark, sf_dir, "documents"), ["text", "lang"], ["doc_id"])


# --------------------------------------------------------------------------
# Aggregation (AGG-*)
# --------------------------------------------------------------------------

@query("total_rows", "SELECT count(*) AS n FROM orders")
def total_rows(spark, sf_dir):
    return agg.count_rows(table(spark, sf_dir, "orders"))


@query("count_by_group", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
""")
def count_by_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderpriority")
    return agg.count_by(o, ["yr", "o_orderpriority"])


@query("value_counts", """
SELECT event_type, count(*) AS count FROM (SELECT nullif(event_type, 'error') AS event_type FROM events)
WHERE event_type IS NOT NULL GROUP BY 1
""")
def value_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    return agg.value_counts(e, "event_type")


ALL_TAGS = ADJECTIVES + NOUNS


def _tag_flags(spark, sf_dir, tags=ALL_TAGS, extra=()):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", *extra)
    return encode.multi_hot(p, "p_name", tags, sep=TAG_SEP)


def _flag_totals_sql(where: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS flag, CAST(coalesce(sum(CAST({_tag_sql(t)} AS INTEGER)), 0) AS BIGINT) AS total FROM part {where}"
        for t in ALL_TAGS)


@query("flag_totals", _flag_totals_sql())
def flag_totals(spark, sf_dir):
    return agg.flag_totals(_tag_flags(spark, sf_dir), ALL_TAGS)


@query("flag_totals_filtered", _flag_totals_sql("WHERE p_type = 'PROMO'"))
def flag_totals_filtered(spark, sf_dir):
    return agg.flag_totals(_tag_flags(spark, sf_dir), ALL_TAGS, where=F.col("p_type") == "PROMO")


MEASURES_SQL = """
SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS Movie_Count,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS TVShow_Count
FROM orders GROUP BY o_orderpriority
"""


def _measures(spark, sf_dir):
    o = encode.indicator(table(spark, sf_dir, "orders"), "o_orderstatus", STATUS_KIND)
    return agg.group_sums(o, ["o_orderpriority"], {"Movie_Count": "movie", "TVShow_Count": "tv_show"})


@query("measures_per_group", MEASURES_SQL)
def measures_per_group(spark, sf_dir):
    return _measures(spark, sf_dir)


@query("melted_measures", f"""
WITH m AS ({MEASURES_SQL})
SELECT o_orderpriority, 'Movie_Count' AS Content_Type, Movie_Count AS Count FROM m
UNION ALL SELECT o_orderpriority, 'TVShow_Count', TVShow_Count FROM m
""")
def melted_measures(spark, sf_dir):
    return reshape.melt(_measures(spark, sf_dir), ["o_orderpriority"], ["Movie_Count", "TVShow_Count"],
                        "Content_Type", "Count")


@query("group_means", f"""
SELECT p_type, {rnd('avg(p_size)', 4)} AS avg_p_size, {rnd('avg(p_retailprice)', 4)} AS avg_p_retailprice
FROM part GROUP BY p_type
""")
def group_means(spark, sf_dir):
    return agg.group_means(table(spark, sf_dir, "part"), ["p_type"], ["p_size", "p_retailprice"], digits=4)


@query("group_means_embeddings", f"""
WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, CAST(i - 1 AS INTEGER) AS position, {rnd('avg(v)', 4)} AS avg_value FROM x GROUP BY label, i
""")
def group_means_embeddings(spark, sf_dir):
    """Mean of every dimension of the vectors per label, in long form."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select("label", F.posexplode("embedding").alias("position", "value"))
    return agg.group_means(e, ["label", "position"], ["value"], digits=4)


@query("min_max", """
SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS start_year, CAST(max(year(o_orderdate)) AS INTEGER) AS end_year
FROM orders
""")
def min_max(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"))
    return agg.min_max(o, "yr", "start_year", "end_year")


TWO_WAY_TAGS = ALL_TAGS + ["purple"]


@query("two_way_pct_by_flag", f"""
WITH tags AS (SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in TWO_WAY_TAGS)}) AS t(tag)),
x AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag,
             CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS m, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS t
      FROM part),
a AS (SELECT tag, CAST(sum(m) AS BIGINT) AS movie_count, CAST(sum(t) AS BIGINT) AS tvshow_count FROM x GROUP BY tag)
SELECT tags.tag, movie_count, tvshow_count,
  {rnd('CAST(movie_count AS DOUBLE) / nullif(movie_count + tvshow_count, 0) * 100', 1)} AS movie_percentage,
  {rnd('CAST(tvshow_count AS DOUBLE) / nullif(movie_count + tvshow_count, 0) * 100', 1)} AS tvshow_percentage
FROM tags LEFT JOIN a ON tags.tag = a.tag
""")
def two_way_pct_by_flag(spark, sf_dir):
    """Per tag: 'movie' and 'tv' rows carrying it and their shares; one scan
    (the union-of-filtered-aggregates shape scans once per tag)."""
    p = _tag_flags(spark, sf_dir, TWO_WAY_TAGS)
    p = encode.indicator(p, "p_type", {"movie": "ECONOMY", "tv_show": "PROMO"})
    return agg.two_way_pct_by_flag(p, TWO_WAY_TAGS, "movie", "tv_show", key="tag",
                                   a_count="movie_count", b_count="tvshow_count",
                                   a_pct="movie_percentage", b_pct="tvshow_percentage", digits=1)


def _in_list(values):
    return ", ".join(f"'{v}'" for v in values)


@query("tag_cooccurrence", f"""
WITH t AS (SELECT list_filter(string_split(p_name, ' '), lambda x: x IN ({_in_list(ADJECTIVES)})) AS l,
                  list_filter(string_split(p_name, ' '), lambda x: x IN ({_in_list(NOUNS)})) AS r FROM part),
a AS (SELECT unnest(list_distinct(l)) AS adjective, r FROM t),
b AS (SELECT adjective, unnest(list_distinct(r)) AS noun FROM a)
SELECT adjective, noun, count(*) AS n FROM b GROUP BY adjective, noun
""")
def tag_cooccurrence(spark, sf_dir):
    """(adjective, noun) pairs carried by the same part, counted: the array
    form of the co-occurrence table (RSH-3); pairs only ever form inside a row."""
    toks = split_tokens("p_name", TAG_SEP)
    p = table(spark, sf_dir, "part").select(
        F.filter(toks, lambda x: x.isin(ADJECTIVES)).alias("adj"),
        F.filter(toks, lambda x: x.isin(NOUNS)).alias("nouns"))
    pairs = reshape.cooccurrence_arrays(p, "adj", "nouns", "adjective", "noun")
    return agg.count_by(pairs, ["adjective", "noun"])


# --------------------------------------------------------------------------
# Sort, top-k, windows (SRT-*, WIN-*)
# --------------------------------------------------------------------------

@query("sorted_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def sorted_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"))
    return rank.sort_by(agg.count_by(o, ["yr"]), ["yr"])


@query("yearly_trend", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS release_year, count(*) AS total_titles FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
GROUP BY 1 ORDER BY 1
""")
def yearly_trend(spark, sf_dir):
    """Titles per year inside a closed year range, in year order (FLT-2,
    AGG-2, SRT-1); the range is written on the date column so it is pushed
    into the scan."""
    o = table(spark, sf_dir, "orders")
    o = o.where((F.col("o_orderdate") >= _ts("1996-01-01")) & (F.col("o_orderdate") < _ts("2000-01-01")))
    counts = agg.count_by(o.select(F.year("o_orderdate").alias("release_year")), ["release_year"], "total_titles")
    return rank.sort_by(counts, ["release_year"])


@query("top5_tags", """
SELECT tag, count(*) AS total FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part)
WHERE tag <> '' GROUP BY tag ORDER BY total DESC, tag LIMIT 5
""")
def top5_tags(spark, sf_dir):
    totals = encode.vocabulary(table(spark, sf_dir, "part"), "p_name", sep=TAG_SEP, value="tag", count="total")
    return rank.top_k(totals, ["-total", "tag"], 5)


@query("top5_flag_totals", "WITH f AS (" + _flag_totals_sql() + ") SELECT flag, total FROM f ORDER BY total DESC, flag LIMIT 5")
def top5_flag_totals(spark, sf_dir):
    """The five most common flags: one-pass totals, long form, then a top-k
    with a name tie-break (AGG-5, RSH-4, SRT-4)."""
    totals = agg.flag_totals(_tag_flags(spark, sf_dir), ALL_TAGS)
    return rank.top_k(totals, ["-total", "flag"], 5)


def _top3_sql(joined: bool) -> str:
    means = "\nUNION ALL ".join(
        f"SELECT p_type, '{t}' AS feature, avg(CAST({_tag_sql(t)} AS INTEGER)) AS value FROM part GROUP BY p_type"
        for t in ALL_TAGS)
    ranked = (f"WITH m AS ({means}), r AS (SELECT p_type, feature, value, "
              "CAST(row_number() OVER (PARTITION BY p_type ORDER BY value DESC, feature) AS INTEGER) AS rank FROM m) ")
    if joined:
        return ranked + "SELECT p_type, string_agg(feature, ', ' ORDER BY rank) AS top_features FROM r WHERE rank <= 3 GROUP BY p_type"
    return ranked + f"SELECT p_type, rank, feature, {rnd('value', 4)} AS value FROM r WHERE rank <= 3"


def _tag_means(spark, sf_dir):
    return agg.group_means(_tag_flags(spark, sf_dir, ALL_TAGS), ["p_type"], ALL_TAGS)


@query("top3_features_per_group", _top3_sql(False))
def top3_features_per_group(spark, sf_dir):
    top = rank.top_n_measures(_tag_means(spark, sf_dir), ["p_type"], [f"avg_{a}" for a in ALL_TAGS],
                              n=3, strip_prefix="avg_")
    return top.withColumn("value", F.round("value", 4))


@query("top3_features_joined", _top3_sql(True))
def top3_features_joined(spark, sf_dir):
    return rank.top_n_measures(_tag_means(spark, sf_dir), ["p_type"], [f"avg_{a}" for a in ALL_TAGS],
                               n=3, joined="top_features", strip_prefix="avg_")


# --------------------------------------------------------------------------
# Set operations (SET-1)
# --------------------------------------------------------------------------

@query("union_all_reports", """
SELECT 'orders' AS source, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'customer' AS source, c_mktsegment AS key, count(*) AS n FROM customer GROUP BY c_mktsegment
""")
def union_all_reports(spark, sf_dir):
    a = agg.count_by(table(spark, sf_dir, "orders"), ["o_orderstatus"]).select(
        F.lit("orders").alias("source"), F.col("o_orderstatus").alias("key"), "n")
    b = agg.count_by(table(spark, sf_dir, "customer"), ["c_mktsegment"]).select(
        F.lit("customer").alias("source"), F.col("c_mktsegment").alias("key"), "n")
    return union_all([a, b])


# --------------------------------------------------------------------------
# Machine learning (ML-*) and metrics (ML-12..15)
# --------------------------------------------------------------------------


MODEL_FEATURES = ["p_size", "p_retailprice", *NOUNS]
SEED = 42


def _model_frame(spark, sf_dir):
    """part with numeric features: size, price and one 0/1 column per noun tag."""
    p = _tag_flags(spark, sf_dir, NOUNS, extra=("p_retailprice",))
    return clean.bool_to_int(p, NOUNS).drop("p_name")


#: The stated layout of the fits below: their results hold for it only, and a
#: larger table has as many more tasks.
FIT_ROWS = 50_000


def _clustered(spark, sf_dir, k):
    """The model frame with its cluster, written once: fits and scores read the files."""
    p = ml.assemble(_model_frame(spark, sf_dir), MODEL_FEATURES, "features")
    model = ml.fit_kmeans(p, k=k, seed=SEED, key="p_partkey", rows_per_partition=FIT_ROWS)
    out = ml.assign_clusters(model, p).withColumn("cluster", F.col("cluster").cast("double"))
    return pipeline.write_stage(out, scratch_path(spark, "clustered"))


@query("feature_vectors", """
SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice,
                   CAST(CAST(coalesce(list_contains(string_split(p_name, ' '), 'gear'), false) AS INTEGER) AS DOUBLE)] AS features
FROM part
""")
def feature_vectors(spark, sf_dir):
    p = clean.bool_to_int(_tag_flags(spark, sf_dir, ["gear"], extra=("p_retailprice",)), ["gear"])
    v = ml.assemble(p, ["p_size", "p_retailprice", "gear"], "vec")
    return v.select("p_partkey", ml.vector_values("vec").alias("features"))


@query("feature_vectors_keep", """
SELECT p_partkey, [CASE WHEN p_size > 25 THEN CAST('nan' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END, p_retailprice] AS features
FROM part
""")
def feature_vectors_keep(spark, sf_dir):
    """Vectors that keep rows with a null feature, as NaN (``handle_invalid="keep"``)."""
    p = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") <= 25, F.col("p_size")))
    return ml.assemble(p, ["size", "p_retailprice"], "vec", "keep").select("p_partkey", ml.vector_values("vec").alias("features"))


def _embedding_clusters(spark, sf_dir, k):
    e = ml.array_features(table(spark, sf_dir, "embeddings"), "embedding")
    model = ml.fit_kmeans(e, k=k, seed=SEED, key="vec_id", rows_per_partition=FIT_ROWS)
    return model, ml.assign_clusters(model, e)


@query("kmeans_assign", "SELECT vec_id, true AS at_nearest_centre FROM embeddings")
def kmeans_assign(spark, sf_dir):
    """Embeddings clustered with k=4, seed 42: whether each row's assigned
    centre is its nearest (the centres are k literal vectors)."""
    model, out = _embedding_clusters(spark, sf_dir, 4)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    v = ml.vector_values("features")
    gaps = F.transform(centres, lambda c: F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)),
                                                      F.lit(0.0), lambda s, x: s + x))
    own = F.element_at(F.col("gaps"), F.col("cluster") + 1)
    return (out.select("vec_id", "cluster", gaps.alias("gaps"))
            .select("vec_id", (own <= F.array_min("gaps") * (1 + 1e-9)).alias("at_nearest_centre")))


@query("kmeans_sizes", "SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_clusters, true AS ids_in_range FROM embeddings")
def kmeans_sizes(spark, sf_dir):
    """Sizes of three clusters, folded into their total, number and range of ids."""
    sizes = agg.count_by(_embedding_clusters(spark, sf_dir, 3)[1], ["cluster"], "count")
    return sizes.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_clusters"),
                     F.bool_and(F.col("cluster").between(0, 2)).alias("ids_in_range"))


@query("cluster_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd(f'avg(CAST({e} AS DOUBLE))', 4)} AS overall_mean FROM part"
    for c, e in [("p_size", "p_size"), ("p_retailprice", "p_retailprice"),
                 *((t, f"CAST({_tag_sql(t)} AS INTEGER)") for t in NOUNS)]))
def cluster_profile(spark, sf_dir):
    """Mean of every feature per KMeans cluster (ML-5); weighted by the
    clusters' sizes the means give back the overall mean."""
    rows = _clustered(spark, sf_dir, 4)
    profile = agg.group_means(rows, ["cluster"], MODEL_FEATURES).join(agg.count_by(rows, ["cluster"], "n"), "cluster")
    overall = profile.agg(*[(F.sum(F.col(f"avg_{c}") * F.col("n")) / F.sum("n")).alias(c) for c in MODEL_FEATURES])
    return reshape.melt(overall, [], MODEL_FEATURES, "feature", "overall_mean").withColumn(
        "overall_mean", F.round("overall_mean", 4))


PROFILE_MEANS = {"minutes": "p_size * 4", "seasons": "p_size % 4", "year": "1990 + p_partkey % 31"}


@query("cluster_description", """
WITH f AS (SELECT p_brand, p_size * 4 AS minutes, p_size % 4 AS seasons, 1990 + p_partkey % 31 AS year, """
       + ", ".join(f"CAST({_tag_sql(t)} AS INTEGER) AS {t}" for t in NOUNS) + """ FROM part),
prof AS (SELECT p_brand, avg(minutes) AS avg_minutes, avg(seasons) AS avg_seasons, avg(year) AS avg_year, """
       + ", ".join(f"avg({t}) AS avg_{t}" for t in NOUNS) + """ FROM f GROUP BY p_brand),
m AS (""" + "\nUNION ALL ".join(f"SELECT p_brand, '{t}' AS feature, avg_{t} AS value FROM prof" for t in NOUNS) + """),
top AS (SELECT p_brand, string_agg(feature, ', ' ORDER BY rn) AS top_features FROM (
          SELECT p_brand, feature, row_number() OVER (PARTITION BY p_brand ORDER BY value DESC, feature) AS rn FROM m)
        WHERE rn <= 3 GROUP BY p_brand)
SELECT prof.p_brand,
  CASE WHEN avg_minutes > 90 THEN 'full-length' WHEN avg_seasons > 1 THEN 'multi-season' ELSE 'short-or-single' END AS length_note,
  CASE WHEN avg_year > 2005 THEN 'recent' ELSE 'older' END AS era_note, top.top_features
FROM prof LEFT JOIN top ON prof.p_brand = top.p_brand
""")
def cluster_description(spark, sf_dir):
    """Rule-based description of each group's mean profile (ML-6); groups are
    brands so the answer is deterministic and checkable."""
    p = clean.bool_to_int(_tag_flags(spark, sf_dir, NOUNS, extra=("p_brand",)), NOUNS)
    p = p.withColumns({k: F.expr(v) for k, v in PROFILE_MEANS.items()})
    profile = agg.group_means(p, ["p_brand"], ["minutes", "seasons", "year", *NOUNS])
    return ml.describe_clusters(profile, "p_brand", "avg_minutes", "avg_seasons", "avg_year",
                                [f"avg_{t}" for t in NOUNS], year_cut=2005)


HASH_SQL = "CAST(('0x' || substr(md5('42|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"
TEST_SQL = HASH_SQL.format(key="p_partkey") + " >= 0.8 * 4294967296"


@query("hash_split", f"""
WITH b AS (SELECT o_orderkey, {HASH_SQL.format(key='o_orderkey')} AS bucket FROM orders)
SELECT o_orderkey, bucket, CASE WHEN bucket < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS split FROM b
""")
def hash_split(spark, sf_dir):
    return ml.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8, SEED)


def _forest_pipeline(train):
    return ml.fit_forest_pipeline(train, MODEL_FEATURES, "cluster", trees=20, seed=SEED, key="p_partkey",
                                  rows_per_partition=FIT_ROWS)


def _known(label, k):
    """Whether a prediction is one of the classes 0 .. k-1."""
    return (F.col(label).isNotNull() & F.col(label).isin([float(i) for i in range(k)])).alias("known_class")


def _learned(pairs, chance):
    """Whether a model beats every constant prediction on ``pairs``, and one fitted on
    labels drawn anew does not on ``chance``: two rows that reach the driver."""
    own, drawn = (metrics.learning_facts(p).first() for p in (pairs, chance))
    return {"learned": F.lit(own["accuracy"] > own["largest_share"] + own["margin"]),
            "chance_without_labels": F.lit(drawn["accuracy"] <= drawn["largest_share"] + drawn["margin"])}


LEARNED_SQL = "true AS known_class, true AS learned, true AS chance_without_labels"


@query("rf_cluster_label", f"SELECT p_partkey, {LEARNED_SQL} FROM part WHERE {TEST_SQL}")
def rf_cluster_label(spark, sf_dir):
    """Forest pipeline (assembler + 20 trees, seed 42) predicting the KMeans
    cluster, trained on the hash-split train rows: one prediction, of a class
    that exists, for each test row. The held-out accuracy is above the largest
    cluster's share; the same fit on labels drawn anew is not."""
    data = _clustered(spark, sf_dir, 4)

    def scored(rows):
        train, test = ml.split_frames(rows, "p_partkey", 0.8, SEED)
        out = _forest_pipeline(train).transform(test).select("p_partkey", F.col("cluster").alias("label"), "prediction")
        return pipeline.write_stage(out, scratch_path(spark, "scored"))

    pairs = scored(data)
    facts = _learned(pairs, scored(ml.redraw_labels(data, "cluster", "p_partkey", SEED + 1)))
    return pairs.select("p_partkey", _known("prediction", 4)).withColumns(facts)


@query("rf_fit_all", f"SELECT p_partkey, {LEARNED_SQL} FROM part")
def rf_fit_all(spark, sf_dir):
    """Forest with default size fitted and scored on all rows (k=3 clusters). The
    fit on labels drawn anew is measured on the labels of another draw."""
    data = _clustered(spark, sf_dir, 3)

    def scored(rows, against):
        model = ml.fit_forest(rows, "cluster", "features", seed=SEED, key="p_partkey", rows_per_partition=FIT_ROWS)
        out = model.transform(against).select("p_partkey", F.col("cluster").alias("label"), "prediction")
        return pipeline.write_stage(out, scratch_path(spark, "scored"))

    pairs = scored(data, data)
    draws = [ml.redraw_labels(data, "cluster", "p_partkey", SEED + i) for i in (1, 2)]
    return pairs.select("p_partkey", _known("prediction", 3)).withColumns(_learned(pairs, scored(*draws)))


def _binary_frame(spark, sf_dir):
    """Numeric features of the catalog and whether a title is a movie; the flags of
    its type are not among the features."""
    enc, feat = _wide_features(spark, sf_dir)
    cols = [*enc.genre_flags, "duration_min", "seasons_num", "country_count", "release_year"]
    feat = feat.withColumn("label", derive.label_from_flag(MOVIE_COL))
    return pipeline.model_input(feat, cols, CATALOG_SPEC).select("show_id", "label", "features")


def _rf_binary_predictions(spark, sf_dir, data=None):
    if data is None:
        data = pipeline.write_stage(_binary_frame(spark, sf_dir), scratch_path(spark, "binary"))
    train, test = ml.split_frames(data, "show_id", 0.8, SEED)
    model = ml.fit_forest(train, "label", "features", trees=50, seed=SEED, key="show_id", rows_per_partition=FIT_ROWS)
    return pipeline.write_stage(model.transform(test).select("show_id", "label", "prediction"),
                                scratch_path(spark, "scored"))


def rf_binary(spark, sf_dir):
    """Forest of 50 trees that tells movies from other titles, on held-out titles,
    and the same fit on labels drawn anew."""
    data = pipeline.write_stage(_binary_frame(spark, sf_dir), scratch_path(spark, "binary"))
    pairs = _rf_binary_predictions(spark, sf_dir, data)
    facts = _learned(pairs, _rf_binary_predictions(spark, sf_dir, ml.redraw_labels(data, "label", "show_id", SEED + 1)))
    return pairs.select("show_id", "label", _known("prediction", 2)).withColumns(facts)


@query("rf_metrics", "SELECT unnest(['accuracy', 'weighted_precision', 'weighted_recall', 'weighted_f1']) AS metric, true AS agrees")
def rf_metrics(spark, sf_dir):
    """The one-pass metrics of the forest against the textbook formulas on the
    same prediction pairs, one class at a time."""
    pairs = _rf_binary_predictions(spark, sf_dir)
    ours = metrics.classification_metrics(pairs)
    names = ours.columns
    hit = (F.col("label") == F.col("prediction")).cast("int")
    parts = []
    for c in (0.0, 1.0):
        is_label, is_guess = (F.col("label") == c).cast("int"), (F.col("prediction") == c).cast("int")
        both = F.sum(is_label * is_guess)
        p, r = F.coalesce(F.try_divide(both, F.sum(is_guess)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.sum(is_label)), F.lit(0.0))
        parts.append((F.avg(is_label), p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))))
    plain = pairs.agg(F.avg(hit).alias("accuracy"), *[sum((w[0] * w[i] for w in parts), F.lit(0.0)).alias(n)
                                                     for i, n in enumerate(names[1:], 1)])
    both = (reshape.melt(ours, [], names, "metric", "a").join(reshape.melt(plain, [], names, "metric", "b"), "metric"))
    return both.select("metric", (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("agrees"))


@query("feature_importance", "SELECT unnest([" + ", ".join(f"'{c}'" for c in MODEL_FEATURES)
       + "]) AS feature, true AS in_range, 1.0::DOUBLE AS total")
def feature_importance(spark, sf_dir):
    """One importance per feature, each within 0 and 1, together 1."""
    train, _ = ml.split_frames(_clustered(spark, sf_dir, 4), "p_partkey", 0.8, SEED)
    found = ml.feature_importances(spark, _forest_pipeline(train), MODEL_FEATURES, digits=9)
    total = found.select(F.round(F.sum("importance"), 6)).scalar()
    return found.select("feature", F.col("importance").between(0, 1).alias("in_range"), total.alias("total"))


# Rule-based predictions, so the metrics have an exact oracle.
PRED_SQL = ("WITH s AS (SELECT CAST(list_position([" + ", ".join(f"'{t}'" for t in PART_TYPES)
            + "], p_type) - 1 AS DOUBLE) AS label, p_size FROM part), "
            "r AS (SELECT label, CASE WHEN p_size % 4 = 0 THEN CAST((CAST(label AS INTEGER) + 1) % 6 AS DOUBLE) "
            "ELSE label END AS pr FROM s), "
            "p AS (SELECT label, CASE WHEN pr = 5 THEN 0.0 ELSE pr END AS prediction FROM r)")

PER_CLASS_SQL = PRED_SQL + """,
conf AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction),
cls AS (SELECT c, sum(tp) AS tp, sum(predicted) AS predicted, sum(support) AS support FROM (
    SELECT label AS c, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM conf
    UNION ALL SELECT prediction AS c, 0 AS support, n AS predicted, 0 AS tp FROM conf) GROUP BY c),
pc AS (SELECT c, tp, predicted, support, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
              coalesce(tp / nullif(support, 0), 0.0) AS recall FROM cls),
pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pc)"""


def _rule_predictions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    label = (F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")) - 1).cast("double")
    pr = F.when(F.col("p_size") % 4 == 0, ((label.cast("int") + 1) % 6).cast("double")).otherwise(label)
    return p.select(label.alias("label"), pr.alias("pr")).select(
        "label", F.when(F.col("pr") == 5, F.lit(0.0)).otherwise(F.col("pr")).alias("prediction"))


@query("class_metrics", PER_CLASS_SQL + f"""
SELECT {rnd('sum(tp) / sum(support)', 6)} AS accuracy,
       {rnd('sum(precision * support) / sum(support)', 6)} AS weighted_precision,
       {rnd('sum(recall * support) / sum(support)', 6)} AS weighted_recall,
       {rnd('sum(f1 * support) / sum(support)', 6)} AS weighted_f1
FROM pf
""")
def class_metrics(spark, sf_dir):
    return metrics.classification_metrics(_rule_predictions(spark, sf_dir), digits=6)


@query("confusion_counts", PRED_SQL + " SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction")
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(_rule_predictions(spark, sf_dir))


@query("confusion_matrix", PRED_SQL + " SELECT label, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE prediction = {c}.0) AS BIGINT) AS pred_{c}" for c in range(6))
    + ", CAST(count(*) FILTER (WHERE prediction IS NULL OR prediction NOT IN (0, 1, 2, 3, 4, 5)) AS BIGINT) AS pred_other"
    + " FROM p GROUP BY label")
def confusion_matrix(spark, sf_dir):
    """Wide confusion matrix: one row per label, one column per class (ML-14)."""
    return metrics.confusion_matrix(_rule_predictions(spark, sf_dir), [float(c) for c in range(6)])


@query("class_report", PER_CLASS_SQL + f"""
SELECT CAST(CAST(c AS INTEGER) AS VARCHAR) AS class, {rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall,
       {rnd('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, {rnd('sum(tp) / sum(support)', 6)}, CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', {rnd('avg(precision)', 6)}, {rnd('avg(recall)', 6)}, {rnd('avg(f1)', 6)},
                 CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', {rnd('sum(precision * support) / sum(support)', 6)},
                 {rnd('sum(recall * support) / sum(support)', 6)}, {rnd('sum(f1 * support) / sum(support)', 6)},
                 CAST(sum(support) AS BIGINT) FROM pf
""")
def class_report(spark, sf_dir):
    return metrics.class_report(_rule_predictions(spark, sf_dir), digits=6)


# --------------------------------------------------------------------------
# The composed catalog paths on a raw catalog derived from ``part``
# --------------------------------------------------------------------------


COUNTRY_MAP = {"United States": "USA", "United Kingdom": "UK"}
CATALOG_SPEC = pipeline.CatalogSpec(country_map=COUNTRY_MAP)

RAW_CATALOG_SQL = r"""
raw AS (SELECT 's' || CAST(p_partkey AS VARCHAR) AS show_id,
  CASE WHEN p_type IN ('ECONOMY', 'MEDIUM', 'SMALL') THEN 'Movie' WHEN p_type IN ('PROMO', 'LARGE') THEN 'TV Show' END AS type,
  p_name AS title,
  CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN '' ELSE p_brand END AS director,
  CASE p_partkey % 5 WHEN 0 THEN 'United States, India' WHEN 1 THEN 'India' WHEN 2 THEN NULL
       WHEN 3 THEN 'United Kingdom, France, United States' ELSE 'France,India , France' END AS country,
  CASE WHEN p_partkey % 9 = 0 THEN 'Not found'
       ELSE strftime(DATE '2015-01-01' + CAST(p_partkey % 2500 AS INTEGER), '%B %-d, %Y') END AS date_added,
  CASE WHEN p_partkey % 13 = 0 THEN 'unknown' ELSE CAST(1940 + (p_partkey * 7) % 85 AS VARCHAR) END AS release_year,
  CASE p_size % 6 WHEN 0 THEN 'TV-MA' WHEN 1 THEN 'PG-13' WHEN 2 THEN 'R' WHEN 3 THEN 'TV-Y7-FV' WHEN 4 THEN NULL
       ELSE '84 min' END AS rating,
  CASE WHEN p_size = 13 THEN 'unknown'
       WHEN p_type IN ('ECONOMY', 'MEDIUM', 'SMALL') THEN CAST(p_size * 4 AS VARCHAR) || ' min'
       WHEN p_type IN ('PROMO', 'LARGE') THEN CAST(p_size % 5 AS VARCHAR) || CASE WHEN p_size % 5 = 1 THEN ' Season' ELSE ' Seasons' END
  END AS duration,
  replace(p_name, ' ', ', ') AS listed_in
FROM part),
dd AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY title, release_year ORDER BY show_id) = 1)"""

COUNTRIES_SQL = ("list_distinct(list_filter(list_transform(string_split(country, ','), lambda x: CASE trim(x) "
                 + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_MAP.items())
                 + " ELSE trim(x) END), lambda x: x <> ''))")
GENRES_SQL = "list_distinct(list_filter(list_transform(string_split(listed_in, ','), lambda x: trim(x)), lambda x: x <> ''))"


def raw_catalog(spark, sf_dir):
    """A raw, messy catalog computed from ``part`` (one title per part)."""
    p = table(spark, sf_dir, "part")
    key, size, ptype = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    movie, tv = ptype.isin("ECONOMY", "MEDIUM", "SMALL"), ptype.isin("PROMO", "LARGE")
    d7, k5 = size % 7, key % 5
    added = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (key % 2500).cast("int")), "MMMM d, yyyy")
    r6 = size % 6
    s5 = (size % 5).cast("string")
    return p.select(
        F.concat(F.lit("s"), key.cast("string")).alias("show_id"),
        F.when(movie, F.lit("Movie")).when(tv, F.lit("TV Show")).alias("type"),
        F.col("p_name").alias("title"),
        F.when(d7 == 0, F.lit(None)).when(d7 == 1, F.lit(" N/A ")).when(d7 == 2, F.lit(""))
         .otherwise(F.col("p_brand")).alias("director"),
        F.when(k5 == 0, F.lit("United States, India")).when(k5 == 1, F.lit("India"))
         .when(k5 == 2, F.lit(None)).when(k5 == 3, F.lit("United Kingdom, France, United States"))
         .otherwise(F.lit("France,India , France")).alias("country"),
        F.when(key % 9 == 0, F.lit("Not found")).otherwise(added).alias("date_added"),
        F.when(key % 13 == 0, F.lit("unknown"))
         .otherwise((F.lit(1940) + (key * 7) % 85).cast("string")).alias("release_year"),
        F.when(r6 == 0, F.lit("TV-MA")).when(r6 == 1, F.lit("PG-13")).when(r6 == 2, F.lit("R"))
         .when(r6 == 3, F.lit("TV-Y7-FV")).when(r6 == 4, F.lit(None)).otherwise(F.lit("84 min")).alias("rating"),
        F.when(size == 13, F.lit("unknown"))
         .when(movie, F.concat((size * 4).cast("string"), F.lit(" min")))
         .when(tv, F.concat(s5, F.when(size % 5 == 1, F.lit(" Season")).otherwise(F.lit(" Seasons"))))
         .alias("duration"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("listed_in"),
    )


def _catalog_rows(spark, sf_dir):
    raw = pipeline.dedupe_catalog(raw_catalog(spark, sf_dir), CATALOG_SPEC)
    return pipeline.catalog_rows(raw, CATALOG_SPEC)


def _features_sql(source: str) -> str:
    return rf"""
WITH {RAW_CATALOG_SQL},
f AS (SELECT show_id, CASE WHEN type = 'Movie' THEN 1 ELSE 0 END AS movie,
             CASE WHEN type = 'TV Show' THEN 1 ELSE 0 END AS tv_show, coalesce(rating, 'Not_Found') AS rating,
             director, release_year, duration,
             CAST(coalesce(len({COUNTRIES_SQL}), 0) AS INTEGER) AS country_count,
             CAST(coalesce(len({GENRES_SQL}), 0) AS INTEGER) AS n_genres FROM {source}),
g AS (SELECT *, CASE WHEN movie = 1 THEN TRY_CAST(regexp_extract(duration, '(\d+)\s*min', 1) AS INTEGER) END AS duration_min,
             CASE WHEN tv_show = 1 THEN TRY_CAST(regexp_extract(duration, '(\d+)\s*Season', 1) AS INTEGER) END AS seasons_num,
             TRY_CAST(release_year AS INTEGER) AS ry FROM f)
SELECT show_id, movie, tv_show, rating, duration_min, seasons_num,
  CASE WHEN movie = 1 THEN CASE WHEN duration_min IS NULL THEN 'Long' WHEN duration_min <= 29 THEN 'Short'
                                WHEN duration_min BETWEEN 30 AND 90 THEN 'Medium' ELSE 'Long' END
       WHEN tv_show = 1 THEN CASE WHEN seasons_num IS NULL THEN 'Long_Running' WHEN seasons_num = 1 THEN 'One_Season'
                                  WHEN seasons_num BETWEEN 2 AND 3 THEN 'Multi_Season' ELSE 'Long_Running' END
       ELSE 'Unknown' END AS content_length_category,
  CASE WHEN director IS NULL OR lower(trim(director)) IN ('', 'not found', 'not_found', 'n/a') THEN 'Original'
       ELSE 'Licensed' END AS content_origin,
  CASE WHEN ry >= 2020 THEN '2020s' WHEN ry >= 1950 THEN CAST(CAST(floor(ry / 10) * 10 AS INTEGER) AS VARCHAR) || 's'
       ELSE 'Unknown' END AS release_decade,
  country_count,
  CASE WHEN country_count > 1 THEN 'Multi-Country' WHEN country_count = 1 THEN 'Single-Country' ELSE 'Unknown' END
    AS multi_country_production,
  n_genres
FROM g
"""


@query("catalog_features", _features_sql("dd"))
def catalog_features(spark, sf_dir):
    """Raw catalog -> de-duplicated rows -> features, in the long form."""
    rows = _catalog_rows(spark, sf_dir).withColumn("n_genres", F.size("genres"))
    return rows.select("show_id", "movie", "tv_show", *pipeline.FEATURE_COLUMNS, "n_genres")


def _wide_features(spark, sf_dir):
    enc = pipeline.encode_catalog(pipeline.dedupe_catalog(raw_catalog(spark, sf_dir), CATALOG_SPEC), CATALOG_SPEC)
    return enc, pipeline.feature_catalog(enc, CATALOG_SPEC)


@query("catalog_features_wide", _features_sql("dd"))
def catalog_features_wide(spark, sf_dir):
    """The same features through flag columns, handed off as typed Parquet."""
    enc, feat = _wide_features(spark, sf_dir)
    feat = encode.row_flag_count(feat, list(enc.genre_flags), "n_genres")
    feat = pipeline.write_stage(feat, scratch_path(spark, "features"))
    return feat.select("show_id", "movie", "tv_show", *pipeline.FEATURE_COLUMNS, "n_genres")


@query("catalog_top_genre_per_country", f"""
WITH {RAW_CATALOG_SQL},
c1 AS (SELECT unnest({COUNTRIES_SQL}) AS country, listed_in FROM dd),
c2 AS (SELECT country, unnest({GENRES_SQL}) AS genre FROM c1),
cnt AS (SELECT country, genre, count(*) AS count FROM c2 GROUP BY country, genre)
SELECT country, genre, count FROM cnt QUALIFY row_number() OVER (PARTITION BY country ORDER BY count DESC, genre) = 1
""")
def catalog_top_genre_per_country(spark, sf_dir):
    return pipeline.top_genre_per_country(_catalog_rows(spark, sf_dir))


@query("catalog_type_share_by_country", f"""
WITH {RAW_CATALOG_SQL},
c1 AS (SELECT unnest({COUNTRIES_SQL}) AS country, CASE WHEN type = 'Movie' THEN 1 ELSE 0 END AS m,
              CASE WHEN type = 'TV Show' THEN 1 ELSE 0 END AS t FROM dd),
a AS (SELECT country, CAST(sum(m) AS BIGINT) AS movie_count, CAST(sum(t) AS BIGINT) AS tvshow_count FROM c1 GROUP BY country)
SELECT country, movie_count, tvshow_count,
  {rnd('CAST(movie_count AS DOUBLE) / nullif(movie_count + tvshow_count, 0) * 100', 1)} AS movie_percentage,
  {rnd('CAST(tvshow_count AS DOUBLE) / nullif(movie_count + tvshow_count, 0) * 100', 1)} AS tvshow_percentage
FROM a
""")
def catalog_type_share_by_country(spark, sf_dir):
    return pipeline.type_share_by_country(_catalog_rows(spark, sf_dir))


@query("catalog_rating_share", f"""
WITH {RAW_CATALOG_SQL},
c AS (SELECT coalesce(rating, 'Not_Found') AS rating, count(*) AS count FROM dd GROUP BY 1)
SELECT rating, count, {rnd('count / (SELECT sum(count) FROM c) * 100', 3)} AS percentage FROM c
""")
def catalog_rating_share(spark, sf_dir):
    return pipeline.rating_share(_catalog_rows(spark, sf_dir))


@query("catalog_clusters", f"""
WITH {RAW_CATALOG_SQL} SELECT count(*) AS n_rows, true AS ids_in_range FROM dd
""")
def catalog_clusters(spark, sf_dir):
    """Stage 3 + KMeans (k=4, seed 42) on the written catalog features: the
    cluster sizes, folded into their total and range of ids."""
    enc, feat = _wide_features(spark, sf_dir)
    cols = [MOVIE_COL, TV_COL, *enc.genre_flags, "duration_min", "seasons_num", "country_count", "release_year"]
    x = pipeline.write_stage(pipeline.model_input(feat, cols, CATALOG_SPEC).select("show_id", "features"),
                             scratch_path(spark, "model-input"))
    model = ml.fit_kmeans(x, k=4, seed=SEED, key="show_id", rows_per_partition=FIT_ROWS)
    sizes = agg.count_by(ml.assign_clusters(model, x), ["cluster"], "count")
    return sizes.agg(F.sum("count").alias("n_rows"), F.bool_and(F.col("cluster").between(0, 3)).alias("ids_in_range"))


MOVIE_COL, TV_COL = pipeline.MOVIE_FLAG, pipeline.TV_FLAG

query("rf_binary", f"""
WITH {RAW_CATALOG_SQL}
SELECT show_id, CASE WHEN type = 'Movie' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, {LEARNED_SQL}
FROM dd WHERE {HASH_SQL.format(key='show_id')} >= 0.8 * 4294967296
""")(rf_binary)


# --------------------------------------------------------------------------
# Streaming: the row-wise stages on files arriving in a directory
# --------------------------------------------------------------------------


RAW_CATALOG_SCHEMA = ("show_id string, type string, title string, director string, country string, "
                      "date_added string, release_year string, rating string, duration string, listed_in string")


@query("stream_catalog_features", _features_sql("raw"))
def stream_catalog_features(spark, sf_dir):
    """The raw catalog lands as CSV files; a Structured Streaming query
    (available-now trigger) encodes them into a Parquet table, which is read
    back. Same features as ``catalog_features`` without the de-duplication."""
    raw = raw_catalog(spark, sf_dir)
    spec = streaming.fixed_vocabularies(CATALOG_SPEC, raw)
    src = io.write_table(raw, scratch_path(spark, "stream-src"), fmt="csv", max_records_per_file=5_000_000)
    stream = streaming.read_catalog_stream(spark, src, RAW_CATALOG_SCHEMA, max_files_per_trigger=1000)
    enc, feat = streaming.encode_stream(stream, spec)
    feat = encode.row_flag_count(feat, list(enc.genre_flags), "n_genres")
    sink = scratch_path(spark, "stream-sink")
    streaming.run_to_parquet(feat.select("show_id", "movie", "tv_show", *pipeline.FEATURE_COLUMNS, "n_genres"),
                             sink).awaitTermination()
    return io.read_table(spark, sink)


# --------------------------------------------------------------------------
# The same operators on the largest driver table (work grows with the data)
# --------------------------------------------------------------------------

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("lineitem_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM lineitem" for c in LINEITEM_COLS))
def lineitem_profile(spark, sf_dir):
    """Null count of every lineitem column in one scan (AGG-4)."""
    return agg.profile_columns(table(spark, sf_dir, "lineitem"))


@query("lineitem_status_share", f"""
WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, count, {rnd('count / (SELECT sum(count) FROM c) * 100', 3)} AS percentage FROM c
""")
def lineitem_status_share(spark, sf_dir):
    """Share of all line items per (return flag, line status) (AGG-9)."""
    return agg.share_of_total(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], digits=3)


@query("lineitem_top_parts_per_supplier", """
WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty
           FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, n, qty FROM c
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) <= 3
""")
def lineitem_top_parts_per_supplier(spark, sf_dir):
    """Three parts with the largest shipped quantity per supplier (AGG-2,
    WIN-1/2): partial aggregate, then a window group limit map-side."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return rank.top_n_per_group(per, ["l_suppkey"], ["-qty", "l_partkey"], 3)


@query("lineitem_first_line_per_order", f"""
SELECT {', '.join(LINEITEM_COLS)} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, {', '.join(
    f'{c} NULLS FIRST' for c in LINEITEM_COLS if c not in ('l_orderkey', 'l_linenumber'))}) = 1
""")
def lineitem_first_line_per_order(spark, sf_dir):
    """One whole row per order, the lowest line number (DDP-3 on a numeric key).
    Line numbers repeat inside an order in this data, so the operator's
    tie-break (the remaining columns in order) decides, as the SQL states."""
    return dedupe.dedupe(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"])


from flagloom.plans import files as _files  # noqa: E402,F401  registers the queries on files and layouts
