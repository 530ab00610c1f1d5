"""Registered profiling and preparation queries."""

import uuid

from pyspark.sql import functions as F

from probity.functions import text
from probity.operators import prep, profile
from probity.plans.registry import register
from probity.session import ensure_checkpoint_dir
from probity.sources import datasets
from probity.sources.tables import TABLES, table, view, with_views

# Comparable columns of the given tables by kind, for the comparison SQL.
NUMERIC = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn"],
}
TEXT = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}
DATES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}


def kinds(name):
    for kind, columns in (("numeric", NUMERIC), ("text", TEXT), ("datetime", DATES)):
        for c in columns.get(name, []):
            yield c, kind


def counts_sql(name, source=None):
    source = source or name
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, COUNT(*) AS "rows", COUNT(DISTINCT {c}) AS unique_count,
                   COUNT(*) - COUNT({c}) AS null_count,
                   ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 3) AS null_percentage FROM {source}"""
        for c, kind in kinds(name)
    )


def stats_sql(name, source=None):
    source = source or name
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", MIN({c})::DOUBLE AS "min", MAX({c})::DOUBLE AS "max",
                   ROUND(AVG({c}::DOUBLE), 4) AS "mean", ROUND(QUANTILE_CONT({c}::DOUBLE, 0.5), 4) AS "median",
                   ROUND(STDDEV_SAMP({c}::DOUBLE), 4) AS "std" FROM {source}"""
        for c in NUMERIC[name]
    )


def profile_sql(name, source=None):
    return f"""SELECT c.*, "min", "max", "mean", "median", "std" FROM ({counts_sql(name, source)}) c
               LEFT JOIN ({stats_sql(name, source)}) s ON c."column" = s."column" """


def top_sql(name, columns):
    counted = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COALESCE(CAST({c} AS VARCHAR), '<NULL>') AS value, COUNT(*) AS "count"
            FROM {name} GROUP BY {c}""" for c in columns
    )
    return f"""SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY "count" DESC, value)
               AS INTEGER) AS "rank" FROM ({counted})) WHERE "rank" <= 10"""


def small_sql(name):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, COUNT(*) AS "count" FROM {name}
            WHERE {c} IS NOT NULL AND (SELECT COUNT(DISTINCT {c}) FROM {name}) <= 20 GROUP BY {c}"""
        for c, _ in kinds(name)
    )



def rounded_stats(df):
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "median", "std")})


def register_profile(name):
    @register(f"profile_{name}", profile_sql(name))
    def run(spark, directory):
        return rounded_stats(profile.column_profile(table(spark, directory, name)))


for _name in ("lineitem", "orders", "customer", "events", "documents"):
    register_profile(_name)


@register("profile_all_tables", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", * FROM ({counts_sql(t)})""" for t in TABLES))
def profile_all_tables(spark, directory):
    out = None
    for t in TABLES:
        part = profile.column_counts(table(spark, directory, t)).select(F.lit(t).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@register("profile_missing_values", "WITH holes AS (" + """
    SELECT c_custkey, c_nationkey, NULLIF(c_acctbal, 0) AS c_acctbal, c_name,
           NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer) """ + profile_sql("customer", "holes"))
def profile_missing_values(spark, directory):
    df = table(spark, directory, "customer").withColumns({
        "c_acctbal": F.nullif("c_acctbal", F.lit(0.0)),
        "c_mktsegment": F.nullif("c_mktsegment", F.lit("BUILDING")),
    })
    return rounded_stats(profile.column_profile(df))


@register("profile_first_rows", "WITH head AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10000) "
          + profile_sql("orders", "head"))
def profile_first_rows(spark, directory):
    head = profile.first_rows(table(spark, directory, "orders"), "o_orderkey")
    return rounded_stats(profile.column_profile(head))


def register_top(name, columns):
    @register(f"top_values_{name}", top_sql(name, columns))
    def run(spark, directory):
        return profile.top_values(table(spark, directory, name))


for _name in ("lineitem", "orders", "part", "documents"):
    register_top(_name, TEXT.get(_name, []) + DATES.get(_name, []))


@register("top_values_with_nulls", top_sql("holes", ["c_name", "c_mktsegment"]).replace(
    "SELECT * FROM (SELECT *, CAST", """WITH holes AS (SELECT c_name, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment
        FROM customer) SELECT * FROM (SELECT *, CAST""", 1))
def top_values_with_nulls(spark, directory):
    df = table(spark, directory, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return profile.top_values(df)


def register_small(name):
    @register(f"small_domains_{name}", small_sql(name))
    def run(spark, directory):
        return profile.small_domain_counts(table(spark, directory, name))


for _name in ("lineitem", "events", "labels"):
    register_small(_name)


@register("likely_sensitive_columns", f"""
    SELECT "column", ROUND(unique_count::DOUBLE / "rows", 6) AS unique_ratio,
           kind = 'text' AND unique_count::DOUBLE / "rows" >= 0.7 AS likely_sensitive
    FROM ({counts_sql("documents")})""")
def likely_sensitive_columns(spark, directory):
    counts = profile.column_counts(table(spark, directory, "documents"))
    return profile.likely_sensitive(counts).withColumn("unique_ratio", F.round("unique_ratio", 6))


# --- Preparation ------------------------------------------------------------

FACTORIZE_SQL = """
    firsts AS (SELECT p_brand AS v, MIN(p_partkey) AS pos FROM holes WHERE p_brand IS NOT NULL GROUP BY p_brand),
    codes AS (SELECT v, ROW_NUMBER() OVER (ORDER BY pos) - 1 AS code FROM firsts),
    firsts_t AS (SELECT p_type AS v, MIN(p_partkey) AS pos FROM holes GROUP BY p_type),
    codes_t AS (SELECT v, ROW_NUMBER() OVER (ORDER BY pos) - 1 AS code FROM firsts_t)"""


@register("encode_first_appearance", f"""
    WITH holes AS (SELECT p_partkey, NULLIF(p_brand, 'Brand#2') AS p_brand, p_type FROM part), {FACTORIZE_SQL}
    SELECT p_partkey, COALESCE(c.code, -1) AS p_brand, COALESCE(t.code, -1) AS p_type
    FROM holes LEFT JOIN codes c ON p_brand = c.v LEFT JOIN codes_t t ON p_type = t.v""")
def encode_first_appearance(spark, directory):
    df = table(spark, directory, "part").select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand"), "p_type")
    return prep.encode_first_appearance(df, "p_partkey")


@register("first_appearance_codes", """
    SELECT 'o_orderpriority' AS "column", o_orderpriority AS value,
           COUNT(*) AS "rows", CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total, ROW_NUMBER() OVER (ORDER BY MIN(o_orderkey)) - 1 AS code FROM orders GROUP BY o_orderpriority
    UNION ALL
    SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), COUNT(*), CAST(SUM(COUNT(*)) OVER () AS BIGINT), ROW_NUMBER() OVER (ORDER BY MIN(o_orderkey)) - 1
    FROM orders GROUP BY o_custkey""")
def first_appearance_codes(spark, directory):
    df = table(spark, directory, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return prep.first_appearance_codes(df, ["o_orderpriority", "o_custkey"], "o_orderkey")


@register("encode_alphabetical", """
    SELECT c_custkey, CAST(DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment FROM customer""")
def encode_alphabetical(spark, directory):
    return prep.encode_alphabetical(table(spark, directory, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@register("keyword_target", """
    SELECT o_orderpriority, CASE WHEN REGEXP_MATCHES(o_orderpriority, '(?i)>|high|yes|true|1|approved') THEN 1 ELSE 0 END AS label,
           COUNT(*) AS "rows" FROM orders GROUP BY o_orderpriority""")
def keyword_target(spark, directory):
    df = table(spark, directory, "orders")
    return df.groupBy("o_orderpriority", prep.keyword_target("o_orderpriority").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"))


@register("binarise_predictions", """
    SELECT CASE WHEN CAST(TRUNC(l_tax * 20) AS INTEGER) > 0.5 THEN 1 ELSE 0 END AS prediction, COUNT(*) AS "rows"
    FROM lineitem GROUP BY 1""")
def binarise_predictions(spark, directory):
    df = table(spark, directory, "lineitem").select((F.col("l_tax") * 40 / 2).alias("prediction"))
    df = df.withColumn("prediction", F.col("prediction") + F.when(F.col("prediction") > 1, 1).otherwise(0))
    return prep.binarise_predictions(df, "prediction").groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"))


@register("non_binary_targets", """
    SELECT l_linenumber AS value, COUNT(*) AS "rows",
           (SELECT COUNT(*) FROM lineitem WHERE l_linenumber NOT IN (0, 1)) AS rows_total
    FROM lineitem WHERE l_linenumber NOT IN (0, 1) GROUP BY l_linenumber ORDER BY 1 LIMIT 10""")
def non_binary_targets(spark, directory):
    return prep.non_binary_targets(table(spark, directory, "lineitem"), "l_linenumber")


@register("align_features_by_name", """
    SELECT s_acctbal, 0.0::DOUBLE AS s_rating, s_suppkey FROM supplier""")
def align_features_by_name(spark, directory):
    return prep.align_by_name(table(spark, directory, "supplier"), ["s_acctbal", "s_rating", "s_suppkey"])


@register("align_features_by_position", """
    SELECT r_regionkey, r_name, 0.0::DOUBLE AS __pad_feature_0, 0.0::DOUBLE AS __pad_feature_1 FROM region""")
def align_features_by_position(spark, directory):
    return prep.align_by_position(table(spark, directory, "region"), 4)


@register("numeric_feature_matrix", """
    WITH source AS (
        SELECT o_orderkey, o_totalprice, COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'nan') AS p,
               CASE WHEN o_custkey = 3 THEN NULL WHEN o_custkey = 4 THEN 'Infinity'::DOUBLE
                    ELSE o_custkey::DOUBLE END AS c FROM orders),
    codes AS (SELECT p, ROW_NUMBER() OVER (ORDER BY MIN(o_orderkey)) - 1 AS code FROM source GROUP BY p)
    SELECT o_orderkey, o_totalprice, code::DOUBLE AS o_orderpriority,
           CASE WHEN c IS NULL OR ISINF(c) THEN 0.0 ELSE c END AS customer
    FROM source JOIN codes ON source.p = codes.p""")
def numeric_feature_matrix(spark, directory):
    key = F.col("o_custkey")
    df = table(spark, directory, "orders").select(
        "o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(key == 3, None).when(key == 4, F.lit(float("inf"))).otherwise(key.cast("double")).alias("customer"),
        "o_orderstatus",
    )
    return prep.numeric_matrix(df, "o_orderkey", drop=["o_orderstatus"])


@register("proxy_label_above_medians", """
    SELECT CASE WHEN l_quantity > (SELECT QUANTILE_CONT(l_quantity, 0.5) FROM lineitem)
                 AND l_extendedprice > (SELECT QUANTILE_CONT(l_extendedprice, 0.5) FROM lineitem)
                THEN 1 ELSE 0 END AS label, COUNT(*) AS "rows" FROM lineitem GROUP BY 1""")
def proxy_label_above_medians(spark, directory):
    df = table(spark, directory, "lineitem").select("l_quantity", "l_extendedprice")
    return prep.above_both_medians(df, "l_quantity", "l_extendedprice").groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"))


@register("benchmark_labels", """
    SELECT 'adult_income' AS dataset, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS label, COUNT(*) AS "rows"
    FROM customer GROUP BY 2
    UNION ALL SELECT 'bank_marketing', CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, COUNT(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'compas', CASE WHEN p_size >= 7 THEN 1 ELSE 0 END, COUNT(*) FROM part GROUP BY 2
    UNION ALL SELECT 'diabetes_readmission', CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END, COUNT(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'german_credit', CASE WHEN toxic = 1 THEN 1 ELSE 0 END, COUNT(*) FROM labels GROUP BY 2""")
def benchmark_labels(spark, directory):
    def open_table(name):
        return table(spark, directory, name)

    inputs = {
        "adult_income": open_table("customer").select(
            F.when(F.col("c_acctbal") > 5000, " >50K").otherwise("<=50K").alias("income")),
        "bank_marketing": open_table("orders").select(
            F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("y")),
        "compas": open_table("part").select(F.col("p_size").cast("string").alias("DecileScore")),
        "diabetes_readmission": open_table("lineitem").select(
            F.when(F.col("l_returnflag") == "N", "No").otherwise("<30").alias("readmitted")),
        "german_credit": open_table("labels").select((F.col("toxic") + 1).alias("kredit")),
    }
    out = None
    for key, df in inputs.items():
        part = prep.benchmark_label(df, key).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
        part = part.select(F.lit(key).alias("dataset"), "label", "rows")
        out = part if out is None else out.unionByName(part)
    return out


@register("stratified_split", """
    SELECT o_orderkey, o_orderstatus, CASE WHEN r <= FLOOR(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
        SELECT o_orderkey, o_orderstatus, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n,
               ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY MD5(o_orderkey || ':42'), o_orderkey) AS r
        FROM orders)""")
def stratified_split(spark, directory):
    df = table(spark, directory, "orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(df, "o_orderstatus", "o_orderkey")


@register("sample_rows", "SELECT * FROM lineitem_ids ORDER BY MD5(k || ':42'), k LIMIT 100".replace(
    "lineitem_ids", "(SELECT o_orderkey AS k, o_totalprice FROM orders)"))
def sample_rows(spark, directory):
    df = table(spark, directory, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return prep.sample_rows(df, "k", 100)


@register("model_features", """
    SELECT 'target' AS dropped, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT * EXCLUDE (c_acctbal), NULL::DOUBLE AS c_acctbal FROM customer)
    UNION ALL SELECT 'sensitive', c_custkey, c_name, c_nationkey, c_acctbal, NULL FROM customer""")
def model_features(spark, directory):
    """With a target only that is left out, without one the sensitive column."""
    df = table(spark, directory, "customer")
    with_target = prep.model_features(df, target="c_acctbal", sensitive="c_mktsegment")
    without = prep.model_features(df, target="no_such_column", sensitive="c_mktsegment")
    return with_target.withColumn("dropped", F.lit("target")).unionByName(
        without.withColumn("dropped", F.lit("sensitive")), allowMissingColumns=True)


@register("complete_rows", """
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders
    WHERE NULLIF(o_orderstatus, 'P') IS NOT NULL AND o_totalprice > 1000""")
def complete_rows(spark, directory):
    df = table(spark, directory, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("o_totalprice"))
    return prep.complete_rows(df, ["o_orderstatus", "o_totalprice"])


@register("guarded_cells", """
    SELECT doc_id, CASE WHEN LEFT(cell, 1) IN ('=', '+', '-', '@', CHR(9), CHR(13)) THEN '''' || cell ELSE cell END AS cell
    FROM (SELECT doc_id, ['=', '+', '-', '@', CHR(9), CHR(13), ' =', ''][CAST(doc_id % 8 AS INTEGER) + 1] || text AS cell FROM documents)""")
def guarded_cells(spark, directory):
    starts = F.array(*[F.lit(c) for c in ("=", "+", "-", "@", "\t", "\r", " =", "")])
    cell = F.concat(F.element_at(starts, (F.col("doc_id") % 8 + 1).cast("int")), F.col("text"))
    return text.guard_cells(table(spark, directory, "documents").select("doc_id", cell.alias("cell")))


@register("normalised_copies", """
    SELECT form, p_partkey, p_name, p_size, p_retailprice FROM part, (SELECT UNNEST(['csv', 'parquet']) AS form)
    UNION ALL SELECT 'lines', item_id, text || CHR(10) || '"quoted", ' || item_id, NULL, NULL FROM benchmark""")
def normalised_copies(spark, directory):
    """Tables written as normalised copies to the shared folder and read again: CSV, Parquet, and CSV cells with line breaks and quotes."""
    folder = f"{ensure_checkpoint_dir(spark)}/normalised-{uuid.uuid4().hex}"
    part = table(spark, directory, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    lines = table(spark, directory, "benchmark").select(
        F.col("item_id").alias("p_partkey"), F.concat("text", F.lit('\n"quoted", '), F.col("item_id").cast("string")).alias("p_name"))
    datasets.normalise(part, f"{folder}/copy", as_csv=True)
    datasets.normalise(part, f"{folder}/copy.parquet")
    datasets.normalise(lines, f"{folder}/lines", as_csv=True)
    read = {
        "csv": datasets.read_dataset(spark, f"{folder}/copy", part.schema), "parquet": datasets.read_dataset(spark, f"{folder}/copy.parquet"),
        "lines": datasets.read_dataset(spark, f"{folder}/lines", lines.schema, multi_line=True).withColumns({
            "p_size": F.lit(None).cast("int"), "p_retailprice": F.lit(None).cast("double")})}
    out = None
    for form, df in read.items():
        rows = df.select(F.lit(form).alias("form"), *part.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


REGISTERED = {
    "customer": [("c_acctbal", "double"), ("c_custkey", "bigint"), ("c_mktsegment", "string"), ("c_name", "string"), ("c_nationkey", "int")],
    "orders": [("o_custkey", "bigint"), ("o_orderkey", "bigint"), ("o_orderpriority", "string"), ("o_orderstatus", "string")],
}


def registration_sql(name):
    kinds = REGISTERED[name]
    types = ",".join(f'"{c}":"{t}"' for c, t in kinds)
    hole = lambda c: f"NULLIF({c}, 'P')" if c == "o_orderstatus" else c
    per_column = lambda made: " || ',' || ".join(f"""'"{c}":' || {made(hole(c))}""" for c, _ in kinds)
    values = ", ".join(f"""(SELECT CASE WHEN COUNT(*) <= 20 THEN '"{c}":{{' || STRING_AGG('"' || v || '":' || n, ',' ORDER BY v) || '}}' END
        FROM (SELECT {hole(c)}::VARCHAR AS v, COUNT(*) AS n FROM {name} WHERE {hole(c)} IS NOT NULL GROUP BY 1))""" for c, _ in kinds)
    return f"""SELECT 'p1' AS project_id, '{name}' AS name, '{name}.parquet' AS file_path, COUNT(*) AS row_count, {len(kinds)} AS column_count,
        '{",".join(c for c, _ in kinds)}' AS columns, '{kinds[-1][0]}' AS target_column, '{{"column_types":{{{types}}},"missing_values":{{'
        || {per_column(lambda c: f"(COUNT(*) - COUNT({c}))")} || '}},"unique_counts":{{' || {per_column(lambda c: f"COUNT(DISTINCT {c})")}
        || '}},"value_counts":{{' || CONCAT_WS(',', {values}) || '}}}}' AS profile_data FROM {name}"""


@register("dataset_registration", " UNION ALL ".join(registration_sql(n) for n in REGISTERED))
def dataset_registration(spark, directory):
    """The rows two tables are registered with, their profiles included."""
    out = None
    for name, kinds in REGISTERED.items():
        df = table(spark, directory, name).select(*[c for c, _ in kinds])
        if name == "orders":
            df = df.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
        row = datasets.dataset_record(df, name, "p1", f"{name}.parquet", target=kinds[-1][0], value_counts=True)
        out = row if out is None else out.unionByName(row)
    return out.withColumn("columns", F.array_join("columns", ",")).drop("sensitive_attributes")


@register("incomplete_rows", with_views("""
    SELECT COUNT(*) AS rows_total, SUM(CASE WHEN requirement_id IS NULL OR status = 'running' THEN 1 ELSE 0 END)::BIGINT
           AS rows_excluded FROM g_validations""", "g_validations"))
def incomplete_rows(spark, directory):
    df = view(spark, directory, "g_validations").withColumn("status", F.nullif("status", F.lit("running")))
    return prep.incomplete_count(df, ["requirement_id", "status"])
