"""Registered privacy queries."""

from pyspark.sql import functions as F

from probity.functions import constants as C
from probity.operators import anonymity, anonymize, hipaa, noise, pii, privacy_report
from probity.plans.registry import register
from probity.sources.tables import table

CUSTOMER_QIS = ["c_mktsegment", "c_nationkey"]
LINE_QIS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]

# The comparison engine's \b is ASCII-only; this spelling has the wider meaning.
SQL_PATTERNS = {
    **C.PII_PATTERNS,
    "name_pattern": r"(^|[^\p{L}\p{N}_])[A-Z][a-z]+\s[A-Z][a-z]+($|[^\p{L}\p{N}_])",
}
ORDER = list(C.PII_PATTERNS)


def hit_sql(name, column="value"):
    found = f"REGEXP_MATCHES({column}, '{SQL_PATTERNS[name]}')"
    if name != "zip_code":
        return found
    digits = f"TRY_CAST(NULLIF(REGEXP_EXTRACT({column}, '^(\\d{{5}})', 1), '') AS INTEGER)"
    return f"({found} AND COALESCE({digits} BETWEEN 501 AND 99950, FALSE))"


def values_sql(source, columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)


def pattern_sql(source, columns, extra=None):
    hits = ", ".join(f"SUM(CASE WHEN {hit_sql(n)} THEN 1 ELSE 0 END) AS h_{n}" for n in ORDER)
    first = " ".join(f"WHEN h_{n}::DOUBLE / present > 0.1 THEN '{n}'" for n in ORDER)
    best = " ".join(f"WHEN h_{n}::DOUBLE / present > 0.1 THEN h_{n}" for n in ORDER)
    return f"""SELECT col, present, distinct_values, CASE {first} END AS pattern, CASE {best} END AS hits FROM (
        SELECT col, COUNT(*) AS present, COUNT(DISTINCT value) AS distinct_values, {hits}
        FROM ({values_sql(source, columns)}) GROUP BY col)"""


def report_sql(source, texts, named=(), plain=(), dates=()):
    total = f"(SELECT COUNT(*) FROM {source})"
    is_date = f"col IN ({', '.join(repr(d) for d in dates)})" if dates else "FALSE"
    fixed = " ".join(
        [f"UNION ALL SELECT '{c}', TRUE, '{t}', 0.9, 'column_name', 'Column name ' || CHR(39) || '{c}' || CHR(39) || ' matches known PII pattern ' || CHR(39) || '{t}' || CHR(39)" for c, t in named]
        + [f"UNION ALL SELECT '{c}', FALSE, NULL, 0.0, 'none', 'No PII patterns detected'" for c in plain]
    )
    return f"""
        SELECT col AS column_name, pattern IS NOT NULL OR (NOT {is_date} AND distinct_values::DOUBLE / {total} > 0.9) AS is_pii,
               CASE WHEN pattern IS NOT NULL THEN pattern WHEN NOT {is_date} AND distinct_values::DOUBLE / {total} > 0.9
                    THEN 'potential_identifier' END AS pii_type,
               ROUND(CASE WHEN pattern IS NOT NULL THEN hits::DOUBLE / present
                    WHEN NOT {is_date} AND distinct_values::DOUBLE / {total} > 0.9 THEN 0.6 ELSE 0.0 END, 6)::DOUBLE AS confidence,
               CASE WHEN pattern IS NOT NULL THEN 'pattern' WHEN NOT {is_date} AND distinct_values::DOUBLE / {total} > 0.9
                    THEN 'value_analysis' ELSE 'none' END AS detection_method,
               CASE WHEN pattern IS NOT NULL THEN hits || '/' || present || ' values match ' || pattern || ' pattern'
                    WHEN {is_date} THEN 'Column contains datetime values'
                    WHEN distinct_values::DOUBLE / {total} > 0.9 THEN 'High cardinality: ' || PRINTF('%.1f', 100 * distinct_values::DOUBLE / {total}) || '% unique values'
                    ELSE 'No PII patterns detected' END AS details
        FROM ({pattern_sql(source, texts)}) {fixed}"""


def short(report):
    return report.withColumn("confidence", F.round("confidence", 6))


@register("pii_report_documents", report_sql("documents", ["text", "lang", "source"], plain=["doc_id", "n_chars"]))
def pii_report_documents(spark, directory):
    return short(pii.pii_report(table(spark, directory, "documents"), "doc_id"))


@register("pii_report_pages", report_sql("pages", ["url", "html"], plain=["page_id"]))
def pii_report_pages(spark, directory):
    return short(pii.pii_report(table(spark, directory, "pages"), "page_id"))


@register("pii_report_conversations", report_sql(
    "conversations", ["role", "text"], plain=["conv_id", "turn"]))
def pii_report_conversations(spark, directory):
    return short(pii.pii_report(table(spark, directory, "conversations"), ["conv_id", "turn"]))


CONTACTS_SQL = """(SELECT c_custkey, c_name AS first_name, c_mktsegment,
    CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '.user@mail.example.org' ELSE 'none' END AS contact,
    CASE WHEN c_nationkey < 5 THEN '192.168.0.' || c_nationkey ELSE 'n/a' END AS host,
    (94000 + c_nationkey) || ' region' AS area, 'near ' || (94000 + c_nationkey) AS place,
    (DATE '2000-01-01' + CAST(c_custkey AS INTEGER))::VARCHAR AS seen, c_name AS code FROM customer)"""


def contacts(spark, directory):
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    return table(spark, directory, "customer").select(
        "c_custkey", F.col("c_name").alias("first_name"), "c_mktsegment",
        F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit(".user@mail.example.org"))).otherwise("none").alias("contact"),
        F.when(F.col("c_nationkey") < 5, F.concat(F.lit("192.168.0."), nation)).otherwise("n/a").alias("host"),
        F.concat((F.col("c_nationkey") + 94000).cast("string"), F.lit(" region")).alias("area"),
        F.concat(F.lit("near "), (F.col("c_nationkey") + 94000).cast("string")).alias("place"),
        F.date_add(F.lit("2000-01-01").cast("date"), key.cast("int")).cast("string").alias("seen"),
        F.col("c_name").alias("code"),
    )


@register("pii_report_contacts", report_sql(
    CONTACTS_SQL, ["c_mktsegment", "contact", "host", "area", "place", "seen", "code"],
    named=[("first_name", "firstname")], plain=["c_custkey"], dates=["seen"]))
def pii_report_contacts(spark, directory):
    return short(pii.pii_report(contacts(spark, directory), "c_custkey"))


@register("pii_custom_patterns", """
    SELECT col AS column_name, is_pii, CASE WHEN is_pii THEN kind END AS pii_type FROM (
        SELECT 'c_name' AS col, TRUE AS is_pii, 'cname' AS kind UNION ALL
        SELECT 'c_mktsegment', AVG(CASE WHEN REGEXP_MATCHES(c_mktsegment, '^MACH') THEN 1 ELSE 0 END) > 0.1, 'machine' FROM customer
        UNION ALL SELECT 'c_custkey', FALSE, NULL UNION ALL SELECT 'c_nationkey', FALSE, NULL UNION ALL SELECT 'c_acctbal', FALSE, NULL)""")
def pii_custom_patterns(spark, directory):
    report = pii.pii_report(
        table(spark, directory, "customer"), "c_custkey", custom_patterns={"machine": "^MACH"}, custom_tokens=["C Name"])
    return report.select("column_name", "is_pii", "pii_type")


@register("pii_first_values", f"""
    SELECT col AS "column", present, {', '.join(f'h_{n} AS {n}' for n in ORDER)} FROM (
        SELECT col, COUNT(*) AS present, {', '.join(
            f"SUM(CASE WHEN {hit_sql(n)} THEN 1 ELSE 0 END)::BIGINT AS h_{n}" for n in ORDER)}
        FROM (SELECT 'text' AS col, value FROM (SELECT text AS value FROM documents ORDER BY doc_id LIMIT 100)
              UNION ALL SELECT 'source', value FROM (SELECT source AS value FROM documents ORDER BY doc_id LIMIT 100))
        GROUP BY col)""")
def pii_first_values(spark, directory):
    df = table(spark, directory, "documents")
    counts = pii.pattern_counts(pii.first_values(df, ["text", "source"], "doc_id", 100), C.PII_PATTERNS)
    return counts.select("column", "present", *[F.col("hits")[i]["hits"].alias(n) for i, n in enumerate(ORDER)])


@register("pii_pattern_hits", f"""
    SELECT col AS "column", COUNT(*) AS present, {', '.join(
        f"SUM(CASE WHEN {hit_sql(n)} THEN 1 ELSE 0 END)::BIGINT AS {n}" for n in ORDER)}
    FROM ({values_sql('documents', ['text', 'lang', 'source'])}) GROUP BY col""")
def pii_pattern_hits(spark, directory):
    values = pii.text_values(table(spark, directory, "documents"), ["text", "lang", "source"])
    counts = pii.pattern_counts(values, C.PII_PATTERNS)
    return counts.select("column", "present", *[F.col("hits")[i]["hits"].alias(n) for i, n in enumerate(ORDER)])


CONTACT_TEXTS = ["c_mktsegment", "contact", "host", "area", "place", "seen", "code"]
CONTACT_REPORT = report_sql(
    CONTACTS_SQL, CONTACT_TEXTS, named=[("first_name", "firstname")], plain=["c_custkey"], dates=["seen"])


@register("pii_samples", f"""
    WITH report AS ({CONTACT_REPORT}),
    found AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS col, '{n}' AS kind, c_custkey AS k, SUBSTRING({c}, 1, 50) AS sample FROM {CONTACTS_SQL} WHERE {hit_sql(n, c)}"
        for c in CONTACT_TEXTS for n in ORDER)})
    SELECT col AS "column", kind AS pii_type, CAST(r AS INTEGER) AS "rank", sample FROM (
        SELECT f.*, ROW_NUMBER() OVER (PARTITION BY col ORDER BY k) AS r
        FROM found f JOIN report ON column_name = col AND pii_type = kind AND detection_method = 'pattern') WHERE r <= 3""")
def pii_samples(spark, directory):
    df = contacts(spark, directory)
    return pii.pii_samples(df, pii.pii_report(df, "c_custkey"), "c_custkey")


@register("pii_recommendations", f"""
    WITH report AS ({CONTACT_REPORT})
    SELECT column_name, 0 AS position, 'Column \'\'' || column_name || '\'\': Remove or anonymize (' || pii_type || ', confidence: '
           || ROUND(confidence * 100)::INTEGER || '%)' AS line FROM report WHERE is_pii
    UNION ALL SELECT column_name, 1, CASE pii_type WHEN 'email' THEN '  → Consider masking: john@email.com -> j***@***.com'
           WHEN 'phone_us' THEN '  → Consider masking last 4 digits: 555-123-4567 -> 555-123-****'
           ELSE '  → CRITICAL: Remove this column immediately or use tokenization' END
    FROM report WHERE is_pii AND pii_type IN ('email', 'phone_us', 'ssn', 'credit_card')""")
def pii_recommendations(spark, directory):
    return privacy_report.pii_recommendations(pii.pii_report(contacts(spark, directory), "c_custkey"))


def _array(items):
    return "[" + ", ".join(f"'{t}'" for t in items) + "]"


@register("pii_column_names", f"""
    SELECT table_name AS "table", column_name AS "column",
           LIST_FILTER({_array(C.PII_COLUMN_TOKENS)}, lambda t: CONTAINS(REGEXP_REPLACE(LOWER(column_name), '[_\\- ]', '', 'g'), t))[1] AS token,
           filled
    FROM (SELECT 'customer' AS table_name, UNNEST(['c_custkey', 'c_name', 'c_address', 'c_phone', 'c_mktsegment']) AS column_name,
                 (SELECT COUNT(*) FROM customer) AS filled
          UNION ALL SELECT 'supplier', UNNEST(['s_suppkey', 's_Full Name', 's_e-mail', 's_city']), (SELECT COUNT(*) FROM supplier))""")
def pii_column_names(spark, directory):
    customer = table(spark, directory, "customer").select(
        "c_custkey", "c_name", F.lit("x").alias("c_address"), F.lit("y").alias("c_phone"), "c_mktsegment")
    supplier = table(spark, directory, "supplier").select(
        "s_suppkey", F.col("s_name").alias("s_Full Name"), F.lit("x").alias("s_e-mail"), F.lit("y").alias("s_city"))
    frames = {"customer": customer, "supplier": supplier}
    filled = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("filled")).select(F.lit(name).alias("table"), "filled")
        filled = part if filled is None else filled.unionByName(part)
    named = pii.columns_by_name(pii.column_listing(spark, frames))
    return named.join(filled, "table").select("table", "column", "token", "filled")


# --- Anonymity ----------------------------------------------------------------

def k_sql(source, qis, k):
    keys = ", ".join(qis)
    present = " AND ".join(f"{c} IS NOT NULL" for c in qis)
    return f"""SELECT {k} AS k_value, COALESCE(MIN(n) >= {k}, FALSE) AS satisfies_k, MIN(n) AS actual_min_k,
               COUNT(*) AS total_groups, SUM(CASE WHEN n < {k} THEN 1 ELSE 0 END)::BIGINT AS violating_groups,
               (SELECT COUNT(*) FROM {source} WHERE NOT ({present})) AS rows_with_missing_values, NULL::VARCHAR AS error
               FROM (SELECT COUNT(*) AS n FROM {source} WHERE {present} GROUP BY {keys})"""


@register("k_anonymity", k_sql("customer", CUSTOMER_QIS, 10))
def k_anonymity(spark, directory):
    return anonymity.k_anonymity(table(spark, directory, "customer"), CUSTOMER_QIS, 10)


@register("k_anonymity_lineitem", k_sql("lineitem", LINE_QIS, 5))
def k_anonymity_lineitem(spark, directory):
    return anonymity.k_anonymity(table(spark, directory, "lineitem"), LINE_QIS, 5)


HOLES_SQL = "(SELECT *, NULLIF(c_mktsegment, 'BUILDING') AS seg, NULLIF(c_nationkey, 7) AS nat FROM customer)"


def holes(spark, directory):
    return table(spark, directory, "customer").withColumns({
        "seg": F.nullif("c_mktsegment", F.lit("BUILDING")), "nat": F.nullif("c_nationkey", F.lit(7))})


@register("k_anonymity_missing_values", k_sql(HOLES_SQL, ["seg", "nat"], 15))
def k_anonymity_missing_values(spark, directory):
    return anonymity.k_anonymity(holes(spark, directory), ["seg", "nat"], 15)


@register("k_anonymity_violations", """
    SELECT c_mktsegment, c_nationkey, COUNT(*) AS "size" FROM customer GROUP BY ALL HAVING COUNT(*) < 10
    ORDER BY 1, 2 LIMIT 10""")
def k_anonymity_violations(spark, directory):
    return anonymity.violating_groups(table(spark, directory, "customer"), CUSTOMER_QIS, 10)


@register("k_anonymity_distribution", f"""
    SELECT n AS "size", COUNT(*) AS groups FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY {', '.join(LINE_QIS)}) GROUP BY n""")
def k_anonymity_distribution(spark, directory):
    return anonymity.size_distribution(table(spark, directory, "lineitem"), LINE_QIS)


CONFIGS = [(["seg"], 200), (["seg", "nat"], 10), (["nat"], 50), (["seg", "nat"], 2)]


@register("k_anonymity_configs", " UNION ALL ".join(
    f"""SELECT {i} AS position, '{','.join(q)}' AS quasi_identifiers, k_value, satisfies_k, actual_min_k, total_groups,
        violating_groups, rows_with_missing_values FROM ({k_sql(HOLES_SQL, q, k)})""" for i, (q, k) in enumerate(CONFIGS)))
def k_anonymity_configs(spark, directory):
    return anonymity.k_anonymity_configs(holes(spark, directory), CONFIGS)


@register("l_diversity", f"""
    SELECT 4 AS l_value, MIN(d) >= 4 AS satisfies_l, MIN(d) AS actual_min_l, COUNT(*) AS total_groups,
           SUM(CASE WHEN d < 4 THEN 1 ELSE 0 END)::BIGINT AS violating_groups, NULL::VARCHAR AS error
    FROM (SELECT COUNT(DISTINCT l_shipdate) AS d FROM lineitem GROUP BY {', '.join(LINE_QIS)})""")
def l_diversity(spark, directory):
    return anonymity.l_diversity(table(spark, directory, "lineitem"), LINE_QIS, "l_shipdate", 4)


@register("l_diversity_violations", f"""
    SELECT {', '.join(LINE_QIS)}, COUNT(DISTINCT l_shipdate) AS diversity, 60 AS required_diversity FROM lineitem
    GROUP BY {', '.join(LINE_QIS)} HAVING COUNT(DISTINCT l_shipdate) < 60 ORDER BY {', '.join(LINE_QIS)} LIMIT 5""")
def l_diversity_violations(spark, directory):
    return anonymity.undiverse_groups(table(spark, directory, "lineitem"), LINE_QIS, "l_shipdate", 60)


@register("generalisation_advice", """
    WITH facts AS (
        SELECT 'c_acctbal' AS "column", 'numeric' AS kind, COUNT(DISTINCT c_acctbal) AS u, COUNT(*) AS n, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer
        UNION ALL SELECT 'c_nationkey', 'numeric', COUNT(DISTINCT c_nationkey), COUNT(*), MIN(c_nationkey), MAX(c_nationkey) FROM customer
        UNION ALL SELECT 'c_mktsegment', 'text', COUNT(DISTINCT c_mktsegment), COUNT(*), NULL, NULL FROM customer
        UNION ALL SELECT 'c_name', 'text', COUNT(DISTINCT c_name), COUNT(*), NULL, NULL FROM customer),
    offers AS (SELECT f.*, m.method, m.ord FROM facts f JOIN (VALUES
            ('binning', 1, 'numeric'), ('rounding', 2, 'numeric'), ('noise_addition', 3, 'numeric'), ('masking', 4, 'text'),
            ('generalization', 5, 'text'), ('categorization', 6, 'text'), ('suppression', 7, 'any')) AS m(method, ord, k)
        ON (m.k = f.kind OR m.k = 'any') AND (method <> 'rounding' OR hi - lo > 20) AND (method <> 'categorization' OR u < n * 0.1))
    SELECT "column", kind, u AS unique_values, 0::BIGINT AS null_count, method,
           CAST(ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY ord) - 1 AS INTEGER) AS position FROM offers""")
def generalisation_advice(spark, directory):
    advice = anonymize.generalisation_advice(
        table(spark, directory, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment", "c_name"])
    return advice.drop("privacy_gain", "utility_loss", "description")


# --- Noise ----------------------------------------------------------------------

DP_COLUMNS = ["c_acctbal", "c_nationkey", "c_mktsegment"]
DP_SQL = """
    SELECT 'c_acctbal' AS "column", MAX(c_acctbal) - MIN(c_acctbal) AS sensitivity,
           (MAX(c_acctbal) - MIN(c_acctbal)) / GREATEST(STDDEV_SAMP(c_acctbal), 1e-6) AS epsilon FROM customer
    UNION ALL SELECT 'c_nationkey', (MAX(c_nationkey) - MIN(c_nationkey))::DOUBLE,
           (MAX(c_nationkey) - MIN(c_nationkey)) / GREATEST(STDDEV_SAMP(c_nationkey), 1e-6) FROM customer
    UNION ALL SELECT 'c_mktsegment', 1.0, COUNT(DISTINCT c_mktsegment)::DOUBLE / COUNT(*) FROM customer"""


@register("dp_column_epsilons", f"""SELECT "column", ROUND(sensitivity, 6)::DOUBLE AS sensitivity, ROUND(epsilon, 6)::DOUBLE AS epsilon FROM ({DP_SQL})""")
def dp_column_epsilons(spark, directory):
    out = noise.column_epsilons(table(spark, directory, "customer"), DP_COLUMNS)
    return out.select("column", F.round("sensitivity", 6).alias("sensitivity"), F.round("epsilon", 6).alias("epsilon"))


@register("dp_budget", f"""
    SELECT ROUND(SUM(epsilon), 6)::DOUBLE AS measured_epsilon, 8.0::DOUBLE AS target_epsilon, SUM(epsilon) <= 8 AS budget_satisfied FROM ({DP_SQL})""")
def dp_budget(spark, directory):
    return noise.privacy_budget(table(spark, directory, "customer"), DP_COLUMNS, 8.0)


@register("dp_laplace_noise", """
    WITH draws AS (
        SELECT c_custkey, c_acctbal, c_mktsegment, (('0x' || SUBSTRING(MD5(c_custkey || ':c_acctbal:42'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE - 0.5 AS u,
               (SELECT MAX(c_acctbal) - MIN(c_acctbal) FROM customer) / (2.0::DOUBLE / 2) AS b FROM customer)
    SELECT c_custkey, c_mktsegment, ROUND(c_acctbal - b * SIGN(u) * LN(1 - 2 * ABS(u)), 3)::DOUBLE AS c_acctbal FROM draws""")
def dp_laplace_noise(spark, directory):
    df = table(spark, directory, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    out = noise.laplace_noise(df, ["c_acctbal", "c_mktsegment"], ["c_custkey"], target_epsilon=2.0)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 3))


@register("dp_noise_scales", """
    SELECT 'o_totalprice' AS "column", MAX(o_totalprice) - MIN(o_totalprice) AS sensitivity,
           (MAX(o_totalprice) - MIN(o_totalprice)) / 0.25 AS scale FROM orders""")
def dp_noise_scales(spark, directory):
    return noise.noise_scales(table(spark, directory, "orders"), ["o_totalprice", "o_orderstatus"], 0.5)


@register("dp_epsilon_after_noise", """
    WITH draws AS (
        SELECT o_totalprice, o_orderstatus, (('0x' || SUBSTRING(MD5(o_orderkey || ':o_totalprice:42'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE - 0.5 AS u,
               (SELECT MAX(o_totalprice) - MIN(o_totalprice) FROM orders) / 0.5::DOUBLE AS b FROM orders),
    noised AS (SELECT o_totalprice - b * SIGN(u) * LN(1 - 2 * ABS(u)) AS x, o_orderstatus FROM draws),
    total AS (SELECT (MAX(x) - MIN(x)) / STDDEV_SAMP(x) + COUNT(DISTINCT o_orderstatus)::DOUBLE / COUNT(*) AS e FROM noised)
    SELECT ROUND(e, 6)::DOUBLE AS measured_epsilon, 1.0::DOUBLE AS target_epsilon, e <= 1 AS budget_satisfied FROM total""")
def dp_epsilon_after_noise(spark, directory):
    df = table(spark, directory, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    noised = noise.laplace_noise(df, ["o_totalprice", "o_orderstatus"], ["o_orderkey"])
    return noise.privacy_budget(noised, ["o_totalprice", "o_orderstatus"])


# --- Anonymised data --------------------------------------------------------------

@register("anonymised_customers", """
    SELECT c_custkey, SUBSTRING(c_name, 1, 3) || '**' AS c_name, SUBSTRING(c_mktsegment, 1, 2) || '***' AS c_mktsegment,
           CAST(GREATEST(LEAST(CEIL((c_acctbal - lo) / ((hi - lo) / 5)) - 1, 4), 0) AS INTEGER) AS c_acctbal
    FROM customer, (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer)""")
def anonymised_customers(spark, directory):
    return anonymize.anonymise(table(spark, directory, "customer"), {
        "c_name": "generalize", "c_mktsegment": "mask", "c_acctbal": "bin", "c_nationkey": "suppress", "unknown": "mask"})


@register("anonymised_price_bins", """
    SELECT bin, COUNT(*) AS "rows" FROM (
        SELECT CAST(GREATEST(LEAST(CEIL((l_extendedprice - lo) / ((hi - lo) / 5)) - 1, 4), 0) AS INTEGER) AS bin
        FROM lineitem, (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem)) GROUP BY bin""")
def anonymised_price_bins(spark, directory):
    binned = anonymize.bin_codes(table(spark, directory, "lineitem"), ["l_extendedprice"])
    return binned.groupBy(F.col("l_extendedprice").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


# --- Health identifiers -----------------------------------------------------------

def hipaa_sql(source, texts, named=()):
    """Flagged columns per category; ``named`` are (identifier, column) pairs found by name."""
    values = " UNION ALL ".join(
        f"SELECT '{i}' AS identifier, col FROM ({values_sql(source, texts)}) WHERE REGEXP_MATCHES(value, '{hipaa._joined(p)}') GROUP BY col"
        for i, p in hipaa.VALUE_PATTERNS.items())
    names = "".join(f" UNION ALL SELECT '{i}', '{c}'" for i, c in named)
    listed = ", ".join(f"({n}, '{h[0]}', '{h[1]}')" for n, h in enumerate(C.HIPAA_IDENTIFIERS))
    return f"""
        WITH flagged AS ({values}{names}),
        grouped AS (SELECT identifier, STRING_AGG(DISTINCT col, ', ' ORDER BY col) AS columns FROM flagged GROUP BY identifier)
        SELECT c.position, c.identifier, c.label, columns IS NULL AS passed, COALESCE(columns, '') AS flagged_columns
        FROM (VALUES {listed}) AS c(position, identifier, label) LEFT JOIN grouped g ON c.identifier = g.identifier"""


@register("hipaa_report_documents", hipaa_sql("documents", ["text", "lang", "source"]))
def hipaa_report_documents(spark, directory):
    return hipaa.hipaa_report(table(spark, directory, "documents"))


@register("hipaa_report_pages", hipaa_sql("pages", ["url", "html"], [("url", "url")]))
def hipaa_report_pages(spark, directory):
    return hipaa.hipaa_report(table(spark, directory, "pages"))


@register("hipaa_verdict", f"""
    SELECT COUNT(*) AS total_checks, SUM(CASE WHEN passed THEN 1 ELSE 0 END)::BIGINT AS passed_checks,
           SUM(CASE WHEN passed THEN 0 ELSE 1 END)::BIGINT AS failed_checks, BOOL_AND(passed) AS overall_passed
    FROM ({hipaa_sql("conversations", ["role", "text"])})""")
def hipaa_verdict(spark, directory):
    return hipaa.hipaa_verdict(hipaa.hipaa_report(table(spark, directory, "conversations")))


@register("hipaa_samples", " UNION ALL ".join(
    f"""SELECT identifier, CAST(r AS INTEGER) AS "rank", sample FROM (
        SELECT '{i}' AS identifier, sample, ROW_NUMBER() OVER (ORDER BY k, sample) AS r FROM (
            SELECT 'text: ' || SUBSTRING(text, 1, 60) AS sample, MIN(doc_id) AS k FROM documents
            WHERE REGEXP_MATCHES(text, '{hipaa._joined(p)}') GROUP BY 1)) WHERE r <= 5"""
    for i, p in hipaa.VALUE_PATTERNS.items()))
def hipaa_samples(spark, directory):
    return hipaa.hipaa_samples(table(spark, directory, "documents"), "doc_id")


# --- Whole audit ------------------------------------------------------------------

AUDIT = {
    "pii_detection": True,
    "k_anonymity": {"k": 10, "quasi_identifiers": CUSTOMER_QIS},
    "k_anonymity_configs": [{"k": 100, "quasi_identifiers": ["c_mktsegment"]}, {"k": 30, "quasi_identifiers": ["c_nationkey"]}],
    "l_diversity": {"l": 3, "quasi_identifiers": ["c_nationkey"], "sensitive_attribute": "c_mktsegment"},
    "differential_privacy": {"quasi_identifiers": ["c_acctbal"], "target_epsilon": 1.0},
    "hipaa": True,
}

AUDIT_SQL = f"""
    WITH sizes AS (SELECT COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey),
    segs AS (SELECT COUNT(*) AS n FROM customer GROUP BY c_mktsegment),
    nats AS (SELECT COUNT(*) AS n, COUNT(DISTINCT c_mktsegment) AS d FROM customer GROUP BY c_nationkey),
    checks AS (
        SELECT 'pii_detection' AS "check", COUNT(*) = 0 AS passed, COUNT(*)::DOUBLE AS measured, 0.0::DOUBLE AS required, COUNT(*) AS failed_count
        FROM ({report_sql("customer", ["c_name", "c_mktsegment"])}) WHERE is_pii
        UNION ALL SELECT 'k_anonymity', MIN(n) >= 10, MIN(n)::DOUBLE, 10, SUM(CASE WHEN n < 10 THEN 1 ELSE 0 END)::BIGINT FROM sizes
        UNION ALL SELECT 'k_anonymity_config_1', MIN(n) >= 100, MIN(n)::DOUBLE, 100, SUM(CASE WHEN n < 100 THEN 1 ELSE 0 END)::BIGINT FROM segs
        UNION ALL SELECT 'k_anonymity_config_2', MIN(n) >= 30, MIN(n)::DOUBLE, 30, SUM(CASE WHEN n < 30 THEN 1 ELSE 0 END)::BIGINT FROM nats
        UNION ALL SELECT 'l_diversity', MIN(d) >= 3, MIN(d)::DOUBLE, 3, SUM(CASE WHEN d < 3 THEN 1 ELSE 0 END)::BIGINT FROM nats
        UNION ALL SELECT 'differential_privacy', e <= 1, ROUND(e, 6), 1, NULL FROM (
            SELECT (MAX(c_acctbal) - MIN(c_acctbal)) / STDDEV_SAMP(c_acctbal) AS e FROM customer)
        UNION ALL SELECT 'hipaa', BOOL_AND(passed), SUM(CASE WHEN passed THEN 1 ELSE 0 END)::DOUBLE, 18,
            SUM(CASE WHEN passed THEN 0 ELSE 1 END)::BIGINT FROM ({hipaa_sql("customer", ["c_name", "c_mktsegment"])})),
    risk AS (
        SELECT LEAST(100, FLOOR(100 * SUM(CASE WHEN passed THEN 0.0 ELSE 1.0 END
                   + CASE WHEN "check" = 'k_anonymity' AND measured < 3 THEN 0.5 ELSE 0.0 END) / COUNT(*)))::DOUBLE AS risk_score
        FROM checks WHERE "check" NOT LIKE 'k_anonymity_config%')"""


def audit(spark, directory):
    return privacy_report.privacy_checks(table(spark, directory, "customer"), "c_custkey", AUDIT)


@register("privacy_checks", AUDIT_SQL + """
    SELECT "check", passed, measured, required, failed_count, CASE "check" WHEN 'k_anonymity_config_1' THEN 'c_mktsegment'
           WHEN 'k_anonymity_config_2' THEN 'c_nationkey' END AS detail FROM checks""")
def privacy_checks(spark, directory):
    return audit(spark, directory)


@register("privacy_verdict", AUDIT_SQL + """
    SELECT COUNT(*) AS checks, SUM(CASE WHEN passed THEN 1 ELSE 0 END)::BIGINT AS checks_passed,
           BOOL_AND(passed) AS overall_passed FROM checks""")
def privacy_verdict(spark, directory):
    return privacy_report.privacy_verdict(audit(spark, directory))


@register("privacy_risk_score", AUDIT_SQL + """
    SELECT risk_score, CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level FROM risk""")
def privacy_risk_score(spark, directory):
    return privacy_report.risk_score(audit(spark, directory))


@register("privacy_metric_rows", AUDIT_SQL + """
    SELECT 'pii_detected_count' AS metric, measured AS value FROM checks WHERE "check" = 'pii_detection'
    UNION ALL SELECT 'k_anonymity_satisfied', CASE WHEN passed THEN 1.0 ELSE 0.0 END::DOUBLE FROM checks WHERE "check" = 'k_anonymity'
    UNION ALL SELECT 'l_diversity_satisfied', CASE WHEN passed THEN 1.0 ELSE 0.0 END FROM checks WHERE "check" = 'l_diversity'
    UNION ALL SELECT 'dp_measured_epsilon', measured FROM checks WHERE "check" = 'differential_privacy'
    UNION ALL SELECT 'dp_budget_satisfied', CASE WHEN passed THEN 1.0 ELSE 0.0 END FROM checks WHERE "check" = 'differential_privacy'
    UNION ALL SELECT 'hipaa_passed', CASE WHEN passed THEN 1.0 ELSE 0.0 END FROM checks WHERE "check" = 'hipaa'
    UNION ALL SELECT 'hipaa_checks_passed', measured FROM checks WHERE "check" = 'hipaa'
    UNION ALL SELECT 'overall_passed', MIN(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FROM checks
    UNION ALL SELECT 'privacy_risk_score', risk_score FROM risk""")
def privacy_metric_rows(spark, directory):
    return privacy_report.metric_rows(audit(spark, directory))


@register("privacy_recommendations", AUDIT_SQL + """
    SELECT "check", 0 AS position, 'Dataset fails 10-anonymity (minimum group size: ' || measured::INTEGER || ', violating groups: ' || failed_count || ')' AS line
    FROM checks WHERE "check" = 'k_anonymity' AND NOT passed
    UNION ALL SELECT 'k_anonymity', 1, '  → Consider generalizing these columns: c_mktsegment, c_nationkey' FROM checks WHERE "check" = 'k_anonymity' AND NOT passed
    UNION ALL SELECT 'k_anonymity', 2, '  → c_mktsegment: masking - Mask part of the value' FROM checks WHERE "check" = 'k_anonymity' AND NOT passed
    UNION ALL SELECT 'k_anonymity', 3, '  → c_nationkey: binning - Group into ranges (e.g., ' || (SELECT MIN(c_nationkey)::DOUBLE FROM customer) || '-'
        || (SELECT MAX(c_nationkey)::DOUBLE FROM customer) || ' into 5-10 bins)' FROM checks WHERE "check" = 'k_anonymity' AND NOT passed
    UNION ALL SELECT "check", 0, 'k-anonymity config #' || RIGHT("check", 1) || ' failed (k=' || required::INTEGER || ', min group size=' || measured::INTEGER || ')'
    FROM checks WHERE "check" LIKE 'k_anonymity_config%' AND NOT passed
    UNION ALL SELECT "check", 0, 'Dataset fails 3-diversity for ''c_mktsegment'' (minimum diversity: ' || measured::INTEGER || ')'
    FROM checks WHERE "check" = 'l_diversity' AND NOT passed
    UNION ALL SELECT "check", 1, '  → Some groups have insufficient diversity in sensitive attribute' FROM checks WHERE "check" = 'l_diversity' AND NOT passed
    UNION ALL SELECT "check", 2, '  → Consider: (1) Further generalizing quasi-identifiers, (2) Suppressing low-diversity groups, or (3) Adding synthetic records'
    FROM checks WHERE "check" = 'l_diversity' AND NOT passed""")
def privacy_recommendations(spark, directory):
    return privacy_report.check_recommendations(
        table(spark, directory, "customer"), audit(spark, directory), AUDIT)


@register("privacy_preset_healthcare", """
    SELECT 'k_anonymity' AS "check", MIN(n) >= 10 AS passed, MIN(n)::DOUBLE AS measured FROM (
        SELECT COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)
    UNION ALL SELECT 'l_diversity', MIN(d) >= 3, MIN(d)::DOUBLE FROM (
        SELECT COUNT(DISTINCT c_acctbal) AS d FROM customer GROUP BY c_mktsegment, c_nationkey)""")
def privacy_preset_healthcare(spark, directory):
    wanted = privacy_report.preset_requirements("healthcare", CUSTOMER_QIS, "c_acctbal")
    checks = privacy_report.privacy_checks(table(spark, directory, "customer"), "c_custkey", {**wanted, "pii_detection": False})
    return checks.select("check", "passed", "measured")


@register("privacy_summary", f"""
    SELECT COUNT(*) AS n_rows, 5 AS n_columns, (SELECT COUNT(*) FROM ({report_sql(
        "documents", ["text", "lang", "source"])}) WHERE is_pii) AS pii_count,
        SUM(0)::BIGINT + (CASE WHEN COUNT(DISTINCT text)::DOUBLE / COUNT(*) > 0.9 THEN 1 ELSE 0 END)
            + (CASE WHEN COUNT(DISTINCT lang)::DOUBLE / COUNT(*) > 0.9 THEN 1 ELSE 0 END)
            + (CASE WHEN COUNT(DISTINCT source)::DOUBLE / COUNT(*) > 0.9 THEN 1 ELSE 0 END) AS high_cardinality_columns,
        1 AS columns_with_missing_values, SUM(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS missing_value_count,
        2 AS numeric_columns, 3 AS categorical_columns, 0 AS datetime_columns
    FROM documents""")
def privacy_summary(spark, directory):
    df = table(spark, directory, "documents").withColumn("lang", F.nullif("lang", F.lit("en")))
    return privacy_report.privacy_summary(df, "doc_id")
