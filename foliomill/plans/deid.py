"""De-identification and message queries over customers, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import deid as D
from foliomill.functions import messages as M
from foliomill.runtime import table

SALT = "foliomill"
TODAY = "2026-01-01"
#: Three-digit codes held to be populous enough.
ZIP3 = [f"{i:03d}" for i in range(5, 400, 5)]


def h01_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed pseudonym of each customer name."""
    return table(spark, sf_dir, "customer").select("c_custkey", D.pseudonym(F.col("c_name"), SALT).alias("pseudonym"))


def h03_shifted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates moved by the customer's own offset."""
    orders = table(spark, sf_dir, "orders")
    offset = D.subject_offset(F.col("o_custkey").cast("string"), SALT)
    return orders.select("o_orderkey", offset.alias("offset_days"), F.date_add(F.col("o_orderdate").cast("date"), offset).cast("string").alias("shifted"))


def h05_age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by age band of their date."""
    band = D.age_band(F.col("o_orderdate").cast("date"), F.to_date(F.lit(TODAY)))
    return table(spark, sf_dir, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def h06_zip3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by shortened postal code, taken from the key; codes outside the allow-list give none."""
    code = F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0")
    return table(spark, sf_dir, "customer").groupBy(D.truncate_zip(code, ZIP3).alias("zip3")).agg(F.count("*").alias("n"))


def h08_k_anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with rare combinations of nation, segment and balance band suppressed."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 2000).cast("string").alias("band"))
    return D.k_anonymize(rows, ["nation", "segment", "band"], 5)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free-text note per order, with identifiers made of its columns."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    mail = F.when(key % 3 == 0, F.concat(F.lit("mail c"), cust, F.lit("@clinic.example")))
    number = F.lpad((key % 10000).cast("string"), 4, "0")
    phone = F.when(key % 4 == 0, F.concat(F.lit("call 555-010-"), number))
    ssn = F.when(key % 7 == 0, F.concat(F.lit("id "), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-12-"), number))
    note = F.concat_ws(" ", F.lit("seen"), F.col("o_orderdate").cast("date").cast("string"), F.lpad(cust, 12, "0"), mail, phone, ssn)
    return table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"))


def h09_phi_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each identifier pattern in the order notes."""
    found = _notes(spark, sf_dir).select("o_orderkey", F.explode(D.phi_matches(F.col("note"))).alias("m"))
    return found.groupBy(F.col("m.kind").alias("kind")).agg(F.count("*").alias("n_matches"), F.countDistinct("m.match").alias("n_distinct"), F.min("m.match").alias("first"))


def h10_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each customer row before de-identification, counted by first digit (audit summary)."""
    digest = F.sha2(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment"), 256)
    return table(spark, sf_dir, "customer").groupBy(F.substring(digest, 1, 1).alias("bucket")).agg(F.count("*").alias("n"), F.min(digest).alias("first_hash"))


def h20_hl7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the HL7 messages within documents, by kind and number of fields."""
    segments = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("MSH|"))).select(F.explode(M.hl7_segments(F.col("text"))).alias("s"))
    return segments.groupBy(F.col("s")[0].alias("segment"), F.size("s").alias("n_fields")).agg(F.count("*").alias("n"))


def h31_x12_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 850-like envelope per order, built and checked; wrong ones would show in ``errors``."""
    body = F.array(F.concat_ws("*", F.lit("BEG"), F.lit("00"), F.col("o_orderkey").cast("string")), F.concat_ws("*", F.lit("CUR"), F.col("o_orderstatus")))
    built = table(spark, sf_dir, "orders").select("o_orderkey", M.x12_build("850", F.col("o_orderkey") % 10000, body).alias("message"))
    return built.select("o_orderkey", "message", F.size(M.x12_errors(F.col("message"))).alias("errors"))


_IPAD = "".join(f"\\x{b ^ 0x36:02X}" for b in SALT.encode().ljust(64, b"\0"))
_OPAD = "".join(f"\\x{b ^ 0x5C:02X}" for b in SALT.encode().ljust(64, b"\0"))


def _hmac(expr: str) -> str:
    return f"sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || encode({expr}))))"


_AGE = f"(date_part('year', DATE '{TODAY}') - date_part('year', d) - CASE WHEN (date_part('month', DATE '{TODAY}'), date_part('day', DATE '{TODAY}')) >= (date_part('month', d), date_part('day', d)) THEN 0 ELSE 1 END)"

QUERIES = {f.__name__: f for f in (h01_pseudonyms, h03_shifted_orders, h05_age_bands, h06_zip3, h08_k_anonymous, h09_phi_patterns, h10_audit, h20_hl7_segments, h31_x12_orders)}

SQL = {
    "h01_pseudonyms": f"SELECT c_custkey, substr({_hmac('c_name')}, 1, 16) AS pseudonym FROM customer",
    "h03_shifted_orders": f"""WITH o AS (SELECT o_orderkey, o_orderdate, CAST(('0x' || substr({_hmac("CAST(o_custkey AS VARCHAR)")}, 1, 16))::UBIGINT % 121 AS INTEGER) - 60 AS offset_days FROM orders)
SELECT o_orderkey, offset_days, CAST(CAST(o_orderdate AS DATE) + offset_days AS VARCHAR) AS shifted FROM o""",
    "h05_age_bands": f"WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), a AS (SELECT {_AGE} AS age FROM o), b AS (SELECT CASE WHEN age >= 90 THEN '90+' WHEN age >= 0 THEN CAST(CAST(floor(age / 5) * 5 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(age / 5) * 5 + 4 AS INTEGER) AS VARCHAR) END AS band FROM a) SELECT band, count(*) AS n FROM b GROUP BY 1",
    "h06_zip3": "WITH z AS (SELECT substr(lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0'), 1, 3) AS z FROM customer) SELECT CASE WHEN CAST(z AS INTEGER) % 5 = 0 AND CAST(z AS INTEGER) BETWEEN 5 AND 399 THEN z END AS zip3, count(*) AS n FROM z GROUP BY 1",
    "h08_k_anonymous": """WITH r AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS band FROM customer), k AS (SELECT *, count(*) OVER (PARTITION BY nation, segment, band) AS n FROM r)
SELECT c_custkey, CASE WHEN n < 5 THEN '*' ELSE nation END AS nation, CASE WHEN n < 5 THEN '*' ELSE segment END AS segment, CASE WHEN n < 5 THEN '*' ELSE band END AS band FROM k""",
    "h09_phi_patterns": """WITH n AS (SELECT concat_ws(' ', 'seen', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), lpad(CAST(o_custkey AS VARCHAR), 12, '0'), CASE WHEN o_orderkey % 3 = 0 THEN 'mail c' || CAST(o_custkey AS VARCHAR) || '@clinic.example' END,
CASE WHEN o_orderkey % 4 = 0 THEN 'call 555-010-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END, CASE WHEN o_orderkey % 7 = 0 THEN 'id ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-12-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END) AS note FROM orders), m AS ("""
    + r"""SELECT 'ssn' AS kind, m FROM (SELECT unnest(regexp_extract_all(note, '\b\d{3}-?\d{2}-?\d{4}\b')) AS m FROM n) WHERE substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(replace(m, '-', ''), 4, 2) <> '00' AND right(m, 4) <> '0000'
UNION ALL SELECT 'phone', unnest(regexp_extract_all(note, '(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}\b')) FROM n
UNION ALL SELECT 'email', unnest(regexp_extract_all(note, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) FROM n
UNION ALL SELECT 'iso_date', unnest(regexp_extract_all(note, '\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b')) FROM n
UNION ALL SELECT 'mrn_like', unnest(regexp_extract_all(note, '\b\d{12,}\b')) FROM n"""
    + ") SELECT kind, count(*) AS n_matches, count(DISTINCT m) AS n_distinct, min(m) AS first FROM m GROUP BY 1",
    "h10_audit": "WITH d AS (SELECT sha256(concat_ws('|', c_custkey, c_name, c_mktsegment)) AS h FROM customer) SELECT substr(h, 1, 1) AS bucket, count(*) AS n, min(h) AS first_hash FROM d GROUP BY 1",
    "h20_hl7_segments": r"""WITH s AS (SELECT unnest(regexp_split_to_array(text, '\r\n?|\n')) AS s FROM documents WHERE contains(text, 'MSH|')), f AS (SELECT s, string_split(s, '|') AS w FROM s WHERE regexp_matches(s, '^[A-Z][A-Z0-9]{2}\|'))
SELECT w[1] AS segment, CAST(len(w) + CASE WHEN w[1] = 'MSH' THEN 1 ELSE 0 END AS INTEGER) AS n_fields, count(*) AS n FROM f GROUP BY 1, 2""",
    "h31_x12_orders": "SELECT o_orderkey, 'ST*850*' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '~BEG*00*' || CAST(o_orderkey AS VARCHAR) || '~CUR*' || o_orderstatus || '~SE*4*' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '~' AS message, CAST(0 AS INTEGER) AS errors FROM orders",
}
