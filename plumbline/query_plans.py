"""Number plans, lanes of overlapping orders, and counters added up by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .dialect import DUCK
from .functions import numbers
from .operators import lanes, lineage
from .registry import query, rows_sql, table
from .streaming import sinks

# -- numbers --------------------------------------------------------------------------------
#: One of these is read beside each document's numbers: national, bare and shared ones, and what is none.
NUMBERS = (
    "07911 123456", "020 7946 0000", "447911123456", "+44 1481 960 194", "0044 20 7946 0000", "1-900-555-1212", "+1 416 555 0199", "+1 787 555 0100", "14165550199", "030 901820", "+49 30 901820", "49301234567", "+7 701 123 4567", "+7 495 123 4567",
    "+999 123", "12", "", "+61 8 9162 1234", "0412 345 678", "61412345678", "+39 06 698 12345", "612 345 678", "+852 2345 6789", "2348031234567",
)
HOMES = {"en": "GB", "de": "DE", "fr": "FR", "es": "ES"}
_FOUND = r"\+[0-9][0-9 ().-]{6,18}[0-9]"
_OWN_SQL = " ".join(f"WHEN home = '{h}' THEN country IN ({', '.join(repr(c) for c in numbers.own_countries(h))})" for h in numbers.OWN)


@query(f"""WITH d AS (SELECT doc_id, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in HOMES.items())} ELSE 'US' END AS home, list_prepend({DUCK.at(DUCK.array(NUMBERS), f'doc_id % {len(NUMBERS)}')}, regexp_extract_all(coalesce(text, ''), '{_FOUND}')) AS l FROM documents),
n AS (SELECT doc_id, home, unnest(range(1, len(l) + 1)) AS nth, l FROM d),
r AS (SELECT doc_id, nth, home, trim(l[nth]) AS raw, regexp_replace(l[nth], '[^0-9]', '', 'g') AS digits FROM n),
{rows_sql(numbers.plan_rows(), 'prefix, country, code, low, high', 'plans')}, {rows_sql(numbers.codes_of_homes().items(), 'home, code', 'homes')}, {rows_sql(numbers.TRUNKS.items(), 'home, trunk', 'trunks')},
h AS (SELECT r.*, coalesce(homes.code, '') AS home_code, coalesce(trunk, '0') AS trunk FROM r LEFT JOIN homes USING (home) LEFT JOIN trunks USING (home)),
t AS (SELECT doc_id, nth, home, 0 AS place, 'international' AS read, CASE WHEN raw LIKE '+%' THEN digits ELSE substr(digits, 3) END AS full_number FROM h WHERE raw LIKE '+%' OR digits LIKE '00%'
 UNION ALL SELECT doc_id, nth, home, 0, 'national', home_code || CASE WHEN trunk <> '' AND starts_with(digits, trunk) THEN substr(digits, length(trunk) + 1) ELSE digits END FROM h WHERE NOT (raw LIKE '+%' OR digits LIKE '00%')
 UNION ALL SELECT doc_id, nth, home, 1, 'bare', digits FROM h WHERE NOT (raw LIKE '+%' OR digits LIKE '00%')),
b AS (SELECT t.*, p.country, p.code, p.low, p.high FROM t LEFT JOIN plans p ON starts_with(full_number, p.prefix) QUALIFY row_number() OVER (PARTITION BY doc_id, nth, place ORDER BY length(p.prefix) DESC NULLS LAST) = 1),
f AS (SELECT *, coalesce(length(full_number) - length(code) BETWEEN low AND high, FALSE) AS valid FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, nth ORDER BY valid DESC, place) = 1)
SELECT doc_id, CAST(nth AS INT) AS nth, read, country, substr(full_number, length(code) + 1) AS national, valid, coalesce(CASE {_OWN_SQL} ELSE country = home END, FALSE) AS domestic FROM f""")
def number_plans(spark, sf_dir):
    """Every number of every document read against all plans, at home where the document's language is."""
    docs = table(spark, sf_dir, "documents")
    home = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in HOMES.items()), F.lit("US"))
    built = F.get(F.array(*map(F.lit, NUMBERS)), F.pmod("doc_id", F.lit(len(NUMBERS))).cast("int"))
    found = F.concat(F.array(built), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_FOUND), F.lit(0)))
    each = docs.select("doc_id", home.alias("own_home"), F.posexplode(found).alias("place", "number")).withColumn("nth", F.col("place") + 1)
    return numbers.parsed(each, ["doc_id", "nth"], "number", F.col("own_home"))


# -- lanes ----------------------------------------------------------------------------------
@query("""WITH RECURSIVE x AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, greatest(o_orderdate, shipped) AS b FROM orders JOIN x ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS k FROM s),
z(o_custkey, k, o_orderkey, ends, lane) AS (SELECT o_custkey, k, o_orderkey, [b], 1 FROM r WHERE k = 1 UNION ALL
 SELECT o_custkey, k, o_orderkey, list_concat(ends[1:lane - 1], [b], ends[lane + 1:]), lane FROM (SELECT r.o_custkey, r.k, r.o_orderkey, z.ends, r.b, coalesce(nullif(list_position(list_transform(z.ends, lambda e: e <= r.a), TRUE), 0), len(z.ends) + 1) AS lane
  FROM z JOIN r ON r.o_custkey = z.o_custkey AND r.k = z.k + 1))
SELECT o_custkey, o_orderkey, CAST(lane - 1 AS INT) AS lane FROM z""")
def order_lanes(spark, sf_dir):
    """Each customer's orders, open from their date to the last shipping, in as few lanes as overlap."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return lanes.packed(orders, "o_custkey", "o_orderdate", "closed", "o_orderkey").select("o_custkey", "o_orderkey", "lane")


# -- counters -------------------------------------------------------------------------------
_KNOWN = ("click", "view", "purchase")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END AS outcome, count(*) AS value FROM events GROUP BY ALL")
def streamed_counters(spark, sf_dir):
    """Events counted by day and outcome as a stream adds them up, batch by batch."""
    path = f"{lineage.shared_folder(spark)}/counters-{uuid.uuid4().hex}"
    kind = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet")
    rows = sinks.bucketed(events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "event_type", _KNOWN).withColumnRenamed("event_type", "outcome")
    sinks.counted_into(rows, f"{path}/table", ["day", "outcome"]).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sinks.counters(spark, f"{path}/table", ["day", "outcome"])
