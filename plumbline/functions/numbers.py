"""Telephone numbers read against a table of number plans: the longest prefix that a plan has wins.

A number with its country code meets the plans by its own first digits, one row for each length of prefix; the table is
fixed and small.  Countries that share a code are told apart by longer prefixes; which of them a home country counts
as its own is a table as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calling code, country, fewest and most digits behind the code; fixed values.
CODES = (
    ("1", "US", 10, 10), ("7", "RU", 10, 10), ("20", "EG", 8, 10), ("27", "ZA", 9, 9), ("30", "GR", 10, 10), ("31", "NL", 9, 9), ("32", "BE", 8, 9), ("33", "FR", 9, 9), ("34", "ES", 9, 9), ("36", "HU", 8, 9), ("39", "IT", 6, 11), ("41", "CH", 9, 9),
    ("43", "AT", 4, 13), ("44", "GB", 9, 10), ("45", "DK", 8, 8), ("46", "SE", 7, 10), ("47", "NO", 8, 8), ("48", "PL", 9, 9), ("49", "DE", 6, 11), ("52", "MX", 10, 10), ("55", "BR", 10, 11), ("60", "MY", 8, 10), ("61", "AU", 9, 9), ("62", "ID", 8, 12),
    ("63", "PH", 8, 10), ("64", "NZ", 8, 10), ("65", "SG", 8, 8), ("66", "TH", 8, 9), ("81", "JP", 9, 10), ("82", "KR", 8, 10), ("84", "VN", 9, 10), ("86", "CN", 10, 11), ("90", "TR", 10, 10), ("91", "IN", 10, 10), ("92", "PK", 9, 10), ("94", "LK", 9, 9),
    ("212", "MA", 9, 9), ("216", "TN", 8, 8), ("222", "MR", 8, 8), ("225", "CI", 10, 10), ("233", "GH", 9, 9), ("234", "NG", 8, 10), ("252", "SO", 7, 9), ("254", "KE", 9, 9), ("269", "KM", 7, 7), ("351", "PT", 9, 9), ("353", "IE", 7, 9), ("358", "FI", 5, 12),
    ("371", "LV", 8, 8), ("375", "BY", 9, 9), ("380", "UA", 9, 9), ("420", "CZ", 9, 9), ("675", "PG", 7, 8), ("852", "HK", 8, 8), ("881", "satellite", 8, 9), ("971", "AE", 8, 9), ("972", "IL", 8, 9),
)
#: Longer prefixes of countries that share a code; fixed values.
SHARED = {
    "CA": "1204 1226 1236 1249 1250 1263 1289 1306 1343 1354 1365 1367 1368 1382 1403 1416 1418 1428 1431 1437 1438 1450 1468 1474 1506 1514 1519 1548 1579 1581 1584 1587 1604 1613 1639 1647 1672 1683 1705 1709 1742 1753 1778 1780 1782 1807 1819 1825 1867 1873 1879 1902 1905",
    "PR": "1787 1939", "VI": "1340", "GU": "1671", "AS": "1684", "MP": "1670", "BS": "1242", "BB": "1246", "AI": "1264", "AG": "1268", "VG": "1284", "KY": "1345", "BM": "1441", "GD": "1473", "TC": "1649", "JM": "1658 1876", "MS": "1664", "SX": "1721", "LC": "1758",
    "DM": "1767", "VC": "1784", "DO": "1809 1829 1849", "TT": "1868", "KN": "1869", "KZ": "76 77", "GG": "441481 447781 447839 447911", "JE": "441534 447509 447797 447937", "IM": "441624 447524 447624 447924", "CC": "6189162", "CX": "6189164", "VA": "3906698",
}
#: Countries whose numbers a home country counts as its own; fixed values.
OWN = {"GB": ("GG", "JE", "IM"), "AU": ("CC", "CX"), "US": ("PR", "VI", "MP", "GU", "AS", "CA"), "CA": ("US", "PR", "VI", "MP", "GU", "AS")}
#: Trunk prefix of each home country where it is not 0; fixed values.
TRUNKS = {"US": "1", "CA": "1", "RU": "8", "ES": "", "IT": "", "PT": "", "SG": "", "HK": "", "DK": "", "NO": "", "PL": "", "CZ": "", "GR": ""}
LONGEST = 7


def plan_rows() -> list[tuple[str, str, str, int, int]]:
    """prefix, country, code, fewest and most digits behind the code."""
    rows = [(code, country, code, low, high) for code, country, low, high in CODES]
    by_prefix = sorted(CODES, key=lambda c: -len(c[0]))
    for country, prefixes in SHARED.items():
        for prefix in prefixes.split():
            code, _, low, high = next(c for c in by_prefix if prefix.startswith(c[0]))
            rows.append((prefix, country, code, low, high))
    return rows


def codes_of_homes() -> dict[str, str]:
    return {country: code for code, country, _, _ in CODES} | {"CA": "1"}


def own_countries(home: str) -> tuple[str, ...]:
    return (home, *OWN.get(home, ()))


def parsed(df: DataFrame, keys: list[str], number: str, home: Column) -> DataFrame:
    """The keys with country, national (digits behind the code), valid, domestic and how it was read.

    ``international``: with a plus sign or 00.  ``national``: against the plan of the home country, its trunk prefix
    taken off.  ``bare``: digits that are no valid number at home but are one with a plus sign before them.  A
    number that nothing fits keeps its national reading and is not valid.  ``keys`` must tell rows apart.
    """
    spark = df.sparkSession
    plans = spark.createDataFrame(plan_rows(), "prefix string, country string, code string, low int, high int")
    of = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("home"))
    raw = F.trim(F.coalesce(F.col(number), F.lit("")))
    rows = df.select(*keys, home.alias("home"), F.regexp_replace(raw, "[^0-9]", "").alias("digits"), raw.startswith("+").alias("plus"))
    trunk, code = F.coalesce(of(TRUNKS), F.lit("0")), F.coalesce(of(codes_of_homes()), F.lit(""))
    own = F.when((trunk != "") & F.col("digits").startswith(trunk), F.substring("digits", F.length(trunk) + 1, F.length("digits"))).otherwise(F.col("digits"))
    is_int = F.col("plus") | F.col("digits").startswith("00")
    abroad = F.when(F.col("plus"), F.col("digits")).otherwise(F.substring("digits", F.lit(3), F.length("digits")))
    way = lambda name, rank, value: F.struct(F.lit(name).alias("read"), F.lit(rank).alias("rank"), value.alias("full"))
    tried = F.when(is_int, F.array(way("international", 0, abroad))).otherwise(F.array(way("national", 0, F.concat(code, own)), way("bare", 1, F.col("digits"))))
    each = rows.select(*keys, "home", F.explode(tried).alias("t")).select(*keys, "home", "t.*")
    heads = each.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.substring(F.col("full"), F.lit(1), n))).alias("prefix")).distinct()
    met = heads.join(plans, "prefix", "left").withColumn("behind", F.length("full") - F.length("code"))
    best = met.groupBy(*keys, "home", "read", "rank", "full").agg(F.max_by(F.struct("country", "code", "low", "high", "behind"), F.when(F.col("country").isNotNull(), F.length("prefix"))).alias("plan"))
    fits = F.coalesce(F.col("plan.behind").between(F.col("plan.low"), F.col("plan.high")), F.lit(False))
    # A valid reading comes before one that is not, then the likelier one.
    picked = best.withColumn("fits", fits).groupBy(*keys, "home").agg(F.min_by(F.struct("read", "full", "plan", "fits"), F.struct(~F.col("fits"), "rank")).alias("p"))
    mine = F.coalesce(*(F.when(F.col("home") == h, F.col("p.plan.country").isin(*own_countries(h))) for h in OWN), F.col("p.plan.country") == F.col("home"))
    return picked.select(*keys, "p.read", "p.plan.country", F.substring("p.full", F.length("p.plan.code") + 1, F.length("p.full")).alias("national"), F.col("p.fits").alias("valid"), F.coalesce(mine, F.lit(False)).alias("domestic"))
