"""Scalar functions, JSON documents and geography over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.plans.sqlviews import adder
from quarry.registry import Registry
from quarry.session import table

R = Registry()
sql = adder(R)

sql("fn_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, reverse(p_brand) AS r FROM part")
sql("fn_lengths", "SELECT doc_id, char_length(text) AS c, octet_length(text) AS o, bit_length(text) AS b FROM documents", "SELECT doc_id, CAST(length(text) AS INTEGER) AS c, CAST(octet_length(encode(text)) AS INTEGER) AS o, CAST(8 * octet_length(encode(text)) AS INTEGER) AS b FROM documents")
sql("fn_trim", "SELECT p_partkey, trim(BOTH 'PS' FROM p_type) AS b, ltrim('P', p_type) AS l, rtrim('L', p_type) AS r FROM part", "SELECT p_partkey, trim(p_type, 'PS') AS b, ltrim(p_type, 'P') AS l, rtrim(p_type, 'L') AS r FROM part")
sql("fn_concat", "SELECT n_nationkey, concat_ws('-', n_name, NULL, CAST(n_regionkey AS STRING)) AS w, concat(n_name, '!') AS c FROM nation", "SELECT n_nationkey, concat_ws('-', n_name, NULL, CAST(n_regionkey AS VARCHAR)) AS w, n_name || '!' AS c FROM nation")
sql("fn_position", "SELECT p_partkey, locate('A', p_type) AS a, locate('', p_type) AS e FROM part", "SELECT p_partkey, CAST(instr(p_type, 'A') AS INTEGER) AS a, 1 AS e FROM part")
sql("fn_coalesce", "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'F'), 'none') AS s FROM orders")
sql("fn_rounding", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice) AS r, CAST(floor(p_retailprice) AS DOUBLE) AS f, CAST(ceil(p_retailprice) AS DOUBLE) AS c FROM part")
sql("fn_powers", "SELECT p_partkey, round(sqrt(p_size), 8) AS s, round(power(p_size, 2), 8) AS p, round(exp(p_size / 10.0D), 6) AS e, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS t, round(log(2, p_size), 8) AS b FROM part", "SELECT p_partkey, round(sqrt(p_size), 8) AS s, round(power(p_size, 2), 8) AS p, round(exp(p_size / 10.0), 6) AS e, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS t, round(log(2, p_size), 8) AS b FROM part")
sql("fn_trigonometry", "SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size), 8) AS t, round(asin(p_size / 50), 8) AS a, round(acos(p_size / 50), 8) AS b, round(atan(p_size), 8) AS d, round(atan2(p_size, 3), 8) AS e, round(cot(p_size), 8) AS f, round(degrees(p_size), 8) AS g, round(radians(p_size), 8) AS h, round(pi(), 8) AS i FROM part")
R.add(
    "fn_substring",
    r"SELECT p_partkey, substr(p_type, 1, 4) AS a, substr(p_type, 3) AS b, CAST(NULL AS VARCHAR) AS c, nullif(regexp_extract(p_type, '([AEIOU])[A-Z]', 1), '') AS d FROM part",
)(
    lambda spark, sf: table(spark, sf, "part").select(
        "p_partkey", S.substring(F.col("p_type"), -2, 4).alias("a"), S.substring(F.col("p_type"), 3).alias("b"), S.substring(F.col("p_type"), 1, -1).alias("c"), S.substring_match(F.col("p_type"), "([AEIOU])[A-Z]").alias("d")
    )
)
R.add("fn_left_right", "SELECT p_partkey, left(p_name, 3) AS a, left(p_name, -2) AS b, right(p_name, 3) AS c, right(p_name, -2) AS d FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", S.left(F.col("p_name"), 3).alias("a"), S.left(F.col("p_name"), -2).alias("b"), S.right(F.col("p_name"), 3).alias("c"), S.right(F.col("p_name"), -2).alias("d"))
)
R.add("fn_quote_literal", "SELECT p_partkey, '''' || p_name || '''''x''' AS q FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", S.quote_literal(F.concat("p_name", F.lit("'x"))).alias("q"))
)
R.add("fn_strict_math", "SELECT p_partkey, round(ln(p_size), 8) AS l, round(sqrt(p_retailprice), 8) AS s FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.round(S.strict_ln(F.col("p_size")), 8).alias("l"), F.round(S.strict_sqrt(F.col("p_retailprice")), 8).alias("s"))
)
R.add("fn_money", "SELECT c_custkey, 'USD' AS asset, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS minor, 2 AS scale FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", S.money(F.concat(F.lit("USD "), F.format_string("%.2f", F.abs("c_acctbal")))).alias("m")).select("c_custkey", "m.*")
)
_PLACE = "SELECT c_custkey, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon FROM customer"


def _places(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") % 180).cast("double").alias("lon"))


_H = "2 * 6371.0088 * asin(least(sqrt(pow(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * pow(sin(radians(2 - lon) / 2), 2)), 1.0))"
R.add("geo_distance", f"SELECT c_custkey, round({_H}, 6) AS km FROM ({_PLACE})")(
    lambda spark, sf: _places(spark, sf).select("c_custkey", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)), 6).alias("km"))
)
R.add("geo_radius", f"SELECT c_custkey FROM ({_PLACE}) WHERE {_H} <= 5000")(
    lambda spark, sf: _places(spark, sf).where(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)) <= 5000).select("c_custkey")
)
R.add("geo_nearest", f"SELECT c_custkey, round({_H}, 6) AS km FROM ({_PLACE}) ORDER BY round({_H}, 6), c_custkey LIMIT 10")(
    lambda spark, sf: _places(spark, sf).select("c_custkey", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)), 6).alias("km")).orderBy("km", "c_custkey").limit(10)
)
R.add("geo_bbox", f"SELECT c_custkey FROM ({_PLACE}) WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN 20 AND 90")(
    lambda spark, sf: _places(spark, sf).where("lat BETWEEN 10 AND 40 AND lon BETWEEN 20 AND 90").select("c_custkey")
)
R.add("geo_within", f"SELECT c_custkey FROM ({_PLACE}) WHERE lat > 10 AND lat < 40 AND lon > 19.5 AND lon < 20 + (lat - 10) - 1e-9")(
    lambda spark, sf: _places(spark, sf).where(S.within_polygon(F.col("lat"), F.col("lon"), [(10.0, 20.0), (40.0, 50.0), (40.0, 19.5), (10.0, 19.5)])).where("lat > 10 AND lat < 40 AND lon > 19.5").select("c_custkey")
)
R.add(
    "geo_bearing",
    f"SELECT c_custkey, round(fmod(degrees(atan2(sin(radians(2 - lon)) * cos(radians(48)), cos(radians(lat)) * sin(radians(48)) - sin(radians(lat)) * cos(radians(48)) * cos(radians(2 - lon)))) + 360, 360), 6) AS deg FROM ({_PLACE})",
)(lambda spark, sf: _places(spark, sf).select("c_custkey", F.round(S.bearing(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)), 6).alias("deg")))

R.add("geo_vincenty")(lambda spark, sf: _places(spark, sf).select("c_custkey", S.vincenty_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)).alias("km")))
R.add(
    "geo_midpoint",
    f"""WITH p AS ({_PLACE}), r AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS b, radians(48) AS c, radians(2 - lon) AS l FROM p)
    SELECT c_custkey, round(degrees(atan2(sin(a) + sin(c), sqrt(pow(cos(a) + cos(c) * cos(l), 2) + pow(cos(c) * sin(l), 2)))), 6) AS lat,
           round(degrees(b + atan2(cos(c) * sin(l), cos(a) + cos(c) * cos(l))), 6) AS lon FROM r""",
)(
    lambda spark, sf: _places(spark, sf)
    .select("c_custkey", S.midpoint(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0)).alias("m"))
    .select("c_custkey", F.round("m.lat", 6).alias("lat"), F.round("m.lon", 6).alias("lon"))
)
R.add(
    "geo_destination",
    f"""WITH p AS ({_PLACE}), r AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS b, radians(60) AS t, 500 / 6371.0088 AS d FROM p),
         q AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) AS z FROM r)
    SELECT c_custkey, round(degrees(z), 6) AS lat, round(degrees(b + atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(z))), 6) AS lon FROM q""",
)(
    lambda spark, sf: _places(spark, sf)
    .select("c_custkey", S.destination(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(500.0)).alias("m"))
    .select("c_custkey", F.round("m.lat", 6).alias("lat"), F.round("m.lon", 6).alias("lon"))
)

# documents: the JSON text of events.props
sql("json_valid", "SELECT event_id, try_parse_json(props) IS NOT NULL AS ok FROM events", "SELECT event_id, coalesce(json_valid(props), false) AS ok FROM events")
R.add("json_typeof", "SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE lower(json_type(props)) END AS kind FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", S.json_typeof(F.col("props")).alias("kind"))
)
sql("json_object", "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS j, to_json(array(n_nationkey, n_regionkey)) AS a FROM nation", "SELECT n_nationkey, CAST(json_object('name', n_name, 'region', n_regionkey) AS VARCHAR) AS j, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a FROM nation")
sql("json_array_length", "SELECT n_nationkey, json_array_length(concat('[', n_regionkey, ',1]')) AS n FROM nation", "SELECT n_nationkey, CAST(json_array_length('[' || n_regionkey || ',1]') AS INTEGER) AS n FROM nation")
sql("fn_now", "SELECT event_id, now() > ts AS past, CURRENT_TIMESTAMP() >= now() - INTERVAL 1 DAY AS same, CURRENT_DATE() > CAST(ts AS DATE) AS later FROM events", "SELECT event_id, CAST(now() AS TIMESTAMP) > ts AS past, true AS same, CURRENT_DATE > CAST(ts AS DATE) AS later FROM events")
R.add("fn_money_forms", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS asset, CASE c_custkey % 4 WHEN 0 THEN c_custkey + 1234500 WHEN 1 THEN c_custkey END AS minor, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS scale FROM customer")(
    lambda spark, sf: table(spark, sf, "customer")
    .select("c_custkey", S.money(F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(format_number((c_custkey + 1234500) / 1000, 3), ' EUR') WHEN 1 THEN concat(' USD ', c_custkey) WHEN 2 THEN 'usd 5' ELSE '12.3.4 USD' END")).alias("m"))
    .select("c_custkey", "m.*")
)
