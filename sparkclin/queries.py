"""Registered queries of the engine and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.fhirpath.compiler import compile_expression
from sparkclin.fhirpath.interpreter import evaluate_column
from sparkclin.functions import text as tx
from sparkclin.functions import units
from sparkclin.operators import hierarchy, history, indexing, reports
from sparkclin.operators.search import Search, Store
from sparkclin.operators.terminology import Include, Terminology, ValueSet
from sparkclin.operators.validation import Element, Invariant, Profile, Slice, validate
from sparkclin.plans.catalog import Catalog
from sparkclin.sources import tables
from sparkclin.sources.tables import MAKERS, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# FHIRPath


def fp(name: str, kind: str, sql: str, **expressions: str) -> None:
    """A query of expressions over a type; collections come as texts joined by a bar."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = MAKERS[kind](spark, sf)
        schema, out = df.schema["resource"].dataType, [F.col("id")]
        for column, e in expressions.items():
            v = compile_expression(e, F.col("resource"), schema)
            single = v.column.cast("double") if isinstance(v.type, T.DecimalType) else v.column
            out.append((F.array_join(F.transform(v.array().column, lambda x: x.cast("string")), "|") if v.many else single).alias(column))
        return df.select(*out)

    query(name, sql)(run)


_CUST = "CAST(c_custkey AS VARCHAR) AS id"
_OBS = "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS id"

fp("fp_where_exists", "Observation", f"SELECT {_OBS}, l_extendedprice > 50000 AS pricey, CASE WHEN l_extendedprice > 50000 THEN l_extendedprice END AS price, l_discount > 0.05 OR l_tax > 0.05 AS extra FROM lineitem",
   pricey="component.where(code.coding.code = 'price').exists(valueQuantity.value > 50000)", price="component.where(code.coding.code = 'price' and valueQuantity.value > 50000).valueQuantity.value.first()",
   extra="component.exists(code.coding.code != 'price' and valueQuantity.value > 0.05)")
fp("fp_select_flatten", "Patient", f"SELECT {_CUST}, split_part(c_name, '#', 2) || '|' || split_part(c_name, '#', 1) AS parts, CAST(2 AS BIGINT) AS n FROM customer",
   parts="name.select(given | family)", n="name.select(given | family).count()")
fp("fp_all_any", "Observation", f"SELECT {_OBS}, l_discount > 0 AND l_tax > 0 AND l_extendedprice > 0 AS positive, l_discount = 0 OR l_tax = 0 AS some_zero, (l_discount > 0)::INT + (l_tax > 0)::INT + (l_extendedprice > 0)::INT = 3 AS all_true FROM lineitem",
   positive="component.all(valueQuantity.value > 0)", some_zero="component.valueQuantity.value.select($this > 0).anyFalse()", all_true="component.select(valueQuantity.value > 0).allTrue()")
fp("fp_aggregate_sum", "Observation", f"SELECT {_OBS}, round(l_extendedprice + l_discount + l_tax, 2) AS total, CAST(3 AS BIGINT) AS n FROM lineitem",
   total="component.valueQuantity.value.aggregate($total + $this, 0.0).round(2)", n="component.count()")
fp("fp_subsetting", "Observation", f"SELECT {_OBS}, 'price' AS first_code, 'tax' AS last_code, 'discount|tax' AS rest, 'price|discount' AS two, 'tax' AS after, 'discount' AS second FROM lineitem",
   first_code="component.code.coding.code.first()", last_code="component.code.coding.code.last()", rest="component.code.coding.code.tail()", two="component.code.coding.code.take(2)", after="component.code.coding.code.skip(2)", second="component.code.coding.code[1]")
fp("fp_setops", "Patient", f"SELECT {_CUST}, c_mktsegment || '|BUILDING' AS both_of, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE c_mktsegment || '|BUILDING' END AS united, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE '' END AS shared, c_mktsegment IN ('BUILDING', 'MACHINERY') AS inside FROM customer",
   both_of="segment.coding.code.combine('BUILDING')", united="segment.coding.code | 'BUILDING'", shared="segment.coding.code.intersect('BUILDING' | 'X')", inside="segment.coding.code.subsetOf('BUILDING' | 'MACHINERY')")
fp("fp_exclude_dups", "Communication", "SELECT CAST(conv_id AS VARCHAR) AS id, string_agg(CASE WHEN role <> 'user' THEN role END, '|' ORDER BY turn) AS others, CAST(count(DISTINCT role) AS BIGINT) AS roles FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role <> 'user') > 0 UNION ALL SELECT CAST(conv_id AS VARCHAR), '', CAST(count(DISTINCT role) AS BIGINT) FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role <> 'user') = 0",
   others="payload.role.exclude('user')", roles="payload.role.distinct().count()")
fp("fp_string_fns", "Medication", "SELECT CAST(p_partkey AS VARCHAR) AS id, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 3) AS part, CAST(strpos(p_name, 'w') - 1 AS BIGINT) AS at, replace(p_name, ' ', '_') AS joined, starts_with(p_name, 'cold') AS cold, contains(p_name, 'dg') AS has, ends_with(p_name, 't') AS ends_t, replace(p_name, ' ', '|') AS words FROM part",
   up="name.upper()", n="name.length()", part="name.substring(1, 3)", at="name.indexOf('w')", joined="name.replace(' ', '_')", cold="name.startsWith('cold')", has="name.contains('dg')", ends_t="name.endsWith('t')", words="name.split(' ')")
fp("fp_regex", "Medication", "SELECT CAST(p_partkey AS VARCHAR) AS id, regexp_matches(p_name, 'w.dget') AS found, regexp_full_match(p_name, '[a-z]+ widget') AS whole, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked FROM part",
   found="name.matches('w.dget')", whole="name.matchesFull('[a-z]+ widget')", masked="name.replaceMatches('[aeiou]', '*')")
fp("fp_math_fns", "Medication", "SELECT CAST(p_partkey AS VARCHAR) AS id, round(abs(p_retailprice - 1000), 4) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(trunc(p_retailprice) AS BIGINT) AS t, round(sqrt(p_retailprice), 6) AS r, round(ln(p_retailprice), 6) AS l, CAST(p_size // 7 AS BIGINT) AS d, CAST(p_size % 7 AS BIGINT) AS m, CAST(p_size * p_size AS BIGINT) AS sq FROM part",
   a="(price - 1000).abs().round(4)", c="price.ceiling()", f="price.floor()", t="price.truncate()", r="price.sqrt().round(6)", l="price.ln().round(6)", d="size div 7", m="size mod 7", sq="size.power(2)")
fp("fp_bankers_round", "Medication", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(CASE WHEN p_size % 2 = 0 THEN p_size / 2 WHEN (p_size // 2) % 2 = 0 THEN p_size // 2 ELSE p_size // 2 + 1 END AS DOUBLE) AS half FROM part",
   half="(size / 2).round()")
fp("fp_convert", "Medication", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, CASE WHEN p_size = 1 THEN TRUE WHEN p_size = 0 THEN FALSE END AS b, FALSE AS name_is_int, CAST(substr(p_brand, 7) AS BIGINT) AS brand FROM part",
   s="size.toString()", d="size.toDecimal()", b="size.toBoolean()", name_is_int="name.convertsToInteger()", brand="code.coding.where(system = 'urn:brand').code.first().substring(6).toInteger()")
fp("fp_kleene", "Location", "SELECT 'region-' || r_regionkey AS id, NULL::BOOLEAN AS both_of, TRUE AS any_of, NULL::BOOLEAN AS odd, TRUE AS implied, FALSE AS no FROM region UNION ALL SELECT 'nation-' || n_nationkey, n_regionkey = 1, TRUE, n_regionkey <> 1, n_regionkey = 1, FALSE FROM nation",
   both_of="partOf.reference = 'Location/region-1' and name.exists()", any_of="partOf.reference = 'Location/region-1' or name.exists()", odd="(partOf.reference = 'Location/region-1') xor true", implied="name.empty() or (partOf.reference.exists() implies partOf.reference = 'Location/region-1')", no="partOf.reference = 'x' and false")
fp("fp_temporal_precision", "Encounter", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate >= TIMESTAMP '1998-03-01' AS later, CASE WHEN date_trunc('month', o_orderdate) <> TIMESTAMP '1998-03-01' THEN FALSE END AS same_month, CASE WHEN year(o_orderdate) <> 1998 THEN o_orderdate < TIMESTAMP '1998-01-01' END AS before_year FROM orders",
   later="period.start >= @1998-03-01", same_month="period.start = @1998-03", before_year="period.start < @1998")
fp("fp_date_arith", "Observation", f"SELECT {_OBS}, strftime(l_shipdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_on, strftime(l_shipdate - INTERVAL 10 DAY, '%Y-%m-%d') AS days_back, l_shipdate + INTERVAL 1 YEAR > TIMESTAMP '2000-01-01' AS late FROM lineitem",
   month_on="effective + 1 month", days_back="effective - 10 days", late="effective + 1 year > @2000-01-01")


_PART = "CAST(p_partkey AS VARCHAR) AS id"
fp("fp_string_more", "Medication", f"""SELECT {_PART}, CASE WHEN contains(p_name, 'e') THEN length(p_name) - strpos(reverse(p_name), 'e') ELSE -1 END AS last_at, p_name AS low, array_to_string(string_split(p_name, ''), '|') AS chars, p_name AS trimmed, lower(hex(encode(p_name))) AS hex,
   to_base64(encode(p_name)) AS b64, p_name AS back, p_name || '&lt;b&gt;' AS escaped, p_name || '<b>' AS unescaped, replace(p_name, ' ', '-') AS dashed, p_name || '-' || p_size AS glued FROM part""",
   last_at="name.lastIndexOf('e')", low="name.upper().lower()", chars="name.toChars()", trimmed="('  ' & name & ' ').trim()", hex="name.encode('hex')",
   b64="name.encode('base64')", back="name.encode('base64').decode('base64')", escaped="(name & '<b>').escape('html')", unescaped="(name & '&lt;b&gt;').unescape('html')", dashed="name.split(' ').join('-')", glued="name & '-' & size.toString()")
fp("fp_collection_more", "Medication", f"""SELECT {_PART}, p_type = 'PROMO' OR p_brand = 'PROMO' AS holds, len(list_distinct(string_split(p_name, ''))) = length(p_name) AS all_differ, p_name AS one, p_brand || '|' || p_type || CASE WHEN p_type = 'PROMO' THEN '' ELSE '|PROMO' END AS united,
   array_to_string(list_sort(string_split(p_name, '')), '|') AS sorted, array_to_string(string_split(p_name, '')[1:3], '|') AS head, contains(p_name, 'w') AS inside, contains(p_name, 'z') AS has, p_name AS traced, TRUE AS valued FROM part""",
   holds="code.coding.code.supersetOf('PROMO')", all_differ="name.toChars().isDistinct()", one="name.single()", united="code.coding.code.union('PROMO')",
   sorted="name.toChars().sort()", head="name.toChars().where($index < 3)", inside="'w' in name.toChars()", has="name.toChars() contains 'z'", traced="name.trace('x')", valued="name.hasValue()")
fp("fp_math_more", "Medication", f"""SELECT {_PART}, round(exp(p_size / 10.0), 6) AS e, round(log10(p_retailprice), 6) AS l, CAST(p_size * 2 AS BIGINT) AS twice, CAST(-p_size AS BIGINT) AS minus, p_size <= 10 AS small, CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END AS chosen,
   TRUE AS alike, p_size <> 7 AS unlike, p_size IN (0, 1) AS flag, FALSE AS dec, TRUE AS str FROM part""",
   e="(size / 10).exp().round(6)", l="price.log(10).round(6)", twice="size * 2", minus="-size", small="size <= 10", chosen="iif(size > 25, 'big', 'little')",
   alike="name ~ name.upper()", unlike="size !~ 7", flag="size.convertsToBoolean()", dec="name.convertsToDecimal()", str="size.convertsToString()")
fp("fp_boolean_more", "Observation", f"SELECT {_OBS}, l_discount > 0.05 OR l_tax > 0.05 OR l_extendedprice > 0.05 AS some, l_extendedprice <= 50000 AND l_discount <= 50000 AND l_tax <= 50000 AS none FROM lineitem",
   some="component.select(valueQuantity.value > 0.05).anyTrue()", none="component.select(valueQuantity.value > 50000).allFalse()")
fp("fp_temporal_more", "Encounter", "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS d, TRUE AS is_date, TRUE AS is_stamp, month(o_orderdate) <= 12 AS is_time, FALSE AS no_date FROM orders",
   d="period.start.toDate()", is_date="period.start.toString().convertsToDate()", is_stamp="(period.start.toString() & 'T10:30:00Z').convertsToDateTime()", is_time="('10:' & period.start.toString().substring(5, 2)).convertsToTime()", no_date="status.convertsToDate()")


fp("fp_types", "Medication", f"""SELECT {_PART}, TRUE AS whole, TRUE AS text, FALSE AS other, p_name AS as_text, CAST(p_size AS BIGINT) AS as_whole, p_name AS only_text, CAST(NULL AS VARCHAR) AS wrong, CAST(p_partkey AS VARCHAR) AS ident, p_name AS own,
   substr(p_name, 2, 1) AS second, p_brand || '|' || p_type AS codes, round(p_size + p_retailprice, 2) AS total, CASE WHEN p_size = 3 THEN '3' ELSE least(p_size, 3) || '|' || greatest(p_size, 3) END AS ordered, TRUE AS past, TRUE AS today_past, TRUE AS of_day FROM part""",
   whole="size is Integer", text="name is String", other="name is Integer", as_text="(name as String)", as_whole="size.as(Integer)", only_text="name.ofType(String)", wrong="name as Integer", ident="%resource.id", own="%context.name",
   second="name.toChars().where($index = 1)", codes="code.repeat(coding).code", total="(size + price).round(2)", ordered="(size | 3).sort()", past="now() > @2020-01-01", today_past="today() >= @2020-01-01", of_day="timeOfDay() >= @T00:00:00")
fp("fp_moments", "Encounter", "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00Z' AS stamp, strftime(o_orderdate, '10:%m') AS clock FROM orders",
   stamp="(period.start.toString() & 'T10:30:00Z').toDateTime()", clock="('10:' & period.start.toString().substring(5, 2)).toTime()")
fp("fp_repeat", "Observation", f"SELECT {_OBS}, CAST(3 AS BIGINT) AS n, 'price|discount|tax' AS codes, TRUE AS measured, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem",
   n="repeat(component).count()", codes="component.repeat(code).coding.code", measured="value is Quantity", day="(effective as dateTime)")


@query("fp_quantities", "SELECT event_id, concat(json_extract_string(props, '$.k'), ' ', chr(39), '1', chr(39)) AS plain, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS heavy, TRUE AS alike, FALSE AS unlike, TRUE AS converts, 'Integer' AS kind, CAST(2 AS BIGINT) AS digits FROM events")
def fp_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that the interpreter alone has: quantities in other units, the type of an item, its precision."""
    mass = r"(k.toString() & ' \'mg\'').toQuantity()"
    items = ["k.toQuantity().toString()", f"({mass} > 0.05 'g').toString()", f"{mass}.comparable(1 'g').toString()", f"{mass}.comparable(1 'm').toString()", "k.convertsToQuantity().toString()", "k.type().name", "(k + 0.25).precision().toString()"]
    combined = items[0] + "".join(f".combine({i})" for i in items[1:])
    df = evaluate_column(read(spark, sf, "events").select("event_id", "props"), "props", combined, "r")
    flag = lambda i: F.get("r", i) == "true"
    return df.select("event_id", F.get("r", 0).alias("plain"), flag(1).alias("heavy"), flag(2).alias("alike"), flag(3).alias("unlike"), flag(4).alias("converts"), F.get("r", 5).alias("kind"), F.get("r", 6).cast("long").alias("digits"))


@query("fp_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS high FROM events")
def fp_json_props(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("resource"))
    schema = df.schema["resource"].dataType
    return df.select("event_id", compile_expression("k", F.col("resource"), schema).column.alias("k"), compile_expression("k > 50", F.col("resource"), schema).column.alias("high"))


@query("fp_boundary", "SELECT event_id, json_extract_string(props, '$.k') || '.5' AS high, CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) - 0.5 AS VARCHAR) AS low FROM events")
def fp_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries of a number to one digit, by the interpreter."""
    df = read(spark, sf, "events").select("event_id", "props")
    df = evaluate_column(df, "props", "k.highBoundary(1) | k.lowBoundary(1)", "r")
    return df.select("event_id", F.get("r", 0).alias("high"), F.get("r", 1).alias("low"))


@query("fp_children", "SELECT event_id, CAST(1 AS BIGINT) AS n, TRUE AS same FROM events")
def fp_children(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate_column(read(spark, sf, "events").select("event_id", "props"), "props", "children().count() | (children() = descendants())", "r")
    return df.select("event_id", F.get("r", 0).cast("long").alias("n"), (F.get("r", 1) == "true").alias("same"))


fp("fp_embedding_index", "Specimen", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1] AS DOUBLE) AS head, CAST(len(embedding) AS BIGINT) AS n, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings",
   head="reading[0]", n="reading.count()", positive="reading.where($this > 0).count()")


# indexing


def idx(name: str, kind: str, code: str, sql: str, *columns: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return indexing.shred(MAKERS[kind](spark, sf), [Catalog.default().params[kind, code]]).select("id", "parameter_name", *columns)


idx("idx_string", "Patient", "name", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'name' AS parameter_name, unnest([split_part(c_name, '#', 1), split_part(c_name, '#', 2), c_name]) AS value, unnest([lower(split_part(c_name, '#', 1)), split_part(c_name, '#', 2), lower(replace(c_name, '#', ''))]) AS value_normalized FROM customer", "value", "value_normalized")
idx("idx_token", "Medication", "code", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'code' AS parameter_name, 'urn:brand' AS system, p_brand AS code, lower(p_brand) AS code_ci, p_name AS display FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'code', 'urn:type', p_type, lower(p_type), NULL FROM part", "system", "code", "code_ci", "display")
idx("idx_date", "Encounter", "date", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'date' AS parameter_name, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS start_date, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS end_date FROM orders", "start_date", "end_date")
idx("idx_number", "Patient", "balance", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'balance' AS parameter_name, c_acctbal AS value FROM customer", "value")
idx("idx_quantity", "Observation", "value-quantity", f"SELECT {_OBS}, 'value-quantity' AS parameter_name, l_quantity AS value, 'http://unitsofmeasure.org' AS system, 'mg' AS code, 'mg' AS unit FROM lineitem", "value", "system", "code", "unit")
idx("idx_reference", "Encounter", "subject", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'subject' AS parameter_name, 'relative' AS reference_kind, 'Patient' AS target_type, CAST(o_custkey AS VARCHAR) AS target_id, NULL::VARCHAR AS target_url FROM orders", "reference_kind", "target_type", "target_id", "target_url")
idx("idx_uri", "Composition", "url", "SELECT CAST(page_id AS VARCHAR) AS id, 'url' AS parameter_name, url AS value, lower(url) AS value_normalized FROM pages", "value", "value_normalized")


@query("idx_text_striphtml", r"""SELECT CAST(page_id AS VARCHAR) AS id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM pages""")
def idx_text_striphtml(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.narrative_text(MAKERS["Composition"](spark, sf)).select("id", "content")


@query("idx_content", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents")
def idx_content(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.content_text(MAKERS["DocumentReference"](spark, sf), "description").select("id", "content")


@query("idx_composite", f"SELECT {_OBS}, 'price' AS code, l_extendedprice AS value FROM lineitem UNION ALL SELECT {_OBS}, 'discount', l_discount FROM lineitem UNION ALL SELECT {_OBS}, 'tax', l_tax FROM lineitem")
def idx_composite(spark: SparkSession, sf: str) -> DataFrame:
    rows = indexing.shred(MAKERS["Observation"](spark, sf), [Catalog.default().params["Observation", "component-code-value"]])
    return rows.select("id", F.col("c0.code").alias("code"), F.col("c1.value").alias("value"))


@query("idx_membership", "SELECT 'quality-' || quality AS collection_id, 'DocumentReference' AS member_type, CAST(doc_id AS VARCHAR) AS member_id, toxic = 1 AS member_inactive FROM labels")
def idx_membership(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.memberships(MAKERS["Group"](spark, sf)).select("collection_id", "member_type", "member_id", "member_inactive")


@query("idx_fused", "SELECT 'balance' AS parameter_name, count(*) AS n FROM customer UNION ALL SELECT 'segment', count(*) FROM customer UNION ALL SELECT 'active', count(*) FROM customer UNION ALL SELECT 'identifier', count(*) FROM customer UNION ALL SELECT 'location', count(*) FROM customer UNION ALL SELECT 'name', 3 * count(*) FROM customer UNION ALL SELECT 'family', count(*) FROM customer UNION ALL SELECT 'address-country', count(*) FROM customer")
def idx_fused(spark: SparkSession, sf: str) -> DataFrame:
    """All parameters of a type, one projection for each kind."""
    index = indexing.index_all(MAKERS["Patient"](spark, sf), Catalog.default().of_type("Patient"))
    return indexing.union_all([d.select("parameter_name") for d in index.values()]).groupBy("parameter_name").agg(F.count(F.lit(1)).alias("n"))


@query("idx_identifier_type", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'MR' AS type_code, CAST(c_custkey AS VARCHAR) AS value FROM customer")
def idx_identifier_type(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.identifier_types(MAKERS["Patient"](spark, sf)).select("id", "type_code", "value")


@query("idx_entry_hash", "SELECT count(DISTINCT (c_custkey, v)) AS n FROM (SELECT c_custkey, unnest([split_part(c_name, '#', 1), split_part(c_name, '#', 2), c_name]) AS v FROM customer)")
def idx_entry_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = indexing.shred(MAKERS["Patient"](spark, sf), [Catalog.default().params["Patient", "name"]])
    return indexing.with_entry_hash(rows.unionByName(rows)).agg(F.count(F.lit(1)).alias("n"))


@query("idx_stale", "SELECT CAST(user_id AS VARCHAR) AS id, count(*) - 1 AS stale FROM events GROUP BY user_id HAVING count(*) > 1")
def idx_stale(spark: SparkSession, sf: str) -> DataFrame:
    versions = MAKERS["AuditEvent"](spark, sf)
    index = indexing.shred(versions, [Catalog.default().params["AuditEvent", "action"]])
    newest = history._newest(versions)
    return indexing.stale_entries(index, newest).groupBy("id").agg(F.count(F.lit(1)).alias("stale"))


@query("text_normalize", "SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-zß0-9]', '', 'g') AS folded FROM documents")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("folded"))


# search: each a request, and the SQL of its matches


def find(name: str, url: str, sql: str, types: tuple[str, ...] = ()) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        kind = url.split("?")[0]
        return Search(Store.from_tables(spark, sf, *(types or (kind,)))).matches(url).select("id")


_C, _O, _P, _L = "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part", f"SELECT {_OBS} FROM lineitem"

find("s_string_prefix", "Patient?name=00000001", f"{_C} WHERE starts_with(split_part(c_name, '#', 2), '00000001') OR starts_with(lower(replace(c_name, '#', '')), '00000001')")
find("s_string_exact", "Medication?name:exact=cold widget", f"{_P} WHERE p_name = 'cold widget'")
find("s_string_contains", "Medication?name:contains=WID", f"{_P} WHERE contains(lower(replace(p_name, ' ', '')), 'wid')")
find("s_string_text", "Medication?name:text=widget AND NOT cold", f"{_P} WHERE contains(' ' || p_name || ' ', ' widget ') AND NOT contains(' ' || p_name || ' ', ' cold ')")
find("s_token_system_code", "Medication?code=urn:type|promo", f"{_P} WHERE lower(p_type) = 'promo'")
find("s_token_or", "Encounter?status=F,P", f"{_O} WHERE o_orderstatus IN ('F', 'P')")
find("s_token_no_system", "Encounter?status=|F", f"{_O} WHERE o_orderstatus = 'F'")
find("s_token_system_only", "Medication?code=urn:brand|", _P)
find("s_token_not", "Encounter?priority:not=urn:priority|5-LOW", f"{_O} WHERE o_orderpriority <> '5-LOW'")
find("s_token_text", "Patient?segment:text=build", f"{_C} WHERE starts_with(lower(c_mktsegment), 'build')")
find("s_token_code_text", "Patient?segment:code-text=mach", f"{_C} WHERE starts_with(lower(c_mktsegment), 'mach')")
find("s_token_of_type", "Patient?identifier:of-type=http://terminology.hl7.org/CodeSystem/v2-0203|MR|7", f"{_C} WHERE c_custkey = 7")
for _p, _t in {"eq": "o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'", "ne": "o_orderdate < '1997-01-01' OR o_orderdate >= '1998-01-01'", "gt": "o_orderdate >= '1998-01-01'", "ge": "o_orderdate >= '1997-01-01'", "lt": "o_orderdate < '1997-01-01'", "le": "o_orderdate < '1998-01-01'", "sa": "o_orderdate >= '1998-01-01'", "eb": "o_orderdate < '1997-01-01'"}.items():
    find(f"s_date_{_p}", f"Encounter?date={_p}1997", f"{_O} WHERE {_t}")
find("s_date_ap", "Encounter?date=ap1997-06-15", f"{_O} WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-14' AND DATE '1997-06-16'")
find("s_date_and", "Encounter?date=ge1997-03&date=lt1997-05-10", f"{_O} WHERE o_orderdate >= '1997-03-01' AND o_orderdate < '1997-05-10'")
for _p, _t in {"eq": "c_acctbal >= 1999.5 AND c_acctbal < 2000.5", "ne": "c_acctbal < 1999.5 OR c_acctbal >= 2000.5", "gt": "c_acctbal >= 2000.5", "ge": "c_acctbal >= 1999.5", "lt": "c_acctbal < 1999.5", "le": "c_acctbal < 2000.5", "ap": "abs(c_acctbal - 2000) <= 200"}.items():
    find(f"s_number_{_p}", f"Patient?balance={_p}2000", f"{_C} WHERE {_t}")
find("s_number_precision", "Patient?balance=2e3", f"{_C} WHERE c_acctbal >= 1500 AND c_acctbal < 2500")
find("s_quantity_unit", "Observation?value-quantity=gt25|http://unitsofmeasure.org|mg", f"{_L} WHERE l_quantity >= 25.5")
find("s_quantity_code_or_unit", "Observation?value-quantity=le10||mg", f"{_L} WHERE l_quantity < 10.5")
find("s_ref_type_id", "Encounter?subject=Patient/7,Patient/9", f"{_O} WHERE o_custkey IN (7, 9)")
find("s_ref_id", "Encounter?subject=12", f"{_O} WHERE o_custkey = 12")
find("s_ref_below", "Patient?location:below=Location/region-1", f"{_C} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", ("Patient", "Location"))
find("s_ref_above", "Location?partof:above=Location/nation-3", "SELECT 'nation-3' AS id UNION ALL SELECT 'region-' || n_regionkey FROM nation WHERE n_nationkey = 3")
find("s_ref_contains", "Patient?location:contains=Location/region-2", f"{_C} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", ("Patient", "Location"))
find("s_uri_exact", "Composition?url=https://thther.example.org/en/685", "SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE url = 'https://thther.example.org/en/685'")
find("s_uri_below", "Composition?url:below=https://thther.example.org", "SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE url = 'https://thther.example.org' OR starts_with(url, 'https://thther.example.org/')")
find("s_uri_above", "Composition?url:above=https://thther.example.org/en/685/more", "SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE starts_with('https://thther.example.org/en/685/more', rtrim(url, '/') || '/') OR url = 'https://thther.example.org/en/685/more'")
find("s_uri_contains", "Composition?url:contains=EXAMPLE.ORG", "SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE contains(lower(url), 'example.org')")
find("s_composite", "Observation?component-code-value=urn:component|price$gt90000", f"{_L} WHERE l_extendedprice >= 90000.5")
find("s_missing", "Location?partof:missing=true", "SELECT 'region-' || r_regionkey AS id FROM region")
find("s_not_missing", "Location?partof:missing=false", "SELECT 'nation-' || n_nationkey AS id FROM nation")
find("s_id", "Patient?_id=1,2,3", f"{_C} WHERE c_custkey IN (1, 2, 3)")
find("s_last_updated", "Encounter?_lastUpdated=ge2000-01-01", f"{_O} WHERE o_orderdate >= '2000-01-01'")
find("s_text_boolean", "DocumentReference?_content=the AND (with OR from) NOT de", "WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id FROM w WHERE contains(t, ' the ') AND (contains(t, ' with ') OR contains(t, ' from ')) AND NOT contains(t, ' de ')")
find("s_text_phrase", 'DocumentReference?_content="of the"', "WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id FROM w WHERE contains(t, ' of the ')")
find("s_chain", "Encounter?subject:Patient.segment=urn:segment|BUILDING", f"{_O} JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", ("Encounter", "Patient"))
find("s_chain_multi_and", "Encounter?subject.segment=BUILDING&subject.balance=gt5000&status=O", f"{_O} JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 5000.5 AND o_orderstatus = 'O'", ("Encounter", "Patient"))
find("s_chain_deep", "Observation?encounter.subject.segment=FURNITURE&value-quantity=lt3", f"{_L} JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE' AND l_quantity < 2.5", ("Observation", "Encounter", "Patient"))
find("s_has", "Patient?_has:Encounter:subject:priority=1-URGENT", f"{_C} WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", ("Patient", "Encounter"))
find("s_has_nested", "Patient?_has:Encounter:subject:_has:Observation:encounter:value-quantity=ge50", f"{_C} WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 49.5)", ("Patient", "Encounter", "Observation"))
find("s_filter_tree", "Encounter?_filter=(status eq F and total gt 200000) or not (priority eq 5-LOW)", f"{_O} WHERE (o_orderstatus = 'F' AND o_totalprice >= 200000.5) OR NOT o_orderpriority = '5-LOW'")
find("s_filter_string", "Medication?_filter=name sw col or name ew get and name co m", f"{_P} WHERE starts_with(replace(p_name, ' ', ''), 'col') OR (ends_with(replace(p_name, ' ', ''), 'get') AND contains(replace(p_name, ' ', ''), 'm'))")
find("s_filter_chain", "Encounter?_filter=subject[balance gt 9000].segment eq BUILDING", f"{_O} JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 9000.5", ("Encounter", "Patient"))
find("s_filter_period", "Encounter?_filter=date po 1997-02 and status pr true", f"{_O} WHERE o_orderdate >= '1997-02-01' AND o_orderdate < '1997-03-01'")


@query("s_ref_fragment", f"{_O} WHERE o_custkey % 7 = 3")
def s_ref_fragment(spark: SparkSession, sf: str) -> DataFrame:
    """References to contained resources, each of its own name."""
    df = MAKERS["Encounter"](spark, sf)
    name = F.concat(F.lit("#p"), F.col("resource.subject.reference").substr(9, 20).cast("long") % 7)
    df = df.withColumn("resource", F.col("resource").withField("subject", F.struct(name.alias("reference"))))
    return Search(Store({"Encounter": df})).matches("Encounter?subject=#p3").select("id")


@query("s_string_any_script", "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE starts_with(CAST(s_suppkey AS VARCHAR), '1')")
def s_string_any_script(spark: SparkSession, sf: str) -> DataFrame:
    """Names beyond Latin letters, folded like the query: accents, capitals and ligatures make no difference."""
    df = MAKERS["Organization"](spark, sf)
    df = df.withColumn("resource", F.col("resource").withField("name", F.concat(F.lit("Φάκελος ﬁ "), F.col("id"))))
    return Search(Store({"Organization": df})).matches("Organization?name=ΦΑΚΕΛΟΣ FI 1").select("id")


find("s_composite_unit", "Observation?component-code-value=urn:component|price$gt90000||1,urn:component|price$gt1||g", f"{_L} WHERE l_extendedprice >= 90000.5")
find("s_composite_no_system", "Observation?component-code-value=PRICE$gt90000,|price$gt1", f"{_L} WHERE l_extendedprice >= 90000.5")
find("s_filter_number", "Patient?_filter=balance gt 9000 or balance lt -500 and segment ne urn:segment|BUILDING", f"{_C} WHERE c_acctbal >= 9000.5 OR (c_acctbal < -500.5 AND c_mktsegment <> 'BUILDING')")
find("s_filter_has", "Patient?_filter=_has:Encounter:subject:total gt 400000", f"{_C} WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000.5)", ("Patient", "Encounter"))


def _documents(spark: SparkSession, sf: str) -> Search:
    store = Store.from_tables(spark, sf, "DocumentReference", "Group")
    store.members = indexing.memberships(store.frames["Group"])
    return Search(store)


@query("s_in_active", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def s_in_active(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).matches("DocumentReference?_in=Group/quality-1").select("id")


@query("s_list", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def s_list(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).matches("DocumentReference?_list=quality-0").select("id")


def _types(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Part types as a code system: all below ANY, sizes below SIZE."""
    up = {"PROMO": "ANY", "ECONOMY": "ANY", "STANDARD": "ANY", "SIZE": "ANY", "LARGE": "SIZE", "MEDIUM": "SIZE", "SMALL": "SIZE"}
    edges = [("urn:type", c, p) for c, p in up.items()] + [("urn:type", "ECONOMY", "SMALL")]  # two parents
    concepts = [("urn:type", c, c.title(), c != "STANDARD", {"kind": "size" if p == "SIZE" else "grade"}) for c, p in up.items()] + [("urn:type", "ANY", "Any", True, {})]
    return spark.createDataFrame(concepts, "system string, code string, display string, active boolean, properties map<string,string>"), spark.createDataFrame(edges, "system string, child string, parent string")


def _terminology(spark: SparkSession) -> Terminology:
    concepts, edges = _types(spark)
    sets = {
        "sizes": ValueSet("sizes", [Include("urn:type", filters=[("concept", "is-a", "SIZE")])]),
        "grades": ValueSet("grades", [Include("urn:type", filters=[("kind", "=", "grade")])]),
        "plain": ValueSet("plain", [Include("urn:type")], [Include("urn:type", codes=["ANY", "PROMO"])]),
        "nested": ValueSet("nested", [Include(value_sets=["sizes"]), Include("urn:type", codes=["PROMO"])]),
    }
    maps = [("urn:type", "PROMO", "urn:new", "P1", "equivalent"), ("urn:type", "LARGE", "urn:new", "L", "wider"), ("urn:type", "SMALL", "urn:new", "S", "unmatched"), ("urn:type", "LARGE", "urn:new", "XL", "narrower")]
    return Terminology(concepts, edges, sets, spark.createDataFrame(maps, "source string, code string, target string, target_code string, equivalence string"))


_BELOW_SIZE = "('SIZE', 'LARGE', 'MEDIUM', 'SMALL', 'ECONOMY')"


def _medications(spark: SparkSession, sf: str) -> Search:
    store = Store.from_tables(spark, sf, "Medication")
    t = _terminology(spark)
    store.expansions = {"sizes": t.expansion("sizes"), "hierarchy:urn:type": t.edges}
    return Search(store)


@query("s_token_in", f"{_P} WHERE p_type IN {_BELOW_SIZE}")
def s_token_in(spark: SparkSession, sf: str) -> DataFrame:
    return _medications(spark, sf).matches("Medication?code:in=sizes").select("id")


@query("s_token_not_in", f"{_P} WHERE p_type NOT IN {_BELOW_SIZE}")
def s_token_not_in(spark: SparkSession, sf: str) -> DataFrame:
    return _medications(spark, sf).matches("Medication?code:not-in=sizes").select("id")


@query("s_token_below", f"{_P} WHERE p_type IN {_BELOW_SIZE}")
def s_token_below(spark: SparkSession, sf: str) -> DataFrame:
    return _medications(spark, sf).matches("Medication?code:below=urn:type|SIZE").select("id")


@query("s_token_above", f"{_P} WHERE p_type IN ('ECONOMY', 'SMALL', 'SIZE', 'ANY')")
def s_token_above(spark: SparkSession, sf: str) -> DataFrame:
    return _medications(spark, sf).matches("Medication?code:above=urn:type|ECONOMY").select("id")


@query("s_compartment", f"SELECT {_OBS} FROM lineitem WHERE l_orderkey = 5")
def s_compartment(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Encounter", "Observation")).compartment("Encounter", "5", "Observation").select("id")


@query("s_include", "WITH m AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50) SELECT 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS id, 'match' AS mode FROM m UNION ALL SELECT DISTINCT 'Patient', CAST(o_custkey AS VARCHAR), 'include' FROM m WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def s_include(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Encounter", "Patient")).search("Encounter?_sort=-total&_count=50&_include=Encounter:subject")


@query("s_revinclude", "WITH m AS (SELECT c_custkey FROM customer ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 30) SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, 'match' AS mode FROM m UNION ALL SELECT 'Encounter', CAST(o_orderkey AS VARCHAR), 'include' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM m)")
def s_revinclude(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Encounter", "Patient")).search("Patient?_sort=balance&_count=30&_revinclude=Encounter:subject")


@query("s_include_iterate", "WITH m AS (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 10) SELECT 'Patient' AS resource_type, CAST(c_custkey AS VARCHAR) AS id, 'match' AS mode FROM m UNION ALL SELECT DISTINCT 'Location', 'nation-' || c_nationkey, 'include' FROM m UNION ALL SELECT DISTINCT 'Location', 'region-' || n_regionkey, 'include' FROM m JOIN nation ON c_nationkey = n_nationkey")
def s_include_iterate(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Location", "Patient")).search("Patient?_sort=balance&_count=10&_include=Patient:location&_include:iterate=Location:partof")


@query("s_sort_param", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS key FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25")
def s_sort_param(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Encounter")).page("Encounter?_sort=-total&_count=25").select("id", F.col("sort_0").alias("key"))


@query("s_offset", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 50")
def s_offset(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Encounter")).page("Encounter?_sort=-total&_count=25&_offset=50").select("id")


@query("s_keyset_page", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice < 100000 ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def s_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    import base64
    import json

    cursor = base64.urlsafe_b64encode(json.dumps([100000.0, "~"]).encode()).decode()
    return Search(Store.from_tables(spark, sf, "Encounter")).page(f"Encounter?_sort=-total&_count=20&_cursor={cursor}").select("id")


@query("s_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def s_total(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Encounter")).total("Encounter?status=F")


@query("s_elements", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS balance, 'SUBSETTED' AS tag FROM customer WHERE c_acctbal >= 9000.5")
def s_elements(spark: SparkSession, sf: str) -> DataFrame:
    from sparkclin.operators.search import subset
    from sparkclin.plans.request import parse_request

    r = parse_request("Patient?balance=gt9000&_elements=balance")
    return subset(Search(Store.from_tables(spark, sf, "Patient")).matches(r), r).select("id", "resource.balance", F.col("resource.meta.tag")[0]["code"].alias("tag"))


@query("s_system", "SELECT 'Patient' AS resource_type, count(*) AS n FROM customer WHERE contains(lower(replace(c_name, '#', '')), '9') UNION ALL SELECT 'Organization', count(*) FROM supplier WHERE contains(lower(replace(s_name, '#', '')), '9')")
def s_system(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Patient", "Organization")).system("?_type=Patient,Organization&name:contains=9").groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


@query("s_everything", "SELECT 'Patient' AS resource_type, '7' AS id UNION ALL SELECT 'Encounter', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey = 7")
def s_everything(spark: SparkSession, sf: str) -> DataFrame:
    return Search(Store.from_tables(spark, sf, "Patient", "Encounter")).everything("7")


# history and reports

_VERSIONS = "WITH v AS (SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_id, ts AS last_updated, event_type AS action, CAST(event_id AS VARCHAR) AS event FROM events), d AS (SELECT *, action = 'error' AND version_id > 1 AS deleted FROM v)"


@query("h_instance", f"{_VERSIONS} SELECT id, version_id, action FROM d WHERE id = '12' ORDER BY last_updated DESC")
def h_instance(spark: SparkSession, sf: str) -> DataFrame:
    return history.history(MAKERS["AuditEvent"](spark, sf), "AuditEvent", "12").select("id", "version_id", F.col("resource.action").alias("action"))


@query("h_type_since", f"{_VERSIONS} SELECT id, version_id, last_updated FROM d WHERE last_updated >= TIMESTAMP '2024-01-05'")
def h_type_since(spark: SparkSession, sf: str) -> DataFrame:
    return history.history(MAKERS["AuditEvent"](spark, sf), "AuditEvent", since="2024-01-05").select("id", "version_id", "last_updated")


@query("h_as_of", f"{_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_id DESC) AS r FROM d WHERE last_updated <= TIMESTAMP '2024-01-04') SELECT id, version_id, event FROM n WHERE r = 1 AND NOT deleted")
def h_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return history.as_of(MAKERS["AuditEvent"](spark, sf), "2024-01-04").select("id", "version_id", F.col("resource.event").alias("event"))


@query("h_current", f"{_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_id DESC) AS r FROM d) SELECT id, version_id, event FROM n WHERE r = 1 AND NOT deleted")
def h_current(spark: SparkSession, sf: str) -> DataFrame:
    return history.current(MAKERS["AuditEvent"](spark, sf)).select("id", "version_id", F.col("resource.event").alias("event"))


@query("h_append", f"{_VERSIONS}, l AS (SELECT id, max(version_id) AS m FROM d GROUP BY id) SELECT id, m + 1 AS version_id FROM l")
def h_append(spark: SparkSession, sf: str) -> DataFrame:
    versions = MAKERS["AuditEvent"](spark, sf)
    first = versions.filter("version_id = 1").withColumn("last_updated", F.lit("2030-01-01").cast("timestamp")).drop("version_id")
    return history.append(versions, first).filter("last_updated >= '2030-01-01'").select("id", "version_id")


@query("h_delete", f"{_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_id DESC) AS r FROM d) SELECT count(*) AS deleted FROM n WHERE r = 1 AND NOT deleted")
def h_delete(spark: SparkSession, sf: str) -> DataFrame:
    versions = MAKERS["AuditEvent"](spark, sf)
    after = history.delete(versions, versions.select("resource_type", "id"), F.lit("2031-01-01").cast("timestamp"))
    return after.filter("last_updated = '2031-01-01'").agg(F.count(F.lit(1)).alias("deleted"))


@query("h_conditional", "SELECT c_mktsegment AS request, CASE WHEN count(*) = 1 THEN 'update' ELSE 'fail' END AS action FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'none', 'create'")
def h_conditional(spark: SparkSession, sf: str) -> DataFrame:
    rows = MAKERS["Patient"](spark, sf).select("id", F.col("resource.segment.coding")[0]["code"].alias("request"))
    wanted = rows.select("request").distinct().unionByName(spark.range(1).select(F.lit("none").alias("request")))
    return history.conditional(rows, wanted).select("request", "action")


@query("h_system", f"{_VERSIONS} SELECT id, version_id, action FROM d WHERE last_updated <= TIMESTAMP '2024-01-10' UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, NULL FROM customer")
def h_system(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["resource_type", "id", "version_id", "last_updated"]
    events = MAKERS["AuditEvent"](spark, sf).select(*columns, F.col("resource.action").alias("action"))
    patients = MAKERS["Patient"](spark, sf).select(*columns, F.lit(None).cast("string").alias("action"))
    return history.history(events.unionByName(patients), at="2024-01-10").select("id", "version_id", "action")


@query("h_vread", f"{_VERSIONS} SELECT id, version_id, action, event FROM d WHERE id = '7' AND version_id = 3")
def h_vread(spark: SparkSession, sf: str) -> DataFrame:
    return history.read(MAKERS["AuditEvent"](spark, sf), "AuditEvent", "7", 3).select("id", "version_id", "resource.action", "resource.event")


@query("h_hard_delete", f"{_VERSIONS} SELECT id, version_id FROM d WHERE version_id > 1 AND id NOT IN (SELECT id FROM d WHERE version_id = 1 AND action = 'error')")
def h_hard_delete(spark: SparkSession, sf: str) -> DataFrame:
    """All versions of some resources are gone, and of the others the first."""
    versions = MAKERS["AuditEvent"](spark, sf)
    first = versions.filter("version_id = 1")
    left = history.hard_delete(versions, first.filter("resource.action = 'error'").select("resource_type", "id"))
    return history.hard_delete(left, first.select("resource_type", "id", "version_id")).select("id", "version_id")


@query("h_batch_order", "WITH e AS (SELECT conv_id AS bundle, turn AS position, CASE role WHEN 'user' THEN 'PUT' WHEN 'assistant' THEN 'GET' ELSE 'DELETE' END AS method FROM conversations) SELECT bundle, position, method, CAST(row_number() OVER (PARTITION BY bundle ORDER BY CASE method WHEN 'DELETE' THEN 0 WHEN 'PUT' THEN 2 ELSE 3 END, position) AS INTEGER) AS step FROM e")
def h_batch_order(spark: SparkSession, sf: str) -> DataFrame:
    method = F.when(F.col("role") == "user", "PUT").when(F.col("role") == "assistant", "GET").otherwise("DELETE")
    return history.order_entries(read(spark, sf, "conversations").select(F.col("conv_id").alias("bundle"), F.col("turn").alias("position"), method.alias("method")))


@query("h_rewrite", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN c_acctbal >= 0 THEN 'Patient/new-' ELSE 'Patient/' END || o_custkey AS reference FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def h_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    names = MAKERS["Patient"](spark, sf).filter("resource.active").select(F.concat(F.lit("Patient/"), "id").alias("full_url"), F.concat(F.lit("Patient/new-"), "id").alias("assigned"))
    return history.rewrite_references(MAKERS["Encounter"](spark, sf).select("id", F.col("resource.subject.reference").alias("reference")), names)


@query("r_type_stats", f"{_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version_id DESC) AS r FROM d) SELECT 'AuditEvent' AS resource_type, count(*) AS versions, count(DISTINCT id) AS ids, count(*) FILTER (WHERE r = 1 AND NOT deleted) AS current, count(*) FILTER (WHERE deleted) AS deletions, max(last_updated) AS latest FROM n")
def r_type_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.type_stats(MAKERS["AuditEvent"](spark, sf))


@query("r_index_coverage", "SELECT 'partof' AS parameter_name, (SELECT count(*) FROM nation) AS indexed, (SELECT count(*) FROM nation) AS entries, (SELECT count(*) FROM region) AS missing")
def r_index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    df = MAKERS["Location"](spark, sf)
    return reports.index_coverage(df, indexing.shred(df, [Catalog.default().params["Location", "partof"]]), ["partof"])


@query("r_dup_hashes", "SELECT md5(c_mktsegment) AS entry_hash, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def r_dup_hashes(spark: SparkSession, sf: str) -> DataFrame:
    df = MAKERS["Patient"](spark, sf)
    return reports.duplicate_hashes(indexing.shred(df, [Catalog.default().params["Patient", "segment"]]), ["code"])


@query("r_ref_integrity", f"SELECT {_OBS}, CAST(l_orderkey AS VARCHAR) AS target_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def r_ref_integrity(spark: SparkSession, sf: str) -> DataFrame:
    refs = indexing.shred(MAKERS["Observation"](spark, sf), [Catalog.default().params["Observation", "encounter"]])
    known = MAKERS["Encounter"](spark, sf).filter("resource.status <> 'P'")
    return reports.dangling_references(refs, known).select("id", "target_id")


@query("r_referencing", "SELECT 'Encounter' AS resource_type, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey = 3")
def r_referencing(spark: SparkSession, sf: str) -> DataFrame:
    refs = indexing.shred(MAKERS["Encounter"](spark, sf), [Catalog.default().params["Encounter", "subject"]])
    return reports.referencing(refs, "Patient", "3").select("resource_type", "id")


@query("r_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def r_top_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_groups(read(spark, sf, "events"), "user_id", 5)


@query("r_job_stats", "SELECT event_type AS kind, count(*) AS jobs, count(*) FILTER (WHERE value > 50) AS done, count(*) FILTER (WHERE value <= 50) AS failed, avg(CASE WHEN value > 50 THEN 60.0 END) AS mean_seconds FROM events GROUP BY event_type")
def r_job_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return reports.job_stats(e.select(F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "done").otherwise("failed").alias("status"), F.col("ts").alias("started"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("finished")))


# terminology

_TYPES = "t(code, parent) AS (VALUES ('PROMO', 'ANY'), ('ECONOMY', 'ANY'), ('STANDARD', 'ANY'), ('SIZE', 'ANY'), ('LARGE', 'SIZE'), ('MEDIUM', 'SIZE'), ('SMALL', 'SIZE'), ('ECONOMY', 'SMALL'))"
_UP = f"WITH RECURSIVE {_TYPES}, u(child, parent) AS (SELECT code, parent FROM t UNION SELECT u.child, t.parent FROM u JOIN t ON u.parent = t.code)"


@query("t_expand_filter", "SELECT code, display FROM (VALUES ('SMALL', 'Small'), ('SIZE', 'Size')) AS v(code, display)")
def t_expand_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).expand("sizes", text="s", active_only=True).select("code", "display")


@query("t_expand_isa", f"{_UP} SELECT child AS code FROM u WHERE parent = 'SIZE' UNION ALL SELECT 'SIZE'")
def t_expand_isa(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).expansion("sizes").select("code")


@query("t_compose_exclude", f"WITH {_TYPES} SELECT DISTINCT code FROM t WHERE code NOT IN ('ANY', 'PROMO')")
def t_compose_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).expansion("plain").select("code")


@query("t_expand_nested", f"{_UP} SELECT child AS code FROM u WHERE parent = 'SIZE' UNION SELECT 'SIZE' UNION SELECT 'PROMO'")
def t_expand_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).expansion("nested").select("code")


@query("t_expand_property", "SELECT unnest(['PROMO', 'ECONOMY', 'STANDARD', 'SIZE']) AS code")
def t_expand_property(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).expansion("grades").select("code")


def _part_codes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.lit("urn:type").alias("system"), F.col("p_type").alias("code"))


@query("t_lookup", "SELECT p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS display, TRUE AS found FROM part")
def t_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).lookup(_part_codes(spark, sf)).select("p_partkey", "display", "found")


@query("t_validate_code", f"SELECT p_partkey, p_type IN {_BELOW_SIZE} AS result, CASE WHEN p_type NOT IN {_BELOW_SIZE} THEN 'unknown code' END AS message FROM part")
def t_validate_code(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).validate_code(_part_codes(spark, sf), "sizes").select("p_partkey", "result", "message")


@query("t_subsumes", f"{_UP} SELECT DISTINCT p_type AS a, 'SIZE' AS b, CASE WHEN p_type = 'SIZE' THEN 'equivalent' WHEN EXISTS (SELECT 1 FROM u WHERE child = 'SIZE' AND parent = p_type) THEN 'subsumes' WHEN EXISTS (SELECT 1 FROM u WHERE child = p_type AND parent = 'SIZE') THEN 'subsumed-by' ELSE 'not-subsumed' END AS outcome FROM part")
def t_subsumes(spark: SparkSession, sf: str) -> DataFrame:
    pairs = read(spark, sf, "part").select(F.lit("urn:type").alias("system"), F.col("p_type").alias("a"), F.lit("SIZE").alias("b")).distinct()
    return _terminology(spark).subsumes(pairs).select("a", "b", "outcome")


_MAP = "m(code, target_code, equivalence) AS (VALUES ('PROMO', 'P1', 'equivalent'), ('LARGE', 'L', 'wider'), ('SMALL', 'S', 'unmatched'), ('LARGE', 'XL', 'narrower'))"


@query("t_translate", f"WITH {_MAP} SELECT p_partkey, target_code, target_code IS NOT NULL AND coalesce(equivalence, '') <> 'unmatched' AS result FROM part LEFT JOIN m ON p_type = code")
def t_translate(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).translate(_part_codes(spark, sf)).select("p_partkey", "target_code", "result")


@query("t_translate_reverse", "SELECT * FROM (VALUES ('P1', 'PROMO', TRUE), ('S', 'SMALL', FALSE), ('Q', NULL, FALSE)) AS v(code, target_code, result)")
def t_translate_reverse(spark: SparkSession, sf: str) -> DataFrame:
    codes = spark.createDataFrame([("urn:new", "P1"), ("urn:new", "S"), ("urn:new", "Q")], "system string, code string")
    return _terminology(spark).translate(codes, reverse=True).select("code", "target_code", "result")


@query("t_closure", f"{_UP} SELECT child, parent FROM u")
def t_closure(spark: SparkSession, sf: str) -> DataFrame:
    return _terminology(spark).closure_pairs().select("child", "parent")


@query("t_closure_delta", "SELECT * FROM (VALUES ('LARGE', 'ANY', 2), ('ECONOMY', 'ANY', 2)) AS v(child, parent, version)")
def t_closure_delta(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame([("urn:type", "LARGE", 1), ("urn:type", "ECONOMY", 1), ("urn:type", "ANY", 2)], "system string, code string, version int")
    return _terminology(spark).closure_delta(members, since=1).select("child", "parent", "version")


@query("x_hierarchy_depth", "WITH RECURSIVE e AS (SELECT 'nation-' || n_nationkey AS c, 'region-' || n_regionkey AS p FROM nation) SELECT c AS child, p AS parent, 1 AS depth FROM e")
def x_hierarchy_depth(spark: SparkSession, sf: str) -> DataFrame:
    rows = indexing.shred(MAKERS["Location"](spark, sf), [Catalog.default().params["Location", "partof"]])
    return hierarchy.closure(rows.select(F.col("id").alias("child"), F.col("target_id").alias("parent")))


# units and validation


@query("u_convert", f"SELECT {_OBS}, round(l_quantity / 1000, 6) AS grams, round(l_quantity * 1000, 3) AS micrograms FROM lineitem")
def u_convert(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities converted by a join with the factors of their units."""
    rows = indexing.shred(MAKERS["Observation"](spark, sf), [Catalog.default().params["Observation", "value-quantity"]])
    table = spark.createDataFrame([(u, float(f), d) for u, f, _, d in units.factor_table(["mg", "g", "ug", "kg"])], "code string, factor double, dims string")
    to = {u: f for u, f, _, _ in units.factor_table(["g", "ug"])}
    out = rows.join(F.broadcast(table), "code")  # as many rows as distinct units in the table above
    return out.select("id", F.round(F.col("value") * F.col("factor") / float(to["g"]), 6).alias("grams"), F.round(F.col("value") * F.col("factor") / float(to["ug"]), 3).alias("micrograms"))


@query("u_compare", f"SELECT {_OBS} FROM lineitem WHERE l_quantity > 20")
def u_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities above 0.02 g, whatever their unit."""
    rows = indexing.shred(MAKERS["Observation"](spark, sf), [Catalog.default().params["Observation", "value-quantity"]])
    table = spark.createDataFrame([(u, float(f)) for u, f, _, _ in units.factor_table(["mg", "g", "ug", "kg"])], "code string, factor double")
    return rows.join(F.broadcast(table), "code").filter(F.round(F.col("value") * F.col("factor"), 9) > 0.02).select("id")


def _profile() -> Profile:
    return Profile(
        elements=[Element("name.given", 1, 1), Element("segment.coding.code", 1, binding=("segments", "required")), Element("name.text", type="code", max_length=18), Element("segment.coding.system", fixed="urn:segment")],
        invariants=[Invariant("bal-1", "", "balance >= 0 or active.not()"), Invariant("bal-2", "", "balance < 9000", "warning")],
        slices=[Slice("building", "segment.coding", "code", "BUILDING", max=0)],
    )


@query("v_invariant", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'warning' AS severity, 'bal-2' AS message FROM customer WHERE c_acctbal >= 9000")
def v_invariant(spark: SparkSession, sf: str) -> DataFrame:
    issues = validate(MAKERS["Patient"](spark, sf), _profile(), "authoring")
    return issues.filter("code = 'invariant'").select("id", "severity", "message")


@query("v_cardinality", "SELECT 'region-' || r_regionkey AS id, 'required' AS code, 'partOf' AS path FROM region")
def v_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return validate(MAKERS["Location"](spark, sf), Profile(elements=[Element("partOf", 1, 1), Element("name", 1)]), "ingestion").select("id", "code", "path")


@query("v_slicing", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'segment.coding:building' AS path FROM customer WHERE c_mktsegment = 'BUILDING'")
def v_slicing(spark: SparkSession, sf: str) -> DataFrame:
    issues = validate(MAKERS["Patient"](spark, sf), _profile(), "server")
    return issues.filter("path LIKE 'segment.coding:%'").select("id", "path")


@query("v_binding", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'error' AS severity, 'not in the value set: ' || c_mktsegment AS message FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")
def v_binding(spark: SparkSession, sf: str) -> DataFrame:
    codes = spark.createDataFrame([("BUILDING",), ("FURNITURE",)], "code string")
    issues = validate(MAKERS["Patient"](spark, sf), _profile(), "server", {"segments": codes})
    return issues.filter("code = 'code-invalid'").select("id", "severity", "message")


@query("v_binding_system", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment <> 'FURNITURE'")
def v_binding_system(spark: SparkSession, sf: str) -> DataFrame:
    """A code of another system is not in the value set, whatever its name."""
    codes = spark.createDataFrame([("urn:other", "BUILDING"), ("urn:segment", "FURNITURE")], "system string, code string")
    profile = Profile(elements=[Element("segment.coding", 1, binding=("segments", "required"))])
    return validate(MAKERS["Patient"](spark, sf), profile, "server", {"segments": codes}).filter("code = 'code-invalid'").select("id")


@query("v_references", f"SELECT {_OBS}, 'unknown: Encounter/' || l_orderkey AS message FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def v_references(spark: SparkSession, sf: str) -> DataFrame:
    targets = MAKERS["Encounter"](spark, sf).filter("resource.status = 'F'").select("resource_type", "id")
    return validate(MAKERS["Observation"](spark, sf), Profile(), "publication", targets=targets, references=["encounter"]).select("id", "message")


# streaming (one micro-batch over the table, which a file stream would read in pieces)


@query("st_activity", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_activity(spark: SparkSession, sf: str) -> DataFrame:
    from sparkclin.streaming.index_stream import activity

    return activity(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("st_file_stream_index", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS code FROM customer")
def st_file_stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """Patients written as files, read as a stream, versioned and indexed by micro-batches."""
    import uuid

    from sparkclin.operators.hierarchy import _shared
    from sparkclin.streaming.index_stream import ROWS, maintain, read_index, read_stream

    folder = f"{_shared(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = MAKERS["Patient"](spark, sf)
    source.write.option("maxRecordsPerFile", ROWS).parquet(f"{folder}/in")
    stream = read_stream(spark, f"{folder}/in", source.schema)
    maintain(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return read_index(spark, f"{folder}/out", "token").filter("parameter_name = 'segment'").select("id", "code")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters of patients of one segment with a balance: a chained search, sorted."""
    search = Search(Store.from_tables(spark, sf_dir, "Encounter", "Patient"))
    return search.page("Encounter?subject:Patient.segment=BUILDING&subject.balance=gt1000&date=ge1997&_sort=-total&_count=50").select("id", F.col("resource.total").alias("total"))


__all__ = ["QUERIES", "SQL", "entry", "tables"]
