"""Sources, projections, cleaning, and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import names, relate
from ..sources import nested, tables
from .registry import ALTERNATIVES_SQL, R4, SALES_SQL, alternatives, query, r4, sales, table

ACC, PLN = clean.ACCENTED, clean.PLAIN
FOLD = f"regexp_replace(translate(replace(lower({{0}}), 'ß', 'ss'), '{ACC}', '{PLN}'), '[^\\x00-\\x7F]', '', 'g')"


@query("s2_parquet_read", "SELECT n_nationkey, n_name FROM nation")
def s2(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name")


@query("s5_prefix_box_scan", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey BETWEEN 5 AND 20 AND (starts_with(s_name, 'Supplier') OR starts_with(s_name, 'S'))")
def s5(spark, d):
    return tables.box_prefix_scan(table(spark, d, "supplier"), {"s_acctbal": (0, 5000), "s_nationkey": (5, 20)}, "s_name", ("Supplier", "S")).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("s6_box_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 900 AND c_nationkey BETWEEN 0 AND 12")
def s6(spark, d):
    return tables.box_prefix_scan(table(spark, d, "customer"), {"c_acctbal": (100, 900), "c_nationkey": (0, 12)}).select("c_custkey", "c_acctbal")


@query("s7_key_list_scan", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def s7(spark, d):
    keys = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return tables.upper_names(tables.by_keys(table(spark, d, "customer"), keys, "c_nationkey").select("c_custkey", "c_name"))


@query("s8_anchor_lookup", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def s8(spark, d):
    return table(spark, d, "nation").where("n_nationkey = 7").select("n_nationkey", "n_name")


@query("s13_request_batches", "SELECT CAST((row_number() OVER (ORDER BY c_name) - 1) // 100 AS BIGINT) AS batch, c_name FROM (SELECT DISTINCT c_name FROM customer)")
def s13(spark, d):
    return tables.request_batches(table(spark, d, "customer"), "c_name", 100).select("batch", F.explode("items").alias("c_name"))


@query("s14_profile", "SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT o_orderkey) AS n_keys, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date, " + R4("1 - count(o_orderpriority) / count(*)") + " AS null_share FROM orders")
def s14(spark, d):
    p = tables.profile(table(spark, d, "orders"), key="o_orderkey", date="o_orderdate", column="o_orderpriority")
    return p.withColumn("null_share", r4(F.col("null_share")))


@query("s12_json_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s12(spark, d):
    return tables.parsed(table(spark, d, "events"), "props", "k long").select("event_id", "props.k")


@query("p1_rename_select", "SELECT obs_id, purchase_date, price AS operation_value FROM " + SALES_SQL)
def p1(spark, d):
    return sales(spark, d).withColumnsRenamed({"price": "operation_value"}).drop("alt_id", "agency", "category")


@query("p2_tolerant_cast", "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no, TRY_CAST(p_name AS INTEGER) AS name_no FROM part")
def p2(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("brand_no"), F.col("p_name").try_cast("int").alias("name_no"))


@query("p3_excel_date", "SELECT p_partkey, CAST(DATE '1899-12-30' + CAST(36000 + p_partkey % 9000 AS INTEGER) AS DATE) AS day FROM part")
def p3(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.excel_date(36000 + F.col("p_partkey") % 9000).alias("day"))


@query("p4_yes_flag", "SELECT p_partkey, CASE WHEN lower(f) = 'sí' THEN 1 ELSE 0 END AS flag, CAST(lower(f) = 'sí' AS INTEGER) AS strict_flag FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SÍ' WHEN 1 THEN 'no' END AS f FROM part)")
def p4(spark, d):
    said = F.when(F.col("p_partkey") % 3 == 0, "SÍ").when(F.col("p_partkey") % 3 == 1, "no")
    return table(spark, d, "part").select("p_partkey", clean.yes_flag(said).alias("flag"), clean.yes_flag(said, strict=True).alias("strict_flag"))


@query("p5_normalize_address", "SELECT doc_id, trim(replace(regexp_replace(" + FOLD.format("'Fraccionamiento ' || text") + ", 'fracc(\\.|ionamiento)?', '', 'g'), 'desarrollo urbano', ''), ' ') AS address FROM documents")
def p5(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.normalize_address(F.concat(F.lit("Fraccionamiento "), F.col("text"))).alias("address"))


@query("p6_canonical_variant", "SELECT c_custkey, coalesce(v.b, c_mktsegment) AS segment FROM customer LEFT JOIN (VALUES ('BUILDING', 'CONSTRUCTION'), ('AUTOMOBILE', 'VEHICLES')) v(a, b) ON c_mktsegment = v.a")
def p6(spark, d):
    mapping = spark.createDataFrame([("BUILDING", "CONSTRUCTION"), ("AUTOMOBILE", "VEHICLES")], "variant string, canonical string")
    return tables.canonical(table(spark, d, "customer"), "c_mktsegment", mapping).select("c_custkey", F.col("c_mktsegment").alias("segment"))


@query("p7_prefix_collapse", "SELECT p_partkey, CASE WHEN starts_with(p_type, 'S') THEN 'S' ELSE p_type END AS p_type FROM part")
def p7(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.collapse_prefix(F.col("p_type"), "S").alias("p_type"))


_NAME_SQL = "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'FRACC ' WHEN 1 THEN 'FRACCIONAMIENTO ' WHEN 2 THEN 'COLONIA ' ELSE 'FRACTO PORTICOS ' END || upper(p_name) || ' ' AS f FROM part)"


def _names(spark, d):
    k = F.col("p_partkey") % 4
    head = F.when(k == 0, "FRACC ").when(k == 1, "FRACCIONAMIENTO ").when(k == 2, "COLONIA ").otherwise("FRACTO PORTICOS ")
    return table(spark, d, "part").select("p_partkey", F.concat(head, F.upper("p_name"), F.lit(" ")).alias("f"))


@query("p8_subdivision_rules", f"SELECT p_partkey, rtrim(CASE WHEN contains(f, 'PORTICOS') THEN 'PORTICOS DEL VALLE' WHEN starts_with(f, 'FRAC') THEN replace(replace(f, 'FRACC ', ''), 'FRACCIONAMIENTO ', '') ELSE f END) AS subdivision FROM {_NAME_SQL}")
def p8(spark, d):
    rules = [("contains", "PORTICOS", "PORTICOS DEL VALLE"), ("prefix", "FRAC", {"FRACC ": "", "FRACCIONAMIENTO ": ""})]
    return _names(spark, d).select("p_partkey", clean.rewrite(F.col("f"), rules).alias("subdivision"))


@query("p9_subdivision_synonyms", f"SELECT p_partkey, lower(trim(replace(regexp_replace(f, '^(FRACC|FRACTO|FRACCIONAMIENTO) ', ''), 'COLONIA', 'COL'))) AS subdivision FROM {_NAME_SQL}")
def p9(spark, d):
    body = F.regexp_replace("f", "^(FRACC|FRACTO|FRACCIONAMIENTO) ", "")
    return _names(spark, d).select("p_partkey", F.lower(F.trim(F.replace(body, F.lit("COLONIA"), F.lit("COL")))).alias("subdivision"))


# Names of every form that the rules know, on the parts.
_FORMS = ("FRACC VILLA ", "FRACCTO ", "FRACCIONAMIENTO VILLANOVA ", "SECTOR PORTICOS DEL VALLE ", "COLONIA BALBUENA DE MEXICALI BC DENTRO DE LA ", "LA RIOJA CASTILLAUNA ", "GRAN FORESTA", "FRACTO FORESTA LIFE")
_FORMS_SQL = "(SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" + (" || upper(p_name)" if i < 6 else "") for i, w in enumerate(_FORMS)) + " END AS f FROM part)"
_VALLE_SQL = "(SELECT p_partkey, regexp_replace(regexp_replace(f, '^FRACCIONAMIENTO VILLANOVA.*', 'VILLANOVA'), '.*PORTICOS DEL VALLE.*', 'PORTICOS DEL VALLE') AS f FROM " + _FORMS_SQL + ")"
_LABEL_SQL = "(SELECT p_partkey, CASE WHEN starts_with(f, 'FRAC') THEN trim(replace(replace(replace(replace(f, 'FRACCIONAMIENTO', ''), 'FRACCTO', ''), 'FRACTO', ''), 'FRACC', '')) ELSE f END AS f FROM " + _VALLE_SQL + ")"
_PLACE_SQL = "(SELECT p_partkey, lower(trim(CASE WHEN starts_with(f, 'COLONIA BALBUENA') THEN replace(f, 'DE MEXICALI BC DENTRO DE LA', '') WHEN starts_with(f, 'LA RIOJA') THEN replace(f, 'CASTILLAUNA', 'CASTILLA') ELSE f END)) AS f FROM " + _LABEL_SQL + ")"


@query("p9_rule_table", f"SELECT p_partkey, CASE WHEN f IN ('gran foresta', 'foresta life') THEN 'foresta residencial' ELSE f END AS subdivision FROM {_PLACE_SQL}")
def p9_rules(spark, d):
    k, form = F.col("p_partkey") % 8, None
    for i, words in enumerate(_FORMS):
        name = F.concat(F.lit(words), F.upper("p_name")) if i < 6 else F.lit(words)
        form = F.when(k == i, name) if form is None else form.when(k == i, name)
    return names.subdivisions(table(spark, d, "part").select("p_partkey", form.alias("subdivision")), "subdivision")


@query("p10_section", f"SELECT p_partkey, CASE WHEN starts_with(f, 'COLONIA') THEN replace(f, 'COLONIA ', '') WHEN starts_with(f, 'FRACTO') THEN replace(f, 'FRACTO PORTICOS', 'PORTICOS') END AS section FROM {_NAME_SQL}")
def p10(spark, d):
    return _names(spark, d).select("p_partkey", clean.section_of(F.col("f"), [("COLONIA", {"COLONIA ": ""}), ("FRACTO", {"FRACTO PORTICOS": "PORTICOS"})]).alias("section"))


@query("p11_remove_label", "SELECT c_custkey, replace(c_name, 'Customer#', '') AS name FROM customer")
def p11(spark, d):
    return table(spark, d, "customer").select("c_custkey", clean.remove_label(F.col("c_name"), "Customer#").alias("name"))


@query("p12_category_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL")
def p12(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).dropna(subset=["o_orderdate"]).select("o_orderkey")


@query("p13_not_like", "SELECT p_partkey FROM part WHERE nullif(p_type, 'STANDARD') NOT LIKE '%A%' AND p_size <> 5")
def p13(spark, d):
    return table(spark, d, "part").where(~F.nullif(F.col("p_type"), F.lit("STANDARD")).contains("A") & (F.col("p_size") != 5)).select("p_partkey")


@query("p14_fill_coordinates", "SELECT alt_id, coalesce(a.x2, v.x) AS x, CASE WHEN a.x2 IS NULL THEN v.y ELSE a.y END AS y FROM (SELECT *, CASE WHEN alt_id % 5 = 0 THEN NULL ELSE x END AS x2 FROM " + ALTERNATIVES_SQL + ") a LEFT JOIN (SELECT n_name, CAST(n_regionkey AS DOUBLE) AS x, CAST(n_nationkey AS DOUBLE) AS y FROM nation) v ON a.name_detail = v.n_name")
def p14(spark, d):
    a = alternatives(spark, d).select("alt_id", "name_detail", F.when(F.col("alt_id") % 5 != 0, F.col("x")).alias("x"), "y")
    v = table(spark, d, "nation").select(F.col("n_name").alias("name_detail"), F.col("n_regionkey").cast("double").alias("x"), F.col("n_nationkey").cast("double").alias("y"))
    return tables.fill_where_null(a, v, "name_detail", test="x", columns=["x", "y"]).select("alt_id", "x", "y")


@query("p15_coalesce_fill", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, p_brand) AS label FROM part")
def p15(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_brand")).alias("label"))


@query("p16_one_per_key", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def p16(spark, d):
    return tables.first_per_key(table(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("p17_year_range", "SELECT obs_id, CAST(year(purchase_date) AS INTEGER) AS purchase_year FROM " + SALES_SQL + " WHERE year(purchase_date) BETWEEN 1996 AND 1998")
def p17(spark, d):
    return sales(spark, d).withColumn("purchase_year", F.year("purchase_date")).where(F.col("purchase_year").between(1996, 1998)).select("obs_id", "purchase_year")


_CODE_SQL = "substr('31234643621462244611126111561135712517139146411512134812', 1 + CAST(c_custkey % 50 AS INTEGER), 5)"
_SIZE_SQL = "CASE c_custkey % 5 WHEN 0 THEN '0 a 5 personas' WHEN 1 THEN '11 a 30 personas' WHEN 2 THEN '101 a 250 personas' WHEN 3 THEN '251 y más personas' ELSE 'unknown' END"


def establishments(spark, d):
    k = F.col("c_custkey")
    size = F.when(k % 5 == 0, "0 a 5 personas").when(k % 5 == 1, "11 a 30 personas").when(k % 5 == 2, "101 a 250 personas").when(k % 5 == 3, "251 y más personas").otherwise("unknown")
    code = F.substr(F.lit("31234643621462244611126111561135712517139146411512134812"), (k % 50 + 1).cast("int"), F.lit(5))
    return table(spark, d, "customer").select(k.alias("id"), code.alias("code"), size.alias("size_class"), F.col("c_acctbal").alias("area"))


@query("p18_workers", f"SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN 175 WHEN 3 THEN 500 END AS workers FROM customer")
def p18(spark, d):
    return establishments(spark, d).select("id", clean.workers(F.col("size_class")).alias("workers"))


_SECTOR_VALUES = ", ".join(f"('{name}', '{p}')" for name, _, ps in clean.SECTORS for p in ps)


@query("p19_sectors", f"SELECT sector, count(*) AS n FROM (SELECT {_CODE_SQL} AS code FROM customer) JOIN (VALUES {_SECTOR_VALUES}) v(sector, p) ON substr(code, 1, 2) = p GROUP BY sector")
def p19(spark, d):
    return tables.with_sector(establishments(spark, d), "code").groupBy("sector").agg(F.count("*").alias("n"))


_AMENITY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(code, '{p}') THEN '{n}'" for n, p in reversed(clean.AMENITIES)) + " END"


@query("p20_amenities", f"SELECT id, {_AMENITY_SQL} AS amenity FROM (SELECT c_custkey AS id, {_CODE_SQL} AS code FROM customer) WHERE {_AMENITY_SQL} IS NOT NULL")
def p20(spark, d):
    return establishments(spark, d).select("id", clean.classify(F.col("code")).alias("amenity")).where("amenity is not null")


_FORMULA_SQL = "CASE " + " ".join(f"WHEN amenity = '{k}' THEN CAST({v[0]} AS DOUBLE)" for k, v in clean.ATTRACTION.items()) + " END"


@query("p21_attraction", f"SELECT id, {R4(_FORMULA_SQL)} AS attraction FROM (SELECT id, area, {_AMENITY_SQL} AS amenity, num_workers FROM (SELECT c_custkey AS id, c_acctbal AS area, {_CODE_SQL} AS code, CAST(CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN 175 WHEN 3 THEN 500 END AS DOUBLE) AS num_workers FROM customer)) WHERE amenity IS NOT NULL")
def p21(spark, d):
    e = establishments(spark, d).withColumns({"amenity": clean.classify(F.col("code")), "num_workers": clean.workers(F.col("size_class")).cast("double")}).where("amenity is not null")
    return e.select("id", r4(clean.formula_by_type(F.col("amenity"), {k: v[0] for k, v in clean.ATTRACTION.items()}).cast("double")).alias("attraction"))


@query("p22_binary_access", "SELECT alt_id, CASE access WHEN 'LIBRE' THEN 0 WHEN 'RESTRINGIDO' THEN 1 END AS access_is_restricted FROM " + ALTERNATIVES_SQL)
def p22(spark, d):
    return alternatives(spark, d).select("alt_id", clean.restricted(F.col("access")).alias("access_is_restricted"))


@query("p23_park_filter", "SELECT p_partkey, 'Parques recreativos' AS kind, p_retailprice AS area FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11', 'Brand#12')")
def p23(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12")).select("p_partkey", F.lit("Parques recreativos").alias("kind"), F.col("p_retailprice").alias("area"))


@query("p24_area_or_polygon", "SELECT p_partkey, unnest(range(1, 3)) AS part_no FROM part WHERE (p_type = 'STANDARD' OR p_size > 25) AND p_retailprice > 0")
def p24(spark, d):
    parts = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long")))
    return table(spark, d, "part").where(((F.col("p_type") == "STANDARD") | (F.col("p_size") > 25)) & (F.col("p_retailprice") > 0)).select("p_partkey", parts.alias("part_no"))


@query("p25_harmonize_names", "SELECT regexp_extract(p_name, '^([a-zA-Z]+)', 1) AS name, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1")
def p25(spark, d):
    return table(spark, d, "part").groupBy(F.regexp_extract("p_name", "^([a-zA-Z]+)", 1).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("p26_safe_identifier", r"SELECT page_id, CASE WHEN b = '' THEN 'unnamed' WHEN regexp_matches(b, '^[0-9]') THEN 'v_' || b ELSE b END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM pages)")
def p26(spark, d):
    return table(spark, d, "pages").select("page_id", clean.safe_identifier(F.col("url")).alias("name"))


@query("p27_drop_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def p27(spark, d):
    return tables.drop_matching(table(spark, d, "customer"), r"c_(nation|mkt)")


@query("p28_mean_impute", "SELECT p_partkey, " + R4("coalesce(CASE WHEN p_size > 10 THEN p_retailprice END, avg(CASE WHEN p_size > 10 THEN p_retailprice END) OVER ()) / 1000") + " AS price FROM part")
def p28(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    return tables.impute_means(parts, ["price"]).select("p_partkey", r4(F.col("price") / 1000).alias("price"))


@query("p29_merge_rows", "SELECT coalesce(t, n_name) AS name, count(*) AS parts, min(n_nationkey) AS first_key FROM nation LEFT JOIN (VALUES (0, 'MERGED NORTH'), (3, 'MERGED SOUTH')) v(r, t) ON n_regionkey = r GROUP BY 1")
def p29(spark, d):
    rules = spark.createDataFrame([(0, "MERGED NORTH"), (3, "MERGED SOUTH")], "n_regionkey int, target string")
    joined = table(spark, d, "nation").join(F.broadcast(rules), "n_regionkey", "left")
    return joined.groupBy(F.coalesce("target", "n_name").alias("name")).agg(F.count("*").alias("parts"), F.min("n_nationkey").alias("first_key"))


@query("p30_membership_flag", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_supplier FROM nation")
def p30(spark, d):
    return tables.with_membership(table(spark, d, "nation"), "n_nationkey", table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "has_supplier").select("n_nationkey", "has_supplier")


@query("p31_nested_flatten", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL")
def p31(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'")
    results = e.select("event_id", "event_type", F.explode(F.array(F.from_json("props", "k long"))).alias("result"))
    return results.select("event_id", "event_type", "result.*").where("k is not null")


_LINES_SQL = "SELECT o_orderkey AS body_id, o_orderstatus AS head_status, o_orderpriority AS priority, l_linenumber AS number, l_partkey AS part_id, t.kind AS kind, t.v AS value, l_linestatus AS lines_status FROM orders JOIN lineitem ON o_orderkey = l_orderkey CROSS JOIN LATERAL (VALUES ('discount', l_discount), ('tax', l_tax)) t(kind, v)"


@query("p31_flatten_by_schema", _LINES_SQL)
def p31_schema(spark, d):
    c = F.col
    rates = F.array(*[F.struct(F.lit(k).alias("kind"), c(f"l_{k}").alias("value")) for k in ("discount", "tax")])
    line = F.struct(c("l_linenumber").alias("number"), F.struct(c("l_partkey").alias("id")).alias("part"), c("l_linestatus").alias("status"), rates.alias("rates"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))  # the lines of one order
    head = F.struct(c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority")).alias("head")
    texts = table(spark, d, "orders").join(lines, c("o_orderkey") == c("l_orderkey")).select(F.to_json(F.struct(c("o_orderkey").alias("id"), head, "lines")).alias("body"))
    schema = "id long, head struct<status string, priority string>, lines array<struct<number long, part struct<id long>, status string, rates array<struct<kind string, value double>>>>"
    return nested.flatten(texts.select(F.from_json("body", schema).alias("body")))


@query("p32_string_scalars", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, replace(trim(' ' || p_brand || ' '), '#', '-') AS b, starts_with(p_name, 'p') AS s, p_brand LIKE '%1%' AS k, concat(p_brand, '/', p_type) AS c FROM part")
def p32(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.replace(F.trim(F.concat(F.lit(" "), c("p_brand"), F.lit(" "))), F.lit("#"), F.lit("-")).alias("b"), c("p_name").startswith("p").alias("s"), c("p_brand").like("%1%").alias("k"), F.concat("p_brand", F.lit("/"), "p_type").alias("c"))


@query("p33_numeric_scalars", "SELECT p_partkey, abs(p_size - 25) AS a, " + R4("ln(1 + p_retailprice)") + " AS l, " + R4("exp(-p_size / 10.0)") + " AS e, " + R4("sqrt(p_retailprice)") + " AS s, least(p_size, 30) AS m, greatest(5, least(p_size, 30)) AS c, CAST(floor(p_retailprice / 100) AS BIGINT) AS f, " + R4("log10(p_retailprice)") + " AS g FROM part")
def p33(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.abs(s - 25).alias("a"), r4(F.log1p(p)).alias("l"), r4(F.exp(-s / 10.0)).alias("e"), r4(F.sqrt(p)).alias("s"), F.least(s, F.lit(30)).alias("m"), F.greatest(F.lit(5), F.least(s, F.lit(30))).alias("c"), F.floor(p / 100).alias("f"), r4(F.log10(p)).alias("g"))


@query("p34_evidence_labels", "SELECT p_partkey, CASE WHEN p < 0.01 THEN 'strong' WHEN p < 0.05 THEN 'moderate' WHEN p < 0.1 THEN 'weak' ELSE 'none' END || ' ' || CASE WHEN b > 0 THEN 'positive' WHEN b < 0 THEN 'negative' ELSE 'zero' END AS label FROM (SELECT p_partkey, p_size - 25 AS b, (p_partkey % 40) / 200.0 AS p FROM part)")
def p34(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.evidence(F.col("p_size") - 25, (F.col("p_partkey") % 40) / 200.0).alias("label"))


@query("j7_key_difference", "SELECT key, 'left' AS side FROM (SELECT DISTINCT c_nationkey AS key FROM customer WHERE c_nationkey % 3 <> 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 4 <> 0) UNION ALL SELECT key, 'right' FROM (SELECT DISTINCT s_nationkey AS key FROM supplier WHERE s_nationkey % 4 <> 0 EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey % 3 <> 0)")
def j7(spark, d):
    a = table(spark, d, "customer").where("c_nationkey % 3 <> 0").select(F.col("c_nationkey").alias("key"))
    b = table(spark, d, "supplier").where("s_nationkey % 4 <> 0").select(F.col("s_nationkey").alias("key"))
    return relate.key_difference(a, b, "key")
