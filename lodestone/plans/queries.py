"""Every query of the library's own operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import urls, xml
from lodestone.operators import relational as R
from lodestone.operators import weights as WT
from lodestone.sources.tables import Tables, random_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
STOP = ["www", "com", "org", "net", "html", "index", "the", "and"]


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, label (quality 1: +1, 0: -1, none: 0), text of documents.

    Texts are dealt by doc_id, as the weights need them, and meet their labels there. The hint is needed: labels are so small on
    disk that Spark would broadcast millions of them, once for each time that documents are read.
    """
    label = F.coalesce(F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1), F.lit(0))
    labels = t(spark, d, "labels").select("doc_id", "quality").hint("shuffle_hash")
    rows = t(spark, d, "documents").select("doc_id", "text").repartition("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", label.alias("label"), "text")


def words() -> Column:
    """Tokens of lower-cased texts."""
    return F.split(F.lower("text"), r"[ \n\t\r]+")


DOCS = """docs AS (SELECT doc_id, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END::INT AS label,
  list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '') AS tokens FROM documents LEFT JOIN labels USING (doc_id)),
counts AS (SELECT doc_id, label, feature, count(*) AS n FROM (SELECT doc_id, label, unnest(tokens) AS feature FROM docs) GROUP BY ALL),
df AS (SELECT feature, count(*) AS df FROM counts WHERE label <> 0 GROUP BY feature),
tf AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS tf FROM counts),
vocab AS (SELECT feature, df, row_number() OVER (ORDER BY feature)::INT AS idx FROM df WHERE df > 1),
nd AS (SELECT count(*) AS n_docs FROM docs)"""

# Selections and projections


@query("SELECT * FROM nation")
def scan_star(spark, d):
    return t(spark, d, "nation")


@query("SELECT s_suppkey, s_name FROM supplier")
def project_columns(spark, d):
    return R.project(t(spark, d, "supplier"), "s_suppkey", "s_name", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def filter_eq_int(spark, d):
    return t(spark, d, "customer").where("c_nationkey = 7").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def filter_lt(spark, d):
    return t(spark, d, "part").where("p_size < 10").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def filter_gt(spark, d):
    return t(spark, d, "part").where("p_size > 40").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 40 AND p_size >= 10")
def filter_le_ge(spark, d):
    return t(spark, d, "part").where(R.all_of(F.col("p_size") <= 40, F.col("p_size") >= 10)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#2'")
def filter_eq_str(spark, d):
    return t(spark, d, "part").where(F.col("p_brand") == "Brand#2").select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size < 5 OR p_size > 40 AND p_brand = 'Brand#2'")
def filter_and_or(spark, d):
    low, high, brand = F.col("p_size") < 5, F.col("p_size") > 40, F.col("p_brand") == "Brand#2"
    return t(spark, d, "part").where(R.any_of(low, R.all_of(high, brand))).select("p_partkey", "p_size", "p_brand")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 10 AND p_size < 40)")
def filter_not_paren(spark, d):
    return t(spark, d, "part").where(~R.all_of(F.col("p_size") > 10, F.col("p_size") < 40)).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > l_quantity")
def filter_col_col(spark, d):
    return t(spark, d, "lineitem").where("l_linenumber > l_quantity").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size * 2 + 3 > 50")
def arith_precedence(spark, d):
    return t(spark, d, "part").where("p_size * 2 + 3 > 50").select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size - (10 - 3) > 5 AND p_size * (2 + 3) < 200")
def arith_paren(spark, d):
    return t(spark, d, "part").where("p_size - (10 - 3) > 5 AND p_size * (2 + 3) < 200").select("p_partkey", "p_size")


@query("SELECT p_partkey, ((p_size - 30) // 7)::INT AS q FROM part")
def int_div(spark, d):
    return t(spark, d, "part").select("p_partkey", R.int_div("p_size - 30", "7").alias("q"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, d):
    return t(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT s_name, s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey, s_name, s_suppkey")
def order_by_total(spark, d):
    return R.order_by(t(spark, d, "supplier").select("s_name", "s_nationkey", "s_suppkey"), "s_nationkey")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_nationkey")
def order_by_distinct(spark, d):
    return R.order_by(t(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct(), "c_mktsegment")


# Joins


@query("SELECT c_custkey, c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
def join_equi(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    return R.join_on(c, n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey > r_regionkey + 1")
def join_theta(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return R.join_on(n, r, n.n_regionkey > r.r_regionkey + 1).select("n_name", "r_name")


@query("SELECT n_nationkey, r_name FROM nation, region")
def join_cross(spark, d):
    return R.join_on(t(spark, d, "nation"), t(spark, d, "region")).select("n_nationkey", "r_name")


@query("SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(spark, d):
    a, b = (t(spark, d, "supplier").select(F.col("s_suppkey").alias(f"{k}_key"), F.col("s_nationkey").alias(f"{k}_nation")) for k in ("left", "right"))
    return R.join_few(a, b, "left_nation", "right_nation", F.col("left_key") < F.col("right_key")).select("left_key", "right_key")


@query("SELECT n_name, r_name FROM nation, region WHERE n_name > r_name")
def join_strings(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return R.join_on(n, r, n.n_name > r.r_name).select("n_name", "r_name")


@query("SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_size = s_nationkey AND NOT p_brand = 'Brand#2'")
def join_mixed_filter(spark, d):
    p, s = t(spark, d, "part").select("p_partkey", "p_size", "p_brand"), t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return R.join_few(p.where(~(p.p_brand == "Brand#2")).select("p_partkey", "p_size"), s, "p_size", "s_nationkey").select("p_partkey", "s_suppkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND o_totalprice > 1000")
def join_three(spark, d):
    tables = [t(spark, d, x) for x in ("orders", "customer", "nation")]
    return R.product(tables, F.expr("o_custkey = c_custkey"), F.expr("c_nationkey = n_nationkey"), F.expr("o_totalprice > 1000")).select("o_orderkey", "c_name", "n_name")


@query("SELECT a.r_name AS r1, n_name, b.r_name AS r2 FROM region a, nation, region b")
def cross_three(spark, d):
    r = t(spark, d, "region")
    return R.product([r.select(F.col("r_name").alias("r1")), t(spark, d, "nation").select("n_name"), r.select(F.col("r_name").alias("r2"))])


@query("SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_size = s_nationkey AND (p_size < 5 OR s_acctbal > 5000 AND p_brand = 'Brand#2')")
def join_or_tree(spark, d):
    p, s = t(spark, d, "part").select("p_partkey", "p_size", "p_brand"), t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    either = R.any_of(F.col("p_size") < 5, R.all_of(F.col("s_acctbal") > 5000, F.col("p_brand") == "Brand#2"))
    return R.join_few(p.where((p.p_size < 5) | (p.p_brand == "Brand#2")), s, "p_size", "s_nationkey", either).select("p_partkey", "s_suppkey")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey OR n_nationkey < 3 AND r_name > 'B'")
def join_or_only(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return R.join_on(n, r, R.any_of(n.n_regionkey == r.r_regionkey, R.all_of(n.n_nationkey < 3, r.r_name > "B"))).select("n_name", "r_name")


@query("SELECT r_name FROM region WHERE 2 * 3 = 6 AND NOT 'a' = 'b'")
def filter_constants(spark, d):
    return t(spark, d, "region").where("2 * 3 = 6 AND NOT 'a' = 'b'").select("r_name")


# Tables


@query("SELECT s_suppkey::INT AS s_suppkey, s_name FROM supplier WHERE s_suppkey < 10 UNION ALL VALUES (100001, 'new one'), (100002, 'new two')")
def insert_values(spark, d):
    own = Tables(spark)
    own.create("insert_values_own", {"s_suppkey": "int", "s_name": "str20"})
    own.insert_from("insert_values_own", t(spark, d, "supplier").where("s_suppkey < 10").select("s_suppkey", "s_name"))
    return own.insert("insert_values_own", ["s_name", "s_suppkey"], ("new one", 100001), ("new two", 100002))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 3")
def insert_select(spark, d):
    own = Tables(spark)
    own.register("insert_select_own", t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    return own.insert_from("insert_select_own", t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey")))


@query("SELECT * FROM customer WHERE NOT (c_nationkey = 3 OR c_acctbal < 0)")
def delete_where(spark, d):
    own = Tables(spark)
    own.register("delete_where_own", t(spark, d, "customer"))
    return own.delete("delete_where_own", F.expr("c_nationkey = 3 OR c_acctbal < 0"))


@query("SELECT * FROM region WHERE false")
def delete_all(spark, d):
    own = Tables(spark)
    own.register("delete_all_own", t(spark, d, "region"))
    return own.delete("delete_all_own")


@query("SELECT * FROM (VALUES ('sid', 'int', 1), ('homework', 'int', 2), ('grade', 'string', 3)) v(column_name, column_type, place)")
def create_describe(spark, d):
    return R.described(Tables(spark).create("create_describe_own", {"sid": "int", "homework": "int", "grade": "str20"}))


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, d):
    return R.row_count(t(spark, d, "lineitem"))


@query("SELECT 'create_list_own' AS table_name")
def create_drop_list(spark, d):
    own = Tables(spark)
    own.create("create_list_own", {"sid": "int"})
    own.create("dropped_own", {"sid": "int"})
    own.drop("dropped_own")
    return spark.createDataFrame([(x,) for x in own.names()], "table_name string")


def _upto(n: int, k: int) -> str:
    return f"((((id + {1009 + 97 * k}) * 48271 + 11) % 2147483647 * 48271 + {k}) % 2147483647 // 97 % {n})::INT"


@query(f"SELECT {_upto(200, 1)} AS sid, {_upto(100, 2)} AS homework, 'stt' || {_upto(10, 3)} AS grade, {_upto(50, 4)} AS project, {_upto(5, 5)} AS exam FROM range(100000) r(id)")
def gen_random_table(spark, d):
    return random_table(spark, 100_000)


# Text features

TOKENS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(url, '^http://', ''), '=[^-&./?=,;:]*', '=', 'g'), '[-&./?=,;:]'), lambda x: x <> '')"


@query(f"SELECT page_id, array_to_string({TOKENS}, ',') AS tokens FROM pages")
def url_tokens(spark, d):
    return t(spark, d, "pages").select("page_id", urls.joined(urls.url_tokens(F.col("url"))).alias("tokens"))


@query(f"SELECT page_id, array_to_string(list_filter({TOKENS}, lambda x: x NOT IN ({', '.join(repr(x) for x in STOP)})), ',') AS tokens FROM pages")
def url_stopwords(spark, d):
    return t(spark, d, "pages").select("page_id", urls.joined(urls.without(urls.url_tokens(F.col("url")), STOP)).alias("tokens"))


@query(ORACLE_SQL["url_stopwords"])
def url_stop_table(spark, d):
    stop = spark.createDataFrame([(x,) for x in STOP], "word string")
    rows = t(spark, d, "pages").select("page_id", urls.url_tokens(F.col("url")).alias("tokens"))
    return urls.without_stop_words(rows, stop, "page_id").select("page_id", urls.joined(F.col("tokens")).alias("tokens"))


@query(f"WITH {DOCS} SELECT doc_id, label, feature, n FROM counts")
def term_counts(spark, d):
    return WT.term_counts(labelled(spark, d), words())


@query(f"WITH {DOCS} SELECT doc_id, label, feature, round(tf, 4) AS tf FROM tf")
def term_frequencies(spark, d):
    return WT.tf(labelled(spark, d), words()).select("doc_id", "label", "feature", WT.to_4(F.col("tf")).alias("tf"))


@query(f"WITH {DOCS} SELECT feature, df FROM df")
def doc_freq(spark, d):
    return WT.doc_freq(labelled(spark, d), words())


@query(f"WITH {DOCS} SELECT feature, df, idx FROM vocab")
def vocabulary(spark, d):
    return WT.vocabulary(labelled(spark, d), words())


@query(f"WITH {DOCS} SELECT doc_id, label, feature, 1 AS w FROM counts JOIN vocab USING (feature)")
def binary_weights(spark, d):
    return WT.weights(labelled(spark, d), "binary", words())


@query(f"WITH {DOCS} SELECT doc_id, label, feature, round(tf, 4) AS w FROM tf JOIN vocab USING (feature)")
def tf_weights(spark, d):
    return WT.weights(labelled(spark, d), "tf", words())


@query(f"WITH {DOCS} SELECT doc_id, label, feature, round(tf * ln(n_docs / df), 4) AS w FROM tf JOIN vocab USING (feature), nd")
def tfidf_weights(spark, d):
    return WT.weights(labelled(spark, d), "tfidf", words())


@query(f"WITH {DOCS} SELECT label, count(*) AS n_docs FROM docs GROUP BY label")
def class_counts(spark, d):
    return WT.class_counts(labelled(spark, d))


def _lines(weight: str, where: str = "true") -> str:
    return f"""WITH {DOCS},
pairs AS (SELECT doc_id, string_agg(idx || ':' || {weight}, ' ' ORDER BY idx) AS pairs FROM tf JOIN vocab USING (feature), nd GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(feature, ',' ORDER BY feature) AS names FROM counts GROUP BY doc_id)
SELECT doc_id, label, concat_ws(' ', CASE WHEN label > 0 THEN '+1' ELSE label::VARCHAR END, pairs, '#', coalesce(names, '')) AS line
FROM docs LEFT JOIN pairs USING (doc_id) LEFT JOIN names USING (doc_id) WHERE {where}"""


@query(_lines("printf('%.4f', round(tf, 4))"))
def vector_lines(spark, d):
    return WT.vector_lines(labelled(spark, d), "tf", words())


@query(_lines("printf('%.4f', round(tf * ln(n_docs / df), 4))"))
def vector_lines_tfidf(spark, d):
    return WT.vector_lines(labelled(spark, d), "tfidf", words())


@query(_lines("1", "label <> 0"))
def train_split(spark, d):
    return WT.vector_lines(labelled(spark, d), "binary", words()).where("label <> 0")


@query(_lines("1", "label = 0"))
def predict_split(spark, d):
    return WT.vector_lines(labelled(spark, d), "binary", words()).where("label = 0")


# XML


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def xml_escape(spark, d):
    return t(spark, d, "pages").select("page_id", xml.escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS plain FROM pages")
def xml_unescape(spark, d):
    return t(spark, d, "pages").select("page_id", xml.unescape(F.col("html")).alias("plain"))


@query("SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '&([A-Za-z#_:][A-Za-z0-9_:.-]*;)', chr(1) || '\\1', 'g'), '&', '&amp;'), chr(1), '&'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def xml_escape_references(spark, d):
    return t(spark, d, "pages").select("page_id", xml.escape(F.col("html"), keep_references=True).alias("escaped"))


@query("SELECT p_partkey, p_name || ' &quot;a&quot; &amp; &apos;b&apos; &lt;c&gt;' AS escaped FROM part")
def xml_escape_quotes(spark, d):
    return R.dealt(t(spark, d, "part")).select("p_partkey", xml.escape(F.concat("p_name", F.lit(" \"a\" & 'b' <c>")), quotes=True).alias("escaped"))


@query("SELECT p_partkey, p_name || ' é < \"' AS plain FROM part")
def xml_unescape_html(spark, d):
    return R.dealt(t(spark, d, "part")).select("p_partkey", xml.unescape_html(F.concat("p_name", F.lit(" &eacute; &#60; &#x22;"))).alias("plain"))


@query("SELECT p_partkey, p_brand AS brand, p_name || ' > it''s & so' AS note, p_type || ' \"x\"' AS other, p_size::VARCHAR AS bare FROM part")
def xml_attr(spark, d):
    # Decoys: a longer tag name, tags in a comment and in CDATA, a name within a value, quotes of the other kind, > in values.
    decoys = F.lit("<part-list brand='no'/><!-- <part brand='no'/> --><![CDATA[<part brand='no'>]]>")
    text = F.concat(F.lit("<a>"), decoys, F.lit("<part other='"), F.col("p_type"), F.lit(" \"x\"' hint=\" brand='no'\" note=\""), F.col("p_name"), F.lit(" > it's &amp; so\" brand='"), F.col("p_brand"), F.lit("' bare="), F.col("p_size").cast("string"), F.lit(">x</part></a>"))
    return R.dealt(t(spark, d, "part")).select("p_partkey", *(xml.attribute(text, "part", k).alias(k) for k in ("brand", "note", "other", "bare")))


@query("SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>|<![^>]*>', '', 'gs'), '<')[2:], lambda x: regexp_extract(x, '^([A-Za-z_:][^\\s/>]*)[^<]*>', 1)), lambda x: x <> ''), ',') AS tags FROM pages")
def xml_elements(spark, d):
    return t(spark, d, "pages").select("page_id", urls.joined(xml.elements(F.col("html"))).alias("tags"))


@query("SELECT p_partkey, 'a,part' || p_size || ',b,c,part,d' AS tags FROM part")
def xml_walk(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("<?xml version='1.0'?><!DOCTYPE a><a><!-- <no> --><![CDATA[<no>]]><part"), size, F.lit(" k=\"x > <no>\"><b/><c x='>'>1 &lt; 2</c></part"), size, F.lit("><part n="), key, F.lit("><d/></part></a>"))
    return R.dealt(t(spark, d, "part")).select("p_partkey", urls.joined(xml.elements(text)).alias("tags"))


@query("SELECT p_partkey, p_name AS name, p_brand || ' & ' || p_type AS second, 2 AS many, p_brand AS torn FROM part")
def xml_find(spark, d):
    one = xml.element("part", xml.element("name", xml.escape(F.col("p_name"))))
    two = xml.element("part", xml.element("name", xml.cdata(F.col("p_brand")), xml.escape(F.concat(F.lit(" & "), "p_type"))))
    built = xml.element("parts", xml.element("names", F.lit("no")), one, two)
    # Ill formed: an element that nothing closes, a lone end tag, and no end of the whole.
    torn = F.concat(F.lit("<parts><lost><part></x><name>"), F.col("p_brand"), F.lit("</name></part></parts><rest>"))
    names = xml.find(built, "parts/part/name")
    return R.dealt(t(spark, d, "part")).select("p_partkey", names[0].alias("name"), names[1].alias("second"), F.size(names).alias("many"), F.get(xml.find(torn, "parts/part/name"), F.lit(0)).alias("torn"))


_HEAD, _TAIL = "'<parts><part brand=\"' || p_brand || '\">'", "'</part><part>x</part></parts>'"
_A = "'<a>' || p_name || '</a>'"


@query(f"""SELECT p_partkey, {_HEAD} || '<b/>' || {_TAIL} AS removed, {_HEAD} || {_A} || '<b>1 &lt; 2</b>' || {_TAIL} AS data,
  '<parts><part brand="it&apos;s">' || {_A} || '<b/>' || {_TAIL} AS changed, '<parts><part brand="' || p_brand || '" size="' || p_size || '">' || {_A} || '<b/>' || {_TAIL} AS added,
  {_HEAD} || {_A} || '<b/><c>' || p_size || '</c>' || {_TAIL} AS appended, {_HEAD} || {_A} || '<b><c/></b>' || {_TAIL} AS nested FROM part""")
def xml_edit(spark, d):
    text = xml.element("parts", xml.element("part", xml.element("a", F.col("p_name")), F.lit("<b/>"), brand=F.col("p_brand")), xml.element("part", F.lit("x")))
    size = F.col("p_size").cast("string")
    made = {
        "removed": xml.remove_element(text, "parts/part/a"), "data": xml.set_data(text, "parts/part/b", F.lit("1 < 2")), "changed": xml.set_attribute(text, "parts/part", "brand", F.lit("it's")),
        "added": xml.set_attribute(text, "parts/part", "size", size), "appended": xml.add_child(text, "parts/part", xml.element("c", size)), "nested": xml.add_child(text, "parts/part/b", F.lit("<c/>")),
    }
    return R.dealt(t(spark, d, "part")).select("p_partkey", *(v.alias(k) for k, v in made.items()))


@query("SELECT p_partkey, true AS whole, false AS cut, NULL::VARCHAR AS none, 'mismatched tag: line 1, column ' || (8 + length(p_brand)) AS fault FROM part")
def xml_well_formed(spark, d):
    built = xml.element("part", xml.cdata(F.col("p_name")), brand=F.col("p_brand"))
    wrong = F.concat(F.lit("<a><b>"), F.col("p_brand"), F.lit("</a>"))
    return R.dealt(t(spark, d, "part")).select("p_partkey", xml.well_formed(built).alias("whole"), xml.well_formed(F.concat(built, F.lit("<"))).alias("cut"), xml.fault(built).alias("none"), xml.fault(wrong).alias("fault"))


@query("""SELECT p_partkey, k.kind, k.name, CASE k.value WHEN 'brand' THEN 'brand="' || p_brand || '"' WHEN 'name' THEN p_name ELSE k.value END AS value, k.depth FROM part, (VALUES ('element', 'part', 'brand', 0), ('cdata', NULL, 'name', 1),
  ('comment', NULL, ' c ', 1), ('element', 'lost', '', 1), ('text', NULL, 'a & b', 1), ('pi', 'go', 'on now', 1), ('element', 'b', '', 1), ('text', NULL, 'x', 2)) k(kind, name, value, depth)""")
def xml_nodes(spark, d):
    built = xml.element("part", xml.cdata(F.col("p_name")), F.lit("<!-- c --><lost>a &amp; b<?go on now?></no><b>x</b>"), brand=F.col("p_brand"))
    rows = R.dealt(t(spark, d, "part")).select("p_partkey", F.explode(xml.nodes(built)).alias("k"))
    return rows.select("p_partkey", "k.kind", "k.name", "k.value", "k.depth")


@query("SELECT p_partkey, 'UTF-8' AS plain, 'UTF-16LE' AS wide, 'ISO-8859-1' AS latin, '<a>é ' || p_name || '</a>' AS back, true AS utf8, false AS other FROM part")
def xml_bytes(spark, d):
    text = F.concat(F.lit("<a>é "), F.col("p_name"), F.lit("</a>"))
    latin, wide = F.encode(F.concat(F.lit("<?xml version='1.0' encoding='iso-8859-1'?>"), text), "ISO-8859-1"), F.encode(text, "UTF-16LE")
    rows = R.dealt(t(spark, d, "part")).select("p_partkey", text.alias("text"), F.encode(text, "UTF-8").alias("bytes"), latin.alias("latin"), wide.alias("wide"))
    back = xml.decoded(xml.encoded("text", F.lit("UTF-16BE")), F.lit("UTF-16BE"))
    found = {k: xml.encoding_of(F.col(c)) for k, c in (("plain", "bytes"), ("wide", "wide"), ("latin", "latin"))}
    return rows.select("p_partkey", *(v.alias(k) for k, v in found.items()), back.alias("back"), xml.is_utf8(F.col("bytes")).alias("utf8"), xml.is_utf8(F.col("latin")).alias("other"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?i)(?:<\\?xml[^>]*\\bencoding|<meta[^>]*\\bcharset)\\s*=\\s*[\"'']?([A-Za-z0-9_.-]+)', 1), '') AS encoding FROM pages")
def xml_encoding(spark, d):
    return t(spark, d, "pages").select("page_id", xml.declared_encoding(F.col("html")).alias("encoding"))
