"""What SQL can't show: order, errors, plans, files, and the library without its corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions import urls, xml
from lodestone.operators import relational as R
from lodestone.operators import shared
from lodestone.operators import weights as WT
from lodestone.sources import text
from lodestone.sources import xml as xml_files
from lodestone.sources.tables import Tables, random_table

DATA = "/root/testdata/sf0.001"


def test_order_is_total(spark):
    df = spark.createDataFrame([(2, "b", 1), (1, "z", 9), (1, "a", 3), (1, "a", 2)], "k int, s string, a int")
    assert [tuple(r) for r in R.order_by(df, "k").collect()] == [(1, "a", 2), (1, "a", 3), (1, "z", 9), (2, "b", 1)]


def test_tables(spark):
    own = Tables(spark)
    own.create("tt_own", {"a": "INT", "b": "STR20"})
    with pytest.raises(ValueError):
        own.create("tt_own", {"a": "int"})
    with pytest.raises(ValueError):
        own.create("tt_other", {"a": "float"})
    own.insert("tt_own", ["b", "a"], ("x", 1), ("y", None))
    assert own.delete("tt_own", F.col("a") > 0).collect() == [(None, "y")]
    own.drop("tt_own")
    with pytest.raises(KeyError):
        own["tt_own"]


def test_int_div(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2)], "a int, b int")
    assert [r[0] for r in df.select(R.int_div("a", "b")).collect()] == [-3, 3]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.select(R.int_div("a", "b - 2")).collect()


def test_conditions_reach_the_scan(spark):
    from lodestone.plans.queries import QUERIES

    plan = QUERIES["join_three"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "GreaterThan(o_totalprice" in plan


def test_random_table_is_the_same_however_split(spark):
    a, b = (sorted(random_table(spark, 500, 3, n).collect()) for n in (1, 7))
    assert a == b and all(0 <= r.sid < 200 and 0 <= r.exam < 5 for r in a)


def test_url_tokens(spark):
    df = spark.createDataFrame([("http://a.com/x-y?q=secret&z=1",), ("https://b.org//",), ("",), (None,)], "u string")
    got = [r[0] for r in df.select(urls.url_tokens(F.col("u"))).collect()]
    assert got == [["a", "com", "x", "y", "q", "z"], ["https", "b", "org"], [], None]


def test_text_files(spark, tmp_path):
    for name, lines in (("positive", "a,b\nb,c\n"), ("negative", "a,c\n"), ("predict", "a,d\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.data").write_text(lines)
    rows = text.labelled_lines(spark, str(tmp_path), "data").select("doc_id", "label", F.split("line", ",").alias("tokens"))
    lines = WT.vector_lines(rows, "binary")
    text.write_vectors(lines, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out/train")).collect()) == ["+1 1:1 2:1 # a,b", "+1 2:1 3:1 # b,c", "-1 1:1 3:1 # a,c"]
    assert [r[0] for r in spark.read.text(str(tmp_path / "out/predict")).collect()] == ["0 1:1 # a,d"]
    assert len(list(tmp_path.glob("positive/*.data"))) == 1


def one(spark, x, *columns):
    return tuple(spark.createDataFrame([(x,)], "x string").select(*columns).first())


def X():
    return F.col("x")


def test_xml(spark):
    x = '<A href=/path/ t="x&lt;y">ok<B/><C>1</C></A>'
    assert one(spark, x, xml.attribute(X(), "A", "href"), xml.attribute(X(), "A", "t"), xml.elements(X()), xml.well_formed(X())) == ("/path/", "x<y", ["A", "B", "C"], False)
    assert one(spark, "a]]>a", xml.cdata(X())) == ("<![CDATA[a]]]]><![CDATA[>a]]>",)
    assert one(spark, "&eacute;&#65;&#x42;&amp;", xml.unescape_html(X())) == ("éAB&",)
    assert one(spark, "a & b &amp; &#65; &x y; <", xml.escape(X(), keep_references=True)) == ("a &amp; b &amp; &#65; &amp;x y; &lt;",)


def test_xml_attributes(spark):
    x = """<H g1=">" g2='>' d="d'd" s='s"s'/>"""
    assert one(spark, x, *(xml.attribute(X(), "H", k) for k in ("g1", "g2", "d", "s", "none"))) == (">", ">", "d'd", 's"s', None)
    assert one(spark, '<A-B h="1"/><A h="2"/>', xml.attribute(X(), "A", "h")) == ("2",)
    assert one(spark, None, xml.attribute(X(), "A", "h"), xml.elements(X()), xml.find(X(), "A"), xml.nodes(X()), xml.well_formed(X()), xml.fault(X())) == (None,) * 6
    assert one(spark, "", xml.attribute(X(), "A", "h"), xml.elements(X()), xml.find(X(), "A"), xml.nodes(X())) == (None, [], [], [])


def test_xml_walk_and_find(spark):
    x = "<A><B><C/><C/><C><D/></C></B><B><C/></B></A>"
    assert "".join(one(spark, x, xml.elements(X()))[0]) == "".join(n.name for n in one(spark, x, xml.nodes(X()))[0]) == "ABCCCDBC"
    assert one(spark, "<R><N>A</N><Name>B</Name><Na>C</Na><Nam>D</Nam></R>", xml.find(X(), "R/Name"), xml.find(X(), "R/Nam"), xml.find(X(), "R/X")) == (["B"], ["D"], [])
    assert one(spark, "<R><C><![CDATA[a]]>]]&gt;<![CDATA[a]]></C></R>", xml.find(X(), "R/C")) == (["a]]>a"],)
    assert one(spark, "<a><!-- <b> --><![CDATA[<c>]]></a>", xml.elements(X())) == (["a"],)
    assert one(spark, "<a><p>1<p>2</a><b>x</c></b>", xml.find(X(), "b"), xml.elements(X())) == (["x"], ["a", "p", "p", "b"])
    rows = spark.createDataFrame([("<a>1</a>",), ("<a>2",), ("<<>a</b>",)], "x string")
    assert [r[0] for r in rows.select(xml.find(X(), "a")).collect()] == [["1"], [""], []]


def test_xml_edits(spark):
    x = "<A><B k='v'>1</B><B/></A>"
    got = one(spark, x, xml.remove_element(X(), "A/B"), xml.set_data(X(), "A/B", F.lit("a<b")), xml.set_attribute(X(), "A/B", "k", F.lit('"')), xml.add_child(X(), "A", F.lit("<C/>")), xml.add_child(X(), "A", F.lit("<C/>"), first=True), xml.remove_element(X(), "A/Z"))
    assert got == ("<A><B/></A>", "<A><B k='v'>a&lt;b</B><B/></A>", "<A><B k=\"&quot;\">1</B><B/></A>", "<A><B k='v'>1</B><B/><C/></A>", "<A><C/><B k='v'>1</B><B/></A>", x)
    assert one(spark, "<A x='k=1'/>", xml.set_attribute(X(), "A", "k", F.lit("2")), xml.set_data(X(), "A", F.lit("d"))) == ("<A x='k=1' k=\"2\"/>", "<A x='k=1'>d</A>")
    assert one(spark, "<A/>", xml.set_data(X(), "A", F.lit(None).cast("string"))) == ("<A/>",)


def test_xml_files(spark, tmp_path):
    given = {"a": "<a>é</a>".encode("utf-8-sig"), "b": "\ufeff<a>é</a>".encode("utf-16-le"), "c": "<?xml version='1.0' encoding='windows-1252'?><a>é €</a>".encode("cp1252"), "d": "<a>é</a>".encode("latin-1")}
    for k, v in given.items():
        (tmp_path / f"{k}.xml").write_bytes(v)
    got = {r.path[-5]: (r.encoding, r.text) for r in xml_files.load(spark, str(tmp_path / "*.xml")).collect()}
    assert got["a"] == ("UTF-8", "<a>é</a>") and got["b"] == ("UTF-16LE", "<a>é</a>") and got["d"] == ("ISO-8859-1", "<a>é</a>")
    assert got["c"][0] == "WINDOWS-1252" and got["c"][1].endswith("<a>é €</a>")
    xml_files.save(spark.createDataFrame([("one", "<a>é\n</a>")], "name string, text string"), str(tmp_path / "out"))
    assert [r.text for r in xml_files.load(spark, str(tmp_path / "out/name=one/*.txt")).collect()] == ["<a>é\n</a>\n"]


def test_token_files(spark, tmp_path):
    urls_ = spark.createDataFrame([(1, ["a", "b"]), (-1, ["c"]), (0, ["d", "a"]), (0, [])], "label int, tokens array<string>")
    text.write_tokens(urls_, str(tmp_path / "out"))
    for name in ("positive", "negative", "predict"):
        (tmp_path / "in" / name).mkdir(parents=True)
        lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out" / name)).collect())
        (tmp_path / "in" / name / "x.data").write_text("\n".join([*lines, "x", ",,b,,b"]) + "\n")
    got = sorted((r.label, r.tokens) for r in text.token_documents(spark, str(tmp_path / "in")).collect())
    assert got == sorted([(1, ["a", "b"]), (1, ["b", "b"]), (0, ["d", "a"]), (0, ["b", "b"]), (-1, ["b", "b"])])  # "c" and "x" are one character
    ids = [sorted(r.doc_id for r in text.labelled_lines(spark, str(tmp_path / "in"), "data").repartition(n).collect()) for n in (1, 5)]
    assert ids[0] == ids[1] and len({*ids[0]}) == len(ids[0])
    (tmp_path / "stop.txt").write_text("The\nAND\n\nthe\n")
    assert sorted(r.word for r in text.stop_words(spark, str(tmp_path / "stop.txt")).collect()) == ["and", "the"]


def test_stop_tables_of_any_size(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, []), (3, None), (4, ["b"])], "k int, tokens array<string>")
    stop = spark.createDataFrame([("b",), ("x",), (None,), ("b",)], "word string")
    want = [(1, ["a", "a", "c"]), (2, []), (3, None), (4, [])]
    for most in (100, 0):
        monkeypatch.setattr(urls, "BROADCAST", most)
        assert sorted((r.k, r.tokens) for r in urls.without_stop_words(rows, stop, "k").collect()) == want


def test_weights_of_any_vocabulary(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 3 - 1, ["a", "b", "a"][: k % 4] + ["é", "", f"x{k % 5}"]) for k in range(40)] + [(99, 0, []), (100, 1, None)], "doc_id int, label int, tokens array<string>")
    want = [sorted(f(rows).collect()) for f in (WT.weights, WT.vector_lines)]
    monkeypatch.setattr(WT, "BROADCAST", 0)
    assert [sorted(f(rows).collect()) for f in (WT.weights, WT.vector_lines)] == want
    assert {r.doc_id: r.line for r in want[1] and WT.vector_lines(rows).where("doc_id > 98").collect()} == {99: "0 # ", 100: "+1 # "}


def test_large_vocabularies_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 3 - 1, ["a", "b"][: k % 3] + [f"x{k % 5}"]) for k in range(40)], "doc_id int, label int, tokens array<string>")
    for scheme in ("binary", "tfidf"):
        want = [sorted(f(rows, scheme).collect()) for f in (WT.weights, WT.vector_lines)]
        with monkeypatch.context() as m:
            m.setattr(WT, "BROADCAST", 2)
            got = [f(rows, scheme) for f in (WT.weights, WT.vector_lines)]
            assert [sorted(x.collect()) for x in got] == want
        for x in got:
            # Only the two most frequent features are broadcast; Spark would broadcast the others by their size on disk.
            assert "SortMergeJoin [feature" in x._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_of_weights_are_bounded_by_bytes(spark):
    long = "é" * WT.LONG
    rows = spark.createDataFrame([(k, k % 3 - 1, ["a", "b"][: k % 3] + [long, f"{k % 5}{long}"]) for k in range(40)], "doc_id int, label int, tokens array<string>")
    common, others = WT._parts(WT.written(WT.doc_freq(rows).where("df > 1")))
    assert sorted(r.feature for r in common.collect()) == ["a", "b"] and others.count() == 6
    assert {(r.doc_id, r.feature): r.w for r in WT.weights(rows, "tf").collect()} == {(k, f): pytest.approx(1 / n, abs=1e-4) for k in range(40) for n in [k % 3 + 2] for f in [*["a", "b"][: k % 3], long, f"{k % 5}{long}"]}
    lines = {r.doc_id: r.line for r in WT.vector_lines(rows, "binary").collect()}
    assert lines[2] == f"+1 3:1 6:1 7:1 8:1 # 2{long},a,b,{long}"


def test_keys_of_repeated_documents_are_not_broadcast(spark):
    rows = spark.createDataFrame([(k % 30, 1, ["a", f"x{k % 5}"]) for k in range(60)] + [(None, 0, ["a"]), (None, 0, ["b"]), (77, 0, ["a"])], "doc_id int, label int, tokens array<string>")
    got = WT.term_counts(rows)
    assert {(r.doc_id, r.feature): r.n for r in got.collect()} == {(k, "a"): 2 for k in range(30)} | {(k, f"x{k % 5}"): 2 for k in range(30)} | {(None, "a"): 1, (None, "b"): 1, (77, "a"): 1}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "twice_id" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "twice_id" in x]


def test_counts_of_awkward_documents(spark):
    rows = [(1, 1, ["b", "a", "b", ""]), (1, 1, ["a"]), (2, 0, []), (3, 0, None), (None, -1, ["é", "é"]), (None, -1, ["z"]), (4, 1, ["", ""]), (5, 1, ["a"])]
    df = spark.createDataFrame(rows, "doc_id int, label int, tokens array<string>")
    assert sorted(map(tuple, WT.term_counts(df).collect()), key=str) == sorted([(1, 1, "a", 2), (1, 1, "b", 2), (None, -1, "é", 2), (None, -1, "z", 1), (5, 1, "a", 1)], key=str)
    assert {(r.doc_id, r.feature): r.tf for r in WT.tf(df).collect()} == {(1, "a"): 0.5, (1, "b"): 0.5, (None, "é"): pytest.approx(2 / 3), (None, "z"): pytest.approx(1 / 3), (5, "a"): 1}


def test_counting_holds_no_table_of_words(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (2, 0, ["a"])], "doc_id int, label int, tokens array<string>")
    for f in (WT.term_counts, WT.tf):
        assert "Aggregate" not in f(df)._jdf.queryExecution().executedPlan().toString()


def test_joins_by_few_keys_are_dealt_by_pairs(spark, monkeypatch):
    a = spark.createDataFrame([(k, k % 3 or None) for k in range(90)] + [(7, 1)], "x int, a int").coalesce(1)
    b = spark.createDataFrame([(k, k % 4 or None) for k in range(60)], "y int, b int").coalesce(1)
    want = sorted(R.join_on(a, b, F.col("a") == F.col("b"), F.col("x") < F.col("y")).collect())
    monkeypatch.setattr(R, "PAIRS", 100)
    for most in (100, 0):
        monkeypatch.setattr(R, "BROADCAST", most)
        got = R.join_few(a, b, "a", "b", F.col("x") < F.col("y"))
        assert got.columns == ["x", "a", "y", "b"] and sorted(got.collect()) == want
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 3 and sum(parts) == len(want)
    assert R.join_few(a, b.where("b > 9"), "a", "b").count() == 0


def test_pairs_of_a_join_are_small_when_saved(spark, tmp_path):
    a = spark.range(25_000).selectExpr("id AS x", "cast(id % 25 AS int) AS a")
    b = spark.range(5_000).selectExpr("id * 7 AS y", "cast(id % 25 AS int) AS b")
    R.join_few(a, b, "a", "b").select("x", "y").write.parquet(str(tmp_path / "pairs"))
    got, whole = spark.read.parquet(str(tmp_path / "pairs")), R.join_on(a, b, F.col("a") == F.col("b"))
    sums = [F.count("*"), F.sum(F.xxhash64("x", "y") % 1_000_003), F.sum("x"), F.sum("y")]
    assert got.agg(*sums).first() == whole.agg(*sums).first() and got.count() == 5_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 5_000_000 / 2


def test_equal_rows_of_a_join_part(spark, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 200)
    a, b = (spark.range(n).selectExpr(f"5 AS {v}", f"1 AS {k}") for n, v, k in ((400, "x", "a"), (30, "y", "b")))
    got = R.join_few(a, b, "a", "b")
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 12_000 and max(parts) < 3_000


def test_few_files_are_many_tasks(spark, monkeypatch):
    from lodestone.plans.queries import QUERIES

    monkeypatch.setattr(R, "ROWS", 500)
    monkeypatch.setattr(R, "PAIRS", 50)
    for name in ("xml_edit", "join_mixed_filter", "join_or_tree", "join_self"):
        rows = QUERIES[name](spark, "/root/testdata/sf0.01")
        assert rows.groupBy(F.spark_partition_id()).count().count() > 1, name


def test_vector_lines_read_documents_twice(spark):
    from lodestone.plans.queries import QUERIES

    plan = QUERIES["vector_lines"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") <= 1 and plan.count("SortMergeJoin") <= 1


def test_labels_are_not_broadcast(spark):
    from lodestone.plans.queries import QUERIES

    for name in ("term_counts", "tf_weights", "tfidf_weights", "vector_lines", "train_split", "predict_split"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        # Broadcasts of features stay; texts are dealt once, where they meet their labels.
        assert plan.count("ShuffledHashJoin [doc_id") == plan.count("documents.parquet") == plan.count("REPARTITION_BY_COL") == 1, name
        assert plan.count("BroadcastExchange") == (name != "term_counts"), name


def test_ties_of_weights_are_rounded_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from lodestone.plans.queries import ORACLE_SQL, QUERIES

    shares = [(57, 800), (3, 20_000), (43, 4000), (1, 160), (1, 32)]
    texts = [(k, " ".join(["a"] * n + ["b"] * (size - n))) for k, (n, size) in enumerate(shares)]
    spark.createDataFrame(texts, "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k, _ in texts[:3]], "doc_id int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("vector_lines", "vector_lines_tfidf", "term_frequencies", "tf_weights", "tfidf_weights"):
        want = con.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect())) == sorted(want.fetchall()), name


def test_intermediate_tables_go(spark):
    rows = shared.written(spark.range(5).toDF("k"))
    path = rows.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert sorted(r.k for r in rows.collect()) == [*range(5)] and Path(path).is_dir()
    assert shared.discard(spark) >= 1 and not Path(path).exists() and shared.discard(spark) == 0


def test_rows_that_a_table_lacks_columns_for(spark):
    own = Tables(spark)
    own.create("tl_own", {"a": "int"})
    with pytest.raises(ValueError, match="no column b"):
        own.insert_from("tl_own", spark.createDataFrame([(1, 2)], "a int, b int"))


def test_entry_without_the_corpus_operators():
    code = "import sys\nsys.modules['lodestone.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'scan_star' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
