"""B3 on nested, unclosed and odd elements; A1 on mixed shards."""

from notedrift.operators import extract as E
from notedrift.sources import io


def elements(spark, page, tag="table"):
    df = spark.createDataFrame([(page,)], "html string")
    return df.select(E.nested_elements("html", tag).alias("e")).first().e


def test_nested_elements_are_whole(spark):
    inner = '<TABLE class="x"><tr><td>1</td></tr></TABLE >'
    outer = f"<table><tr><td>{inner}</td><td>{inner}</td></tr></table>"
    page = f"<p>a</p>{outer}<tables>no</tables>\n<table\nid=2>é</table>"
    assert elements(spark, page) == [outer, inner, inner, "<table\nid=2>é</table>"]
    deep = "<table>" * 30 + "x" + "</table>" * 30
    assert elements(spark, deep) == ["<table>" * k + "x" + "</table>" * k for k in range(30, 0, -1)]


def test_odd_elements(spark):
    assert elements(spark, None) is None
    assert elements(spark, "") == [] and elements(spark, "no element") == []
    assert elements(spark, "</table><table>a</table></table><table>b</table>") == ["<table>a</table>", "<table>b</table>"]
    assert elements(spark, "<table>never closed <table>in</table>") == ["<table>in</table>"]
    assert elements(spark, "<li>a</li><LI>b</LI>", "li") == ["<li>a</li>", "<LI>b</LI>"]


def test_kind_of_the_page(spark):
    df = spark.createDataFrame([(1, "<table>a</table><table>b</table>", True), (2, "<table>c</table>", None), (3, "none", True)], "id int, html string, c boolean")
    rows = E.extract_html_tables(df, "id", consolidated=df.c).collect()
    assert sorted(tuple(r) for r in rows) == [(1, True, 0, "<table>a</table>"), (1, True, 1, "<table>b</table>"), (2, False, 0, "<table>c</table>")]


def test_shards_of_two_schemas_are_two_loads(spark, scratch):
    for i in range(6):
        df = spark.range(i * 10, i * 10 + 10).selectExpr("id", "id * 2 as a") if i % 2 else spark.range(i * 10, i * 10 + 10).selectExpr("id", "id as b")
        df.coalesce(1).write.parquet(f"{scratch}/s{i}")
    spark.range(0).selectExpr("id as other").write.parquet(f"{scratch}/empty")
    got = io.read_shards(spark, scratch, "part-")
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == list(range(60))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
