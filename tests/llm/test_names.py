"""Columns of the caller's that are called as those made inside."""

from tidewell.llm import ngram_join, url_filters


def test_url_filter_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([("http://spam.org/a", "keep", 7, "b"), ("http://x.com/", "keep", 8, None), (None, None, 9, "c"), ("http://y.org/" + "z" * 200_000, "keep", 10, "d")], "url string, _url_h string, _p_b int, c0 string")
    got = url_filters.url_filter(pages, spark.createDataFrame([("http://spam.org/a",)], "url string"))
    assert got.columns == ["url", "_url_h", "_p_b", "c0", "host", "path", "rule", "verdict"]
    rows = {r._p_b: r for r in got.collect()}
    assert [(rows[i]._url_h, rows[i].c0, rows[i].host, rows[i].verdict) for i in (7, 8, 9)] == [("keep", "b", "spam.org", "block"), ("keep", None, "x.com", "allow"), (None, "c", "", "allow")]
    assert len(rows[10].path) == 200_001 and rows[10].verdict == "allow"


def test_distinct_documents_keep_columns_of_any_name(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text, 20, "x"), (1, text, 10, "y"), (1, text, 11, "z"), (3, None, 30, None), (4, "other words stand here and differ", 40, "w")], "doc_id long, text string, _j_1 int, _p_m string")
    got = ngram_join.distinct_documents(docs)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.orderBy("doc_id").collect()]
    assert [r[0] for r in rows] == [1, 3, 4] and rows[0] in {(1, text, 10, "y"), (1, text, 11, "z")} and rows[1:] == [(3, None, 30, None), (4, "other words stand here and differ", 40, "w")]
