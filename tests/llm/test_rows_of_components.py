"""One row of each component stays, with null and repeated ids too."""

from epochloom.llm import simhash


def text(k, tail=""):
    return " ".join(f"w{k}x{i}" for i in range(60)) + tail


def test_null_and_repeated_ids(spark):
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (2, text(3)), (3, text(4)), (None, text(4)), (None, text(5)), (None, text(6)), (None, text(6)), (4, text(7)), (4, text(7))]
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in part], "doc_id long, text string, lang string, source string, n_chars long")
        got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
        want = [(1, text(1)), (2, text(2)), (2, text(3)), (3, text(4)), (None, text(5)), (None, text(6)), (4, text(7))]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_texts_move_once(spark, tmp_path):
    """One exchange of the plan carries texts, also after a read of Parquet."""
    docs = spark.createDataFrame([(i, text(i % 7), "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/docs")
    out = simhash.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
    lines = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    moved = [x for x in lines if ") Exchange" in x.split("\n")[0] and "text#" in x]
    assert len(moved) == 1
