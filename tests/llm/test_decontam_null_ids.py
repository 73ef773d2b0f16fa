import pytest

from noveltybench.llm import decontam


@pytest.mark.parametrize("most", [200_000, 0])
def test_windows_of_null_ids_count(spark, most):
    passage = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Before it, {passage}."), (2, "clean text stays")], "doc_id long, text string")
    b = spark.createDataFrame([(None, passage), (7, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.mark(d, b, max_broadcast=most).collect()}
    assert got == {1: (13, 11, []), 2: (3, 0, [])}
    assert [r["doc_id"] for r in decontam.decontaminate(d, b).collect()] == [2]
