"""Joins with sides that grow with the input bring none of them to the driver."""


def test_near_duplicates_broadcast_nothing(spark):
    from quillveil.llm.neardup import near_duplicates

    docs = spark.createDataFrame([(i, f"ein langer Text mit vielen Worten und Nummer {i % 5}") for i in range(20)], "doc_id long, text string")
    rows = near_duplicates(docs)
    assert rows.count() == 20
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
