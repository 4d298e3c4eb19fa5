from quarrylens.llm.sampling import sampled_texts


def test_bounded_and_repeatable(spark):
    d = spark.range(4000).selectExpr("concat('text number ', id % 3000) as text", "id")
    a = sampled_texts(d, 100, 5)
    assert a == sampled_texts(d.repartition(7), 100, 5) and len(a) == len(set(a)) == 100
    few = spark.createDataFrame([("one text",), ("one text",), (None,), ("",), ("x" * 50,)], "text string")
    assert sorted(sampled_texts(few, 10, 5, 20)) == ["one text"] and sampled_texts(few.limit(0), 10, 5) == []
