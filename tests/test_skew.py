from quillspan.operators.skew import heavy_keys


def test_heavy_keys(spark):
    rows = [(7, [7, 8])] * 300 + [(i, [i]) for i in range(1000, 1500)] + [(None, None), (None, [])]
    df = spark.createDataFrame(rows, "k long, ks array<long>")
    assert [(x.key, x.n) for x in heavy_keys(df, "k", 100).collect()] == [(7, 300)]
    assert sorted((x.key, x.n) for x in heavy_keys(df, "ks", 100).collect()) == [(7, 300), (8, 300)]
    assert heavy_keys(df, "k", 300).count() == 0 and heavy_keys(df.limit(0), "k", 1).count() == 0
