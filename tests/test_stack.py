from boutline.ml import training


def test_rows_are_turned_once(spark):
    made = [(i, i % 2, 0.3 + 0.01 * (i % 7) + 0.1 * (i % 2) * (i % 3), m) for i in range(60) for m in ("a", "b")]
    model, wide = training.stack(spark.createDataFrame(made, "row_id long, y_true int, p double, model string"), ["a", "b"], "row_id")
    assert wide.inputFiles()  # read from the written table, not turned again by each reader
    assert wide.count() == 60 and training.predict(model, wide, ["row_id"], "y_true").count() == 60
