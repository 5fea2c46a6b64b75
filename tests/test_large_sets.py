"""Large sets are compared by blocks, not by their subsets."""

from weftline.operators import predictions


def test_large_sets_make_no_subsets(spark):
    row = spark.createDataFrame([(1, [f"t{i}" for i in range(10)]), (2, ["a", "b"])], "id long, c array<string>")
    assert {x["id"] for x in predictions._subsets(row, "id").collect()} == {2}
