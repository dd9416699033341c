from pyspark.sql import functions as F

from tallygrid.functions.display import accounting


def test_a_negative_zero_is_no_negative_number(spark):
    df = spark.createDataFrame([(0, -0.0), (1, 0.0), (2, -0.4), (3, 0.4), (4, -1.5), (5, None)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(accounting(F.col("x"))).collect()] == ["0", "0", "(0)", "0", "(2)", None]
