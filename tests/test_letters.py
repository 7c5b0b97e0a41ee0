"""Letters of numbers beyond three letters, by the query and up to the largest BIGINT."""

from pyspark.sql import functions as F

from pagemill.functions import numbering as num
from pagemill.plans import scalar


def letters(n):
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def test_letters_of_any_length(spark, tmp_path):
    keys = [1, 26, 27, 702, 703, 18278, 18279, 20000, 475254, 475255, 2**31, 2**53 + 1, 26**13, 2**63 - 1]
    d = spark.createDataFrame([(k,) for k in keys], "p_partkey long")
    assert [r[0] for r in d.select(num.letters(F.col("p_partkey"))).collect()] == [letters(k) for k in keys]
    d.write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey: r.a for r in scalar.QUERIES["fn_alpha26"](spark, str(tmp_path)).collect()} == {k: letters(k) for k in keys}
