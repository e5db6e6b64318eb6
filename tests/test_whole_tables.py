from pyspark.sql import functions as F

from specloom.plans.registry import QUERIES
from specloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_queries_over_all_rows(spark):
    queue = [(r.o_orderdate, r.o_orderkey) for r in QUERIES["o_review_queue_whole"](spark, SF).collect()]
    assert queue == sorted(queue) and len(queue) == table(spark, SF, "orders").filter("o_orderstatus = 'O'").count() > 50
    assert QUERIES["x_dimensions_all"](spark, SF).count() == table(spark, SF, "part").count()
    assert not QUERIES["j_catalog_overlay_lines"](spark, SF).filter(F.col("line") > 2).isEmpty()
