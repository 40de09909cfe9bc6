"""A sort runs in as many tasks as its rows need, in the same order."""
from pyspark.sql import functions as F

from colloquy.operators import assemble, skew
from colloquy.plans.docket import Docket
from conftest import SMALL


def test_reading_order_does_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    linked = Docket.from_driver_tables(spark, SMALL).linked.filter("hash(position_id) % 4 = 0").localCheckpoint()
    whole = assemble.positions_by_question(linked).collect()
    monkeypatch.setattr(skew, "ROWS_A_TASK", 100)
    dealt = assemble.positions_by_question(linked, 2_000)
    assert dealt.collect() == whole and whole
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 8
