"""Tasks grow in number with the docket, not in size."""
import pytest

from colloquy.operators import assemble, skew, stats
from colloquy.plans import registry
from colloquy.plans.docket import Docket
from conftest import SMALL


@pytest.mark.parametrize("rows,tasks", [(None, None), (0, None), (800, None), (801, 9), (5_000, 50)])
def test_more_rows_make_more_tasks(spark, monkeypatch, rows, tasks):
    monkeypatch.setattr(skew, "ROWS_A_TASK", 100)
    df = spark.range(1000)
    dealt = skew.dealt_by_size(df, rows, "id")
    assert (dealt is df) if tasks is None else dealt.rdd.getNumPartitions() == tasks
    assert dealt.count() == 1000


def test_rollup_runs_in_as_many_tasks_as_the_docket_needs(spark, monkeypatch):
    size = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(skew, "ROWS_A_TASK", size // 40)
    docket = Docket.from_driver_tables(spark, SMALL)
    dealt = docket.dealt(docket.positions, "submission_id")
    assert docket.size == size and dealt.rdd.getNumPartitions() == -(-size // (size // 40))
    assert assemble.question_rows(docket.linked).count() and stats.commenter_rollup(docket.question_rows).count()


@pytest.mark.parametrize("name", ["stance_distribution", "snapshot"])
def test_results_do_not_depend_on_the_number_of_tasks(spark, monkeypatch, name):
    whole = sorted(registry.QUERIES[name](spark, SMALL).collect())
    monkeypatch.setattr(skew, "ROWS_A_TASK", 200)
    assert sorted(registry.QUERIES[name](spark, SMALL).collect()) == whole and whole
