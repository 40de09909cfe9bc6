"""Several results of one docket run the joins behind its positions once."""
import pytest

from colloquy.plans import registry
from colloquy.plans.docket import Docket
from conftest import SMALL


@pytest.mark.parametrize("name,scans", [("signal_cards", 0), ("result_count", 0), ("clean_docket_violations", 0), ("violations", 1)])
def test_positions_are_read_from_where_they_were_written(spark, name, scans):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan parquet" in line and "l_orderkey" in line for line in plan.splitlines()) == scans


def test_claims_and_guard_share_their_rows(spark, monkeypatch):
    kept, made = Docket.kept, []
    monkeypatch.setattr(Docket, "kept", lambda self, *columns: made.append(columns) or kept(self, *columns))
    assert registry.QUERIES["evidence_guard"](spark, SMALL).count() and len(made) == 1
