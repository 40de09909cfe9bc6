"""Memory of the Python workers, which live on from task to task."""
import subprocess
import sys
import tracemalloc

import pyarrow as pa
import pytest

from colloquy.llm import toxicity


def test_few_texts_of_a_batch_are_python_strings():
    model = toxicity.Model({"vile": 2.0, "scum": 1.5, "scum-": 0.5}, -1.0)
    words = [f"w{i}" for i in range(700)]
    texts = pa.array([" ".join(words[i % 9:]) + (" vile" if i % 2 else " scumbag") if i % 50 else None for i in range(10_000)])
    tracemalloc.start()
    batch = toxicity.scores(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 30e6 and peak < 8e6
    assert batch.to_pylist()[:200] == pytest.approx([model.score(t) for t in texts.slice(0, 200).to_pylist()])


def test_scores_by_column_equal_plain_scores(spark):
    model = toxicity.Model({"vile": 2.0, "kind": -1.5}, 0.25)
    docs = [(1, "vile words"), (2, None), (3, ""), (4, "Kind and vile"), (5, "kind\nkind")]
    got = {r.id: r.s for r in spark.createDataFrame(docs, "id long, text string").withColumn("s", toxicity.toxicity(toxicity.F.col("text"), model)).collect()}
    assert got == pytest.approx({i: model.score(t) for i, t in docs})


HELD = """
import re
import pyarrow as pa
from colloquy.llm.blocks import give_back

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

give_back()
before = held()
tables = [pa.table({"x": pa.array([str(i) * 90 for i in range(40_000)])}) for _ in range(8)]
most = held()
del tables
kept = held()
give_back()
print(before, most, kept, held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_blocks_go_back_to_the_system():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout
    before, most, kept, after = map(float, out.split())
    assert most - before > 100 and after - before < (most - before) / 4 and after < 0.7 * kept
