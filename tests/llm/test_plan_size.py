"""What the driver holds of a plan does not grow with the tables a plan looks up."""
from colloquy.llm import line_sets


def test_rarity_is_in_no_text_of_a_plan_and_in_no_row(spark):
    docs = spark.createDataFrame([(1, "red green blue\nred green"), (2, "one two three")], "doc_id long, text string")
    marked = line_sets._marked(line_sets._lines(docs, "doc_id", "text"), line_sets._rarity(docs.select("text")), 0.8)
    run = marked._jdf.queryExecution()
    assert len(run.toString()) < line_sets.CELLS // 8
    assert "AS table" not in run.optimizedPlan().toString()
    assert sorted(len(r.own["keys"]) for r in marked.collect()) == [0, 0, 1]
