"""What references are made of is made once, and none of it is sent whole to the driver."""

from loomline.operators import guidance
from loomline.plans import text_queries as q


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_edges_and_dead_references_take_texts_apart_once(spark, sf_dir):
    _, edges, dead = q._edges(spark, sf_dir)
    for df in (edges, dead):
        assert "part.parquet" not in plan(df) and "regexp_extract_all" not in plan(df)
        assert "BroadcastHashJoin" not in plan(df)


def test_reached_files_are_rolled_up_without_broadcast(spark):
    index = guidance.written(spark.createDataFrame([("r", "a.py", "a.py", False)], "repo_id string, path string, base string, is_dir boolean"), "index")
    reached = guidance.written(spark.createDataFrame([("r", "a.py", 1, "CLAUDE.md", "reference")], "repo_id string, node string, hop int, via string, kind string"), "reached")
    assert "BroadcastHashJoin" not in plan(guidance.file_rollup(index, reached))
