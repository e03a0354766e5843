from litlens.operators import labels as L
from litlens.operators import trends as T
from litlens.plans.catalog import QUERIES
from litlens.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_screen_filter_reaches_the_scan(spark):
    p = spark.read.parquet(f"{SF}/documents.parquet")
    plan = _plan(p.filter("source = 'src1'").select("doc_id"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_resolution_joins_vocabulary_by_broadcast(spark):
    plan = _plan(L.resolve_answers(X.responses(spark, SF), X.vocabulary(spark)))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert "partial_min" in plan  # map-side combine before the shuffle


def test_fixture_fan_out_has_no_join(spark):
    plan = _plan(X.responses(spark, SF))
    assert "Join" not in plan and "Generate" in plan


def test_trend_windows_run_on_aggregates(spark):
    r = T.top_label_per_decade(X.papers(spark, SF), L.resolve_answers(X.responses(spark, SF),
                                                                      X.vocabulary(spark)))
    plan = _plan(r)
    assert plan.index("Window") < plan.index("HashAggregate")  # window above the aggregation


def test_no_query_pairs_rows(spark):
    """No registered query plans a cross product or a nested-loop join."""
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_resolution_is_hash_aggregated(spark):
    plan = _plan(L.resolve_answers(X.responses(spark, SF), X.vocabulary(spark)))
    assert "SortAggregate" not in plan


def test_votes_and_stream_are_hash_aggregated(spark):
    for name in ("majority_vote", "technique_invalid", "stream_resolve"):
        assert "SortAggregate" not in _plan(QUERIES[name](spark, SF)), name


def test_every_query_reads_the_given_tables(spark):
    """Each registered query scans the test tables (its work grows with them)."""
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF))
        assert "FileScan parquet" in plan or "Scan parquet" in plan, name
