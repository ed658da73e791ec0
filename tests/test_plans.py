"""Plan-shape tests: the physical plans we rely on at scale."""

from pyspark.sql import functions as F

from terrapanel.operators.lookup import season_calendar, season_lookup
from terrapanel.operators.windows import panel_lookback
from terrapanel.sources.tables import readings, table

from sample_paths import SF_SMALL


def _plan(df):
    """The plan that ran: executed once, the final adaptive part of it."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plan = execution.executedPlan().toString()
    if "AdaptiveSparkPlan" in plan:
        assert "isFinalPlan=true" in plan
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def test_dimension_lookup_is_broadcast(spark):
    r = readings(spark, SF_SMALL).withColumn("Month", F.lit("JAN"))
    plan = _plan(season_lookup(r, season_calendar(spark)))
    assert "BroadcastHashJoin" in plan


def test_panel_window_and_dedupe_share_one_exchange(spark):
    r = readings(spark, SF_SMALL)
    out = panel_lookback(r, "moisture", dedupe=True)
    plan = _plan(out)
    # one hash exchange on the panel keys feeds both the dedupe and the window
    hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning(state" in line]
    assert len(hashed) == 1, plan
    assert "SinglePartition" not in plan


def test_cut_panels_shuffle_the_rows_once(spark):
    r = readings(spark, SF_SMALL)
    for dedupe in (False, True):
        plan = _plan(panel_lookback(r, "moisture", pieces=2000, samples=4, dedupe=dedupe))
        assert "SinglePartition" not in plan
        assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(state" in line and "_piece" in line]) == 1, plan
        assert "BroadcastHashJoin" in plan


def test_small_derived_tables_do_not_move_the_fact_rows(spark):
    """Shares, codes, fences, class sizes and latest years: no exchange of the fact rows on their few keys."""
    from terrapanel.operators.latest import latest_non_null
    from terrapanel.operators.lookup import category_code, frequency_encode
    from terrapanel.operators.sampling import sample_per_class, stratified_split

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # only what was counted is broadcast
    try:
        r = readings(spark, SF_SMALL)
        plan = _plan(category_code(frequency_encode(r, "state", "f"), "district", "d"))
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan
        assert "SortMergeJoin" not in _plan(latest_non_null(r, ["state", "district"], ["moisture"]))
        docs = table(spark, SF_SMALL, "documents").select("doc_id", F.col("lang").alias("label"))
        assert "Exchange hashpartitioning(label" not in _plan(stratified_split(docs, "label", ["doc_id"]))
        assert "WindowGroupLimit" in _plan(sample_per_class(docs, "label", ["doc_id"], 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_and_columns_reach_the_scan(spark):
    li = table(spark, SF_SMALL, "lineitem").where(F.col("l_quantity") > 10).select("l_quantity", "l_tax")
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_year_split_prunes_partitions(spark, tmpdir_path):
    from terrapanel.sources.files import write_table

    r = readings(spark, SF_SMALL)
    path = f"{tmpdir_path}/readings"
    write_table(r, path, partition_by=["Year"])
    part = spark.read.parquet(path).where(F.col("Year") == 1999)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan and "(Year#" in plan
    assert part.count() == r.where(F.col("Year") == 1999).count()


def test_no_registered_query_plans_a_cross_join(spark):
    """No Cartesian product or nested-loop join in any registered query (the
    tree-model fits are skipped for time; their scoring plans are joins by key)."""
    from terrapanel.plans.catalog import QUERIES

    skip = {"model_random_forest", "model_gbt_a", "model_gbt_b", "model_classifier_report", "model_ranking"}
    bad = []
    for name, fn in QUERIES.items():
        if name in skip:
            continue
        plan = _plan(fn(spark, SF_SMALL))
        bad += [(name, k) for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
    assert bad == []


def test_rows_meet_few_bounds_of_their_panel_and_carry_none(spark):
    """Pieces come from two joins by key and bounds, not from arrays of all cuts that each row searches."""
    from terrapanel.operators.windows import _panel_cuts, _with_piece

    order = ["Year", "Month_num", "Day", "row_id"]
    r = spark.range(0, 3000).selectExpr("'S' as state", "string(id % 2) as district", "2020 as Year", "1 as Month_num", "1 as Day", "id as row_id")
    cuts = _panel_cuts(r.where("district = '0'"), ["state", "district"], order, 64, 8)
    out = _with_piece(r, cuts, ["state", "district"], order)
    plan = _plan(out)
    assert "lambdafunction" not in plan and plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in plan, plan
    starts = [c.k3.v for c in cuts.first()["_cuts"]]
    assert len(starts) > 40
    for x in out.collect():
        assert x["_piece"] == (sum(s <= x.row_id for s in starts) if x.district == "0" else None)
