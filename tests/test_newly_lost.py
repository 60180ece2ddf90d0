from loomspan.plans import catalog


def test_users_newly_reached_and_lost_over_all_events(spark, tmp_path):
    rows = [(i, u, v) for i, u, v in [(0, 1, 70.0), (2, 2, 10.0), (3, 2, 10.0), (700, 3, 70.0), (701, 4, 61.0), (702, 5, 90.0), (703, 5, 90.0), (4, 6, 60.0), (705, 1, 50.0)]]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["agg22_newly_lost_users"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "lost"), (3, "lost"), (4, "newly")]
