from vellum.plans.monitor import conversation_last_turns


def test_last_turns_by_instant(spark, tmp_path):
    rows = [
        ("t", "a", "2000-01-01T12:30:00+02:00"),  # 10:30
        ("t", "b", "2000-01-01 11:00:00"),
        ("t", "c", "2000-01-01T10:45:00.000Z"),
        ("t", "d", "2000-01-01T10:45:00+00:00"),
        ("t", "d", "2000-01-01T10:45:00+00:00"),
        ("t", "e", None),
        ("u", "x", None),
        ("u", "y", "later"),
        ("u", "z", "2000-01-01T00:00:00Z"),
    ]
    spark.createDataFrame(rows, "thread_id string, step_id string, created_at string").write.parquet(f"{tmp_path}/chat_steps.parquet")
    found = sorted((r["thread_id"], r["place"], r["step_id"]) for r in conversation_last_turns(spark, str(tmp_path)).collect())
    assert found == [("t", 1, "b"), ("t", 2, "d"), ("t", 3, "c"), ("u", 1, "z"), ("u", 2, "y"), ("u", 3, "x")]
