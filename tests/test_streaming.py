from glotspark.streaming import increments


def entries(spark, rows):
    return spark.createDataFrame(rows, increments.ENTRIES)


def values(df):
    return sorted((r.locale, r.key, r.value, r.ord) for r in df.collect())


def test_last_value_wins_and_blanks_do_not(spark):
    old = entries(spark, [("en", "a", "A", 0), ("en", "b", "", 1)])
    new = entries(spark, [("en", "a", " ", 5), ("en", "b", "B", 6), ("ja", "a", "J", 7), ("en", "b", "B2", 8)])
    assert values(increments.merged(old, new)) == [("en", "a", "A", 0), ("en", "b", "B2", 1), ("ja", "a", "J", 7)]


def test_stream(spark, tmp_path):
    incoming, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "ckpt"))
    assert increments.current(spark, table).count() == 0
    for rows in ([("en", "a", "", 0)], [("en", "a", "A", 1), ("en", "b", "B", 2)]):
        entries(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
        increments.merge_stream(spark, incoming, table, checkpoint, 1).awaitTermination()
    assert values(increments.current(spark, table)) == [("en", "a", "A", 0), ("en", "b", "B", 2)]
    assert increments.versions(spark, table) == [0, 1]
    assert values(increments.current(spark, table, before=1)) == [("en", "a", "", 0)]
