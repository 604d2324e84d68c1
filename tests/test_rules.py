"""Integrity rules hold a share of the rows in a task, whatever keys they share."""

from graphloom.operators import rules


def test_rows_that_share_a_key_stay_where_they_are(spark):
    """200,000 rows of one key of two, one of them missing in what is known: keys meet, rows don't."""
    rows = spark.range(200_000).selectExpr("id", "if(id = 7, 'gone', if(id = 9, null, 'here')) as k")
    known = spark.createDataFrame([("here",), ("here",), ("there",)], "name string")
    assert sorted(r.id for r in rules.lost(rows, "k", known, "name").collect()) == [7, 9]
    listed = rows.selectExpr("id", "array(k, 'here') as ks")
    assert sorted(r.id for r in rules.lost_members(listed, "id", "ks", known, "name").collect()) == [7, 9]


def test_groups_are_dealt_over_all_partitions(spark):
    """No step counts rows before they are dealt, and what is dealt is not put together again."""
    rows = spark.range(50_000).selectExpr("if(id = 3, 4, id) as k")
    found = rules.repeated(rows, "k")
    assert [tuple(r) for r in found.collect()] == [(4, 2)]
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
