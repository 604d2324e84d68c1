"""What rounds of joins send to the driver doesn't follow the size of the tables."""

import gc
import weakref

from graphloom.llm import exchange
from graphloom.operators import graph, scans
from graphloom.storage import stored


def sent(spark, job):
    """(what job gives, most bytes that the tasks of one of its stages sent to the driver)."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}

    before, out = stages(), job()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, max(v for k, v in stages().items() if k not in before)


def test_rounds_send_little_to_the_driver(spark):
    """Strong components of 60,000 nodes: rings of three, four of them in a row."""
    nodes = stored(spark.range(60_000).toDF("node_id"), "nodes")
    ring = nodes.selectExpr("node_id as a", "node_id - node_id % 3 + (node_id + 1) % 3 as b")
    on = nodes.where("node_id % 3 = 0 and floor(node_id / 3) % 4 < 3").selectExpr("node_id as a", "node_id + 3 as b")
    found, size = sent(spark, lambda: graph.condensed_ranks(nodes, ring.union(on)).selectExpr("count(*) as n", "sum(int(scc = node_id - node_id % 3)) as same", "sum(int(rank = floor(node_id / 3) % 4)) as ranked").first())
    assert (found["n"], found["same"], found["ranked"]) == (60_000, 60_000, 60_000)
    assert size < 400e3, size


def test_ranges_sample_little(spark):
    rows = spark.range(200_000).selectExpr("id % 7 as g", "sha2(string(id), 256) as k", "1 as one")
    out, size = sent(spark, lambda: stored(scans.running(rows, ["g"], ["k"]), "placed").where("idx = n").count())
    assert out == 7 and size < 100e3, size


def test_settings_of_the_session_come_back(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.execution.rangeExchange.sampleSizePerPartition")
    before = [spark.conf.get(n, None) for n in names]
    stored(spark.range(3).toDF("k"), "few")
    assert [spark.conf.get(n, None) for n in names] == before


def test_corpus_tables_leave_no_garbage_with_the_driver(spark):
    """What a job held in a cycle is gone when its table is stored."""

    class Held:
        pass

    held = Held()
    held.me, held.df = held, spark.range(5)
    gone = weakref.ref(held)
    del held
    gc.disable()
    try:
        out = exchange.stored(spark.range(3).toDF("k"), "few")
        assert gone() is None and out.count() == 3
    finally:
        gc.enable()
