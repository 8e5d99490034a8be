"""Components of links: against plain union, and how many tasks they take."""

import random

import pytest

from wardstone.llm.components import EDGES, components


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {(x, find(x)) for x in root if find(x) != x}


def graphs():
    rng = random.Random(5)
    yield []
    yield [(7, 7), (3, 3)]
    yield [(i, i + 1) for i in range(60)]  # a chain
    yield [(500 - i, 499 - i) for i in range(40)] + [(-(2**63), 2**63 - 1), (2**63 - 1, 460)]
    yield [(1000, i) for i in range(80)] + [(2000, i) for i in range(79, 120)]  # stars whose centres are not the least
    yield [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] * 2


@pytest.mark.parametrize("links", list(graphs()), ids=range(6))
def test_components_are_those_of_plain_union(spark, links):
    rows = components(spark.createDataFrame(links, EDGES)).collect()
    assert len(rows) == len(set(rows))
    assert {(r.node, r.root) for r in rows} == plain([x for x in links if x[0] != x[1]])


def test_few_links_take_few_tasks_whatever_the_partitions(spark):
    links = [(1000, i) for i in range(80)] + [(2000 + i, 2000) for i in range(40)]
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "components")
        rows = components(spark.createDataFrame(links, EDGES)).collect()
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.root) for r in rows} == plain(links)
    assert tasks < 211
