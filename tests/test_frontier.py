import random
import shutil

import pytest
from factloom.streaming import frontier
from pyspark.sql import functions as F


def brute(seeds, links, pages, max_depth, budget, wanted):
    """One node at a time from a list kept in order."""
    waiting, seen, out, fetched, found = [], set(), [], 0, 0

    def add(node, depth):
        if node not in seen and (node not in pages or pages[node]["allow"]):
            seen.add(node)
            waiting.append((depth, -(pages[node]["s"] if node in pages else 0), node))

    for s in seeds:
        add(s, 0)
    while waiting and fetched < budget and not (wanted and found >= wanted):
        waiting.sort()
        depth, _, node = waiting.pop(0)
        out.append((node, depth))
        if node in pages:
            fetched += 1
            found += pages[node]["c"]
            if depth < max_depth:
                for src, dst in links:
                    if src == node:
                        add(dst, depth + 1)
    return out


@pytest.fixture(scope="module")
def web(spark):
    r = random.Random(2)
    nodes = [f"n{i:02d}" for i in range(60)]
    pages = {n: {"allow": r.random() < 0.85, "c": r.random() < 0.3, "s": r.randrange(4)} for n in nodes if r.random() < 0.8}
    links = [(a, b) for a in nodes for b in r.sample(nodes, 6)] + [("n00", None)]
    frames = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(n, p["allow"], p["c"], p["s"]) for n, p in pages.items()], "node string, a boolean, c boolean, s int")
    seeds = [n for n in nodes if pages.get(n, {}).get("allow")][:2]
    return seeds, links, pages, *frames


def run(spark, path, web, depth, budget, wanted=0, **kw):
    seeds, _, _, links, pages = web
    out = frontier.discover(spark, path, spark.createDataFrame([(s,) for s in [*seeds, None]], "node string"), links, pages, frontier.Rules(depth, budget, wanted), allow=lambda p: F.col("a"), candidate=lambda p: F.col("c"), score=lambda p: F.col("s"), **kw)
    return [(r.node, r.depth) for r in out.orderBy("place").collect()]


@pytest.mark.parametrize(("depth", "budget", "wanted", "nodes"), [(2, 1000, 0, 1000), (3, 9, 0, 4), (3, 1000, 5, 1000), (0, 5, 0, 5)])
def test_as_one_at_a_time(spark, web, tmp_path, depth, budget, wanted, nodes):
    seeds, links, pages, *_ = web
    assert run(spark, str(tmp_path / "f"), web, depth, budget, wanted, round_nodes=nodes) == brute(seeds, links, pages, depth, budget, wanted)


def test_resumed_and_killed_runs_equal_one(spark, web, tmp_path):
    path, whole = str(tmp_path / "f"), run(spark, str(tmp_path / "g"), web, 3, 12)
    assert run(spark, path, web, 3, 5) == whole[: len(run(spark, path, web, 3, 0))]
    last = sorted((tmp_path / "f").iterdir())[-1]
    (last / "_SUCCESS").unlink()  # the last round was killed
    before = len(frontier.rounds(spark, path))
    left = 12 - frontier.visited(spark, path).where("fetched").count()
    assert run(spark, path, web, 3, left, round_nodes=3) == whole and len(frontier.rounds(spark, path)) > before
    assert frontier.pending(spark, path).count() > 0


def test_nothing_to_visit(spark, web, tmp_path):
    _, _, _, links, pages = web
    none = spark.createDataFrame([], "node string")
    assert frontier.discover(spark, str(tmp_path / "e"), none, links, pages, frontier.Rules(2, 5)).count() == 0
    assert frontier.visited(spark, str(tmp_path / "missing")) is None
    shutil.rmtree(tmp_path / "e")
