"""Visits against a queue in Python."""

from collections import defaultdict, deque

import numpy as np
import pytest

from tidemark.operators import frontier as R
from tidemark.plans import collection_plans as P


def queue(homes, pages, links, depth, budget):
    pages, out_links, seen_rows = set(pages), defaultdict(list), []
    for host, path, pos, target in sorted(links, key=lambda x: x[2]):
        out_links[host, path].append(target)
    for host, home in homes:
        seen, todo, n = {home}, deque([(home, 0)]), 0
        while todo:
            path, level = todo.popleft()
            if level > depth or n >= budget:
                seen_rows.append((host, path, level, None, "depth" if level > depth else "budget"))
                continue
            seen_rows.append((host, path, level, n, "visited" if (host, path) in pages else "missing"))
            n += 1
            for target in out_links[host, path] if (host, path) in pages else ():
                if target not in seen:
                    seen.add(target)
                    todo.append((target, level + 1))
    return sorted(seen_rows, key=lambda r: r[:3])


@pytest.mark.parametrize("depth,budget", [(3, 7), (2, 100), (9, 1)])
def test_visits_match_a_queue(spark, depth, budget):
    rng = np.random.default_rng(depth)
    pages = [(f"h{h}", f"/{i}") for h in range(4) for i in range(40) if (i + h) % 9 or i == 0]
    links = [(h, p, pos, f"/{int(t)}") for h, p in [*pages, ("h1", "/gone")] for pos, t in enumerate(rng.integers(0, 45, int(rng.integers(0, 5))))]
    homes = [(f"h{h}", "/0") for h in range(4)] + [("empty", "/0")]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = R.visits(make(homes, "host string, path string"), make(pages + pages[:3], "host string, path string"), make(links, "host string, path string, pos int, target string"), depth, budget)
    want = queue(homes, pages, links, depth, budget)
    # where a budget ends within a level, deeper pages are never noted by either
    assert sorted((tuple(r) for r in got.select("host", "path", "level", "place", "outcome").collect()), key=lambda r: r[:3]) == want


def test_query_matches_a_queue(spark):
    frames = P.page_graph(spark, "/root/testdata/sf0.001")
    want = queue(*([tuple(r) for r in f.collect()] for f in frames), 3, 12)
    got = P.frontier_visits(spark, "/root/testdata/sf0.001").select("host", "path", "level", "place", "outcome").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:3]) == want and len({r.level for r in got}) > 1
