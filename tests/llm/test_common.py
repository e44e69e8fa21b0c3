import random

import numpy as np

from judgefuse.llm.common import Forest, WordHash, components, give_back, gram_hashes


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 400)]                       # a hub
    edges += [(1000 + i, 1001 + i) for i in range(60)]            # a long chain
    edges += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)]
    edges += [(5, 5), (7, 3000), (3000, 7), (3000, 1030)]         # a loop, repeats and a bridge
    forest = Forest()
    for a, b in edges:
        forest.unite(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: forest.find(i) for e in edges for i in e if e[0] != e[1]}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gram_hashes():
    h = WordHash().of([b"a", b"b", b"a", b"b", b"a", b"c"])
    g = gram_hashes(h, 3)
    assert len(g) == 4 and g[0] == g[2] and len(np.unique(g)) == 3
    assert len(gram_hashes(h, 7)) == 1 and len(gram_hashes(h[:0], 3)) == 0
    assert gram_hashes(h[:2], 3) != gram_hashes(h[:1], 3)


def test_freed_memory_is_given_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    small = [np.ones(8000) for _ in range(8000)]  # 512 MB in pieces of the allocator's heap
    last = small[-1]
    del small
    held = resident()
    give_back()
    assert held - resident() > 300 << 20 and len(last) == 8000
