"""Pairs by rarest elements: none that is alike is lost, few others come."""

import random

from tidemark.llm.prefix_pairs import set_pairs


def test_set_pairs_lose_nothing(spark):
    rng = random.Random(21)
    sets = []
    for size in (1, 2, 5, 40, 200):  # copies of one set with edits of their own, of which some repeat, up to about the threshold; lengths differ too
        base = rng.sample(range(10**6), size)
        for _ in range(40):
            own = set(base)
            for x in rng.sample(base, rng.randrange(1 + size // 6)):
                own.discard(x)
            own |= {rng.choice([rng.randrange(10**6), 2_000_000 + rng.randrange(30)]) for _ in range(rng.randrange(1 + size // 6))}
            sets.append(sorted(own))
    component = [rng.randrange(30) for _ in sets]
    rest = [rng.random() < 0.6 for _ in sets]
    nodes = spark.createDataFrame([(i, component[i], rest[i]) for i in range(len(sets))], "node long, component long, rest boolean").repartition(3)
    held = spark.createDataFrame([(i, s) for i, s in enumerate(sets) if s], "node long, held array<long>").repartition(3)
    for alike in (0.8, 0.5):
        got = {(r.a, r.b) for r in set_pairs(nodes, held, alike).collect()}
        may = [(a, b) for b in range(len(sets)) for a in range(b) if component[a] != component[b] and (rest[a] or rest[b])]
        want = {(a, b) for a, b in may if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= alike * len(set(sets[a]) | set(sets[b]))}
        assert want <= got <= set(may) and len(want) > 500
        assert len(got) <= 1.5 * len(want)
    assert set_pairs(nodes.limit(0), held, 0.8).count() == 0 and set_pairs(nodes, held.limit(0), 0.8).count() == 0
