import random

from codeweave.llm.links import components


def by_hand(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return sorted((x, top(x)) for x in up)


def test_components(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1000 + k) for k in range(1, 30)]
    mixed = [(r.randrange(2000, 2080), r.randrange(2000, 2080)) for _ in range(60)]
    for links in (chain + star + mixed + [(5, 5), (None, 3), (4, None), (7, 8), (7, 8)], []):
        got = components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(tuple(x) for x in got.collect()) == by_hand(links)
