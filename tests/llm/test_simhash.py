import random

import numpy as np
import xxhash
from llm_data import awkward_rows, rows
from tidewater.llm import graph, simhash


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, most=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= most) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(values))]


def test_every_row_has_the_fingerprint_and_component_of_brute_force(awkward):
    held = sorted(awkward_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [slow_print(r[1]) for r in held]
    parts = slow_components(prints)
    want = sorted(((r[0], p - (1 << 64) if p >> 63 else p, held[c][0]) for r, p, c in zip(held, prints, parts)), key=repr)
    assert rows(simhash.near_duplicates(awkward)) == want


def test_clouds_of_near_prints_are_joined_exactly(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    parts = slow_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = dict(map(tuple, graph.components(simhash.links(frame)).collect()))
    names = {}
    for p, c in zip(signed, parts):
        assert names.setdefault(c, roots.get(p, p)) == roots.get(p, p)
    assert len(set(names.values())) == len(set(parts))


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (0, 1)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, graph.components(frame).collect())) == \
        {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}
    assert graph.components(frame.where("false")).count() == 0


def test_one_of_each_keeps_the_first_and_all_columns(awkward, nothing):
    out = simhash.one_of_each(awkward)
    assert out.columns == awkward.columns
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(awkward).collect()}
    want = sorted(d for d, c in groups.items() if d is not None and d == c)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == want
    assert simhash.one_of_each(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_no_expanded_table_goes_through_the_driver(spark, monkeypatch):
    """Tables far below the broadcast limit by Spark's estimate, which does not know the 64 rows a fingerprint makes."""
    plans = []

    def watched(name, owner):
        real = getattr(owner, name)

        def keep(*args):
            plans.append((args[-1], args[-2]._jdf.queryExecution().executedPlan().toString()))
            return real(*args)

        monkeypatch.setattr(owner, name, keep)

    watched("keep", simhash)
    watched("keep", simhash.Scratch)
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63) >> 3 << 3 | j,) for i in range(50) for j in (0, 1)], "fp long")
    assert simhash.links(prints).count() >= 50
    assert len(plans) > 5 and [label for label, plan in plans if "BroadcastExchange" in plan] == []
