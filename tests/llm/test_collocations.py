"""Collocations against counting every phrase directly."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import SCHEMA, awkward_rows, rows

from tidewater.llm import collocations as c

LOWER = str.maketrans({chr(u): chr(u + 32) for u in range(65, 91)})


def brute_force(table, least, top, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        covered = set()
        for g, n in able.items():
            for k in range(2, len(g)):
                covered |= {g[i:i + k] for i in range(len(g) - k + 1) if n >= f[g[i:i + k]]}
        scored = []
        for g, a in able.items():
            if g not in covered:
                score, _, left, right = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    passages = ["in the event of a fire please leave", "Released under the licence", "ünder the Ünder of", "a a a a a a"]
    out = []
    for i in range(300):
        words = [rng.choice(["the", "a", "of", "The", "é", "日本", "x1", f"w{rng.randrange(200)}", rng.choice(passages)]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n", "?!", "\x0b"]) for w in words)
        out.append((i, text, rng.choice(["en", "de", None, ""]), "s", 1))
    return out


@pytest.mark.parametrize("least, top", [(3, 2000), (20, 7), (1, 50)])
def test_collocations_equal_brute_force(spark, least, top):
    table = corpus() + awkward_rows()[:-8]
    docs = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as g", "2 as f", "'x' as phrase", "3 as n", "4 as h").repartition(5)
    assert rows(c.collocations(docs, least, top)) == brute_force([(r[1], r[2]) for r in table], least, top)


def test_query(spark, tmp_path, nothing):
    table = corpus(2) + corpus(3)
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = c.op13_collocations(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"),
        ("n", "bigint"), ("score", "bigint")]
    assert rows(got) == brute_force([(r[1], r[2]) for r in table], 100, 2000)
    assert c.collocations(nothing).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 10**11 + 7, 10**14 + 3, 3 * 10**11 + 1, 2 * 10**11 + 9
    flows = spark.createDataFrame([([1], left), ([2], right), ([1, 2], a)], "g array<long>, f long")
    got = c.lowest_cuts(flows, spark.createDataFrame([([1, 2], a, n)], "g array<long>, a long, n long")).first()
    assert got["score"] == 1000 * a * n // (left * right)


def test_runs_that_are_not_frequent_are_not_counted_one_by_one(spark, monkeypatch):
    rng, kept = random.Random(4), {}
    table = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(60)), "en", "s", 1) for i in range(400)]

    def keep(df, label, put=c.keep):
        out = put(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(c, "keep", keep)
    docs = spark.createDataFrame(table, SCHEMA).repartition(4)
    assert rows(c.collocations(docs, 5)) == brute_force([(r[1], r[2]) for r in table], 5, 2000)
    # Nearly all of 2,500 pairs are frequent, hardly any of some 20,000 longer runs.
    assert kept["edges"] < 4000


def test_full_buckets_and_small_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "FEWEST_BITS", 13)
    monkeypatch.setattr(c, "MOST_BITS", 13)
    monkeypatch.setattr(c, "HELD", 100)
    monkeypatch.setattr(c, "SPELLED", 3)
    table = corpus(5)
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert rows(c.collocations(docs, 3)) == brute_force([(r[1], r[2]) for r in table], 3, 2000)


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter_phrases_only(spark, longest):
    table = corpus(6)
    docs = spark.createDataFrame(table, SCHEMA)
    assert rows(c.collocations(docs, 4, 2000, longest)) == brute_force([(r[1], r[2]) for r in table], 4, 2000, longest)


def test_packed_buckets_come_back():
    rng = np.random.default_rng(3)
    for n, below in ((0, 9), (1, 9), (500, 9), (500, 1 << 28)):
        buckets = np.sort(rng.integers(0, below, n).astype(np.uint32))
        assert c.unpacked(c.packed(buckets)).tolist() == buckets.tolist()


def test_tally_is_the_same_however_often_it_merges(monkeypatch):
    monkeypatch.setattr(c, "TALLY", 5)
    rng, tally, seen = np.random.default_rng(1), c.Tally(2), Counter()
    total = Counter()

    def take():
        runs, counts = tally.take()
        assert (runs[:, 0] == runs[:, 1]).all()
        seen.update(dict(zip(runs[:, 0].tolist(), counts.tolist())))

    for _ in range(50):
        values = rng.integers(0, 40, 30).astype(np.uint64)
        total.update(values.tolist())
        if tally.add(np.stack([values, values], 1)):
            take()
    take()
    assert seen == total
