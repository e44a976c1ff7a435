"""Shards, line dedup and the pipeline."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from llm_data import awkward_rows, prose, rows, texts

from tidewater.llm import hilbert, lines


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_runs_of_the_curve(awkward, nothing):
    got = hilbert.shards(awkward, "doc_id", 7).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((d for d, _ in texts()), key=repr)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    in_order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert in_order == sorted(in_order)
    assert hilbert.shards(nothing, "doc_id").count() == 0
    few = hilbert.shards(awkward.limit(3), "doc_id", 16).collect()
    assert len(few) == 3 and max(Counter(r["shard"] for r in few).values()) == 1


def test_written_shards_have_narrow_ranges(spark, tmp_path):
    rng = random.Random(4)
    table = spark.createDataFrame([(i, rng.randrange(1000), rng.randrange(1000)) for i in range(4000)], "id long, a int, b int")
    hilbert.write_shards(table, "id", str(tmp_path / "out"), shards=16, dimensions=("a", "b"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "id", "a", "b") == rows(table)
    spans = back.groupBy("shard").agg({"a": "max", "b": "max"}).join(back.groupBy("shard").agg({"a": "min", "b": "min"}), "shard")
    share = [(r["max(a)"] - r["min(a)"]) * (r["max(b)"] - r["min(b)"]) / 1e6 for r in spans.collect()]
    assert np.mean(share) < 0.2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_the_banded_test_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 10))) for _ in range(2))
        for most in range(4):
            assert lines.edits_within(a, b, most) == (distance(a, b) <= most)


def changed(rng, line, edits):
    for _ in range(edits):
        at = rng.randrange(len(line))
        line = rng.choice([line[:at] + line[at + 1:], line[:at] + "é" + line[at:], line[:at] + "q" + line[at + 1:]])
    return line


def slow_dedup(held, edits, shortest):
    first = {}
    for doc, text in sorted(held):
        for n, line in enumerate(text.split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                first[line] = min(first.get(line, (doc, n)), (doc, n))
    order = {line: int(np.uint64(xxhash.xxh64_intdigest(line.encode(), 42)).astype(np.int64)) for line in first}
    known = [line for line in first if len(line) >= shortest]
    gone = {max(a, b, key=order.get) for i, a in enumerate(known) for b in known[:i]
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    return [(doc, "\n".join(line for n, line in enumerate(text.split("\n"))
                            if line not in first or (first[line] == (doc, n) and line not in gone))) for doc, text in held]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_go_as_in_a_comparison_of_all_pairs(spark, edits):
    rng = random.Random(edits)
    base = [prose(rng, 6)[:40] for _ in range(12)]
    held = [(i, "\n".join(changed(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(4))) for i in range(30)]
    held += [(100 + i, changed(rng, base[0], 1)) for i in range(25)]
    got = lines.dedup_lines(spark.createDataFrame(held, "doc_id long, text string").repartition(4), edits, 12)
    assert rows(got) == sorted(slow_dedup(held, edits, 12), key=repr)


def test_short_lines_go_only_where_they_repeat_and_rows_of_one_id_are_told_apart(spark):
    held = [(None, "short\none\n\nshort"), (None, "a\nshort"), (4, "b\n \nshort"), (4, "c\nb"), (4, "one\nshore"), (9, "b\n\n")]
    got = lines.dedup_lines(spark.createDataFrame(held, "doc_id long, text string").repartition(3)).collect()
    out = [line for r in got for line in r["text"].split("\n")]
    assert sorted(line for line in out if line.strip()) == ["a", "b", "c", "one", "shore", "short"]
    nulls = {line for r in got if r["doc_id"] is None for line in r["text"].split("\n")}
    assert {"short", "one", "a"} <= nulls and {r["text"] for r in got if r["doc_id"] == 9} == {"\n"}


def test_line_dedup_of_awkward_rows(awkward, nothing):
    out = lines.dedup_lines(awkward)
    assert out.columns == awkward.columns and out.count() == len(awkward_rows())
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[110] == (None, None) and got[111] == ("", 0) and got[112] == (" \n\t ", 4)
    assert got[118][0] == "the same line of thirty two chars or more" and got[118][1] == len(got[118][0])
    assert got[100][0].count("\n") < awkward_rows()[40][1].count("\n") + 1 and got[3][0] is not None
    assert lines.dedup_lines(nothing).count() == 0


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the generated tables")
def test_every_stage_works_on_what_its_predecessor_kept(spark, tmp_path):
    import corpus_pipeline as P
    from tidewater.llm import packing, rules, simhash

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        held[name] = docs = spark.read.parquet(str(tmp_path / name))
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = {n: {r["doc_id"]: r["text"] for r in t.collect()} for n, t in held.items() if n != "packing"}
    assert set(kept["language"]) == {d for d, t in source.items() if any(c.isalpha() for c in t or "")}
    verdicts = rules.apply_rules(held["language"], rules.log_ratios(held["language"], spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert set(kept["quality"]) == {r["doc_id"] for r in verdicts.where("kept").collect()}
    assert sorted(kept["lines"].items()) == sorted(slow_dedup(list(kept["quality"].items()), lines.EDITS, lines.SHORTEST))
    groups = simhash.near_duplicates(held["lines"]).collect()
    assert set(kept["near_copies"]) == {r["component_id"] for r in groups}
    placed = held["packing"]
    assert {r["doc_id"] for r in placed.select("doc_id").collect()} == set(kept["near_copies"])
    assert placed.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0
    assert rows(P.run(spark, SMALL), "doc_id", "piece", "ids_crc32") == rows(placed, "doc_id", "piece", "ids_crc32")
