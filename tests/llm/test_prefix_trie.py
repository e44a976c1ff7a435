"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from llm_data import rows

from tidewater.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(table):
    out = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute_force(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    out = []
    for node, inside in members.items():
        ends = sorted(c for c in inside if len(convs[c]) == len(node))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed=1):
    rng = random.Random(seed)
    out = []
    for c in range(-12, 60):
        if c % 7 == 0:
            continue
        for t in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 12])):
            text = rng.choice(["same", "same", "otherwise", "é" * 5, ""]) if t < 6 else f"{rng.random()}"
            out.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    out += [(61, t, "user", f"long {t}") for t in range(150)] + [(62, t, "user", f"long {t}") for t in range(140)]
    out += [(70, None, None, None), (70, 0, "user", None), (71, 0, "", ""), (72, 3, "user", "x"), (72, 1, "user", "y"),
            (None, 1, "user", "no id"), (10**12, 0, "user", "same"), (75, 2, "user", "same"), (75, 2, "user", "same")]
    return out + [(200 + c, t, "user", f"copy {t}") for c in range(300) for t in range(10)]


def test_trie_equals_brute_force(spark):
    data = table()
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as n", "2 as k", "'x' as pos", "3 as depth").repartition(5)
    want = brute_force(conversations(data))
    assert rows(p.conversation_trie(docs), *COLUMNS) == want


def test_rebuilt_trie_equals_brute_force(spark, tmp_path):
    data = table(2)
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = p.op12_trie(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    assert rows(got) == brute_force(rebuilt(conversations(data)))


def test_one_conversation_and_none(spark, monkeypatch):
    monkeypatch.setattr(p, "CHUNK_IDS", 7)
    data = [(5, 0, "user", "x")] + [(c, 0, "user", "y") for c in range(6, 50)]
    assert rows(p.conversation_trie(spark.createDataFrame(data, SCHEMA))) == brute_force(conversations(data))
    assert p.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    tied = [(1, 4, "a", "x"), (1, 4, "b", "y"), (2, 4, "b", "y"), (2, 4, "a", "x")]
    got = p.conversation_trie(spark.createDataFrame(tied, SCHEMA)).select("depth", "n_convs").collect()
    assert sorted(map(tuple, got)) == [(0, 2), (1, 2), (2, 2)]
    assert p.conversation_trie(spark.createDataFrame([(None, None, None, None)], SCHEMA)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the generated tables")
def test_query_over_a_given_table(spark):
    held = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows(p.op12_trie(spark, "/root/testdata/sf0.01")) == brute_force(rebuilt(conversations(map(tuple, held))))
