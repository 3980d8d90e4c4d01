"""The conversation trie against a trie built in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string, d long, first string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in held.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = seqs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(seqs):
    members, kids = defaultdict(set), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))

    def below(p):
        leaves, saved = 0, (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for k in kids[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    rows = []
    for p in list(members):
        ends = ",".join(str(c) for c in sorted(seqs) if tuple(seqs[c]) == p)
        rows.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def turns_of(seed, longest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(400), 120):
        stem = c % 7
        for t in range(r.choice([1, 1, 2, 3, 5, longest])):
            said = f"turn {t} of {stem}" if t < r.randint(0, 6) or c % 11 == 0 else f"own {c} {t}"
            rows.append((c, t, r.choice(["user", "user", None]), said if r.random() < 0.95 else r.choice([None, "", "a  b\n\tc"])))
    rows += [(5000, None, "x", "last"), (5000, None, "x", "last"), (5000, 3, "", "z"), (5001, None, None, None), (None, 1, "a", "b")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "longest", "block"), [(1, 9, 64), (2, 30, 2), (3, 90, 5)])
def test_trie_matches_brute_force(spark, monkeypatch, seed, longest, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = turns_of(seed, longest)
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(sequences(rows))


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = turns_of(4, 6) + [(c, 0, "user", f"only {c}") for c in range(600, 660) if c % 20]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    seqs = rebuilt(sequences(rows))
    assert any(not s for s in seqs.values())
    assert got(queries.op11_prefix_trie(spark, str(tmp_path))) == brute(seqs)


def test_positions_are_preorder_intervals(spark):
    rows = prefix_trie.prefix_trie(frame(spark, turns_of(5, 8))).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1))
    at = {(r["conv_id"], r["depth"]): r for r in rows}
    for r in rows:
        inside = [x for x in rows if r["position"] <= x["position"] <= r["subtree_end"]]
        assert all(x["depth"] > r["depth"] for x in inside if x is not r)
        assert sum(x["n_children"] == 0 for x in inside) == r["n_leaves"]
        if r["depth"]:
            up = at[r["parent_conv_id"], r["depth"] - 1]
            assert up["position"] < r["position"] <= r["subtree_end"] <= up["subtree_end"]


def test_one_conversation_holds_most_turns_and_one_sequence_most_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(1, t, "u", f"t{t % 5}") for t in range(700)] + [(c, t, "u", f"same {t}") for c in range(-300, 0) for t in range(2)]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute_deep(sequences(rows))


def brute_deep(seqs):
    import sys

    sys.setrecursionlimit(5000)
    return brute(seqs)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")]])
def test_no_conversation_no_node(spark, rows):
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    places = prefix_trie.turn_places(frame(spark, [(4, 1, "u", "x")]))
    members = spark.createDataFrame([(4,), (2,), (3,)], "conv long")
    rows = {r["depth"]: r for r in prefix_trie.trie_nodes(places, members).collect()}
    assert (rows[0]["conv_id"], rows[0]["n_convs"], rows[0]["ends_sha256"]) == (2, 3, hashlib.sha256(b"2,3").hexdigest())
    alone = prefix_trie.trie_nodes(places.where("false"), members).collect()
    assert [(r["conv_id"], r["n_leaves"], r["n_children"]) for r in alone] == [(2, 1, 0)]
