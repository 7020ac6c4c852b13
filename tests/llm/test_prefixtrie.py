"""The prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from rankwell.llm import prefixtrie

TURNS = "conv_id long, turn long, role string, text string, d int, key string"


def plain(rows):
    """Sorted rows of the trie in plain Python."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * words
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    out = [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(ends[n])) for n, m in members.items()]
    return sorted(out, key=repr)


def trie(spark, rows):
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr)


def test_trie_against_plain(spark):
    """Shared openings, copies, null and repeated turn numbers, null roles, texts and ids, repeated rows, negative ids."""
    r = random.Random(5)
    rows = []
    for c in [*range(-30, 130), 2_000, 1_000_000_007]:
        for turn in range(r.randrange(0, 7)):
            number = None if r.random() < 0.05 else r.choice([turn, turn, turn, 2])
            rows.append((c, number, r.choice(["user", "assistant", None]), r.choice(["a b", "a", "", None, "x\ty é"]), 1, "k"))
    rows += r.sample(rows, 30) + [(None, 0, "user", "a", 1, "k")]
    got = trie(spark, rows)
    assert got == plain(rows) and len(got) > 200


def test_trie_copies_and_chain(spark):
    """A third of the conversations is one and the same, across ranges of ids; one has 300 turns; ids like 3:ab differ from ab."""
    rows = [(c, t, "user", f"t{t}", 1, "k") for c in range(0, 3000, 2) for t in range(4)]
    rows += [(7001, t, "user", "a b c", 1, "k") for t in range(300)]
    rows += [(8000, 0, "ab", "c", 1, "k"), (8020, 0, "a", "bc", 1, "k"), (8040, 0, "abc", "", 1, "k")]
    assert trie(spark, rows) == plain(rows)


def test_trie_levels(spark):
    """A full binary trie: as many levels of light paths as the logarithm of the conversations."""
    rows = [(20 * c, t, "user", str(c >> t & 1), 1, "k") for c in range(64) for t in range(6)]
    got = trie(spark, rows)
    assert got == plain(rows) and got[-1][1] == 6 and len(got) == 127


def test_trie_empty(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefixtrie.prefix_trie(none).count() == 0
    assert prefixtrie.prefix_trie(none.unionByName(spark.createDataFrame([(None, 1, "u", "x", 1, "k")], TURNS))).count() == 0


def test_trie_of_text_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 1, "k")], TURNS).withColumn("path", F.lit("x"))
    assert prefixtrie.prefix_trie(df).count() == len(plain([(1, 0, "user", "a")]))
