import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from careloom.llm.conversations import prefix_trie
from careloom.llm.radix import RadixTree

SCHEMA = "conv_id long, turn long, role string, text string, depth string, hi int, key binary, n_convs array<int>"


def brute(rows, every=20):
    """Nodes by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, mark, (role, text)))
    own = {c: [x[3] for x in sorted(xs)] for c, xs in own.items()}
    built = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if every else 0
        built[c] = own.get(c - c % every, [])[:h] + xs[h:] if every else xs
    members = defaultdict(list)
    for c, xs in built.items():
        for d in range(len(xs) + 1):
            members[tuple(xs[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += k not in children
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.add((min(m), len(k), parent, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sample(seed=3):
    rng = random.Random(seed)
    said = [(r, t) for r in ("user", "bot") for t in ("hi", "how are\tyou", "a b c", "", "ü  x")]
    rows = []
    for c in range(140):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, *rng.choice(said[:3] if t < 2 else said)))
    rows += [(c, t, "user", f"the same {t}") for c in range(200, 290) for t in range(4)]  # one common conversation
    rows += [(c, t, "user", f"line {t} {t % 7}") for c in (300, 301, 320) for t in range(70 + c % 3)]  # long ones
    rows += [(320, 90, "user", "end"), (340, 0, None, None), (340, None, "user", "early"), (341, 5, "user", None)]
    rows += [(342, 1, "user", "tie"), (342, 1, "bot", "tie"), (342, 1, "bot", "tie"), (399, 1, "user", "alone")]
    rows += [(None, 1, "user", "no conversation"), (10**15, 1, "user", "hi"), (10**15 + 1, 1, "user", "x " * 5000)]
    rng.shuffle(rows)
    return [(*r, "x", 1, b"k", [0]) for r in rows]


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("segment, tree_bytes", [(1024, 1 << 20), (1024, 200), (8, 300), (8, 0)])
def test_against_brute_force(spark, segment, tree_bytes):
    """Few turns a string and small trees make long conversations, and open nodes in every tree."""
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(prefix_trie(df, every=20, segment=segment, tree_bytes=tree_bytes)) == brute(rows)


def test_without_shared_turns_and_other_names(spark):
    rows = sample(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"conv_id": "c", "turn": "t", "role": "r", "text": "said"})
    assert found(prefix_trie(df, "c", "t", "r", "said", segment=8)) == brute(rows, None)


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA), every=20).count() == 0
    rows = [(c, 0, "user", "only turn", "", 0, b"", []) for c in range(25, 32)]  # some lose their only turn
    got = found(prefix_trie(spark.createDataFrame(rows, SCHEMA), every=20))
    assert got == brute(rows) and {r[1] for r in got} <= {0, 1}


def test_radix_tree_layouts():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(range(256), k=rng.randint(0, 3))) for _ in range(3000)} | {bytes([1, 2]) + bytes([i]) * 40 for i in range(20)})
    tree = RadixTree()
    order = list(range(len(keys)))
    rng.shuffle(order)
    for i in order:
        tree.insert(keys[i], i)
    rooms, values = set(), []
    for node, _, _, children in tree.bottom_up():
        assert children == sum(1 for _ in node.children()) <= node.room
        assert node.value >= 0 or children > 1 or node is tree.root
        rooms.add(node.room)
        values += [node.value] if node.value >= 0 else []
    assert rooms == {4, 16, 48, 256} and sorted(values) == sorted(order)
    for i, k in enumerate(keys):  # every key is found on its path
        node, at = tree.root, len(tree.root.prefix)
        while at < len(k):
            node = node.child(k[at])
            at += 1 + len(node.prefix)
        assert node.value == i
