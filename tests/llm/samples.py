"""Small invented texts with all the odd rows that the operators have to take."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SYLLABLES = "an ba co du el fi go hu in ka le mo nu or pa ri so tu um ve wo xi yé zu".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n):
    out = []
    for i, w in enumerate(words(rng, n)):
        out.append(w.capitalize() if i % 11 == 0 else w + "." if i % 11 == 10 else w)
    return " ".join(out)


def shingles(text):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def corpus(seed=7):
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, empties, ties."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(40, 400)) for _ in range(60)]
    rows = list(enumerate(base))
    n = len(rows)
    for _ in range(12):
        rows.append((n, rows[3][1]))  # exact copies
        n += 1
    for _ in range(40):  # near copies of one text, some at the edge of the threshold
        w = base[5].split(" ")
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(words(rng, 1))
        rows.append((n, " ".join(w)))
        n += 1
    passage = prose(rng, 70)
    for _ in range(9):
        rows.append((n, f"{prose(rng, 90)} {passage} {prose(rng, 80)}"))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "wörd " * 3000), (n + 6, "x" * 50000), (n + 7, "a b\u3000c\x1fd <|endoftext|> <s> don't ▁x  y ")]
    rows += [(None, base[7]), (None, None), (4, base[4])]
    return rows, passage


def root_of(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def merge(parent, a, b):
    a, b = root_of(parent, a), root_of(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
