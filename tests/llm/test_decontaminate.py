import random

from samples import ALNUM, LOW, prose

from careloom.llm import decontaminate


def brute(docs, items, span=10):
    """Per row of docs: number of words, hit words and sorted items."""
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i: i + n]), set()).add(str(item) if item is not None else None)
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i: i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_of
        out.append((doc, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, docs, rows):
    rng = random.Random(3)
    texts = [t for _, t in rows if t and len(t.split()) > 60]
    items = []
    for i in range(40):
        w = rng.choice(texts).split()
        a, n = rng.randrange(len(w) - 30), rng.choice([1, 2, 4, 9, 10, 11, 15, 30])
        items.append((i, " ".join(w[a: a + n]).upper() if i % 3 else "-" + ", ".join(w[a: a + n])))
    items += [(100, None), (101, ""), (102, "..."), (None, items[3][1]), (5, items[6][1]), (103, prose(rng, 40)), (104, "wörd " * 12)]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, words string")
    got = decontaminate.find_items(docs, table).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == brute(rows, items)
    for r in got:  # the spans cover the hit words
        assert len({i for s in r["spans"] for i in range(s["start"], s["end"])}) == r["n_hit"]


def test_passage_at_every_offset(spark):
    rng = random.Random(5)
    passage = prose(rng, 10)
    docs = [(i, f"{prose(rng, i)} {passage} {prose(rng, 30 - i)}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    item = spark.createDataFrame([(1, f"{prose(rng, 3)} {passage} {prose(rng, 4)}")], "item_id long, text string")
    got = decontaminate.find_items(df, item).collect()
    assert all(r["n_hit"] >= 10 for r in got) and len(got) == 30
    assert decontaminate.drop_contaminated(df, item).count() == 0


def test_every_row_has_its_own_verdict(spark):
    rng = random.Random(31)
    passage, clean = prose(rng, 12), prose(rng, 40)
    df = spark.createDataFrame([(None, f"x {passage}"), (None, clean), (None, None), (1, passage), (1, clean)], "doc_id long, text string")
    item = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontaminate.drop_contaminated(df, item).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(None, clean), (None, None), (1, clean)]))


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(no_docs, none).count() == 0
    assert decontaminate.find_items(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
