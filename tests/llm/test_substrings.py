import random

from samples import LOW, SPACED, prose

from careloom.llm import substrings


def test_shared_passage_wherever_it_stands(spark, docs, rows, passage):
    found = substrings.repeated_spans(docs).collect()
    holders = sorted(d for d, t in rows if t and passage in t)
    texts = {d: SPACED.findall(t.translate(LOW)) for d, t in rows if t and d is not None}
    words = SPACED.findall(passage.translate(LOW))
    for d in holders[1:]:
        at = next(i for i in range(len(texts[d])) if texts[d][i: i + 70] == words)
        assert any(r["id"] == d and r["start"] <= at and r["end"] >= at + 70 and r["kept"] == holders[0] for r in found), d
    assert not any(r["id"] == holders[0] for r in found)


def test_copies_go_and_clean_documents_stay(docs, rows, passage):
    spans = substrings.repeated_spans(docs)
    left = {r["doc_id"]: r["text"] for r in substrings.remove_spans(docs, spans).collect() if r["doc_id"] is not None}
    text = dict(r for r in rows if r[0] is not None)
    for d in range(60):
        if d not in (3, 5):
            assert left[d] == text[d]
    assert left[3] == text[3] and not any(d in left for d in range(60, 72))  # copies of document 3
    holders = sorted(d for d, t in text.items() if t and passage in t)
    for d in holders[1:]:
        before, after = text[d].split(passage)
        assert left[d] == before.strip() + "\n" + after.strip()
    assert left[max(text) - 7] is None and left[max(text) - 6] == ""


def test_every_place_of_a_passage(spark):
    rng = random.Random(9)
    passage = prose(rng, 51)
    data = [(i, f"{prose(rng, i)}\n{passage[:100]}{passage[100:]} {prose(rng, 60 - i)}") for i in range(60)]
    got = substrings.repeated_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["id"] for r in got} == set(range(1, 60)) and all(r["end"] - r["start"] >= 51 for r in got)


def test_similar_paragraphs(spark):
    rng = random.Random(11)
    w = prose(rng, 120).split(" ")
    other = w.copy()
    other[40] = "changed"
    data = [(1, " ".join(w) + "\n" + prose(rng, 60)), (2, prose(rng, 60) + "\n" + " ".join(other)), (3, prose(rng, 130))]
    got = substrings.similar_paragraphs(substrings.source_rows(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text"), 50, 80).collect()
    assert [(r["id"], r["start"], r["end"], r["kept"]) for r in got] == [(2, 60, 180, 1)]


def test_short_runs_and_repeats_inside_one_document_stay(spark):
    rng = random.Random(13)
    line = prose(rng, 40)
    data = [(i, f"{prose(rng, 30)} {line} {prose(rng, 30)}") for i in range(4)] + [(9, "\n".join([prose(random.Random(1), 60)] * 5))]
    assert substrings.repeated_spans(spark.createDataFrame(data, "doc_id long, text string")).count() == 0


def words_held(rows, least=50):
    """(id, place) of every word in a window that a smaller document holds."""
    texts = {d: SPACED.findall(t.translate(LOW)) for d, t in rows}
    owner = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - least + 1):
            owner.setdefault(tuple(texts[d][i: i + least]), d)
    return {(d, i + j) for d, w in texts.items() for i in range(len(w) - least + 1) if owner[tuple(w[i: i + least])] < d for j in range(least)}


def words_found(spark, rows):
    found = substrings.shared_passages(substrings.source_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text"), 50)
    return {(r["id"], i) for r in found.collect() for i in range(r["start"], r["end"])}


def test_passage_whose_parts_smaller_documents_hold(spark):
    rng = random.Random(17)
    w = prose(rng, 71).split(" ")
    parts = [w[:48], w[23:], w, w]
    rows = [(i + 1, f"{prose(rng, 30)} {' '.join(p)} {prose(rng, 30)}") for i, p in enumerate(parts)]
    assert words_found(spark, rows) == {(4, 30 + i) for i in range(71)} == words_held(rows)


def test_lines_that_the_kept_document_repeats(spark):
    rng = random.Random(23)
    lines = [prose(rng, 49) for _ in range(4)]
    before, after = ([f"{x} {prose(rng, 25)}" for x in lines] for _ in range(2))
    rows = [(1, "\n".join([*before, *lines, prose(rng, 25), *after])), (2, "\n".join([prose(rng, 10), *lines, prose(rng, 10)]))]
    assert words_found(spark, rows) == {(2, 10 + i) for i in range(196)} == words_held(rows)


def test_recombined_lines(spark):
    rng = random.Random(19)
    lines = [prose(rng, rng.randint(5, 70)) for _ in range(30)]
    rows = [(d, "\n".join(rng.choices(lines, k=rng.randint(2, 12)) + [prose(rng, rng.randint(0, 60))])) for d in range(50)]
    rows += [(100 + d, t) for d, t in rows[:5]]
    assert words_found(spark, rows) == words_held(rows)


def test_every_row_has_its_own_ranges(spark):
    rng = random.Random(29)
    passage, clean, alone = prose(rng, 60), prose(rng, 70), prose(rng, 80)
    rows = [(1, passage), (2, f"{alone} {passage}"), (2, clean), (2, None), (2, "one two"), (None, f"{passage} {clean}"), (None, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_spans(df, substrings.repeated_spans(df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, passage), (2, alone), (2, clean), (2, None), (2, "one two"), (None, "three")]))


def test_cut_keeps_the_rest():
    assert substrings.cut("Aé b  c\nd e", [(1, 3)]) == "Aé\nd e"
    assert substrings.cut("a b c", [(0, 3)]) == ""


def test_empty_table(no_docs):
    spans = substrings.repeated_spans(no_docs)
    assert spans.count() == 0 and substrings.remove_spans(no_docs, spans).count() == 0
