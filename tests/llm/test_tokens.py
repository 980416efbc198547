import sentencepiece

from careloom.llm import tokens

MODEL = tokens.tokenizer_path("piece_bpe_32k.model")


def test_counts_equal_the_library(docs, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = tokens.count_tokens(docs, MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        assert r["n_tokens"] == len(model.encode(text)), text[:80]
        assert r["n_bytes"] == len(text.encode())
    assert got[0]["h"] == "x"  # further columns pass through


def test_spaces_at_odd_places(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["foo ", " foo", "  foo   bar ", " ", "   ", "a\n b", "▁", "▁▁ x", "x ▁y▁ z", "\t", "é  ñ", "a▁"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in tokens.count_tokens(df, MODEL).collect():
        assert r["n_tokens"] == len(model.encode(r["text"])), repr(r["text"])


def test_small_memory_of_pretokens(docs, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    seen = tokens.Remembered(lambda words: [len(w) for w in words])
    for part in (["a", "bb"], [f"w{i}" for i in range(60)], ["a", "ccc"]):
        assert seen(part) == [len(w) for w in part]


def test_empty_table(no_docs):
    out = tokens.count_tokens(no_docs, MODEL)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
