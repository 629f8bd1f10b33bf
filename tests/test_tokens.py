import pytest

from corpusflow.operators.tokens import Vocab, detokenize, tokenize_bpe, tokenize_char, tokenize_raw


def test_char_tokenizer_borders(spark):
    df = spark.createDataFrame(
        [(0, ""), (1, "a"), (2, "éàü"), (3, "A b\n~"), (4, None)], "doc_id long, text string"
    )
    rows = {r.doc_id: (r.ids, r.n_tokens) for r in tokenize_char(df).collect()}
    assert rows[0] == ([], 0)
    assert rows[1] == ([ord("a") - 31], 1)
    assert rows[2] == ([], 0)
    assert rows[3] == ([34, 1, 67, 0, 95], 5)
    alphabet = sorted(set("\n " + "".join(chr(c) for c in range(33, 127))))
    assert len(alphabet) == 96 and alphabet.index("~") == 95


def test_char_roundtrip(spark):
    df = spark.createDataFrame([(0, "Hello, world!\nOK é")], "doc_id long, text string")
    out = detokenize(tokenize_char(df).drop("text"), "ids", "char").first().text
    assert out == "Hello, world!\nOK "


def test_bpe_byte_vocab_roundtrip_and_eot(spark):
    text = "héllo <|endoftext|> wörld"
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    tok = tokenize_bpe(df).first()
    assert tok.ids[-1] == 256 and tok.n_tokens == len(text.encode()) + 1
    assert tok.ids[:-1] == list(text.encode())
    back = detokenize(tokenize_raw(df).drop("text")).first().text
    assert back == text


def test_special_policies(spark):
    df = spark.createDataFrame([(0, "a<|endoftext|>b")], "doc_id long, text string")
    allowed = tokenize_raw(df, special="allow").first().ids
    assert allowed == [97, 256, 98]
    with pytest.raises(Exception):
        tokenize_raw(df, special="reject").collect()


def test_vocab_with_merges(spark):
    ranks = {bytes([i]): i for i in range(256)}
    ranks[b"ab"] = 256
    v = Vocab("merged", ranks, special=(("<|endoftext|>", 257),))
    df = spark.createDataFrame([(0, "abab")], "doc_id long, text string")
    assert tokenize_bpe(df, vocab=v).first().ids == [256, 256, 257]


def test_kernels_answer_a_large_batch_in_parts():
    import pyarrow as pa

    from corpusflow.functions.arrow import char_ids_batch, ids_md5, ids_stats, row_steps

    texts = pa.array(["a" * 700_000, None, "b" * 700_000, "", "c" * 3_000_000])
    parts = list(char_ids_batch.func(iter([texts])))
    assert len(parts) == 3 and [len(x) for p in parts for x in p.to_pylist()] == [700_000, 0, 700_000, 0, 3_000_000]
    ids = pa.concat_arrays(parts)
    one = [ids_stats.func(ids.slice(i, 1)).to_pylist()[0] for i in range(5)]
    assert ids_stats.func(ids).to_pylist() == one and ids_stats.func(ids.slice(0, 0)).to_pylist() == []
    assert ids_md5.func(ids).to_pylist() == [ids_md5.func(ids.slice(i, 1)).to_pylist()[0] for i in range(5)]
    assert list(row_steps([0, 4, 4, 9, 10], 5)) == [(0, 2), (2, 3), (3, 4)] and list(row_steps([0])) == []
