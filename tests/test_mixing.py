from collections import Counter

from pyspark.sql import functions as F

from conftest import tok_frame
from corpusflow.operators.mixing import (
    carve_tail,
    concat_domains,
    concat_streams,
    mix_by_rate,
    noise_tokens,
    resample_spans,
    shuffle_blocks,
)
from corpusflow.operators.packing import pack_blocks

L = 8


def _blocks(spark, streams):
    rows = []
    for dom, ids in streams.items():
        rows.append(("train", dom, 0, ids))
    return pack_blocks(tok_frame(spark, rows), L, ["split", "domain"], ["doc_id"])


def _flat(blocks, domain):
    out = []
    for b in sorted((b for b in blocks if b.domain == domain), key=lambda b: b.block_id):
        out += b.ids
    return out


def test_concat_domains_in_list_order(spark):
    rows = [("train", "b", 0, [1, 2, 3]), ("train", "a", 0, [4, 5]), ("train", "a", 1, [6])]
    df = tok_frame(spark, rows)
    got = _flat(concat_domains(df, L, ["b", "a"]).collect(), "all")
    assert got == [1, 2, 3, 4, 5, 6]
    got = _flat(concat_domains(df, L).collect(), "all")
    assert got == [4, 5, 6, 1, 2, 3]


def test_carve_tail_short_stream_moves_whole(spark):
    blocks = _blocks(spark, {"a": list(range(30)), "b": [100, 101, 102]})
    out = carve_tail(blocks, L, 2).collect()  # tail of 16 tokens
    assert _flat(out, "a") == list(range(14))
    assert _flat(out, "b") == []
    assert _flat(out, "mix") == list(range(14, 30)) + [100, 101, 102]


def test_shuffle_blocks_permutes_blocks(spark):
    ids = list(range(21))  # 2 full blocks + a short one
    out = _flat(shuffle_blocks(_blocks(spark, {"a": ids}), L, 5).collect(), "a")
    assert sorted(out) == ids
    chunks = [tuple(ids[i:i + L]) for i in range(0, 21, L)]
    pos, found = 0, []
    while pos < len(out):
        for c in chunks:
            if tuple(out[pos:pos + len(c)]) == c and c not in found:
                found.append(c)
                pos += len(c)
                break
        else:
            raise AssertionError("not a block permutation")
    assert sorted(found) == sorted(chunks)


def test_noise_draws_from_stream(spark):
    blocks = _blocks(spark, {"a": [7, 7, 9]})
    sizes = spark.createDataFrame([("train", "a", 50)], "split string, domain string, n long")
    out = _flat(noise_tokens(blocks, L, sizes, 3).collect(), "noise")
    assert len(out) == 50 and set(out) <= {7, 9}


def test_resample_spans_are_contiguous(spark):
    ids = list(range(100))
    blocks = _blocks(spark, {"a": ids})
    sizes = spark.createDataFrame([("train", "a", 35)], "split string, domain string, n long")
    out = _flat(resample_spans(blocks, L, sizes, 10, 1).collect(), "a")
    assert len(out) == 30
    for k in range(3):
        span = out[k * 10:(k + 1) * 10]
        assert span == list(range(span[0], span[0] + 10))


def test_mix_floors_twice(spark):
    blocks = _blocks(spark, {"a": list(range(100)), "b": list(range(200, 300))})
    budgets = spark.createDataFrame([("train", 45)], "split string, n long")
    out = _flat(mix_by_rate(blocks, L, budgets, None, ctx_len=10, seed=2).collect(), "mix")
    # floor(45 * 0.5) = 22 tokens per domain -> 2 spans of 10
    assert len(out) == 40
    assert all(x < 100 for x in out[:20]) and all(x >= 200 for x in out[20:])
    weighted = mix_by_rate(blocks, L, budgets, {"b": 1.0, "a": 0.0}, ctx_len=10, seed=2).collect()
    assert Counter(x >= 200 for x in _flat(weighted, "mix")) == Counter({True: 40})


def test_carve_by_split_with_head(spark):
    rows = [(s, d, 0, list(range(k, k + 30))) for s in ("train", "val") for d, k in (("a", 0), ("b", 100))]
    blocks = pack_blocks(tok_frame(spark, rows), L, ["split", "domain"], ["doc_id"])

    def stream(out, split, domain):
        return _flat([b for b in out if b.split == split], domain)

    out = carve_tail(blocks, L, {"train": 1, "val": 2}, head={"val": 2}, allow_overlap=True).collect()
    assert stream(out, "train", "a") == list(range(22)) and stream(out, "val", "a") == list(range(16))
    assert stream(out, "train", "mix") == list(range(22, 30)) + list(range(122, 130))
    assert stream(out, "val", "mix") == list(range(14, 30)) + list(range(114, 130))
    apart = carve_tail(blocks, L, {"val": 2}, head={"val": 2}).collect()
    assert stream(apart, "val", "a") == list(range(14)) and stream(apart, "train", "a") == list(range(30))
    assert stream(apart, "train", "mix") == []


def test_concat_streams_keeps_every_token(spark):
    blocks = _blocks(spark, {"b": list(range(11)), "a": list(range(50, 69))})
    assert _flat(concat_streams(blocks, L).collect(), "all") == [*range(50, 69), *range(11)]
    assert _flat(concat_streams(blocks, L, ["b", "a"]).collect(), "all") == [*range(11), *range(50, 69)]


def test_draws_from_another_split(spark):
    rows = [("train", "a", 0, [1] * 40), ("val", "a", 0, [2] * 40)]
    blocks = pack_blocks(tok_frame(spark, rows), L, ["split", "domain"], ["doc_id"])
    sizes = spark.createDataFrame([("train", "a", 20), ("val", "a", 20)], "split string, domain string, n long")
    noise = noise_tokens(blocks, L, sizes, 3, source_split="train").collect()
    assert {b.split for b in noise} == {"train", "val"} and set(_flat(noise, "noise")) == {1}
    mix = mix_by_rate(blocks, L, sizes.drop("domain"), {"a": 1.0}, 10, 2, source_split="train").collect()
    assert Counter(x for b in mix for x in b.ids) == Counter({1: 40})


def test_many_spans_and_intervals_meet_their_blocks_by_shuffle(spark, monkeypatch):
    from corpusflow import session
    from corpusflow.operators import mixing, views
    from corpusflow.operators.packing import pack_blocks

    rows = [("train", d, i, [(i * 7 + j) % 400 for j in range(40 + i % 9)]) for d in ("a", None, "b") for i in range(20)]
    blocks = pack_blocks(tok_frame(spark, rows), 16, ["split", "domain"], ["doc_id"]).cache()
    sizes = mixing.stream_lengths(blocks).select("split", "domain", F.col("stream_len").alias("n"))
    build = {
        "spans": lambda: mixing.resample_spans(blocks, 16, sizes, 10, 3),
        "shuffle": lambda: mixing.shuffle_blocks(blocks, 16, 5),
        "concat": lambda: mixing.concat_streams(blocks, 16),
    }
    rows_of = lambda df: sorted(map(repr, df.select("split", "domain", "block_id", "ids").collect()))
    want = {k: rows_of(f()) for k, f in build.items()}
    assert any("span-draws" in f for f in build["spans"]().inputFiles())  # the planner knows how many there are
    monkeypatch.setattr(views, "FEW", 0)
    monkeypatch.setattr(views, "INTERVALS", 0)
    monkeypatch.setattr(session, "TASK_TOKENS", 200)
    assert {k: rows_of(f()) for k, f in build.items()} == want


def test_carve_query_moves_as_much_as_the_reference(spark, tmp_dir, monkeypatch):
    from corpusflow.queries import mixes

    docs = [(s * 100 + i, chr(97 + i) * 1000, f"s{s}") for s in range(2) for i in range(12)]  # one of twelve is validation
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/documents.parquet")

    def held():
        rows = mixes.q_carve_tail(spark, tmp_dir).groupBy("split", "domain").agg(F.sum("n_tokens")).collect()
        return {(r[0], r[1]): r[2] for r in rows}

    assert mixes.CARVE == {"train": 558_035, "val": 2000}  # blocks of 512: 2 * 10**9 tokens of seven domains
    assert held() == {("train", "mix"): 22_000, ("val", "mix"): 2_000}  # shorter than that, so they move whole
    monkeypatch.setattr(mixes, "CARVE", {"train": 10, "val": 1})
    kept = {(s, d): n for s, n in (("train", 11_000 - 5_120), ("val", 1_000 - 512)) for d in ("s0", "s1")}
    assert held() == kept | {("train", "mix"): 10_240, ("val", "mix"): 1_024}
