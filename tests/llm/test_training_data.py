"""Training-data operators against brute force, and their defined results for odd input."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import embedding, langid, line_dedup, packing, repetition, sharding, simhash, source_mix, toxicity, warc
from corpusflow.llm.graph import components
from corpusflow.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators must not trip over.
EXTRA = ("id", "fp", "key", "size", "shard", "score", "kept", "rep", "n_lines", "start", "component_id", "rest", "h")
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "one two three", "en", "a", 13),
        (3, "one two three", "en", "a", 13),
        (4, "one two three", "en", "b", 13),
        (None, "no id here at all", "en", None, 17),
        (5, "ONE two\nthree", "de", "b", 13),
        (6, LONG, "en", "a", len(LONG)),
        (7, "12345 !!! \t\n", "fr", "c", 12),
        (8, "<|endoftext|> x  y éé 　 z", "fr", "c", 20),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in EXTRA})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(7) for c in EXTRA})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- sharding -------------------------------------------------------------------------------------


def best_capacity(sizes, shards):
    """Least maximum of a contiguous partition, by dynamic programming."""
    ends = list(itertools.accumulate(sizes, initial=0))
    best = ends[1:]
    for _ in range(shards - 1):
        best = [min([best[i]] + [max(best[j], ends[i + 1] - ends[j + 1]) for j in range(i)]) for i in range(len(sizes))]
    return best[-1]


def test_smallest_capacity_is_minimax():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 50, rng.integers(1, 14)).tolist()
        for shards in (1, 2, 3, 8):
            assert sharding.smallest_capacity(sizes, shards) == best_capacity(sizes, shards)


def test_shards_are_minimax_over_groups(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)  # so that segments have to be split
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    got = sharding.minimax_shards(documents).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    import hashlib

    digest = {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts.items()}
    groups = collections.Counter()
    for i, t in texts.items():
        groups[digest[i]] += len(t.encode()) + 1
    want = best_capacity([groups[d] for d in sorted(groups)], 8)
    assert got.groupby("shard")["size"].sum().max() == want
    by_digest = got.assign(d=got.doc_id.map(digest)).groupby("d").shard.nunique()
    assert by_digest.max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


@pytest.mark.parametrize("kind", ["even", "one", "nine", "many"])
def test_cuts_beside_hot_groups_read_back_few_segments(kind):
    """Groups that hold a third of all bytes and more: the capacity is the least one, no call returns over 20,000 rows."""
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 1 << sharding.KEY_BITS, 200_000))
    sizes = rng.integers(1, 4000, len(keys))
    total = int(sizes.sum())
    if kind == "one":
        sizes[len(keys) // 3] = total // 2
    elif kind == "nine":
        sizes[rng.choice(len(keys), 9, replace=False)] = total
    elif kind == "many":
        sizes[rng.choice(len(keys), 40, replace=False)] = total // rng.integers(5, 40, 40)
    returned = []

    def summary(start, shift, finer):
        low, high = np.searchsorted(keys, [start, start + (1 << shift)])
        prefix = keys[low:high] >> finer
        at = np.flatnonzero(np.diff(prefix, prepend=-1))
        held = np.split(sizes[low:high], at[1:]) if len(at) else []
        return [sharding.Segment(int(prefix[i]) << finer, finer, int(s.sum()), len(s), int(s.max())) for i, s in zip(at, held)]

    def finer(segments):
        out = [part for s in segments for part in summary(s.start, s.shift, max(0, s.shift - sharding.STEP_BITS))]
        returned.append(len(out))
        return out

    cuts = sharding.settle(summary(0, sharding.KEY_BITS, sharding.KEY_BITS - sharding.FIRST_BITS), finer, 8)
    starts = np.concatenate([[0], np.searchsorted(keys, cuts)])
    assert np.add.reduceat(sizes, starts).max() == sharding.smallest_capacity(sizes.tolist(), 8)
    assert max(returned, default=0) <= 20_000


def test_shards_odd_rows(odd, empty):
    got = sharding.minimax_shards(odd, 3).toPandas()
    assert len(got) == 10 and got[got.doc_id == 1]["size"].tolist() == [1]
    assert got[got.text_crc32 == zlib.crc32(b"one two three")].shard.nunique() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.minimax_shards(empty).count() == 0


# --- repetition -----------------------------------------------------------------------------------


def brute_repetition(t):
    w = WORD.findall(t or "")
    seen, dup_lines = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup_lines += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = [any(grams[tuple(w[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w))]
    out = [len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup_lines, sum(covered)]
    for n in repetition.NGRAM_LIMITS:
        first, chars = set(), [0] * len(w)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in first:
                chars[i : i + n] = [len(x) for x in g]
            first.add(g)
        out.append(sum(chars))
    return out


def check_repetition(rows):
    for text, got in rows:
        want = brute_repetition(text)
        names = [*repetition.COUNTS, *(f"dup_{n}gram_chars" for n in repetition.NGRAM_LIMITS)]
        assert [got[c] for c in names] == want, text[:80]
        assert got["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_repetition_counts(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    check_repetition((texts[r["doc_id"]], r) for r in repetition.repetition_rules(documents).collect())


def test_repetition_odd(spark, odd, empty):
    words = np.random.default_rng(1).integers(0, 4, (40, 60))
    made = [(i, " ".join("abcd"[c] for c in row) + "\n" + "x y\n" * (i % 3)) for i, row in enumerate(words)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    check_repetition((made[r["doc_id"]][1], r) for r in repetition.repetition_rules(docs).collect())
    rows = repetition.repetition_rules(odd).collect()
    assert len(rows) == 10
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert not next(r for r in rows if r["doc_id"] == 6)["kept"]
    assert repetition.repetition_rules(empty).count() == 0


# --- packing --------------------------------------------------------------------------------------


def check_packing(pieces, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        got = sorted(by[i], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in got) == ids.tobytes()
        assert [p["start"] for p in got] == list(itertools.accumulate([p["length"] for p in got], initial=0))[:-1]
        assert {p["doc_tokens"] for p in got} == {len(ids)}
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    sizes = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([n for _, n in parts], initial=0))[:-1]
        sizes.append(sum(n for _, n in parts))
    assert max(sizes) <= 1024
    return sum(1024 - n for n in sizes if n & (n - 1)), sum(sizes)


def test_packing_round_trip_and_padding(documents):
    pieces = packing.pack(documents, tokenizer_path()).collect()
    padding, tokens = check_packing(pieces, [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert padding <= 1024
    steps = {p["sequence_id"]: (p["step_id"], p["sequence_tokens"]) for p in pieces}
    loads = collections.Counter()
    for step, n in steps.values():
        loads[step] += n
    assert max(loads.values()) - min(loads.values()) <= 1024


def test_packing_odd(odd, empty):
    pieces = packing.pack(odd.where("doc_id IS NULL OR doc_id != 3"), tokenizer_path(), cell_tokens=1000).collect()
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in odd.where("doc_id != 3").collect()])
    assert packing.pack(odd, tokenizer_path()).where("doc_id = 3 AND start = 0").count() == 2
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [1024], [2048, 1], [600] * 7, [512, 512, 3], list(range(1, 1500, 7)), [100] * 50 + [5000]])
def test_plan_fills_windows(lengths):
    doc, start, length, sequence, offset, tier = packing.plan(np.array(lengths, dtype=np.int64))
    assert length.sum() == sum(lengths) and (length > 0).all()
    sizes = np.bincount(sequence, weights=length) if len(sequence) else np.zeros(0)
    open_ = [n for n in sizes if int(n) & (int(n) - 1)]
    assert len(open_) <= 1 and sizes.max(initial=0) <= 1024


def test_piece_encoding_equals_whole_texts():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer_path()), packing.ByteBpe(tokenizer_path())
    texts = ["a  b", "x y", " lead", "trail  ", "tab\t x", "don't  can't 1 2 33", "a \n b", "\u0085 q w", "\U0001f600 \U0001f600 x", "", " "]
    for _ in range(2):  # the second time from what is known
        ids, n = e.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


# --- SimHash --------------------------------------------------------------------------------------


@pytest.mark.parametrize("entries", [3, 40, 1000])
def test_forgotten_pieces_are_encoded_again(entries):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer_path()), packing.ByteBpe(tokenizer_path(), entries)
    rng = np.random.default_rng(5)
    letters = np.array(["a", "b", " ", " ", "  ", "\n", "\u00e9", "\u00a0", "\u3000", "\u6f22", "'s", "7"])
    for _ in range(20):
        texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(15)]
        ids, per_text = e.encode(pa.array(texts))
        want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
        assert per_text.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])
    assert (np.diff(e.keys.astype(object)) >= 0).all() and len(e.keys) == len(e.known) == len(e.sizes) == len(e.uses)


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    label = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(values[i], values[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints_and_components(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [got[i]["fingerprint"] for i, _ in rows] == [f"{f:016x}" for f in fps]
    label = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[i]["component_id"] for i, _ in rows] == [rows[x][0] for x in label]


@pytest.mark.parametrize("max_group", [simhash.MAX_GROUP, 3])
def test_trie_links_lose_none(spark, max_group):
    """Also when groups are split into pairs of child prefixes."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:
        at = int(b)
        for _ in range(12):  # chains of small steps, so that components are longer than one link
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                at ^= 1 << int(bit)
            values.add(at)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, max_group)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    label = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = collections.defaultdict(set)
    for v, x in zip(signed, label):
        groups[x].add(v)
    want = {v: min(g) for g in groups.values() if len(g) > 1 for v in g}
    assert found == want


def test_components_of_chain_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert got == want


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert by[3]["component_id"] == by[4]["component_id"] == 3
    assert by[5]["component_id"] == 3  # the same words, in lower case
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1
    assert simhash.keep_one(empty).count() == 0


# --- toxicity -------------------------------------------------------------------------------------


def test_gapped_insults_are_found(spark):
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("abcdefghijklmnoprstuv"), rng.integers(3, 9))) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(clean, 30), *([bad] if bad else []), *rng.choice(clean, 5)]) + "."
    rows, labels = [], []
    for i in range(160):
        bad = ["wretchling", "scoundrel", None, None][i % 4]
        rows.append((i, text(bad)))
        labels.append((i, int(bad is not None)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    scores = toxicity.score_texts(
        pa.array([text("wretch-ling"), text("s.c.o.u.n.d.r.e.l"), text("scouxndrel"), text("WRETCHLING!"), text(None), "", None]), model
    )
    assert (scores[:4] > 0.5).all() and (scores[4:] < 0.5).all()


def test_kernel_is_the_sum_over_common_subsequences():
    def explicit(w):
        codes = [ord(c) - 96 for c in w]
        out = collections.Counter()
        for at in itertools.combinations(range(len(w)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                out[tuple(codes[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    marks, words = ["stupid", "idiotic"], ["stuupid", "idiot", "clean", "ab"]
    _, columns, matrix = toxicity._landmark_matrix(pa.array(marks, pa.large_string()))
    got = toxicity._kernel(pa.array(words, pa.large_string()), columns, matrix)
    for w, row in zip(words, got):
        x = explicit(w)
        length = sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1)) for at in itertools.combinations(range(len(w)), 4) if at[-1] - at[0] < 7)
        for m, k in zip(marks, row):
            y = explicit(m)
            want = sum(v * y[s] for s, v in x.items()) / sum(v * v for v in y.values()) ** 0.5
            assert k == pytest.approx(want / max(length, 1e-12) ** 0.5 if length else 0.0)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1), (8, None), (5, 2)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels.limit(0), F.lit(True))
    assert toxicity.score(odd, none).where("predicted = 1").count() == 0


# --- line frequency -------------------------------------------------------------------------------


def test_boilerplate_lines(spark):
    rows = [(i, f"own {i}\nshared by host\n\nshared by host\nrare {i % 20}", "h" if i < 60 else None) for i in range(64)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.1, min_pages=5).collect()
    for r in got:
        if r["source"] == "h":
            assert r["text"] == f"own {r['doc_id']}\n\nrare {r['doc_id'] % 20}" and (r["n_lines"], r["n_dropped"]) == (5, 2)
        else:  # four pages: fewer than a line has to stand on
            assert "shared by host" in r["text"] and r["n_dropped"] == 0


def test_boilerplate_by_brute_force(spark, documents):
    """The operator's own ratio, also on hosts of a few pages: every line repeated on over a fiftieth of them goes."""
    few = [(10_000_000 + i, f"same on both\nown {i}", "en", "few", 1) for i in range(2)] + [(20_000_000, "alone\nalone", "en", "one", 1)]
    docs = documents.select(*[f.split()[0] for f in SCHEMA.split(", ")]).union(spark.createDataFrame(few, SCHEMA))
    rows = docs.collect()
    pages = collections.Counter(r["source"] for r in rows)
    on = collections.Counter(key for r in rows for key in {(r["source"], x) for x in (r["text"] or "").split("\n") if x.strip(" ")})
    drop = {k for k, n in on.items() if n >= 2 and n > line_dedup.RATIO * pages[k[0]]}
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs).collect()}
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if (r["source"], x) not in drop]
        if r["text"] is not None:
            assert (got[r["doc_id"]]["text"], got[r["doc_id"]]["n_dropped"]) == ("\n".join(kept), len(lines) - len(kept))
    assert got[10_000_001]["text"] == "own 1" and got[20_000_000]["text"] == "alone\nalone"


def test_pipeline_keeps_a_document_of_many_copies(spark):
    """Copies over a tenth of a source are left to the near-dedup stage, which keeps one with its text."""
    copied = "\n".join(f"copied line {i} with some words of its own" for i in range(8))
    rows = [(i, copied, "en", "h", len(copied)) for i in range(40)]
    for i in range(40, 100):
        text = f"shared by all\nown words {i} {i * 7919 % 1009} {i * 104729 % 997} of document {i * 31 % 89}"
        rows.append((i, text, "en", "h", len(text)))
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    cleaned = stages["line_dedup"](spark, docs, SF)
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(got[i] == copied for i in range(40)) and not any("shared by all" in t for t in got.values())
    assert [r["text"] for r in stages["simhash_dedup"](spark, cleaned, SF).collect()].count(copied) == 1


def test_line_dedup_odd(odd, empty):
    got = line_dedup.drop_boilerplate(odd, min_pages=2).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[2]["text"] == "" and by[2]["n_lines"] == 1
    assert by[3]["text"] == "" and by[3]["n_dropped"] == 1
    assert by[4]["text"] == "one two three"
    assert line_dedup.drop_boilerplate(empty).count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    big = "é payload \r\n\r\n WARC/1.1\r\n" * 60
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (9, "http://a/9", big), (3, None, None),
        (4, "http://a\r\nX: y", ""), (5, "http://b", "short"), (6, "http://b", "short"), (None, "http://c", big + "z"), (None, "http://c", big + "z"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in EXTRA})
    path = str(tmp_path / "w")
    got = warc.archive_pages(pages, path).collect()
    assert len(got) == 10
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {
        (1, "revisit", 9): 1, (2, "revisit", 9): 1, (9, "response", None): 1, (9, "revisit", 9): 1, (3, "response", None): 1,
        (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (None, "response", None): 1, (None, "revisit", None): 1,
    }
    import hashlib

    for r in got:
        if r["page_id"] in (1, 2, 9):
            assert (r["payload_bytes"], r["payload_digest"]) == (len(big.encode()), hashlib.sha1(big.encode()).hexdigest())
    stored = [r["payload"] for r in warc.read_archives(spark, path).collect() if r["warc_type"] == "response"]
    assert sorted(bytes(p) for p in stored) == sorted([big.encode(), b"", b"", b"short", b"short", (big + "z").encode()])


def test_archives_of_large_and_hot_pages(spark, tmp_path):
    """Large payloads stay out of every exchange, records have ids of their own, and a third of equal rows is resolved."""
    rows = [(i, f"http://a/{i}", f"{i} " * 100_000) for i in range(40)] + [(None, None, "")] * 300
    rows += [(77, "http://hot", "hot " * 400)] * 300 + [(5, "http://hot/5", "hot " * 400)] * 20
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    path = str(tmp_path / "w")
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages, path).collect())
    want = collections.Counter({(i, "response", None): 1 for i in range(40)})
    want.update({(None, "response", None): 300, (77, "response", None): 1, (77, "revisit", 77): 299, (5, "revisit", 77): 20})
    assert got == want
    records = warc.read_archives(spark, path)
    assert records.select("record_id").distinct().count() == records.count() == len(rows)
    assert {len(r["payload"]) for r in records.where("page_id = 39 AND warc_type = 'response'").collect()} == {300_000}
    pages.where("page_id < 40 AND page_id <> 5").write.parquet(str(tmp_path / "p"))
    large = spark.read.parquet(str(tmp_path / "p")).selectExpr("page_id AS _id", "url AS _url", "html AS _payload")
    assert "hashpartitioning" not in warc.records_of(large, 1000)._jdf.queryExecution().executedPlan().toString()


def test_archives_of_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------


def test_vector_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MEMBERS", 16)  # so that cells are dealt out in blocks
    monkeypatch.setattr(embedding, "PROBES", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 16))
    for i in range(0, 200, 4):
        x[i + 1 : i + 3] = x[i] + rng.normal(size=(2, 16)) * 0.12
    x[200:250] = x[200] + rng.normal(size=(50, 16)) * 0.1
    x[250:255] = x[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (None, rows[0][1]), (905, [])]
    report = {}
    got = {r["vec_id"]: r for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in EXTRA}), report=report).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    assert report["recall"] >= 0.99
    assert [got[i]["n_links"] for i in range(260)] == (linked.sum(axis=1) - 1).tolist()
    label = brute_components(list(range(260)), lambda a, b: linked[a, b])
    assert [got[i]["component_id"] for i in range(260)] == label
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 906))
    assert len(got) == len(rows)


def test_vectors_of_every_length_link(spark):
    rows = [(i, [1.0, 0.0, 0.01 * i]) for i in range(6)] + [(10, [3.0, 4.0]), (11, [3.0, 4.0]), (12, [3.1, 4.0]), (13, [4.0, -3.0])]
    rows += [(20, [2.0]), (21, [5.0]), (22, [-1.0]), (30, [1.0] * 5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: (5, 0) for i in range(6)} | {10: (2, 10), 11: (2, 10), 12: (2, 10), 13: (0, 13)}
    assert got == want | {20: (1, 20), 21: (1, 20), 22: (0, 22), 30: (0, 30)}


def test_no_vectors(spark):
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _reps(spark, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(c) for c in v], 1) for i, v in enumerate(u)]
    return u, spark.createDataFrame(rows, "id long, v array<double>, copies long")


def test_visits_where_few_queries_have_links(spark, monkeypatch):
    """One linked pair among 1,500 vectors: the first queries do not show it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x[1] = x[0] + rng.normal(size=16) * 0.1 * np.linalg.norm(x[0]) / 4
    u, reps = _reps(spark, x)
    linked = u @ u.T >= 0.9
    rows = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for limit, measured in ((32_768, True), (64, False)):  # all vectors are drawn, or too few for a measurement
        monkeypatch.setattr(embedding, "MAX_QUERY_ROWS", limit)
        monkeypatch.setattr(embedding, "WHOLE_CELL_ROWS", 100)
        index = embedding.fit_index(reps, 1500)
        visits, recall = embedding.visits_needed(reps, 1500, index, 0.9, 0.999, query_rows=32)
        assert (visits is not None) == (recall is not None) == measured
        report = {}
        got = {r["vec_id"]: r["n_links"] for r in embedding.near_vectors(rows, report=report).collect()}
        assert [got[i] for i in range(1500)] == (linked.sum(axis=1) - 1).tolist()


def test_large_group_does_not_set_the_visits(spark, monkeypatch):
    """A tight group of a third has most links; those of 150 loose pairs need more visits."""
    monkeypatch.setattr(embedding, "CELL_ROWS", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 32))
    x[:300] = x[0] + rng.normal(size=(300, 32)) * 0.05
    x[300:450] = x[450:600] + rng.normal(size=(150, 32)) * 0.43
    u, reps = _reps(spark, x)
    index = embedding.fit_index(reps, 900)
    visits, recall = embedding.visits_needed(reps, 900, index, 0.9, 0.999, query_rows=900)
    q, r = np.nonzero((u @ u.T >= 0.9) & ~np.eye(900, dtype=bool))
    loose = q >= 300
    cells, near = index.cells(u), index.visits(u, visits)
    reached = (near[q[loose]] == cells[r[loose]][:, None]).any(axis=1).mean()
    assert loose.sum() > 50 and reached >= 0.99 and recall >= 0.99


def test_made_partners_set_the_visits_of_rare_links(spark):
    """A thousandth of the vectors is linked, at hardly the threshold: the visits find them in a small part of the cells."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(30_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:300] = embedding.made_partners(x[300:600], 0.905)[0]
    index = embedding.MultiIndex(embedding._codebook(x[:9000, :8], 48), embedding._codebook(x[:9000, 8:], 48))
    _, reps = _reps(spark, x[:6000])
    visits, recall = embedding.visits_of_made(reps, 6000, index, 0.9, 0.999)
    near, cells = index.visits(x[:300], visits), index.cells(x[300:600])
    assert recall >= 0.999 and (near == cells[:, None]).any(axis=1).mean() >= 0.99
    assert visits < 0.2 * 48 * 48
    assert (index.places(x[:300], x[300:600]) < visits).tolist() == (near == cells[:, None]).any(axis=1).tolist()


def test_rare_links_of_many_vectors(spark, monkeypatch):
    """Made partners set the visits of the whole operator; every vector has one partner or none."""
    monkeypatch.setattr(embedding, "MAX_QUERY_ROWS", 512)
    monkeypatch.setattr(embedding, "WHOLE_CELL_ROWS", 100)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:24] = embedding.made_partners(x[100:124], 0.91)[1]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    report = {}
    got = {r["vec_id"]: r["n_links"] for r in embedding.near_vectors(rows, report=report).collect()}
    assert sum(got.values()) >= 0.99 * 48 and report["recall"] >= 0.99 and report["visits"] < report["codes"] ** 2


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(6)
    index = embedding.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    a, b = index.distances(x)
    whole = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    assert (index.visits(x, 9) == np.argsort(whole, axis=1, kind="stable")[:, :9]).all()


# --- language -------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    got = QUERIES["op9_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_counts_of_long_and_many_texts(monkeypatch):
    """Parts of a long text add up to the whole, also without spaces; memory follows neither length nor rows."""
    import tracemalloc

    mixed = "Straße über ÀÉ日本語の文 42x, İstanbul\n" * 40
    texts = [mixed, "ab" * 700, "é" * 1001, "日本" * 333 + " a", "x " * 600]
    whole = [langid.counts(pa.array([t])) for t in texts]
    monkeypatch.setattr(langid, "SLICE_BYTES", 97)
    for t, (table, letters) in zip(texts, whole):
        got, n = langid.counts(pa.array([t]))
        assert (got == table).all() and n == letters
    monkeypatch.undo()
    model = langid.LanguageModel(np.ones(langid.FEATURES, np.float32), np.eye(4, langid.FEATURES, dtype=np.float32), tuple("abcd"), 0.0)
    for column in (pa.array(["a", "", None, "bc d"] * 2500), pa.array(["some words here " * 1_200_000])):
        tracemalloc.start()
        assert len(langid.predict(column, model)[0]) == len(column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300_000_000


def test_language_odd(spark, odd, empty, documents):
    model = langid.fit(documents, F.lit(True))
    by = {r["doc_id"]: r for r in langid.classify(odd, model).collect()}
    assert len(by) == 9 and all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (1, 2, 7))
    assert by[6]["lang_pred"] != "und"
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 7} & {r["doc_id"] for r in kept.collect()}
    assert langid.classify(empty, langid.fit(empty, F.lit(True))).count() == 0
    none = langid.fit(empty, F.lit(True))
    assert langid.classify(odd, none).where("lang_pred != 'und'").count() == 0


@pytest.mark.parametrize("left_out", ["de", "es", "fr"])
def test_texts_of_an_unlearned_language_are_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    model = langid.fit(docs, (F.col("lang") != left_out) & (F.col("doc_id") % 2 == 0))
    got = langid.classify(docs, model).where("lang_pred != 'und'").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    unlearned = got.lang == left_out
    assert got[unlearned].rejected.mean() > 0.9
    assert got[~unlearned].rejected.mean() < 0.01


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    """A third of the rows share an id: a sample holds one of them, and other ids besides."""
    texts = ["one of many words here", "und noch ein Satz dazu", "encore une phrase ici"]
    rows = [(7 if i % 3 == 0 else i, f"{texts[i % 3]} {chr(97 + i % 26)}", "xx", i % 2) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    tables = []
    monkeypatch.setattr(langid, "vectors", lambda table, idf, f=langid.vectors: (tables.append(table), f(table, idf))[1])
    langid.fit(docs, F.lit(True), per_lang=500)
    assert len(tables[0]) == len({r[0] for r in rows})
    bags = []
    monkeypatch.setattr(toxicity, "train", lambda vocabulary, words, labels: bags.extend(words))
    toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    assert len(bags) == len({r[0] for r in rows})


def test_short_texts_are_kept(spark, documents):
    model = langid.fit(documents, F.lit(True))
    words = [w for r in documents.where("length(text) > 200").limit(40).collect() for w in r["text"].split()[:1] if w.isalpha()]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert langid.classify(rows, model).where("NOT rejected").count() >= 0.9 * len(words)


# --- mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > cap * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in free}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
    return target


def check_mix(rows, texts):
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    targets = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) for r in rows if r["doc_id"] in texts)


def test_mix_meets_targets(documents, odd, empty):
    check_mix(source_mix.mix_sources(documents).collect(), {r["doc_id"]: r["text"] for r in documents.collect()})
    rows = source_mix.mix_sources(odd).collect()
    assert len(rows) == 10
    check_mix(rows, {r["doc_id"]: r["text"] for r in odd.collect()})
    assert source_mix.mix_sources(empty).count() == 0


def test_taken_rows_hold_what_was_taken(documents, odd, empty):
    for docs in (documents, odd.where("doc_id IS NULL OR doc_id != 3")):
        want = {r["doc_id"]: r["taken"] for r in source_mix.mix_sources(docs).collect() if r["taken"]}
        got = collections.Counter()
        taken = source_mix.take_mix(docs)
        assert taken.columns == docs.columns
        for r in taken.collect():
            got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
        assert {i: n for i, n in got.items() if n} == want
    assert source_mix.take_mix(empty).count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_stages_keep_columns_and_bear_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
            out.collect()


def test_pipeline_by_brute_force(spark, documents):
    """Every stage on the result of the one before, against what plain Python makes of it."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} <= {
                r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")
            }
        elif name == "line_dedup":
            pages, on = collections.Counter(r["source"] for r in before), collections.Counter()
            for r in before:
                on.update({(r["source"], x) for x in r["text"].split("\n") if x.strip(" ")})
            drop = {k for k, n in on.items() if n >= corpus_pipeline.LINE_PAGES and n > corpus_pipeline.LINE_RATIO * pages[k[0]]}
            want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop) for r in before}
            assert {r["doc_id"]: r["text"] for r in rows} == want
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != next(b["text"] for b in before if b["doc_id"] == r["doc_id"]))
        elif name == "simhash_dedup":
            order = sorted(before, key=lambda r: r["doc_id"])
            label = brute_components([brute_fingerprint(r["text"]) for r in order], lambda a, b: (a ^ b).bit_count() <= 2)
            assert {r["doc_id"] for r in rows} == {order[x]["doc_id"] for x in label}
        elif name == "source_mix":
            sizes = collections.Counter()
            for r in before:
                sizes[r["source"]] += len(WORD.findall(r["text"]))
            got = collections.Counter()
            for r in rows:
                got[r["source"]] += len(WORD.findall(r["text"]))
            assert all(abs(got[s] - t) <= 1 for s, t in brute_targets(dict(sizes)).items())
        else:
            texts = collections.Counter((r["doc_id"], r["text"]) for r in before)
            tokens = collections.Counter()
            for r in rows:
                tokens[r["doc_id"]] += r["length"]
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path())
            want = collections.Counter()
            for (i, text), n in texts.items():
                want[i] += n * (len(t.encode(text, add_special_tokens=False).ids) + 1)
            assert tokens == want


#: These return a row per conversation, or per triple; their SQL holds their rows.
OTHER_ROWS = {"op11_conversation", "op13_hard_negatives"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_ROWS))
def test_queries_return_a_row_per_input(spark, name):
    df = QUERIES[name](spark, SF)
    table = {"op7_warc": "pages", "op8_embedding": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() >= n
