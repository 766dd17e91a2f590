"""Token files against the tokenizer itself, and packing against its rules."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing, shared, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  ", "a", "A.", "Foo, bar. É. à, ×. Don't STOP's ,. .. foo”. a b. <|endoftext|> <|ENDOFTEXT|>x. İX ΑΣ. 漢字。1,2 3.5. x\x00y \r\n z\tq.",
    "STRASSE ẞ. ﬁ. ÿ, ÷, Å. Ķ.́ a.́", "\n\n.", "x<|startoftext|>y Łódź, ŁÓDŹ.", "longword" * 5000, "many words here " * 30_000,
]


def expected(texts):
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        yield start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()
        start += len(ids)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_files_give_back_what_the_tokenizer_gives(spark, kind):
    rows = [(k * 3, t, "x") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    manifest = token_files.write_tokens(docs, PATH, shared.shared_path(spark, "t"), kind=kind, block_ids=1000)
    got = sorted(map(tuple, token_files.read_tokens(manifest, with_ids=True).collect()))
    assert got == [(r[0], *e) for r, e in zip(rows, expected(TEXTS))]


def test_the_query_equals_the_tokenizer(spark):
    sample = "/root/testdata/sf0.001"
    docs = sorted(map(tuple, shared.table(spark, sample, "documents").select("doc_id", "text").collect()))
    got = sorted(map(tuple, token_files.op3_token_files(spark, sample).collect()))
    assert got == [(d, *e[:3]) for (d, _), e in zip(docs, expected([t for _, t in docs]))]


def test_repeated_and_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a a"), (1, "b"), (None, "c")], "doc_id long, text string")
    got = token_files.read_tokens(token_files.write_tokens(docs, PATH, shared.shared_path(spark, "t"))).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 2), (2, 1, 3), (5, 1, 2), (7, 1, 2)]
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), PATH, shared.shared_path(spark, "t"))).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        for kind in token_files.PLANES:
            assert (token_files.from_planes(token_files.to_planes(ids, kind), n, kind) == ids).all()
    ids = np.array([5, 6], np.uint32)
    bits = [b"" if not p else p for p in token_files.to_planes(ids, "bit")]
    assert [bool(b) for b in bits[:4]] == [True, True, True, False] and not any(bits[3:])


def test_encoder_forgets_and_stays_exact():
    encoder, tokenizer = token_files.Encoder(PATH, keep=50), Tokenizer.from_file(PATH)
    for k in range(20):
        text = f"alpha{k} Beta. gamma{k % 3}, delta*** {k}"
        ids, lengths = encoder.encode(pa.array([text], pa.large_string()), None)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and lengths.tolist() == [len(ids)]


def test_words_that_a_linear_hash_confuses():
    morse = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    texts = [morse, other, morse[:16], other[:16], morse[:17], other[:17], f"{morse} {other}", "abcdefgh abcdefg\x00 abcdefgh\x00", "x<y X<Y x<|endoftext|>"]
    encoder, tokenizer = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # from the tokenizer, then from memory
        ids, lengths = encoder.encode(pa.array(texts, pa.large_string()), None)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    hashes = shared.Words(pa.array(texts[:6], pa.large_string())).hashes()
    assert len(set(hashes.tolist())) == 6


# ---------------------------------------------------------------- packing


def check(rows, lengths, capacities):
    """Every document whole, no bin over its capacity, none larger than its contents need, no gap or overlap."""
    most = max(capacities)
    pieces, bins = Counter(), {}
    for r in rows:
        assert r.doc_start == r.piece * most and 0 < r.length <= most
        pieces[r.doc_id] += r.length
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.capacity))
    assert pieces == Counter({d: n for d, n in lengths.items() if n > 0})
    for own in bins.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert {c for *_, c in own} == {min(c for c in capacities if c >= at)}
    return bins


@pytest.mark.parametrize("seed", range(3))
def test_packing_keeps_its_rules(spark, seed):
    rng = random.Random(seed)
    capacities = (8, 16, 64)
    lengths = {d: rng.choice([0, 1, 3, 5, 5, 5, rng.randint(1, 64), rng.randint(1, 300)]) for d in range(700)}
    docs = spark.createDataFrame([(d, n, "x") for d, n in lengths.items()], "doc_id long, n int, length string")
    bins = check(packing.pack(docs, length=docs["n"], capacities=capacities, overhead=2).collect(), lengths, capacities)
    # no worse than first fit by document into the largest size
    rest, opened = [], 0
    for n in (n for d in sorted(lengths) for n in [64] * (lengths[d] // 64) + [lengths[d] % 64] if n):
        k = next((k for k, r in enumerate(rest) if r >= n), None)
        if k is None:
            opened += 1
            rest.append(64 - n)
        else:
            rest[k] -= n
    assert sum(own[0][2] + 2 for own in bins.values()) <= opened * 66


def test_plan_equals_best_fit_piece_by_piece():
    rng = random.Random(4)
    for _ in range(30):
        counts = Counter(rng.randint(1, 20) for _ in range(rng.randint(1, 60)))
        plan = packing.best_fit(counts, (20,), 0, 20)
        room = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - length)
            else:
                room.append(20 - length)
        assert sum(e - f for f, e, _ in plan.bins) == len(room)
        assert sorted(20 - u for f, e, u in plan.bins for _ in range(e - f)) == sorted(room)


def test_packing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "w " * 20_000)], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 2, None: 1, 4: 3}
    assert sum(r.length for r in got) == 1 + 1 + 3 + 3 + 2 + 20_001
    assert packing.pack(docs.limit(0)).count() == 0


def test_the_query(spark):
    sample, tokenizer = "/root/testdata/sf0.001", Tokenizer.from_file(PATH)
    docs = shared.table(spark, sample, "documents").select("doc_id", "text").collect()
    lengths = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in docs}
    check(packing.op7_packing(spark, sample).collect(), lengths, packing.CAPACITIES)


def test_sequences_read_from_token_files(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta!"]) for _ in range(rng.choice([0, 3, 40, 700])))) for k in range(60)] + [(7, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_files.write_tokens(docs, PATH, shared.shared_path(spark, "t"), block_ids=256)
    packed = packing.pack_files(manifest, capacities=(64, 256, 512))
    got = {r.bin_id: r for r in packing.sequences(packed).collect()}
    want = Counter(tuple(e[3]) for e in expected([t for _, t in rows]))
    pieces, found = {}, Counter()
    for r in packed.collect():
        pieces.setdefault((r.doc_id, r.path, r.at - r.doc_start), []).append((r.piece, got[r.bin_id].ids[r.bin_offset : r.bin_offset + r.length]))
        assert len(got[r.bin_id].ids) <= r.capacity == got[r.bin_id].capacity
    for own in pieces.values():
        found[tuple(x for _, ids in sorted(own) for x in ids)] += 1
    assert found == want
