"""Token blocks and packing: exact round trips, damage, odd texts."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaderstream.llm import packing, token_blocks, tokens
from leaderstream.llm.queries import BYTE_BPE, QUERIES

PATH = public_tokenizers.path(BYTE_BPE)

ODD = [
    "", " a", "a ", "a  b", "a\n\nb", "a \n b", "\n", "a\tb", "a \tb", "x\t \tb", "it's   ok", "don't, we're", "<|endoftext|> x",
    "naïve café² 3½", "日本語 テスト", "a\r\nb", "  ", "a b c", "é.", "x.\ny", "\nab", "a\n", "\x00 \x1f", "ﬁ ǅ ʼn", "é a",
]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    encoder = tokens.encoder(PATH)
    assert encoder.ids(text).tolist() == encoder.words.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abÄé .,'!\n\t  019", max_size=30))
def test_ids_are_those_of_the_tokenizer(text):
    encoder = tokens.encoder(PATH)
    assert encoder.ids(text).tolist() == encoder.words.encode(text)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(PATH)
    text = " ".join(f"w{n}, x{n}" for n in range(500))
    assert encoder.ids(text).tolist() == encoder.words.encode(text)
    assert len(encoder.words) <= 50


def test_words_met_again_outlast_others():
    """Words of every text are encoded once, though the others fill the store many times over."""
    encoder, encoded = tokens.Encoder(PATH, 60), []
    spaced = encoder.words.spaced
    encoder.words.spaced = lambda word: encoded.append(word) or spaced(word)
    for n in range(40):
        letters = [chr(97 + n // 26) + chr(97 + n % 26) + c for c in "abcdefgh"]
        text = "so often met " + " ".join(f"q{x}" for x in letters) + " often met"
        assert encoder.ids(text).tolist() == encoder.words.encode(text)
    assert encoded.count("often") == encoded.count("met") == 1
    assert len(encoded) == len(set(encoded)) == 322
    assert len(encoder.words) + len(encoder.words.older) <= 60


def test_marks_behind_words_leave_the_word_its_own():
    """Words with runs of any ASCII marks behind them are put together; only other odd words need the whole tokenizer."""
    encoder = tokens.Encoder(PATH)
    whole, called = encoder.words.encode, []
    encoder.words.encode = lambda text: called.append(text) or whole(text)
    text = "some word### other$$$ word.### (an é&&& word') word\"}]\nword*** x' a-b o'clock"
    assert encoder.ids(text).tolist() == whole(text)
    assert called == [" (an", " a-b", " o'clock"]


def test_long_words_are_not_remembered():
    encoder = tokens.Encoder(PATH)
    text = "a " + "ab" * 5000 + " b"
    assert encoder.ids(text).tolist() == encoder.words.encode(text)
    assert all(len(word) < 100 for word in encoder.words)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000, 70_001])
@pytest.mark.parametrize("kind", ["even", "skewed", "same", "periodic"])
def test_blocks_round_trip(n, kind):
    random = np.random.default_rng(n)
    ids = {
        "even": random.integers(0, 50_257, n),
        "skewed": np.minimum(random.zipf(1.3, n), 50_256),
        "same": np.full(n, 50_256),
        "periodic": np.arange(n) % 37,
    }[kind]
    cuts = np.sort(random.integers(0, n + 1, 5))
    documents = np.split(ids, cuts)
    data = token_blocks.pack_block(documents, 50_257)
    read = token_blocks.unpack_block(data)
    assert [d.tolist() for d in read] == [d.tolist() for d in documents]
    if kind in ("same", "periodic") and n == 70_001:
        assert len(data) < n


def test_damage_is_seen():
    data = bytearray(token_blocks.pack_block([np.arange(3000)], 50_257))
    for at in (0, 20, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            token_blocks.unpack_block(bytes(broken))
    with pytest.raises(ValueError):
        token_blocks.unpack_block(bytes(data[:10]))


def test_block_is_as_small_as_its_model_says():
    """Random ids take their entropy, and a bit for what a block learns and its lanes begin with."""
    random = np.random.default_rng(7)
    share = 1 / np.arange(1, 301)
    share /= share.sum()
    ids = random.choice(np.arange(300), 1 << 20, p=share).astype(np.uint16)
    entropy = -(share * np.log2(share)).sum()
    data = token_blocks.pack_block([ids], 50_257)
    assert (token_blocks.unpack_block(data)[0] == ids).all()
    assert len(data) * 8 / len(ids) < entropy + 0.49


def test_cut_or_added_words_are_seen():
    ids = np.arange(3000) % 700
    lanes, starts, words = token_blocks.encode_ids(ids, 50_257)
    assert token_blocks.decode_ids(3000, 50_257, lanes, starts, words).tolist() == ids.tolist()
    for wrong in (words[:-1], np.append(words, words[:1]), words ^ np.uint32(1)):
        with pytest.raises(ValueError):
            token_blocks.decode_ids(3000, 50_257, lanes, starts, wrong)


def test_blocks_of_odd_rows(spark, monkeypatch):
    rows = [(5, "a b"), (None, "n"), (2, None), (9, ""), (5, "a b"), (1, "word " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"part": F.lit(1), "data": F.lit("x")})
    found = sorted(token_blocks.digest(frame, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 5, 5, 9]
    assert [r["n_tokens"] for r in found] == [2, 50_002, 1, 3, 3, 1]
    assert token_blocks.digest(frame.limit(0), PATH).count() == 0


def brute(lengths, capacity):
    """Plain best fit with falling sizes: the number of bins."""
    free = []
    for size in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= size]
        if fits:
            free[free.index(min(fits))] -= size
        else:
            free.append(capacity - size)
    return len(free)


def test_packing_is_best_fit():
    random = np.random.default_rng(2)
    lengths = random.integers(1, 101, 700)
    sequence, offset = packing.pack(lengths, 100)
    assert len(set(sequence)) == brute(lengths, 100)
    for s in set(sequence):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
        assert lengths[at].sum() <= 100


def test_packing_keeps_every_capacity():
    random = np.random.default_rng(3)
    lengths = random.integers(1, 60, 500)
    sequence, _ = packing.pack(lengths, 100, most_documents=3, most_cost=4000.0)
    for s in set(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 4000
    with pytest.raises(ValueError):
        packing.pack(np.array([101]), 100)
    assert packing.pack(np.array([], dtype=np.int64), 100)[0].tolist() == []


def test_packing_chooses_by_every_capacity():
    """Against vector best fit one sequence after the other; capacities that can't run out choose too."""
    lengths = np.random.default_rng(4).integers(1, 101, 300)
    need = np.stack([lengths / 100, np.full(300, 1 / 100), lengths**2 / 100**2], axis=1)
    weight, free, wanted = need.mean(axis=0), [], np.zeros(300, int)
    for at in sorted(range(300), key=lambda k: (-(need[k] @ weight), k)):
        left = [weight @ (f - need[at]) ** 2 if np.all(f - need[at] > -1e-9) else np.inf for f in free]
        best = int(np.argmin([*left, 1e9]))
        if best == len(free):
            free.append(np.ones(3))
        free[best] = free[best] - need[at]
        wanted[at] = best
    sequence, _ = packing.pack(lengths, 100, most_documents=100, most_cost=100.0**2)
    assert sequence.tolist() == wanted.tolist()
    assert packing.pack(lengths, 100)[0].tolist() != wanted.tolist()


@pytest.mark.parametrize("what", ["op9_packing", "pipeline"])
def test_production_packing_ends_sequences_by_tokens(spark, tmp_path, what):
    """Many short documents share a sequence: neither their number nor their cost runs out before the tokens."""
    frame = spark.range(300).selectExpr("id AS doc_id", "'a b' AS text")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    if what == "pipeline":
        found = corpus_pipeline.pack(spark, frame, str(tmp_path))
    else:
        found = QUERIES[what](spark, str(tmp_path))
    assert [r["count"] for r in found.groupBy("sequence_id").count().collect()] == [300]
    sequence, _ = packing.pack(np.full(packing.GROUP, 3), packing.CAPACITY, packing.DOCUMENTS, packing.COST)
    assert len(set(sequence)) == -(-packing.GROUP // (packing.CAPACITY // 3)) == 25


def test_packing_of_odd_rows(spark):
    rows = [(5, "a b"), (None, None), (2, ""), (5, "a b"), (1, "word " * 5_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"piece": F.lit(1), "_group": F.lit("x")})
    found = packing.packed(frame, PATH).collect()
    long = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == 1)
    assert long == [(0, 0, 5002 - 4096), (1, 906, 2048), (2, 2954, 2048)]
    assert sorted(r["length"] for r in found if r["doc_id"] != 1) == [1, 1, 3, 3]
    assert packing.packed(frame.limit(0), PATH).count() == 0
