from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import EDGE_TEXTS
from tokenizers import Tokenizer

from seqbraid.llm import prefix_bpe, viterbi, wavelet

PIECES = [
    "a", "B", "the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'RE", "é", "ß", "Σ", "日", "🎉", "1", "23", ".",
    "!!", "\xa0", "\x1c", "\x00", "<|endoftext|>", "<|", "don't", "\r\n", "́", "İ", "____", "====", "tion",
]


def texts(n, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_file():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_file():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def piece_file():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_prefix_counts(byte_file):
    library = Tokenizer.from_file(byte_file)
    own = prefix_bpe.PrefixCounter(byte_file)

    def count(t):
        return len(library.encode(t, add_special_tokens=False).ids)

    for text in texts(400, 14, 1):
        assert own.count(text) == count(text)
        table = own.prefix_counts(text)
        exact = [count(text[:i]) for i in range(len(text) + 1)]
        assert table == exact
        if "<|endoftext|>" not in text:
            for limit in (0, 1, 3, 7):
                best = max(i for i, n in enumerate(exact) if n <= limit)
                assert own.longest_within(text, limit) == best
                assert own.measure(text, limit) == (exact[-1], best)


def test_token_count_query(spark, edge_docs, no_docs, byte_file):
    library = Tokenizer.from_file(byte_file)
    for r in prefix_bpe.token_counts(edge_docs, byte_file).collect():
        text = EDGE_TEXTS[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
        assert len(library.encode(text[: r.cut_chars], add_special_tokens=False).ids) <= 512
    assert prefix_bpe.token_counts(no_docs, byte_file).count() == 0


def test_memo_is_bounded():
    memo = prefix_bpe.Memo(3)
    for i in range(20):
        memo.put(i, i)
        memo.get(0)
    assert len(memo.young) + len(memo.old) <= 6 and memo.get(0) == 0 and memo.get(5) is None


def test_pieces_match_the_library(piece_file):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    own = viterbi.PieceModel(piece_file)
    draw = random.Random(2)
    unbroken = ["".join(draw.choices(["a", "the", "er", "=", "-", "tion", "x", "é"], k=300)) for _ in range(40)]
    for text in texts(400, 40, 3) + unbroken + [" " * n + "x" + " " * n for n in range(1, 40)]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids) == text == library.decode(ids.tolist())


def test_stream_commits_early(piece_file):
    own = viterbi.PieceModel(piece_file)
    text = "thetioner" * 300
    parts = list(own.stream(text))
    assert len(parts) > 50
    assert sum(parts, [])[1:] == own.encode(text).tolist()[1:]
    assert max(map(len, parts)) <= 4 * own.longest


def test_piece_query(spark, edge_docs, no_docs, piece_file):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    encoded = viterbi.encode_documents(edge_docs, piece_file, keep_text=True)
    for r in encoded.collect():
        text = EDGE_TEXTS[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
        assert r.round_trip == (r.text == text) == ("▁" not in text)
    back = viterbi.decode_documents(encoded.select("doc_id", "ids"), piece_file)
    assert {r.doc_id: r.text for r in back.collect()}[8] == EDGE_TEXTS[8]
    assert viterbi.encode_documents(no_docs, piece_file).count() == 0


def test_wavelet_matrix():
    draw = np.random.default_rng(4)
    for n in (1, 7, 512, 513, 5000):
        ids = draw.choice([0, 1, 5, 300, 49407, 65535], n)
        matrix = wavelet.WaveletMatrix.build(ids)
        assert (matrix.unpack() == ids).all()
        assert all(matrix.access(i) == ids[i] for i in range(0, n, max(1, n // 50)))
        for value in (0, 5, 49407, 65535, 7):
            at = np.flatnonzero(ids == value)
            lo, hi = n // 5, n - n // 7
            assert matrix.count(value) == len(at)
            assert matrix.count(value, lo, hi) == ((at >= lo) & (at < hi)).sum()
            assert [matrix.locate(value, k) for k in range(0, len(at), 17)] == at[::17].tolist()
    assert matrix.count(1 << 20) == 0
    with pytest.raises(IndexError):
        matrix.access(5000)


def test_shards_round_trip(spark, edge_docs, no_docs, word_file, tmp_path):
    library = Tokenizer.from_file(word_file)
    path = wavelet.write_shards(edge_docs, word_file, str(tmp_path / "a"), shard_tokens=50)
    start, shards = 0, spark.read.parquet(path).count()
    assert shards > 2
    found = sorted(wavelet.read_documents(spark, path, with_ids=True).collect())
    for r, text in zip(found, EDGE_TEXTS, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    total = wavelet.count_token(spark, path, 1).groupBy().sum("n").first()[0]
    assert total == sum(r.ids.count(1) for r in found)
    plain = [i for r in found for i in r.ids]
    draw = random.Random(1)
    for value in (1, plain[0], max(plain), draw.choice(plain)):
        at = sorted(r.position for r in wavelet.locate_token(spark, path, value).collect())
        assert (at == [i for i, x in enumerate(plain) if x == value]) is True
    assert wavelet.locate_token(spark, path, 49_000).count() == plain.count(49_000)
    asked = [0, 1, 49, 50, 51, len(plain) - 1, *(draw.randrange(len(plain)) for _ in range(40))]
    wanted = spark.createDataFrame([(x,) for x in [*asked, *asked, None, -1, len(plain)]], "position long")
    got = sorted(map(tuple, wavelet.access_tokens(spark, path, wanted).collect()))
    assert got == sorted((x, plain[x]) for x in set(asked))
    empty = wavelet.write_shards(no_docs, word_file, str(tmp_path / "b"))
    assert wavelet.read_documents(spark, empty).count() == 0
    assert wavelet.locate_token(spark, empty, 1).count() == 0


def test_repeated_and_null_ids_are_written_each(spark, word_file):
    rows = [(7, "b"), (None, None), (7, "a a"), (7, "b"), (None, "c"), (-1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = wavelet.write_shards(docs, word_file, shard_tokens=3)
    found = sorted(map(tuple, wavelet.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, -1, 7, 7, 7]
    assert [r[1] for r in found] == [0, 1, 3, 4, 7, 9] and [r[2] for r in found] == [1, 2, 1, 3, 2, 2]


def test_short_stretches_take_the_path_of_the_stream():
    """Ids by the short recursion, the stream and the library; a character without a piece is left to the stream."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = viterbi.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = "abcdeéßж0123.,#-" + "etaoinshr" * 4
    for _ in range(2_000):
        stretch = viterbi.BLANK + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        streamed = [i for ids in own.stream(stretch) for i in ids]
        assert own._short(stretch) == streamed == library.encode(stretch[1:])
    assert own._short(viterbi.BLANK + "a\U0001f9ff") is None
