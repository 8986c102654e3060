"""Token files and piece coding against the libraries' own encoders."""

import random
import zlib

import numpy as np
import pytest

from seaway.llm import pieces, token_files, wordcache
from seaway.llm.wavelet import WaveletMatrix

P = pytest.importorskip("public_tokenizers")
PLAN = "route_id long, plan_text string"
BITS = [*" \n\t\r.,'!?&-_abcXYZ0123éßÉÜñΣσςİıΩａ世界𝔘́▁\x1c\x85\xa0٣Ⅷ½ﬁ", "the ", "ing", "  ", " \n", "\r\n", "'s ", "'LL", "<|endoftext|>", "waypoint ", "▁▁", "    "]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "\n", " a ", "x" * 5000, "abc " * 3000]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (513, 2), (3000, 49_407), (700, 70_000)])
def test_wavelet_matrix_answers_like_an_array(n, top):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n))
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(x).to_bytes())
    assert m.to_array().tolist() == x.tolist()
    if n:
        at = rng.integers(0, n, 50)
        assert m.access(at).tolist() == x[at].tolist()
    for v in [*x[:5].tolist(), 0, top + 1, -1]:
        where = np.flatnonzero(x == v)
        assert m.count(int(v)) == len(where)
        assert [m.select(int(v), k) for k in range(len(where) + 1)][-1] == -1
        assert m.occurrences(int(v)).tolist() == where.tolist()
        cut = rng.integers(0, n + 1, 9)
        assert m.rank(int(v), cut).tolist() == [int((x[:c] == v).sum()) for c in cut]
        assert m.count(int(v), n // 3, n // 2) == int((x[n // 3 : n // 2] == v).sum())


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_words_encode_like_whole_texts(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(wordcache, "BYTES", 300)
    wordcache._powers.cache_clear()
    t = Tokenizer.from_file(P.path(name))
    cache = wordcache.WordCache(token_files.word_encoder(t), size=64)  # so small that words are dropped all the time
    some = texts(3, 1500)
    want = [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in cache.encode_texts(some)] == want
    wordcache._powers.cache_clear()


def test_words_with_equal_first_hash_stay_apart(monkeypatch):
    cache = wordcache.WordCache(lambda w: (np.array([len(x) for x in w], np.int32), np.ones(len(w), np.int64)))
    real = cache._hashes
    monkeypatch.setattr(cache, "_hashes", lambda *a: (real(*a)[0] & np.uint64(1), real(*a)[1]))
    some = ["a bb ccc", "dddd", "a eeeee bb", ""]
    assert [x.tolist() for x in cache.encode_texts(some)] == [[1, 2, 3], [4], [1, 5, 2], []]


def test_token_files_hold_every_text_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    some = texts(5, 200)
    rows = [(1000 - 3 * i, None if i == 7 else s, i) for i, s in enumerate(some)]
    plans = spark.createDataFrame(rows, PLAN + ", start int").repartition(7)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(plans, path, P.path("word_bpe_49k.json"), 1, shard_tokens=300)
    got = {r.route_id: r for r in token_files.read_token_files(spark, path).collect()}
    at, all_ids = 0, []
    for i, s, _ in sorted(rows):
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        all_ids += ids
    assert len(got) == len(rows) and spark.read.parquet(path).count() > 3
    assert token_files.count_tokens(spark, path, 1).agg({"n": "sum"}).first()[0] == all_ids.count(1)


def test_token_files_of_odd_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("odd", [(1, "b"), (1, "a"), (None, "x"), (2, None)])):
        path = str(tmp_path / name)
        token_files.write_token_files(spark.createDataFrame(rows, PLAN), path, P.path("word_bpe_49k.json"), 1)
        got = token_files.read_token_files(spark, path).orderBy("start").collect()
        assert [r.route_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
        assert not got or got[-1].n_tokens == 1


@pytest.fixture(scope="module")
def model():
    return pieces.load_pieces(P.path("piece_bpe_32k.model"))


def test_merge_ranked_pieces_equal_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    some = texts(7, 4000)
    got = model.coder.encode(some)
    assert [x.tolist() for x in got] == sp.encode(some)
    assert [model.coder.decode(x) for x in got] == sp.decode([x.tolist() for x in got])


def test_unigram_pieces_equal_the_library(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    scores = {}
    rng = random.Random(2)
    for p in proto.pieces:
        if p.type == 1:
            p.score = scores.setdefault(p.piece, -rng.uniform(3, 14) - 0.3 * len(p.piece))
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    uni = pieces.PieceModel(model.pieces, tuple(float(p.score) for p in proto.pieces), model.kinds, False)
    some = [t for t in texts(9, 1500) if len(t) < 200]
    same = [a.tolist() == b for a, b in zip(uni.coder.encode(some), sp.encode(some), strict=True)]
    assert all(same)


def test_pieces_of_tables(spark, model):
    rows = [(1, None, "clash"), (2, "", "x"), (3, "Heading  north\n\tnow ü 世 𝔘", "y"), (3, "Heading  north\n\tnow ü 世 𝔘", "y"), (4, "long " * 30_000, "z")]
    x = pieces.encode_pieces(spark.createDataFrame(rows, PLAN + ", piece_ids string"), model)
    got = pieces.decode_pieces(x, model).orderBy("route_id").collect()
    assert [r.decoded_text for r in got] == [r[1] or "" for r in rows]
    assert got[0].piece_ids == [] and got[2].piece_ids == got[3].piece_ids and len(got) == 5
    assert pieces.encode_pieces(spark.createDataFrame([], PLAN), model).count() == 0


def test_decoding_of_broken_bytes(model):
    byte = model.coder.bytes
    assert model.coder.decode([byte[0xE4], byte[0xB8]]) == "�" and model.coder.decode(None) == ""


def test_long_runs_of_tied_pieces_equal_the_library():
    import time

    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    coder, library = pieces.load_pieces(path).coder, sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [" " * k for k in (1, 2, 3, 15, 16, 17, 31, 33, 500, 20_001)] + ["a" + " " * k + "b" for k in range(40)]:
        assert list(coder.encode([text])[0]) == library.encode(text)
    begin = time.time()
    assert len(coder.encode([" " * 100_000])[0]) == 6251  # a quadratic merge takes half an hour
    assert time.time() - begin < 60
