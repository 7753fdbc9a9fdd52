import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken

from mnemoframe.llm import byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_perfect_hash_fills_every_slot():
    keys = [f"k{i}".encode() for i in range(5000)]
    mph = byte_bpe.PerfectHash(keys)
    assert sorted(mph.slots) == list(range(5000))
    assert all(mph.find(k) == i for i, k in enumerate(keys))
    assert mph.find(b"other") == -1
    assert byte_bpe.PerfectHash([]).find(b"x") == -1


def test_merges_like_the_library():
    codec = byte_bpe.ByteBpe(byte_bpe.load_ranks(RANKS), P.PATTERN).prepared()
    enc, rng = reference(), random.Random(3)
    texts = ["".join(rng.choice("abcdefé üß中文  \n\t12'tsth") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in [*texts, "aaaaaaaaaaaaaaaaaaaaaaa", "ababababab", "\x00\x01", "🙂🙂"]:
        got = [i for p in codec.split(t) for i in codec.encode_piece(p)]
        assert got == enc.encode_ordinary(t), t


def test_rows(spark):
    rows = [(1, "Hello world, it's 2024!"), (2, None), (3, ""), (None, "x"), (3, "same id"), (4, "très " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as id", "3 as n_tokens")
    out = byte_bpe.encode(df, RANKS, P.PATTERN).collect()
    enc = reference()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, raw, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in out), key=key) == sorted(want, key=key)
    assert byte_bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
