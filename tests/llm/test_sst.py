import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from mnemoframe.llm import sst

VOCABULARY = P.path("word_bpe_49k.json")


def test_lookup_and_scan(tmp_path):
    path = tmp_path / "a.sst"
    writer = sst.Writer(open(path, "wb"), 2)
    keys = [sst.key_of(None), *[sst.key_of(i * 3 - 6000) for i in range(4000)]]
    for n, key in enumerate(keys):
        writer.add(key, np.arange(n % 700, dtype=np.uint32))
    writer.close()
    reader = sst.Reader(str(path))
    assert len(reader.places) > 3 and reader.n_docs == len(keys)
    assert [k for k, _ in reader.scan()] == keys
    for n in (0, 1, 2, 17, 3999, 4000):
        assert len(reader.get(keys[n])) == n % 700
    assert all(reader.get(sst.key_of(i * 3 - 5999)) is None for i in range(2000))
    assert sst.id_of(keys[0]) is None and sst.id_of(keys[1]) == -6000


def test_rows_against_the_library(spark):
    rows = [(5, "Hello  Wörld's 12 áé x\x1cy"), (None, "null id"), (1, None), (1, "twice"), (-3, ""), (9, "<|startoftext|> ab<|endoftext|>c"), (7, "long wörd " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as ids", "3 as id")
    manifest = sst.write_shards(df, VOCABULARY, shard_bytes=60_000)
    got = {(r.doc_id, r.n_tokens): r for r in sst.read_shards(manifest).collect()}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        r = got.pop((doc_id, len(ids)))
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.ids_crc32, bytes(r.ids)) == (start, zlib.crc32(raw), raw), doc_id
        start += len(ids)
    assert not got
    assert sst.read_shards(sst.write_shards(df.limit(0), VOCABULARY)).count() == 0


def test_documents_of_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in sst.read_shards(sst.write_shards(docs, VOCABULARY, shard_bytes=50_000)).drop("ids").collect()}
    tokenizer, start = Tokenizer.from_file(VOCABULARY), 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_encode_as_whole_texts():
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = sst.WordEnds(f.read())
    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(4)
    letters = ["a", "B", "ß", "É", "e\u0301", "\u0130", "\u03a3", "'s", "'", ",", "...", "\u2026", " ", "\n", "\x1c", "\u00a0", "1", "\u00b2", "_", "-", "<|", "<|ENDOFTEXT|>", "<|endoftext|>", "\u4e2d", "\u0301", "$$$", "tion", "the"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        pieces = encoder.pieces(text.encode())
        assert encoder.memo.flat(pieces, encoder.many)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
