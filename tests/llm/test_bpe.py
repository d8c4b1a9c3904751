import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from ashlar.llm import bpe
from ashlar.llm.queries import op6_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cut_texts_encode_as_whole_ones(monkeypatch):
    random.seed(5)
    whole, codec = library(), bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    bits = ["a", "b", " ", "  ", "\n", "\t", " 12", "é", "'s", "'ll", "!!", " ", "　", "日本", "。", "Ж", "12", "’s", "<|endoftext|>", "x" * 20]
    monkeypatch.setattr(bpe, "PIECE_CHARS", 10)
    for _ in range(300):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 200)))
        assert [i for p in bpe.pieces(text, 10) for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text) == codec.encode(text).tolist()
        assert "".join(bpe.pieces(text, 10)) == text and codec.decode(codec.encode(text)) == text.encode()


def test_long_texts_without_white_space_are_cut():
    random.seed(6)
    text = "".join(random.choice(("日本語のテキスト", "、", "。", "ab", "12", "'s", "ж")) for _ in range(500_000))
    parts = list(bpe.pieces(text))
    assert len(text) > 1_000_000 and max(map(len, parts)) < bpe.PIECE_CHARS + 200 and "".join(parts) == text
    assert bpe.Codec(bpe.load_ranks(PATH), P.PATTERN).encode(text).tolist() == library().encode_ordinary(text)


def test_encode_decode_frames(spark):
    rows = [(1, None, 0), (1, "", 0), (2, "naïve 😀 text", 0), (2, "naïve 😀 text", 0), (3, "word " * 200_000, 0), (4, "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    coded = bpe.encode(df, PATH, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "N_TOKENS", "token_ids", "n_tokens_1"]
    got = bpe.decode(coded, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, r.decoded.decode()) for r in got) == sorted((i, t or "") for i, t, _ in rows)
    assert all(r.token_ids == library().encode_ordinary(r.text or "") and r.n_tokens_1 == len(r.token_ids) for r in got)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_query_against_the_library(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    whole = library()
    for r in op6_byte_bpe(spark, sf_dir).collect():
        ids = whole.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
