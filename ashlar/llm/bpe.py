"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file (about 50,000 lines, its size is checked) is read once on the driver and shipped to the
executors, so it need not exist on them.  Texts are encoded an Arrow batch at a time; nothing is
shuffled and no state outlives a text.  Long texts are cut at safe boundaries before encoding: between
a character that is not white space and one that is, or between a letter and a digit or mark (no apostrophe), no match
of the splitting pattern can span the cut, and matches on either side are those of the whole text, so the ids are exactly those of
one call on the whole text while memory stays small.  The pattern must keep letters apart from digits and marks that follow them, as
those of byte-level vocabularies do; a text without any such boundary is one match or nearly so, and goes to the library whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _common as C
from . import _text as X

#: Characters in one call of the library; longer texts are cut.
PIECE_CHARS = 1 << 16
#: More ranks than any byte-level vocabulary in use; beyond it the file is refused, not shipped.
MAX_RANKS = 1 << 20

#: Letters and marks that every version of Unicode has classed alike; an apostrophe may belong to the letters after it.
_LETTER = r"A-Za-z\u0410-\u044F\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
_MARK = r"0-9!-&(-/:-@\[-`{-~\u2010-\u2018\u201A-\u2027\u3001-\u3003\u3008-\u3011\uFF01-\uFF06\uFF08-\uFF0F\uFF1A-\uFF20"
_CUT = regex.compile(rf"(?<=\S)(?=\s)|(?<=[{_LETTER}])(?=[{_MARK}])")
_cache: dict[tuple, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} has {len(ranks)} ranks; at most {MAX_RANKS} are shipped to executors")
    return ranks


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at the first safe boundary after every ``limit`` characters."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Codec:
    """One process's encoder; made from the shipped ranks at first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE_CHARS:
            return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.concatenate([np.asarray(self.encoding.encode_to_numpy(p, disallowed_special=()), dtype="<u4") for p in pieces(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def _mapped(df: DataFrame, rank_path: str, pattern: str, fields: list[T.StructField], column: str, make: Callable) -> DataFrame:
    """``df`` with the columns that ``make`` computes from ``column``, a few MB of text at a time."""
    shipped = df.sparkSession.sparkContext.broadcast(load_ranks(rank_path))
    key = (rank_path, pattern)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _cache:
            _cache[key] = Codec(shipped.value, pattern)
        for batch in X.batches(stream, names[at]) if cut else stream:
            added = make(_cache[key], batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    at = df.columns.index(column)
    cut = isinstance(df.schema.fields[at].dataType, T.StringType)
    for f in fields:
        f.name = C.free_name(df.columns, f.name)
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f"c{i}" for i in range(len(schema))]  # by position: input names may clash or repeat in case
    wide = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = wide.mapInArrow(run, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)]))
    return out.toDF(*schema.names)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every row of ``df`` with ``token_ids`` (array of int) and ``n_tokens`` added.

    A null or empty text has no ids.  Rows, repeated ones too, and all other columns stay as they are;
    if an added name is taken, a number follows it.  An empty table gives an empty table.
    """

    def make(codec: Codec, column: pa.Array) -> list[pa.Array]:
        ids = [codec.encode(x.as_py() or "") for x in column]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64))]

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]
    return _mapped(df, rank_path, pattern, fields, text, make)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Every row of ``df`` with ``decoded`` (binary: the tokens' bytes, joined) added; null ids give none.

    Bytes are returned as they are: a slice of ids may begin or end inside a character.
    """

    def make(codec: Codec, column: pa.Array) -> list[pa.Array]:
        # one row's ids at a time are Python numbers
        rows = (x.values for x in column)
        return [pa.array([codec.decode(x.to_numpy(zero_copy_only=False)) if x is not None else b"" for x in rows], pa.binary())]

    return _mapped(df, rank_path, pattern, [T.StructField("decoded", T.BinaryType())], ids, make)


def roundtrip_digests(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` added; the ids themselves are not kept, so rows stay small."""

    def make(codec: Codec, column: pa.Array) -> list[pa.Array]:
        counts, ids_digest, text_digest = [], [], []
        for x in column:
            ids = codec.encode(x.as_py() or "")
            counts.append(len(ids))
            ids_digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_digest.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, rank_path, pattern, fields, text, make)
