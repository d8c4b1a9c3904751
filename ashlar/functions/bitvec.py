"""10,000-bit vectors as Spark columns.

The compute form is ``array<bigint>`` of 157 words (bit i is bit i % 64 of word i / 64; the last word's upper 48 bits are
zero); the interchange form is ``binary`` of 1250 bytes, the words in little-endian order.  Everything here is a
built-in expression, so it runs in the JVM, is folded when constant, and moves with filters and projections.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS, WORDS, BYTES = 10_000, 157, 1250
#: The last word holds 16 bits.
LAST_MASK = 0xFFFF

#: Names whose seeded vectors mark the parts of a node (fixed values).
ROLES = ("ROLE_SCHEMA", "ROLE_LOGIC", "ROLE_CONTEXT", "ROLE_INPUT", "ROLE_OUTPUT", "ROLE_CONDITION")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often the result mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _swap(digits: Column) -> Column:
    """A signed word from the first 16 hex digits, of 8 bytes in little-endian order; ``digits`` should be bound."""
    return F.conv(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(8, 0, -1)]), 16, -10).cast("long")


def fp_seed(text: Column) -> Column:
    """Seeded fingerprint: word i comes from the first 8 bytes of SHA-256 of ``text:i``."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256))
    word = lambda h, i: _swap(h).bitwiseAND(F.when(i == WORDS - 1, LAST_MASK).otherwise(-1).cast("long"))
    return F.when(text.isNotNull(), F.transform(hashes, word))


def seed_words(text: str) -> list[int]:
    """fp_seed of a text known beforehand, as signed words."""
    words = [int.from_bytes(hashlib.sha256(f"{text}:{i}".encode()).digest()[:8], "little", signed=True) for i in range(WORDS)]
    return [*words[:-1], words[-1] & LAST_MASK]


def literal(words: list[int]) -> Column:
    """A vector known beforehand as a constant."""
    return F.array(*[F.lit(w).cast("long") for w in words])


def callable_text(fn) -> str:
    """What a Python function is known by: name, signature and body as its source has them (the code's bytes where there is no source)."""
    try:
        body = inspect.getsource(fn)
    except (OSError, TypeError):
        body = fn.__code__.co_code.hex() if hasattr(fn, "__code__") else ""
    return f"{fn.__name__}::{inspect.signature(fn)}::{body}"


def identity(kind: Column, name: Column, content: Column, signature: Column | None = None) -> Column:
    """fp_seed of KIND::name::content, or of KIND::name::signature::content."""
    return fp_seed(F.concat_ws("::", kind, name, *([] if signature is None else [signature]), content))


def random_words(seed: Column) -> Column:
    """A vector of random bits that follows from a number or text alone: words are hashes of it and their place."""
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.xxhash64(seed, i).bitwiseAND(F.when(i == WORDS - 1, LAST_MASK).otherwise(-1).cast("long")))


def fingerprint(name: Column, signature: Column, body: Column) -> Column:
    return fp_seed(F.concat(name, F.lit("::"), signature, F.lit("::"), body))


def role_vector(name: str) -> Column:
    return literal(seed_words(name))


def fp_tile(text: Column) -> Column:
    """Tiled hash as 1250 bytes: SHA-256 of the text over and over.  Only 256 bits are free."""
    return F.unhex(F.substring(F.repeat(F.sha2(text, 256), 40), 1, 2 * BYTES))


def to_bytes(words: Column) -> Column:
    """The 1250-byte form."""
    word = lambda w: F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.substring(F.lpad(F.hex(w), 16, "0"), 2 * k + 1, 2)), "")
    return F.unhex(F.substring(F.array_join(F.transform(words, word), ""), 1, 2 * BYTES))


def from_bytes(data: Column) -> Column:
    """Words of a 1250-byte value; any other length is an error."""
    right = F.octet_length(data) == BYTES
    parts = lambda digits: F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.substring(digits, i * 16 + 1, F.lit(16)))
    words = F.transform(bound(F.rpad(F.hex(data), 16 * WORDS, "0"), parts), _swap)
    failed = F.raise_error(F.concat(F.lit(f"a vector has {BYTES} bytes, not "), F.octet_length(data).cast("string")))
    return F.when(data.isNotNull(), F.when(right, words).otherwise(failed.cast("array<bigint>")))


def to_hex(words: Column) -> Column:
    return F.lower(F.hex(to_bytes(words)))


def from_hex(text: Column) -> Column:
    return from_bytes(F.unhex(text))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda n, x: n + x)


def xor(a: Column, b: Column) -> Column:
    """Bind, and unbind: xor(xor(a, b), b) is a."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def hamming(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))))


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(float(BITS))


def popcount(a: Column) -> Column:
    return _sum(F.transform(a, F.bit_count))


def get_bit(a: Column, i: Column) -> Column:
    return F.getbit(F.element_at(a, F.floor(i / 64).cast("int") + 1), (i % 64).cast("int")) == 1


def set_bit(a: Column, i: Column, value: bool = True) -> Column:
    """A copy with one bit set or cleared."""
    word = F.floor(i / 64).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))
    return F.transform(a, lambda x, k: F.when(k == word, x.bitwiseOR(mask) if value else x.bitwiseAND(F.bitwise_not(mask))).otherwise(x))


def zero_words(a: Column, b: Column) -> Column:
    """Words in which two vectors agree throughout."""
    return F.size(F.filter(xor(a, b), lambda x: x == 0))


def index32(a: Column) -> Column:
    """Low 32 bits of the first word."""
    return a[0].bitwiseAND(F.lit(0xFFFFFFFF))


def indexed(rows: DataFrame, fp: str = "fp", key: str = "id") -> DataFrame:
    """``rows`` with ``idx``: the 32-bit index; of several vectors with one index all but the first (by ``key``) take the second word's low bits with bit 31 set."""
    first = Window.partitionBy("idx").orderBy(key)
    low = rows.withColumn("idx", index32(F.col(fp))).withColumn("k", F.row_number().over(first))
    other = F.col(fp)[1].bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 31))
    return low.withColumn("idx", F.when(F.col("k") == 1, F.col("idx")).otherwise(other)).drop("k")


def cam48(data: Column) -> Column:
    """48-bit address: the first 6 bytes of SHA-256 of the bytes."""
    return F.conv(F.substring(F.sha2(data, 256), 1, 12), 16, 10).cast("long")


def positional_cam(data: Column) -> Column:
    """The bytes at 0, 208, 416, 624, 832 and 1040 in hex."""
    return F.lower(F.concat(*[F.hex(F.substring(data, at + 1, 1)) for at in range(0, 1041, 208)]))


def majority3(a: Column, b: Column, c: Column) -> Column:
    """Bundle of three: a bit is set where two or three have it."""
    ab = F.zip_with(a, b, lambda x, y: F.struct(x.bitwiseAND(y).alias("both"), x.bitwiseOR(y).alias("any")))
    return F.zip_with(ab, c, lambda p, z: p["both"].bitwiseOR(p["any"].bitwiseAND(z)))


def bundle2(a: Column, b: Column) -> Column:
    """Bundle of two: ties give 0, so a bit is set where both have it."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def bundle_array(vectors: Column) -> Column:
    """Majority of an array of vectors, ties 0; an empty array is an error."""
    n = F.size(vectors)

    def word(i: Column) -> Column:
        own = F.transform(vectors, lambda v: v[i])
        bit = lambda k: F.when(2 * F.aggregate(own, F.lit(0), lambda s, x: s + F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(1)).cast("int")) > n, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), word)
    return F.when(n > 0, words).otherwise(F.raise_error(F.lit("nothing to bundle")).cast("array<bigint>"))


def region_similarity(a: Column, b: Column, start: int, end: int) -> Column:
    """Similarity over the bits start..end-1 of two 1250-byte values, bits counted from each byte's highest."""
    first, last = start // 8, (end + 7) // 8
    byte = lambda digits, k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    lead, tail = 0xFF >> (start % 8), (0xFF << (-end % 8)) & 0xFF
    mask = lambda k: F.when(k == first, lead).otherwise(255).bitwiseAND(F.when(k == last - 1, tail).otherwise(255))
    differ = lambda h: F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda k: F.bit_count(byte(h["a"], k).bitwiseXOR(byte(h["b"], k)).bitwiseAND(mask(k))))
    return 1 - _sum(bound(F.struct(F.hex(a).alias("a"), F.hex(b).alias("b")), differ)) / F.lit(float(end - start))


def segment_score(a: Column, b: Column) -> Column:
    """Two-stage score over 40 segments of 31 bytes (the last 10 bytes aside): distance / 1000 + variance / 100 + largest / 50."""
    byte = lambda digits, k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    segment = lambda h: lambda s: _sum(F.transform(F.sequence(s * 31, s * 31 + 30), lambda k: F.bit_count(byte(h["a"], k).bitwiseXOR(byte(h["b"], k)))))
    own = bound(F.struct(F.hex(a).alias("a"), F.hex(b).alias("b")), lambda h: F.transform(F.sequence(F.lit(0), F.lit(39)), segment(h)))
    return bound(own, _score)


def _score(v: Column) -> Column:
    total = _sum(v)
    squares = F.aggregate(v, F.lit(0), lambda n, x: n + x * x)
    return total / 1000 + (squares / 40 - F.pow(total / 40, F.lit(2))) / 100 + F.array_max(v) / 50


def permute(a: Column, by: int) -> Column:
    """Words turned around by ``by`` places: marks a place in a list."""
    by %= WORDS
    return a if not by else F.concat(F.slice(a, WORDS - by + 1, by), F.slice(a, 1, WORDS - by))


def state_of(resonance: Column, role: str) -> Column:
    """What was bound with a role."""
    return xor(resonance, role_vector(role))


def encode_number(value: Column) -> Column:
    """A scalar as the vector of its text."""
    return fp_seed(value.cast("string"))


def encode_list(values: Column) -> Column:
    """XOR of the values' vectors, each turned by its place (at most ``WORDS`` of them keep their order apart)."""
    turned = lambda v, i: F.concat(F.slice(v, WORDS - F.pmod(i, F.lit(WORDS)) + 1, WORDS), F.slice(v, F.lit(1), WORDS - F.pmod(i, F.lit(WORDS))))
    placed = F.transform(values, lambda x, i: bound(fp_seed(x.cast("string")), lambda v: turned(v, i)))
    return F.aggregate(placed, F.array_repeat(F.lit(0).cast("long"), WORDS), xor)


def encode_fields(fields: Column) -> Column:
    """XOR of every field's name vector bound to its value's, for a map of names to values."""
    pairs = F.transform(F.map_entries(fields), lambda e: xor(fp_seed(e["key"]), fp_seed(e["value"].cast("string"))))
    return F.aggregate(pairs, F.array_repeat(F.lit(0).cast("long"), WORDS), xor)


def probe(record: Column, field: Column) -> Column:
    """What a record of one field holds under a name; of more fields, that and the others' noise."""
    return xor(record, fp_seed(field))


def thermometer(values: Column, low: float, high: float, levels: int = 62) -> Column:
    """A vector whose words stand for the dimensions of ``values`` (157 at most): word d has as many low bits set as levels between ``low`` and ``high``
    lie under value d, so the Hamming distance of two of them is the sum of the differences in levels.  Null and NaN count as above ``high``; no values give null."""
    level = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(levels)), (x.cast("double") - low) * (levels / (high - low))))).cast("int")
    words = F.transform(values, lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), level(x)) - 1)
    return F.when(F.size(values) > 0, F.slice(F.concat(words, F.array_repeat(F.lit(0).cast("long"), WORDS)), 1, WORDS))
