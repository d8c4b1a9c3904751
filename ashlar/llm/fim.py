"""Fill-in-middle: texts are cut into prefix, middle and suffix at seeded code points and put together anew.

Identical texts are one entry of an index that holds the places of the text's code points as an Elias-Fano list: two bits a code point
and a few more for wide ones, instead of eight bytes.  Documents meet the entry of their text, and each selects its own two cuts from the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, 1
#: Documents of one text that a task cuts; more are dealt to several, each with a copy of the entry.
HOT = 1_000
#: Lists of hot texts up to so many are broadcast.
BROADCAST_TEXTS = 100_000
#: Every so many boundaries the place of a boundary's bit is kept, so that a selection looks at some hundred bytes.
_SAMPLE = 512


def elias_fano(text: bytes) -> bytes:
    """The first byte of every code point of a UTF-8 text, and its length, as an Elias-Fano list.

    Layout, little-endian: number of boundaries, bits of a lower part, number of samples (uint32 each); samples (uint32); lower parts, packed;
    upper parts, in unary.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int64)
    n, low = len(at), 0
    while n << (low + 1) <= len(data):
        low += 1
    ones = (at >> low) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    upper[ones] = 1
    lower = ((at[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    samples = ones[::_SAMPLE].astype("<u4")
    return b"".join((np.array([n, low, len(samples)], dtype="<u4").tobytes(), samples.tobytes(), np.packbits(lower.ravel(), bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes()))


def select(boundaries: bytes, i: int) -> int:
    """Boundary ``i`` (from 0) of an Elias-Fano list."""
    n, low, n_samples = np.frombuffer(boundaries, dtype="<u4", count=3).tolist()
    samples = np.frombuffer(boundaries, dtype="<u4", count=n_samples, offset=12)
    lower_at = 12 + 4 * n_samples
    upper_at = lower_at + (n * low + 7) // 8
    s, rest = divmod(i, _SAMPLE)
    first = int(samples[s])
    last = int(samples[s + 1]) // 8 + 1 if s + 1 < n_samples else len(boundaries) - upper_at
    bits = np.unpackbits(np.frombuffer(boundaries, dtype=np.uint8, count=last - first // 8, offset=upper_at + first // 8), bitorder="little")
    upper = first + int(np.flatnonzero(bits[first % 8 :])[rest]) - i
    if not low:
        return upper
    bit = i * low
    part = int.from_bytes(boundaries[lower_at + bit // 8 : lower_at + (bit + low + 7) // 8], "little") >> (bit % 8)
    return (upper << low) | (part & ((1 << low) - 1))


def _boundaries(text: Column) -> Column:
    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array((elias_fano(x.as_buffer().to_pybytes()) for x in texts), pa.binary())

    return made(text.cast("binary"))


def _selected(boundaries: Column, cuts: Column) -> Column:
    """For an array of struct<low, high> (units) the bytes at which these begin."""
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    @F.arrow_udf("array<struct<low: int, high: int>>")
    def found(lists: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = ((x.as_buffer().to_pybytes(), places) for x, places in zip(lists, wanted.to_pylist(), strict=True))
        return pa.array(([{"low": select(x, p["low"]), "high": select(x, p["high"])} for p in places] for x, places in rows), kind)

    return found(boundaries, cuts)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, text, n_documents, n_units): a row for each distinct text, a null one counting as empty.

    Texts are grouped by their SHA-256; of each group the distinct contents are gathered, task by task before the shuffle, so copies travel once a
    task and a group of two contents would be seen: that stops the job with an error instead of mixing texts.
    """
    body = F.coalesce(C.keyed(text), F.lit(""))
    groups = docs.select(F.unhex(F.sha2(body, 256)).alias("text_key"), body.alias("text")).groupBy("text_key")
    found = groups.agg(F.collect_set("text").alias("contents"), F.count(F.lit(1)).alias("n_documents"))
    one = F.when(F.size("contents") == 1, F.col("contents")[0]).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("string"))
    return found.select("text_key", one.alias("text"), "n_documents").withColumn("n_units", F.length("text").cast("long"))


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sentinels: tuple[str, str, str] = SENTINELS,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = SEED,
    hot: int = HOT,
) -> DataFrame:
    """The rows with n, form, prefix_chars, middle_chars and output, under free names.

    Numbers drawn from the SHA-256 of ``seed:key`` choose two of the n + 1 places between code points (they may be equal: a part is empty then)
    and the form: plain (the text as it is) for empty texts, texts that hold a sentinel and ``plain_percent`` of the rest; of the others
    ``spm_percent`` put the suffix first.  A null text counts as empty and stays null beside its empty output; a null key is an empty one.
    Rows that repeat are cut alike.  The text moves once a distinct text (a hot one once more per ``hot`` documents); documents move without it, and meet
    their entry in groups of some ``hot`` at most.
    """
    n, form, prefix, middle, output = C.free_names(docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(C.keyed(key).cast("string"), F.lit(""))), 256)
    h = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(draws, 8 * i + 1, F.lit(8)), 16, 10).cast("long"))
    others = [C.keyed(c) for c in docs.columns if c != text]
    own = F.unhex(F.sha2(F.coalesce(C.keyed(text), F.lit("")), 256))
    slim = docs.select(own.alias("text_key"), F.struct(C.keyed(text).isNull().alias("absent"), h.alias("h"), F.struct(*others).alias("row")).alias("doc"))

    many = slim.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > hot)
    many = C.written(many.withColumn("copies", F.ceil(F.col("copies") / hot).cast("int")), "hot")
    n_hot = many.count()
    index = distinct_texts(docs, text)
    entry, made = ["text", "n_units"], [_boundaries(F.col("text")).alias("boundaries")]
    gathered = F.collect_list("doc").alias("docs")
    if not n_hot:
        met = index.join(slim.groupBy("text_key").agg(gathered), "text_key").select(*entry, "docs", *made)
    else:
        listed = F.broadcast(many) if n_hot <= BROADCAST_TEXTS else many
        cold = index.where(F.col("n_documents") <= hot).join(slim.join(listed, "text_key", "left_anti").groupBy("text_key").agg(gathered), "text_key")
        salted = slim.join(listed, "text_key").withColumn("salt", F.floor(F.rand(seed) * F.col("copies")).cast("int"))
        entries = index.where(F.col("n_documents") > hot).select("text_key", *entry, *made, F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_documents") / hot).cast("int") - 1)).alias("salt"))
        warm = entries.join(salted.groupBy("text_key", "salt").agg(gathered), ["text_key", "salt"])
        met = cold.select(*entry, "docs", *made).unionByName(warm.select(*entry, "docs", "boundaries"))

    body, units = F.col("text"), F.col("n_units")
    holds = F.greatest(*[F.contains(body, F.lit(s)) for s in sentinels])

    def place(doc: Column) -> Column:
        first, second = doc["h"][0] % (units + 1), doc["h"][1] % (units + 1)
        shape = F.when((units == 0) | F.col("holds") | (doc["h"][2] % 100 >= 100 - plain_percent), "plain").when(doc["h"][3] % 100 < spm_percent, "spm").otherwise("psm")
        return F.struct(F.least(first, second).alias("low"), F.greatest(first, second).alias("high"), shape.alias("form"))

    placed = met.withColumn("holds", holds).withColumn("places", F.transform("docs", place))
    placed = placed.withColumn("bytes", _selected(F.col("boundaries"), F.transform("places", lambda p: F.struct(p["low"], p["high"]))))
    each = placed.select("text", "n_units", F.inline(F.arrays_zip("docs", "places", "bytes")))
    data, low, high = body.cast("binary"), F.col("bytes")["low"], F.col("bytes")["high"]
    part = lambda begin, size: F.substring(data, begin + 1, size).cast("string")
    before, between, after = part(F.lit(0), low), part(low, high - low), part(high, F.octet_length(data) - high)
    p, s, m = map(F.lit, sentinels)
    shape = F.col("places")["form"]
    joined = F.when(shape == "plain", body).when(shape == "psm", F.concat(p, before, s, after, m, between)).otherwise(F.concat(s, after, p, before, m, between))
    texts = [(F.when(~F.col("docs")["absent"], body) if c == text else F.col("docs")["row"][c]).alias(c) for c in docs.columns]
    cut = lambda x: F.when(shape != "plain", x)
    return each.select(
        *texts, units.alias(n), shape.alias(form), cut(F.col("places")["low"]).alias(prefix), cut(F.col("places")["high"] - F.col("places")["low"]).alias(middle), joined.alias(output)
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from its output: no part holds a sentinel, so the first of each parts them."""
    p, s, m = sentinels

    def parted(begin: str, mark: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(1 + len(begin)))
        first = F.substring_index(rest, mark, 1)
        others = F.substr(rest, F.length(first) + 1 + len(mark))
        second = F.substring_index(others, m, 1)
        return first, second, F.substr(others, F.length(second) + 1 + len(m))

    before, after, between = parted(p, s)
    psm = F.concat(before, between, after)
    after, before, between = parted(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(before, between, after))
