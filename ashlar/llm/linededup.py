"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A text's lines (split on ``\\n``, white space at their ends aside; blank lines hold no unit) are laid out as units: one for every
``UNIT_WORDS`` words begun, each carrying hashes of its whole line and its place in it.  A *run* is a
window of ``run_units`` consecutive units, so a few short lines or one long line make a run alike, and lines of over 40 words together hold one in any script.
A line is deleted if it lies, with any unit, in a run that occurs earlier in the table (by document id, then
by place).

1. Winnowing: of every window's unit hashes the smallest is kept, leftmost on ties.  The choice depends on the window's content
   alone, so equal runs choose the same fingerprint: no repeated run can be missed.
2. Positions are joined on the fingerprints that occur twice or more; all other windows drop out.
3. Matches are extended both ways: every window around a fingerprint that chose it is hashed whole and held
   against the first occurrence of that content; later ones mark their lines.

Fingerprints and runs are counted by partial aggregation before they are shuffled, and occurrences meet one row per
content (the first), never each other, so groups of any size cost as many rows as they have members.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .quality import _with

UNIT_WORDS = 8
#: A run of 6 units is 6 short lines, or fewer with over 40 words.
RUN_UNITS = 6
#: Units that a text has at most, as a power of two: more than a string's 2 GB hold.
PLACE_BITS = 26

_SPACES = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _units(lines: Column) -> Column:
    """Hashes (h of 64 bits, g of 32) of the units of a text's lines, in order."""
    none = F.array().cast("array<struct<h:bigint,g:int>>")

    def of_line(line: Column) -> Column:
        each = lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda j: F.struct(F.xxhash64(x["h"], j).alias("h"), F.hash(x["g"], j).alias("g")))
        whole = lambda bare: _with(F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g"), _count(bare).alias("n")), each)
        return _with(F.btrim(line, F.lit(_SPACES)), lambda bare: F.when(F.octet_length(bare) > 0, whole(bare)).otherwise(none))

    return F.flatten(F.transform(lines, of_line))


def _count(bare: Column) -> Column:
    """Units of a line without white space at its ends, which has a word; most lines have single spaces only, which are counted without splitting."""
    odd = reduce(or_, [bare.contains(x) for x in ("  ", *_SPACES[1:])])
    words = F.when(odd, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)
    return F.ceil(words / UNIT_WORDS).cast("int")


def _line_of_units(lines: Column) -> Column:
    """Per unit the place of its line."""
    none = F.array().cast("array<int>")
    return F.flatten(F.transform(lines, lambda line, at: _with(F.btrim(line, F.lit(_SPACES)), lambda bare: F.when(F.octet_length(bare) > 0, F.array_repeat(at, _count(bare))).otherwise(none))))


def _chosen(hashes: Column, run: int) -> Column:
    """Array of (fp, first, last): the windows first..last chose the fingerprint fp.

    Hash and place are packed into one number, so the least of a window is the leftmost least hash and tells its
    place.  (Elements are read one by one: slice() would copy the whole array for every window.)
    """
    last = F.size(hashes) - run

    def runs(least: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), last), lambda s: (s == 0) | (least[s] != least[F.greatest(s - 1, F.lit(0))]))
        ends = lambda b, i: F.when(i < F.size(b) - 1, b[F.least(i + 1, F.size(b) - 1)]).otherwise(last + 1) - 1
        fp = lambda s: hashes[least[s].bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")]
        return _with(starts, lambda b: F.transform(b, lambda s, i: F.struct(fp(s).alias("fp"), s.alias("first"), ends(b, i).alias("last"))))

    packed = F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
    least = lambda v: F.transform(F.sequence(F.lit(0), last), lambda s: F.least(*[v[s + k] for k in range(run)]))
    return _with(_with(packed, least), runs)


def later_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run_units: int = RUN_UNITS) -> DataFrame:
    """(id, key, starts): per document (key: hash of id and text) the starts of its runs that occur earlier."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    units = df.select(F.col(doc_id).alias("id"), key.alias("key"), _units(_lines(F.col(text))).alias("u"))
    units = C.written(units.where(F.size("u") >= run_units).select("id", "key", F.col("u.h").alias("h"), F.col("u.g").alias("g")), "units")

    marks = units.select("id", "key", F.inline(_with(F.col("h"), lambda h: _chosen(h, run_units))))
    repeated = marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    ranges = marks.join(repeated, "fp", "left_semi").groupBy("id", "key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"id": "own", "key": "own_key"})

    # hashed before they are exploded, so that no row carries its text's whole array; 96 bits, as equality deletes text
    starts = F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"])))
    hashed = lambda f, c, s: f(*[F.col(c)[s + k] for k in range(run_units)])
    content = lambda s: F.struct(s.alias("s"), hashed(F.xxhash64, "h", s).alias("content"), hashed(F.hash, "g", s).alias("check"))
    runs = units.join(ranges, (F.col("key") == F.col("own_key")) & F.col("id").eqNullSafe(F.col("own"))).select("id", "key", F.inline(F.transform(starts, content)))
    runs = C.written(runs, "runs")
    firsts = runs.groupBy("content", "check").agg(F.min(F.struct("id", "key", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = runs.join(firsts.select("content", "check", "first"), ["content", "check"]).where(F.struct("id", "key", "s") != F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set("s").alias("starts"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run_units: int = RUN_UNITS) -> DataFrame:
    """Every row of ``df``, later repeated runs deleted from the text, with ``n_removed_lines`` added.

    A null or empty text stays as it is.  Blank lines stay, unless no other line is left: then the text is
    empty.  Rows with the same id and the same text are one document and end alike; a null id comes before all
    others.  An empty table gives an empty table.  If the added name is taken, a number follows.
    """
    name, id_, key, starts, result = C.free_names(df.columns, "n_removed_lines", "id_of", "key", "starts", "result")
    later = later_runs(df, doc_id, text, run_units).toDF(id_, key, starts)
    rows = df.join(later, (F.xxhash64(F.col(doc_id), F.col(text)) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(id_)), "left")

    def gone(lines: Column) -> Column:
        covered = _with(_line_of_units(lines), lambda u: F.array_distinct(F.flatten(F.transform(F.col(starts), lambda s: F.array(*[u[s + k] for k in range(run_units)])))))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        body = F.array_join(F.transform(left, lambda i: lines[i]), "\n")
        blank = F.btrim(body, F.lit(_SPACES + "\n")) == ""
        return F.struct(F.when(blank, F.lit("")).otherwise(body).alias("text"), (F.size(lines) - F.size(left)).cast("long").alias("n"))

    same = F.struct(F.col(text).alias("text"), F.lit(0).cast("long").alias("n"))
    rows = rows.withColumn(result, F.when(F.col(starts).isNull(), same).otherwise(_with(_lines(F.col(text)), gone)))
    return rows.select(*[F.col(result)["text"].alias(c) if c == text else C.keyed(c) for c in df.columns], F.col(result)["n"].alias(name))
