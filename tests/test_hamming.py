import numpy as np
import pytest

from ashlar.functions import bitvec as V
from ashlar.operators import graph, hamming


def words(bits):
    x = np.zeros((len(bits), V.WORDS * 64), dtype=np.uint8)
    x[:, : V.BITS] = bits
    return np.packbits(x, axis=1, bitorder="little").view(np.int64)


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), w.tolist()) for i, w in zip(ids, x, strict=True)] + [(None, x[0].tolist()), (10**9, None)], "idx long, fp array<long>").repartition(3)


def distances(x, y):
    return np.array([[int(np.bitwise_count(a ^ b).sum()) for b in y.view(np.uint64)] for a in x.view(np.uint64)])


def flipped(bits, n, rng):
    out = bits.copy()
    at = rng.choice(V.BITS, n, replace=False)
    out[at] ^= 1
    return out


def test_groups_find_every_pair_within_reach():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, V.BITS, dtype=np.uint8)
    for most in (100, 500, 1000, 2000):
        n, size = hamming.groups_for(most)
        assert n * (hamming.FLIPS + 1) > most and n * size <= V.BITS
        q = words(base[None, :]).view(np.uint64)[0]
        near = hamming.near_values(q, most)
        for _ in range(20):
            values = hamming.group_values(words(flipped(base, most, rng)[None, :]).view(np.uint64), most)[0]
            assert (near == values[:, None]).any()
        # the worst case: as many bits in each group as it takes to miss, and one group that has one less
        bad, left = base.copy(), most
        for g in range(n):
            k = min(hamming.FLIPS + 1, left)
            bad[g * size : g * size + k] ^= 1
            left -= k
        assert left == 0 and (near == hamming.group_values(words(bad[None, :]).view(np.uint64), most)[0][:, None]).any()


@pytest.mark.parametrize("entries", [hamming.FOLDER_ENTRIES, 200])
def test_index_gives_the_rows_of_a_scan(spark, entries):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (500, V.BITS), dtype=np.uint8)
    for i in range(1, 12):  # neighbours of row 0 at up to 1,100 bits
        base[i] = flipped(base[0], 100 * i, rng)
    x = words(base)
    index = hamming.HammingIndex.build(table(spark, x), f"{graph.shared_folder(spark)}/index-{entries}", folder_entries=entries)
    assert index.n == 500 and (entries > 200 or index.first_bits > 0)
    for q in (x[0], words(flipped(base[300], 400, rng)[None, :])[0], words(rng.integers(0, 2, (1, V.BITS), dtype=np.uint8))[0]):
        d = distances(q[None, :], x)[0]
        want = sorted((int(d[i]), int(i)) for i in np.flatnonzero(d <= 1000))
        for way in (index.search, index.scan):
            found, share = way(q.tolist(), 0.9)
            assert [(r.distance, r.idx) for r in found.collect()] == want and share < 0.05
    assert [r.idx for r in index.search(x[0].tolist(), 0.95)[0].collect()] == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        index.search(x[0].tolist(), 0.8)


def test_all_parts_and_little_of_them_read(spark, sf_dir):
    from ashlar.queries_rows import part_index, turned

    index = part_index(spark, sf_dir)
    found, share = index.search(turned(spark, sf_dir), 0.9)
    assert {r.distance for r in found.collect()} == {960} and share < 0.05


def pairs(x, ids, most):
    d = distances(x, x)
    return sorted((min(ids[i], ids[j]), max(ids[i], ids[j]), int(d[i, j])) for i in range(len(x)) for j in range(i) if d[i, j] <= most)


@pytest.mark.parametrize("cell_rows", [2048, 20, 3])
def test_join_gives_every_pair_once(spark, cell_rows):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2, (6, V.BITS), dtype=np.uint8)
    base = np.stack([flipped(centres[i % 6], int(rng.integers(0, 900)), rng) for i in range(120)] + [rng.integers(0, 2, V.BITS, dtype=np.uint8) for _ in range(20)])
    x, ids = words(base), [int(i) for i in rng.permutation(1000)[:140]]
    found, copies = hamming.similarity_join(table(spark, x, ids), 0.9, cell_rows=cell_rows)
    got = sorted((r.a, r.b, round((1 - r.similarity) * V.BITS)) for r in found.collect())
    assert got == pairs(x, ids, 1000) and len(got) > 300
    assert copies >= 1 and (cell_rows > 20 or copies > 1)


def test_rows_far_from_other_cells_do_not_visit_them(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2, (8, V.BITS), dtype=np.uint8)
    x = words(np.stack([flipped(centres[i % 8], 150, rng) for i in range(160)]))
    found, copies = hamming.similarity_join(table(spark, x), 0.95, cell_rows=10)
    got = sorted((r.a, r.b, round((1 - r.similarity) * V.BITS)) for r in found.collect())
    assert got == pairs(x, range(160), 500) and copies < 4  # of 16 cells


def level_codes(rng, n, dimensions=64):
    x = rng.normal(size=(n, dimensions))
    levels = np.clip(np.floor((x / np.linalg.norm(x, axis=1, keepdims=True) + 0.375) * (62 / 0.75)), 0, 62).astype(np.int64)
    return np.concatenate([(np.int64(1) << levels) - 1, np.zeros((n, V.WORDS - dimensions), np.int64)], axis=1)


def test_crowded_rows_are_sent_once_a_block_and_keep_every_pair(spark):
    rng = np.random.default_rng(8)
    x, ids = level_codes(rng, 300), [int(i) for i in rng.permutation(1000)[:300]]
    found, copies = hamming.similarity_join(table(spark, x, ids), 0.94, cell_rows=5)
    got = sorted((r.a, r.b, round((1 - r.similarity) * V.BITS)) for r in found.collect())
    assert got == pairs(x, ids, 600) and len(got) > 50
    assert copies == 1  # some 30 cells before


@pytest.mark.parametrize("levels", [True, False])
def test_all_pairs_block_by_block(spark, levels):
    rng = np.random.default_rng(9)
    x = level_codes(rng, 151)
    x[:3, 5:9] = [[-1] * 4, [0] * 4, [2**63 - 1] * 4]  # levels up to 64, which three together fit a byte
    if not levels:
        x[7, V.WORDS - 1] = 6
    ids = [int(i) for i in rng.permutation(1000)[:151]]
    rows = table(spark, x, ids).where("idx IS NOT NULL AND fp IS NOT NULL").withColumnRenamed("fp", "v")
    found, blocks = hamming.all_pairs(rows, 151, 650, block_rows=40)
    assert blocks == 4 and sorted((r.a, r.b, r.distance) for r in found.collect()) == pairs(x, ids, 650)


def test_a_comparison_hands_on_its_pairs_in_batches():
    same = np.full((1000, 3), 5, np.uint8)
    ids = np.arange(1000)
    sizes = [b.num_rows for b in hamming._batches(hamming._level_pairs(same, same, 0, True), ids, ids)]
    assert sum(sizes) == 1000 * 999 // 2 and max(sizes) < hamming.BATCH_PAIRS + 1000


def test_equal_vectors_meet_their_least_row(spark):
    rng = np.random.default_rng(6)
    one = words(rng.integers(0, 2, (1, V.BITS), dtype=np.uint8))[0]
    found, _ = hamming.similarity_join(table(spark, np.stack([one] * 30)), 0.9)
    assert sorted((r.a, r.b, r.similarity) for r in found.collect()) == [(0, i, 1.0) for i in range(1, 30)]


@pytest.mark.parametrize("way", ["cells", "blocks"])
@pytest.mark.parametrize("copies", [256, 4])
def test_every_copy_is_in_all_pairs_of_its_vector(spark, monkeypatch, way, copies):
    monkeypatch.setattr(hamming, "COPIES", copies)
    monkeypatch.setattr(hamming, "crowded", lambda *_: way == "blocks")
    rng = np.random.default_rng(10)
    if way == "cells":
        centres = rng.integers(0, 2, (3, V.BITS), dtype=np.uint8)
        x, threshold = words(np.stack([flipped(centres[i % 3], 150, rng) for i in range(60)])), 0.95
    else:
        x, threshold = level_codes(rng, 200), 0.94
    x = np.concatenate([x, x[[0] * 40], x[[1] * 9], x[[3]], x[:5]])
    ids = [*(int(i) for i in rng.permutation(1000)[: len(x) - 5])]
    ids += [*ids[:3], *ids[5:7]]  # rows that come twice, and rows of one id with two vectors
    found, _ = hamming.similarity_join(table(spark, x, ids).where("idx IS NOT NULL"), threshold, cell_rows=20, every_copy=True)
    got = sorted((r.a, r.b, round((1 - r.similarity) * V.BITS)) for r in found.collect())
    assert got == [p for p in pairs(x, ids, hamming._reach(threshold)) if p[0] < p[1]] and len(got) > 1000


@pytest.mark.parametrize("odd", [False, True])
def test_similar_embeddings_pairs_equal_codes_as_its_sql_does(spark, tmp_path, odd):
    import duckdb

    from ashlar import queries

    x = np.random.default_rng(11).normal(size=(120, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    x += [[*x[0][:63], x[0][63] + 1e-9], x[0], x[0], x[1]]
    if odd:
        x += [None, [], [], *[[float(v), *x[2][1:]] for v in ("inf", "nan", "1e30", "-inf")]]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.sql(queries.ORACLES["similar_embeddings"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["similar_embeddings"](spark, str(tmp_path)).collect())) == want
    assert {(0, 120), (120, 121), (121, 122), *([(127, 128), (128, 129)] if odd else [])} <= {w[:2] for w in want}


def test_join_of_nothing(spark):
    assert hamming.similarity_join(spark.createDataFrame([], "idx long, fp array<long>"), 0.9)[0].collect() == []


def test_duplicate_vectors_are_made_once_a_text(spark, sf_dir):
    from ashlar import queries

    plan = queries.QUERIES["duplicate_vectors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_seeded" not in plan


def test_an_index_without_groups_scans_alone(spark, tmp_path):
    import pytest

    from ashlar.functions import project

    rows = project.seeded(spark.range(50).selectExpr("id AS idx", "concat('n', id) AS name"), "name")
    index = hamming.HammingIndex.build(rows, str(tmp_path / "i"), groups=False)
    assert not (tmp_path / "i" / "values").exists()
    found, _ = index.scan("n7")
    assert [(r.idx, r.distance) for r in found.collect()] == [(7, 0)]
    with pytest.raises(ValueError):
        hamming.HammingIndex(spark, str(tmp_path / "i")).search("n7")
