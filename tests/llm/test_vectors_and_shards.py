"""Whitening, vector codes and shards against plain numpy and exhaustive search, with odd rows among the usual."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import queries, sharding, vector_codes
from spanloom.llm.sharding import place
from spanloom.llm.vector_codes import encode
from spanloom.llm.whitening import whiten

# Columns whose names the operators use themselves.
VECTORS = "vec_id long, embedding array<float>, label int, x string, row_id int, index int, part string, error long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "p", 3) for r in rows], VECTORS)


def usual(n, dim, seed):
    rng = np.random.default_rng(seed)
    tilt = rng.standard_normal((dim, dim))
    return (rng.standard_normal((n, dim)) @ tilt).astype(np.float32)


def odd(dim):
    """Vectors that take no part."""
    inf, nan = float("inf"), float("nan")
    return [(9001, None, 1), (9002, [], 1), (9003, [1.0] * (dim - 1) + [None], 1), (9004, [nan] * dim, 2),
            (9005, [0.5] * (dim - 1) + [-inf], None), (9006, [0.5] * (dim + 4), 2), (9007, [1e30] * dim, 2)]


def whole(values, offset=0):
    return np.floor(np.asarray(values, np.float64) * 1024).astype(np.int64) + offset


# -- whitening -------------------------------------------------------------------

@pytest.mark.parametrize("dim", [12, 3])
def test_whitening_equals_numpy(spark, dim):
    given = usual(300, dim, dim)
    given[7] = given[6]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(given)] + [(5, given[0].tolist(), 1), (None, given[1].tolist(), 1)]
    got = whiten(vectors(spark, rows + odd(dim))).collect()
    x = whole([v for _, v, _ in rows], 100_000)
    n, k = len(x), min(8, dim)
    sums = x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    expected = centred @ axes[:, :k] / np.sqrt(values[:k])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    # One sign for a component, whichever it is; rows of one id are told apart by their deviation.
    for c in range(k):
        mine = sorted((r["vec_id"] if r["vec_id"] is not None else -1, int(r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1)
        sign = np.sign(axes[:, c][np.abs(axes[:, c]).argmax()])
        plain = sorted((i if i is not None else -1, int(d), sign * w) for (i, _, _), d, w in zip(rows, deviation, expected[:, c]))
        assert [m[:2] for m in mine] == [p[:2] for p in plain]
        assert np.allclose([m[2] for m in mine], [p[2] for p in plain], atol=1e-8)
        share = [r["explained"] for r in got if r["component"] == c + 1]
        assert np.allclose(share, values[c] / values.sum(), rtol=1e-9)


def test_components_without_variance(spark):
    flat = usual(40, 6, 1)
    flat[:, 4] = flat[:, 1]  # equal dimensions: five components vary
    got = whiten(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(flat)])).collect()
    assert {r["component"] for r in got} == set(range(1, 7)) and got[0]["identity_error"] < 1e-9
    assert all((r["whitened"] is None) == (r["component"] == 6) for r in got)
    single = whiten(vectors(spark, [(1, [1.0, 2.0, 3.0], 0)])).collect()
    assert len(single) == 3 and all(r["whitened"] is None and r["explained"] == 0.0 and r["deviation"] == 0 for r in single)


def test_a_table_of_many_blocks(spark, monkeypatch):
    """Blocks of few rows and columns, several tasks for the scatter: the same answer."""
    from spanloom.llm import whitening

    given = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(usual(200, 10, 5))]).repartition(5)
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(given).collect()}
    for name, value in (("ROWS", 16), ("COLUMNS", 4), ("SUMMED", 3)):
        monkeypatch.setattr(whitening, name, value)
    many = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(given).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], abs_tol=1e-8) for k in one)


def test_vectors_of_an_empty_table(spark):
    for rows in ([], odd(8)[:5]):
        none = vectors(spark, rows)
        assert whiten(none).collect() == [] and encode(none).collect() == []
        assert whiten(none).columns == whiten(vectors(spark, [(1, [1.0], 1)])).columns


# -- vector codes ----------------------------------------------------------------

def plain_codes(x, entries=256, rounds=4):
    """(codes, errors, codebooks) by the definition; x in the order of the start."""
    parts = x.astype(object).reshape(len(x), 4, -1)
    books = [[list(p) for p in parts[:entries, k]] for k in range(4)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k in range(4):
            at = [nearest(p, books[k])[0] for p in parts[:, k]]
            for e in set(at):
                mine = [p for p, a in zip(parts[:, k], at) if a == e]
                books[k][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(p[k], books[k]) for k in range(4)] for p in parts]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return ["".join(f"{e:02x}" for e, _ in f) for f in found], [sum(d for _, d in f) for f in found], \
        hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n, huge", [(320, False), (40, False), (60, True)])
def test_codes_equal_the_definition(spark, n, huge):
    given = np.round(usual(n, 8, n), 2)
    given[n // 2 :: 3] = given[1]  # a hot vector: its entry owns a third of the parts
    if huge:
        given *= 1e6  # distances beyond what doubles hold
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 2) for i, v in enumerate(given)]
    again = [(n, given[3].tolist(), 1), (n, given[2].tolist(), 1), (None, given[4].tolist(), 0)]
    got = encode(vectors(spark, rows + again + odd(8)).repartition(3)).collect()
    order = sorted(rows + again, key=lambda r: (r[0] is None, r[0], whole(r[1]).tolist()))
    codes, errors, digest = plain_codes(whole([v for _, v, _ in order]))
    by_label = {label: sum(e for e, r in zip(errors, order) if r[2] == label) for label in (None, 0, 1)}
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"]) for r in got) == sorted(
        (r[0] if r[0] is not None else -1, c, e, by_label[r[2]]) for r, c, e in zip(order, codes, errors))
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_parts_must_be_equal(spark):
    with pytest.raises(ValueError, match="equal parts"):
        encode(vectors(spark, [(1, [1.0, 2.0, 3.0], 0)]))


def test_owners_share_a_hot_entry():
    n, width = 40_000, 16
    members = (np.arange(n), np.zeros(n, np.int8), np.zeros(n, np.int16), np.zeros((n, 2), np.int64))
    held = np.bincount(vector_codes.owners(members, width), minlength=width)
    assert set(np.flatnonzero(held)) == {0, 4, 8, 12} and held.max() < 1.1 * n / 4


# -- shards ----------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, key string, size int, shard string, slot int, part int, bytes int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "s", 2, 3, 4) for r in rows], DOCUMENTS)


def least_capacity(sizes, shards):
    """The smallest largest shard of all contiguous partitions, by trying."""
    best = {(0, 0): 0}
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for s in range(1, shards + 1):
        for i in range(len(ends)):
            best[s, i] = min((max(best[s - 1, j], int(ends[i] - ends[j])) for j in range(i + 1) if (s - 1, j) in best), default=None)
            if best[s, i] is None:
                del best[s, i]
    return best[shards, len(sizes)]


def check(rows, placed, shards):
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in placed) == sorted(
        (i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in placed} <= {("bytes", None)}
    of = {}
    for r in placed:
        of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in of.values()) and set(of) <= set(range(shards))
    # The same by digest: which shard each text has gone to.
    sizes, texts = {}, {}
    for i, t in rows:
        key = hashlib.sha256((t or "").encode()).hexdigest()
        sizes[key] = sizes.get(key, 0) + len((t or "").encode()) + 1
        texts[i, zlib.crc32((t or "").encode())] = key
    at = {}
    for r in placed:
        at.setdefault(texts[r["doc_id"], r["text_crc32"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in at.values())
    alone, left = [], sum(sizes.values())
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        if shards - len(alone) == 1 or sizes[key] * (shards - len(alone)) < left:
            break
        alone.append(key)
        left -= sizes[key]
    order = [k for k in sorted(sizes) if k not in alone]
    per = [0] * shards
    for key, size in sizes.items():
        per[min(at[key])] += size
    assert [min(at[k]) for k in alone] == list(range(len(alone)))
    places = [min(at[k]) for k in order]
    assert places == sorted(places)
    if order:
        assert max(per[len(alone):]) == least_capacity([sizes[k] for k in order], shards - len(alone))
    return per


@pytest.mark.parametrize("seed", range(2))
def test_shards_have_the_least_capacity(spark, monkeypatch, seed):
    """A coarse outline, so that ranges are refined several times."""
    monkeypatch.setattr(sharding, "OUTLINE", 8)
    monkeypatch.setattr(sharding, "PIECES", 4)
    rng = random.Random(seed)
    rows = [(i, "é" * rng.choice([1, 5, 40, rng.randrange(300)]) + str(i)) for i in range(120)]
    rows += [(200 + i, "copied text") for i in range(50)] + [(300, None), (301, ""), (302, None), (None, "x"), (5, "other under 5"), (5, "other under 5")]
    for shards in (1, 5, 16):
        check(rows, place(documents(spark, rows).repartition(4), shards).collect(), shards)


def test_hot_texts_stand_alone(spark):
    rows = [(i, f"text {i} " + "word " * (i % 40)) for i in range(300)] + [(1000 + i, "a hot text " * 20) for i in range(400)]
    rows += [(2000, "long " * 8000)]
    per = check(rows, place(documents(spark, rows)).collect(), 16)
    assert max(per[2:]) - min(per[2:]) < 500


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, "a"), (3, "b")]])
def test_fewer_groups_than_shards(spark, rows):
    placed = place(documents(spark, rows))
    assert placed.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(rows, placed.collect(), 16)


def test_the_queries_give_all_rows(spark):
    from test_operators import SF_DIR

    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert queries.op12_sharding(spark, SF_DIR).count() == n
    kinds = dict(queries.op11_embedding_whitening(spark, SF_DIR).dtypes)
    assert kinds == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                     "explained": "double", "identity_error": "double"}


def test_codes_match_sql(spark):
    from oracle import duck, duck_rows, spark_rows
    from test_operators import SF_DIR

    assert spark_rows(queries.op13_vector_codes(spark, SF_DIR)) == duck_rows(
        duck(SF_DIR), queries.ORACLES["op13_vector_codes"])
