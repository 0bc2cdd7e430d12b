import math

import numpy as np

from wayflux.llm import whitening


def plain(x):
    """Whitened rows, shares of the variance, by a plain eigendecomposition."""
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    return centred @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_rank_one_updates_of_equal_and_deflated_values():
    rng = np.random.default_rng(1)
    for d, z in (([0, 0, 0, 0], [1, 2, 0, 3]), ([1, 1, 2, 2], [1, 1, 1, 1]), ([0, 1, 2, 3], [0, 1, 0, 1e-18]), ([5], [2]), ([0, 0, 1, 1e9], [1e-3, 1, 1, 1]), ([1, 2, 3], [0, 0, 0])):
        d, z = np.array(d, float), np.array(z, float)
        basis = np.linalg.qr(rng.normal(size=(len(d), len(d))))[0]
        values, vectors = whitening.rank_one(d, basis, 0.7, z.copy())
        want = basis @ (np.diag(d) + 0.7 * np.outer(z, z)) @ basis.T
        assert abs(vectors @ np.diag(values) @ vectors.T - want).max() <= 1e-13 * max(abs(want).max(), 1)
        assert abs(vectors.T @ vectors - np.eye(len(d))).max() < 1e-13 and (np.diff(values) >= 0).all()


def test_spectra_merge_to_the_scatter_of_all_rows():
    rng = np.random.default_rng(2)
    for rows in (np.floor(rng.normal(size=(90, 6)) * [1, 5, 9, 20, 40, 80]), np.repeat(np.floor(rng.normal(size=(3, 5)) * 9), 20, 0), np.tile(np.arange(4.0), (9, 1))):
        whole = None
        for part in np.array_split(rows, 4):
            one = whitening.Spectrum.of(part[0])
            for row in part[1:]:
                one.add(row)
            if whole is None:
                whole = one
            else:
                whole.merge(one)
        centred = rows - rows.mean(0)
        scatter = centred.T @ centred
        assert whole.n == len(rows) and abs(whole.mean - rows.mean(0)).max() < 1e-12 * max(1, abs(rows).max())
        assert abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() <= 1e-11 * max(scatter.max(), 1)


def test_whiten_against_plain_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 5)) * [0.2, 0.3, 0.5, 0.9, 1.7]).astype(np.float32)
    good = [(k, v.tolist(), 1, 2.0) for k, v in enumerate(vectors)] + [(0, vectors[0].tolist(), 1, 2.0), (None, vectors[1].tolist(), 1, 2.0)]
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [math.nan] * 5), (904, [math.inf, 0.0, 0.0, 0.0, 0.0]), (905, [-math.inf, 0.0, 0.0, 0.0, 0.0]), (906, [1.0, 2.0])]
    frame = spark.createDataFrame([*good, *((i, v, 1, 2.0) for i, v in bad)], "vec_id long, embedding array<float>, n int, whitened double").repartition(3)
    for components in (3, 32):
        got = whitening.whiten(frame, components=components).collect()
        count = min(components, 5)
        assert len(got) == 152 * count and {r.n for r in got} == {152}
        x = np.floor(64 * np.array([g[1] for g in good], np.float32).astype(float)) + 1_000_000
        want, share = plain(x)
        off = 152 * x.astype(int) - x.astype(int).sum(0)
        deviation = (off**2).sum(1)
        sign = None
        for k, (vec_id, *_) in enumerate(good[:150]):
            rows = sorted((r for r in got if r.vec_id == vec_id), key=lambda r: r.component)[:: 2 if vec_id == 0 else 1]
            w = np.array([r.whitened for r in rows])
            sign = np.sign(w * want[k, :count]) if sign is None else sign
            assert abs(w * sign - want[k, :count]).max() < 1e-9 and all(r.deviation == int(r.deviation_exact) == deviation[k] for r in rows)
            assert np.allclose([r.explained for r in rows], share[:count], rtol=1e-12)
        assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-10


def test_whiten_nothing_to_whiten(spark):
    kind = "vec_id long, embedding array<double>"
    columns = whitening.whiten(spark.createDataFrame([], kind)).columns
    assert columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 3.0, 1e30]) for k in range(6)], kind)).collect()  # only one direction varies
    assert len(flat) == 6 and {r.component for r in flat} == {1} and abs(sum(r.whitened**2 for r in flat) / 6 - 1) < 1e-12


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(10**9, [0, 10**9 * 5 + 3], np.ones(1), np.eye(2)[:, :1], 1.0)
    x = np.array([[2.0**40, 7.0]])
    assert model.deviations(x) == [(10**9 * 2**40) ** 2 + (10**9 * 7 - 10**9 * 5 - 3) ** 2]
