"""What a round of the eigensolver shuffles doesn't grow with its products."""

import numpy as np

from latentspark.operators import blocks, spectral


def ring_cells(spark, n):
    ring = np.eye(n) - (np.eye(n, k=1) + np.eye(n, k=-1) + np.eye(n, k=1 - n) + np.eye(n, k=n - 1)) / 2
    ring[3, 40] = ring[40, 3] = -0.3
    i, j = np.nonzero(ring)
    return ring, blocks.cut_lineage(spark.createDataFrame(list(zip((i * 5).tolist(), (j * 5).tolist(), ring[i, j].tolist(), strict=True)), "src long, dst long, l double").repartition(5))


def test_products_of_a_round_move_nothing(spark, monkeypatch):
    shuffles, products = [], spectral._WholeCells.filtered_products

    def counted(self, x, middle, half, degree):
        out = products(self, x, middle, half, degree)
        self._cells_for(4).count()
        shuffles.append((degree, out.toDebugString().decode().count("PairwiseRDD") - x.toDebugString().decode().count("PairwiseRDD")))
        return out

    ring, cells = ring_cells(spark, 90)
    monkeypatch.setattr(spectral, "MAX_DENSE", 10)
    monkeypatch.setattr(spectral, "PART_ROWS", 20)
    monkeypatch.setattr(spectral, "PRODUCT_CELLS", 50)
    monkeypatch.setattr(spectral._WholeCells, "filtered_products", counted)
    nodes, values, vectors = spectral.eigenvectors(cells, 4)
    assert max(d for d, _ in shuffles) >= spectral.DEGREE and max(s for _, s in shuffles) <= 5
    assert (nodes == np.arange(90) * 5).all() and np.allclose(values, np.linalg.eigvalsh(ring)[:4], atol=1e-9)
    assert np.abs(ring @ vectors - vectors * values).max() < 1e-6


def test_larger_matrices_are_met_by_rows(spark, monkeypatch):
    ring, cells = ring_cells(spark, 90)
    monkeypatch.setattr(spectral, "MAX_DENSE", 10)
    monkeypatch.setattr(spectral, "WHOLE_BYTES", 100)
    assert np.allclose(spectral.eigenvectors(cells, 4)[1], np.linalg.eigvalsh(ring)[:4], atol=1e-9)


def test_signature_of_as_many_parts_as_values(spark):
    basis = spectral.basis_table(spark, np.arange(2), np.eye(2))
    assert {(r.node, r.hks) for r in spectral.heat_kernel_signature(basis, np.zeros(2), 3).collect()} == {(0, 1.0), (1, 1.0)}
