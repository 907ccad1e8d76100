import numpy as np

from lawmesh.llm import neardup


def test_crowded_cells_are_sliced_by_visitors_too(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(8) + 0.02 * rng.standard_normal((120, 8))
    rows = [(i, "a", x.tolist()) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    compare = neardup.compare

    def bounded(least, index):
        run = compare(least, index)

        def checked(pdf):
            assert (pdf.role == 1).sum() <= 80
            return run(pdf)

        return checked

    monkeypatch.setattr(neardup, "compare", bounded)
    told = []
    monkeypatch.setattr(neardup, "settle", lambda df, f=neardup.settle: told.append(df.columns) or f(df))
    got = neardup.near_duplicates(d, slice_rows=8).collect()
    assert any("visitors" in c for c in told)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(1) - 1
    assert all(r.n_links == links[r.vec_id] and r.component_id == 0 for r in got)
