"""Work and storage that must follow the stored entries, not the product of genes and cells or of targets and bins."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from regweave.operators.matrix import Expression
from regweave.session import shared_dir
from regweave.sinks import writers as W
from regweave.sources import text as T


def stored(spark, before=()):
    """Size of the scratch tables that are not among ``before``."""
    top = Path(shared_dir(spark).removeprefix("file://"))
    new = [p for p in top.iterdir() if p not in before]
    return sum(f.stat().st_size for p in new for f in p.rglob("*") if f.is_file())


def scratch(spark):
    return set(Path(shared_dir(spark).removeprefix("file://")).iterdir())


def test_wide_sparse_lines_are_stored_by_their_entries(spark, tmp_path):
    width = 100_000
    rows = [("a", 0, 3.0), ("a", 64, 1.0), ("b", 99_999, 25.0), ("c", 1500, 7.0), ("c", 1501, 8.0)]
    rows += [(f"n{i:02d}", i * 997, 2.0) for i in range(40)]
    expr = Expression(spark.createDataFrame(rows, "gene string, cell int, value double"), spark.range(width).select(F.col("id").cast("int").alias("cell")))
    path = str(tmp_path / "m")
    W.save_matrix_slice(expr, path)
    lines = [r.value.split("\t") for r in T.numbered_lines(spark, path).orderBy("line_no").collect()]
    assert lines[0] == ["gene", *map(str, range(width))] and [x[0] for x in lines[1:]] == sorted({r[0] for r in rows})
    want = np.zeros((len(lines) - 1, width), int)
    for g, c, v in rows:
        want[sorted({r[0] for r in rows}).index(g), c] = v
    assert (np.array([x[1:] for x in lines[1:]], int) == want).all()
    before = scratch(spark)
    back = T.read_gene_major(spark, path)
    assert sorted(map(tuple, back.values.collect())) == sorted(rows) and back.nr_cells() == width
    assert stored(spark, before) < 400_000  # the header's numbers, mostly; 43 lines of zeros took 8.6 MB of text
    before = scratch(spark)
    assert T.skip_lines(spark, path, 1).count() == 43
    assert T.numbered_lines(spark, path).filter("line_no > 0").count() == 43


def test_odd_fields_beside_runs_of_zeros(spark, tmp_path):
    zeros = "\t0" * 200
    texts = ["a" + zeros, "b" + zeros + ".5" + zeros, "c" + zeros + "0", "d\x01" + zeros + "\t \x02", "e" + "\t0" * 1100 + "\t 7 ", "", "f", "g\t", "h\t\t0\tNaN\tx", "i" + "\t0" * 8 + "\t1"]
    path = tmp_path / "odd.txt"
    path.write_text("".join(t + "\n" for t in ["head", *texts]))
    got = T.numbered_lines(spark, str(path)).orderBy("line_no").collect()
    assert [r.value for r in got] == ["head", *texts]
    expr = T.read_gene_major(spark, str(path))
    assert sorted(map(tuple, expr.values.collect())) == [("b", 199, 0.5), ("e", 1100, 7.0), ("i", 8, 1.0)]
    assert expr.nr_cells() == 1101
    assert sorted(r.gene for r in expr.names.collect()) == sorted(t.split("\t")[0].strip(" ") for t in texts)


def test_skipped_lines_over_several_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}.txt").write_text("".join(f"{i}-{k}\n" for k in range(3)))
    for n in (1, 3, 4, 9, 15, 20):
        got = sorted(r.value for r in T.skip_lines(spark, str(tmp_path), n).collect())
        assert got == [f"{i}-{k}" for i in range(5) for k in range(3)][n:]


def test_correlations_without_shuffled_pairs(spark, monkeypatch):
    """Both ways of correlating agree, with numpy too; the plan for few regulator entries joins no grid of pairs."""
    from brute import as_expression
    from regweave.operators import correlation as R
    from regweave.operators.select import regulator_index

    rng = np.random.default_rng(8)
    m = rng.integers(1, 9, (30, 50)) * (rng.random((30, 50)) < 0.1).astype(float)
    m[4] = m[2]
    m[5] = 0
    m[5, :] = 3  # constant: no correlation
    names = [f"g{i:02d}" for i in range(30)]
    expr = as_expression(spark, m, names)
    regs = regulator_index(expr.values, names[:7])
    monkeypatch.setattr(R, "PAIRS", 5)
    monkeypatch.setattr(R, "CHUNK", 11)
    found = []
    for held in (R.HELD_ENTRIES, -1):
        monkeypatch.setattr(R, "HELD_ENTRIES", held)
        out = R.pearson(expr.values, regs, 50)
        joins = "Join" in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert joins == (held < 0)
        found.append({(r.tf, r.gene): (r.corr, r.sign) for r in out.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 7 * sum(m.any(axis=1))
    for (tf, gene), (corr, sign) in found[0].items():
        other = found[1][tf, gene]
        assert sign == other[1] and (corr is None) == (other[0] is None)
        if corr is not None:
            a, b = m[names.index(tf)], m[names.index(gene)]
            want = 1.0 if tf == gene else np.corrcoef(a, b)[0, 1]
            np.testing.assert_allclose([corr, other[0]], want, rtol=1e-9, atol=1e-12)


def test_task_hook_shuffles_a_vector_once_per_group_of_regulators(spark, monkeypatch):
    from brute import as_expression
    from regweave.operators.matrix import pack
    from regweave.plans import tasks

    rng = np.random.default_rng(5)
    m = rng.integers(0, 4, (40, 12)).astype(float)
    names = [f"g{i:02d}" for i in range(40)]
    packed = pack(as_expression(spark, m, names).values, 12, cells_per_row=5)
    regs = spark.createDataFrame([(g,) for g in names[:9]], "gene string")
    task = lambda row, block: [(row.gene, g, float(p)) for g, p in zip(block.genes, block.products(row))]
    want = sorted((t, r, float(m[i] @ m[k])) for i, t in enumerate(names) for k, r in enumerate(names[:9]) if m[i].any() and m[k].any())
    rows = {}
    for held in (10**6, 40, 1):
        monkeypatch.setattr(tasks, "HELD_ENTRIES", held)
        out = tasks.flat_map_targets_with_regulators(packed, regs, task, "target string, regulator string, product double", 8, 2)
        assert sorted(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().analyzed().toString()
        rows[held] = [int(x) for x in __import__("re").findall(r"explode\(sequence\(0, (\d+)", plan)]
    assert 0 in rows[10**6] and all(n > 0 for n in rows[1])  # copies of a target's vector: one, then several
