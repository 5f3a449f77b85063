import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import as_expression, fixture
from regweave.operators import select as S
from regweave.operators.matrix import Expression, pack
from regweave.params import BoostParams, RegressionParams, RunConfig, with_defaults, with_seed
from regweave.plans.run import run
from regweave.plans.tasks import flat_map_targets, flat_map_targets_with_regulators
from regweave.sinks import writers as W
from regweave.sources import csc
from regweave.sources import text as T


def put(path, text):
    path.write_text(text)
    return str(path)


def test_gene_major_and_delimiters(spark, tmp_path):
    path = put(tmp_path / "m.txt", "gene|c0|c1|c2\nA| 1 |0|2.5\nB|0|NaN|x\n")
    expr = T.read_gene_major(spark, path, 1, "|")
    assert sorted(map(tuple, expr.values.collect())) == [("A", 0, 1.0), ("A", 2, 2.5)]
    assert sorted(r.cell for r in expr.cells.collect()) == [0, 1, 2]
    path = put(tmp_path / "r.txt", "A  1   0 3\n")
    expr = T.read_gene_major(spark, path, 0, " +", regex=True)
    assert sorted(map(tuple, expr.values.collect())) == [("A", 0, 1.0), ("A", 2, 3.0)]


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = put(tmp_path / "big.txt", "".join(f"line{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = T.numbered_lines(spark, path)
        assert lines.filter(F.col("value") != F.concat(F.lit("line"), "line_no")).isEmpty() and lines.count() == 5000
        assert T.skip_lines(spark, path, 700).count() == 4300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_annotated_and_condition_major(spark, tmp_path):
    meta = "".join(f"meta{i}\tx\t1\t2\n" for i in range(10))
    path = put(tmp_path / "z.txt", meta + "\nTspan12\t1\t0\t3\nTshz1\t2\t4\t0\n")
    expr = T.read_annotated(spark, path)
    assert sorted(map(tuple, expr.values.collect())) == [("Tshz1", 0, 4.0), ("Tspan12", 1, 3.0)]
    assert expr.nr_cells() == 2
    path = put(tmp_path / "d.tsv", "G1\tG2\n0.5\t0\n1.5\t2\n")
    expr = T.read_condition_major(spark, path)
    assert sorted(map(tuple, expr.values.collect())) == [("G1", 0, 0.5), ("G1", 1, 1.5), ("G2", 1, 2.0)]
    df, genes = T.read_wide_csv(spark, path)
    assert genes == ["G1", "G2"] and [r.expression for r in df.collect()] == [[0.5, 0.0], [1.5, 2.0]]
    ml, _ = T.read_wide_csv(spark, path, ml_vector=True)
    assert list(ml.collect()[1].expression) == [1.5, 2.0]


def test_lists(spark, tmp_path):
    path = put(tmp_path / "tf.txt", " Dlx1 \n\nDlx2\nDlx1\n")
    assert sorted(r.gene for r in T.read_names(spark, path).collect()) == ["Dlx1", "Dlx2"]
    path = put(tmp_path / "cells.txt", "3\n\n 5\n")
    assert sorted(r.cell for r in T.read_cell_subset(spark, path).collect()) == [3, 5]


def test_edges_roundtrip_and_order(spark, tmp_path):
    rows = [("a", "t", 0.5, 1), ("b", "t", 2.0, 0), ("c", "u", 1.25, 1)]
    edges = spark.createDataFrame(rows, "regulator string, target string, gain double, include int")
    for single in (False, True):
        out = str(tmp_path / f"edges{single}")
        W.save_edges(edges, out, single_file=single)
        assert sorted(map(tuple, T.read_edges(spark, out, include_flags=True).collect())) == sorted(rows)
        lines = [r.value for r in T.numbered_lines(spark, out).orderBy("line_no").collect()]
        assert lines == ["b\tt\t2.0\t0", "c\tu\t1.25\t1", "a\tt\t0.5\t1"]
    W.save_output(edges, str(tmp_path / "mat"), "matrix")
    lines = [r.value for r in T.numbered_lines(spark, str(tmp_path / "mat")).orderBy("line_no").collect()]
    assert lines == ["regulator\tt\tu", "a\t0.5\t0.0", "b\t2.0\t0.0", "c\t0.0\t1.25"]
    W.save_output(edges, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    with pytest.raises(ValueError):
        W.save_output(edges, "x", "xml")


def test_csc_roundtrip_and_options(spark):
    # fixed values: three genes over ten cells
    m = np.array([[0, 0, 0, 0, 2, 0, 2, 0, 1, 1], [1, 1, 0, 0, 2, 1, 1, 1, 0, 0], [1, 0, 2, 2, 0, 0, 0, 0, 0, 0]], float)
    names = ["g07", "g13", "g37"]
    expr = as_expression(spark, m, names)
    gene_names = spark.createDataFrame([(i, g) for i, g in enumerate(names)], "gene_idx int, gene string")
    arrays = csc.to_csc(expr.values, gene_names, S.index_cells(expr.cells))
    ptr = [r.start for r in arrays[0].orderBy("pos").collect()]
    assert ptr == [0, *np.cumsum((m != 0).sum(axis=0)).tolist()]
    back = csc.name_genes(csc.csc_entries(*arrays), gene_names)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, expr.values.collect()))
    index = spark.createDataFrame([(2, 0), (0, 1)], "gene_idx int, new_idx int")
    got = sorted(tuple(r) for r in csc.csc_entries(*arrays, cell_top=5, gene_index=index).collect())
    assert got == [(0, 0, 1.0), (2, 0, 2.0), (3, 0, 2.0), (4, 1, 2.0)]
    assert csc.csc_dimensions(arrays[0], gene_names) == (10, 3)


def test_params():
    assert with_defaults({}) == {"silent": 1, "nthread": 1, "eta": 0.01, "max_depth": 1}
    assert with_defaults({"eta": 0.3})["eta"] == 0.3 and with_seed({}, 5) == {"seed": 5}
    assert BoostParams.from_map({"eta": "0.15", "max_depth": "6"}).max_depth == 6
    for bad in ({"etaa": 1}, {"eta": 0}, {"subsample": 2}, {"max_depth": 0}, {"gamma": -1}, {"eval_metric": "auc"}):
        with pytest.raises(ValueError):
            BoostParams.from_map(bad)
    for bad in ({"run_mode": "x"}, {"output_format": "x"}, {"sample_size": 0}, {"nr_estimation_genes": 0}, {"skip_headers": -1}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    assert RegressionParams().boost.eta == 0.01 and RunConfig().with_rounds(7).nr_boosting_rounds == 7


def test_run_modes(spark, tmp_path):
    Y, _, regs, names = fixture(cells=40, regulators=4, targets=4)
    body = "".join(g + "\t" + "\t".join(str(v) for v in row) + "\n" for g, row in zip(names, Y))
    matrix = put(tmp_path / "m.tsv", "\t".join(["gene", *map(str, range(40))]) + "\n" + body)
    tfs = put(tmp_path / "tf.txt", "\n".join(regs))
    base = dict(input_path=matrix, regulators_path=tfs, booster_params={"eta": 0.3}, sample_size=30)
    dry = run(spark, RunConfig(**base, run_mode="dry"))
    assert dry.edges is None and dry.params.nr_rounds is None
    cfg = run(spark, RunConfig(**base, run_mode="cfg", nr_boosting_rounds=9))
    assert cfg.edges is None and cfg.params.nr_rounds == 9
    out = str(tmp_path / "out")
    inf = run(spark, RunConfig(**base, nr_boosting_rounds=3, output_path=out, include_flags=True, truncate=5, targets=("t00",)))
    saved = T.read_edges(spark, f"{out}.result", include_flags=True)
    assert 0 < saved.count() <= 5 and saved.count() == inf.edges.count()
    report = {r.key: r.value for r in spark.read.json(f"{out}.report").collect()}
    assert report["rounds"] == "3" and report["config.truncate"] == "5"
    assert report["matrix.cells"] == "30" and report["boost.eta"] == "0.3" and report["params.nr_rounds"] == "3"
    assert int(report["matrix.regulator_bytes"]) == 12 * int(report["matrix.regulator_entries"]) > 0


def test_lines_keep_their_numbers_when_splits_change(spark, tmp_path):
    path = put(tmp_path / "many.txt", "".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        lines = T.numbered_lines(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "31000")
        got = {r.value: r.line_no for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"line {i}": i for i in range(5000)}


def test_empty_cells_and_genes_are_written(spark, tmp_path):
    values = spark.createDataFrame([("g1", 0, 2.0), ("g1", 2, 3.0)], "gene string, cell int, value double")
    cells = spark.createDataFrame([(0,), (1,), (2,)], "cell int")
    expr = Expression(values, cells, names=spark.createDataFrame([("g1",), ("g2",)], "gene string"))
    path = str(tmp_path / "m")
    W.save_matrix_slice(expr, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["g1\t2\t0\t3", "g2\t0\t0\t0", "gene\t0\t1\t2"]
    back = T.read_gene_major(spark, path)
    assert sorted(r.gene for r in back.genes().collect()) == ["g1", "g2"] and back.nr_cells() == 3


def test_task_sees_whole_vectors(spark):
    expr = as_expression(spark, np.arange(1, 21, dtype=float).reshape(2, 10), ["a", "b"])
    packed = pack(expr.values, 10, cells_per_row=3)
    assert packed.count() == 8
    out = flat_map_targets(packed, lambda row: [(row.gene, len(row.values), float(row.values[-1]))], "gene string, n long, last double")
    assert sorted(map(tuple, out.collect())) == [("a", 10, 10.0), ("b", 10, 20.0)]


def test_task_with_regulators_sees_every_pair_once(spark):
    """Several blocks and chunks; unknown, repeated and null regulators change nothing; no regulators give no rows."""
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, (9, 12)).astype(float)
    data[:, 0] = 1
    names = list("abcdefghi")
    packed = pack(as_expression(spark, data, names).values, 12, cells_per_row=5)
    regs = spark.createDataFrame([(g,) for g in ["b", "d", "d", "h", "nowhere", None]], "gene string")

    class Resource:
        def close(self):
            pass

    def task(row, block, res):
        assert isinstance(res, Resource)
        return [(row.gene, g, float(p)) for g, p in zip(block.genes, block.products(row))]

    schema = "target string, regulator string, product double"
    got = flat_map_targets_with_regulators(packed, regs, task, schema, 2, 1, Resource)
    want = sorted((t, r, float(data[i] @ data[names.index(r)])) for i, t in enumerate(names) for r in "bdh")
    assert sorted(map(tuple, got.collect())) == want
    assert flat_map_targets_with_regulators(packed, regs.limit(0), task, schema, 2, 1, Resource).count() == 0


def test_run_estimates_its_rounds(spark, tmp_path):
    Y, _, regs, names = fixture(cells=40, regulators=4, targets=4)
    body = "".join(g + "\t" + "\t".join(str(v) for v in row) + "\n" for g, row in zip(names, Y))
    matrix = put(tmp_path / "e.tsv", "\t".join(["gene", *map(str, range(40))]) + "\n" + body)
    tfs = put(tmp_path / "etf.txt", "\n".join(regs))
    done = run(spark, RunConfig(input_path=matrix, regulators_path=tfs, booster_params={"eta": 0.3}, run_mode="cfg", nr_estimation_genes=4))
    assert done.params.nr_rounds is None or done.params.nr_rounds > 0


def test_task_hook_with_partition_resource(spark):
    class Resource:
        def __init__(self):
            self.calls = 0

        def close(self):
            assert self.calls > 0

    expr = as_expression(spark, np.eye(4) * 2, list("abcd"))

    def task(row, res):
        res.calls += 1
        return [(row.gene, float(v)) for v in row.values]

    packed = pack(expr.values, 4)
    out = flat_map_targets(packed, task, "gene string, v double", 1, Resource)
    assert sorted(map(tuple, out.collect())) == [(g, 2.0) for g in "abcd"]
