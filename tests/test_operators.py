import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import as_expression
from regweave.functions.scalar import challenge_score, turn_angle
from regweave.functions.vectors import assemble, assemble_ml, interact
from regweave.operators import correlation as R
from regweave.operators import edges as E
from regweave.operators import matrix as M
from regweave.operators import select as S
from regweave.operators.importance import dump_importance, parse_dump, parse_losses
from regweave.operators.ordering import hash_position, id_position
from regweave.operators.skew import salted_join

# --- fixed values: example series and their expected elbow --------------------------
ELBOW_SERIES = [
    7.07e14, 4.81e13, 3.65e13, 1.98e14, 1.78e14, 7424315.0, 7252873.0, 6299353.0, 4545308.0, 1615836.0,
    1442182.0, 1094521.0, 1072370.0, 752762.0, 623782.0, 541074.0, 504379.0, 421922.0, 415787.0,
]
CONVEX_SERIES = [10.0, 9.9, 9.8, 9.7, 0.0]


def series(spark, values):
    rows = [("s", i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "target string, i int, v double")


def elbow(spark, values, **kw):
    out = E.elbow_points(series(spark, values), ["target"], [F.col("i")], "v", **kw).collect()
    return out[0].elbow if out else None


def plain_elbow(values, x_scale=10, streak=3, precision=0.001):
    n = len(values)
    if n < 4 or max(values) == min(values):
        return None
    v = (np.array(values) - min(values)) / (max(values) - min(values))
    run = 0
    for i in range(n - 1):
        u, w = np.array([-1.0, v[i] - v[i + 1]]), np.array([n * x_scale - i - 1, v[-1] - v[i + 1]])
        cos = u @ w / (np.linalg.norm(u) * np.linalg.norm(w))
        run = run + 1 if abs(math.acos(max(-1, min(1, cos))) - math.pi) < precision else 0
        if run == streak:
            return i
    return None


def test_straight_line_angle(spark):
    pts = [tuple(F.lit(float(x)) for x in p) for p in ((0, 1), (1, 1), (20, 1))]
    assert spark.range(1).select(turn_angle(*pts)).first()[0] == math.pi


def test_elbow_goldens(spark):
    assert elbow(spark, ELBOW_SERIES) == 7
    assert elbow(spark, ELBOW_SERIES[:8]) is None and elbow(spark, ELBOW_SERIES[:12]) == 7
    for values in (CONVEX_SERIES, [], [5], [6, 5], [10, 2, 1], [3, 3, 3, 3, 3, 3]):
        assert elbow(spark, values) is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1e6), min_size=4, max_size=30))
def test_elbow_matches_plain_python(spark, values):
    for data in (values, sorted(values, reverse=True)):
        assert elbow(spark, data) == plain_elbow(data)


def test_label_goldens(spark):
    def labels(values):
        rows = [(f"r{i:02d}", "t", float(v)) for i, v in enumerate(values)]
        out = E.with_labels(spark.createDataFrame(rows, "regulator string, target string, gain double"))
        return [r.include for r in out.orderBy(F.desc("gain")).collect()]

    assert labels(sorted(ELBOW_SERIES, reverse=True)).count(1) == plain_elbow(sorted(ELBOW_SERIES, reverse=True), 3) - 2
    for values in (CONVEX_SERIES, [5], [6, 5], [10, 2, 1]):
        assert labels(values) == [1] * len(values)
    marked = E.with_streaks(series(spark, ELBOW_SERIES), ["target"], [F.col("i")], "v", x_scale=3)
    cut = marked.first().elbow - 2
    assert [1] * cut + [0] * (19 - cut) == [1] * 5 + [0] * 14


def test_no_precision_means_all_included(spark):
    df = spark.createDataFrame([("a", "t", 1.0)], "regulator string, target string, gain double")
    assert E.with_labels(df, None).first().include == 1


def test_normalize_variants_agree_and_zero_total_is_null(spark):
    rows = [("a", "t", 3.0), ("b", "t", 1.0), ("a", "u", 0.0)]
    df = spark.createDataFrame(rows, "regulator string, target string, gain double")
    one = {(r.regulator, r.target): r.gain for r in E.normalize(df).collect()}
    two = {(r.regulator, r.target): r.gain for r in E.normalize(df, skew_safe=True).collect()}
    assert one == two == {("a", "t"): 0.75, ("b", "t"): 0.25, ("a", "u"): None}
    assert {r.gain for r in E.normalize(df, F.max).filter("target = 't'").collect()} == {1.0, 1 / 3}


def test_rank_goldens(spark):
    def ranks(values, **kw):
        expr = as_expression(spark, np.array([values], dtype=float), ["g"])
        out = R.to_rankings(expr.values, len(values), **kw)
        return [r.rank for r in out.orderBy("cell").collect()]

    got = ranks([0, 2, 3, 3, 0, 8, 8])
    assert got[1] == 3 and {got[0], got[4]} == {1, 2} and {got[2], got[3]} == {4, 5} and {got[5], got[6]} == {6, 7}
    assert sorted(ranks([1, 1, 1, 1, 1])) == [1, 2, 3, 4, 5]
    assert ranks([1]) == [1] and ranks([1], base=0) == [0]
    assert ranks([0, 2, 3, 3, 0, 8, 8], ties="average") == [1.5, 3, 4.5, 4.5, 1.5, 6.5, 6.5]


def test_spearman_equals_pearson_on_ranks(spark):
    a, b = [2.0, 10.0, 3.0, 7.0], [8.0, 1.0, 5.0, 9.0]
    expr = as_expression(spark, np.array([a, b]), ["a", "b"])
    regs = S.regulator_index(expr.values, ["a"])
    want = np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1]
    for out in (R.spearman(expr.values, regs, 4), R.spearman_shuffled(expr.values, regs, 4)):
        got = {r.gene: r.corr for r in out.collect()}
        assert got["a"] == 1.0 and got["b"] == pytest.approx(want)


def test_correlations_on_sparse_rows_match_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-3, 6, (6, 40)) * (rng.random((6, 40)) < 0.5)
    m[5] = 0
    m[5, :] = 2
    names = [f"g{i}" for i in range(6)]
    expr = as_expression(spark, m.astype(float), names)
    regs = S.regulator_index(expr.values, names[:3])
    got = {(r.tf, r.gene): r for r in R.pearson(expr.values, regs, 40).collect()}
    assert len(got) == 18

    def avg_rank(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    sp = {(r.tf, r.gene): r.corr for r in R.spearman(expr.values, regs, 40).collect()}
    for i in range(3):
        for j in range(5):
            if i != j:
                assert got[names[i], names[j]].corr == pytest.approx(np.corrcoef(m[i], m[j])[0, 1])
                assert got[names[i], names[j]].sign == np.sign(np.cov(m[i], m[j])[0, 1])
                assert sp[names[i], names[j]] == pytest.approx(np.corrcoef(avg_rank(m[i]), avg_rank(m[j]))[0, 1])
        assert got[names[i], "g5"].corr is None


def test_fold_goldens(spark):
    cells = spark.range(100).withColumnRenamed("id", "cell")
    assert sorted(r["count"] for r in S.assign_folds(cells, 100, 2).groupBy("fold").count().collect()) == [50, 50]
    folds = S.assign_folds(cells.filter("cell < 99"), 99, 3)
    train, test = S.split_folds(folds, 0)
    assert (train.count(), test.count()) == (66, 33)
    assert S.assign_folds(cells.filter("cell < 3"), 3, 5).agg(F.max("fold")).first()[0] == 2
    for bad in ((100, 1), (0, 5)):
        with pytest.raises(ValueError):
            S.assign_folds(cells, *bad)


def test_slice_sample_and_subsets(spark):
    m = np.array([[0, 1, 0, 3, 0], [0, 0, 2, 0, 4]], dtype=float)
    expr = as_expression(spark, m, ["Dlx1", "Dlx2"])
    sel = spark.createDataFrame([(0, 0), (1, 1)], "cell int, new_cell int")
    dense = M.densify(S.slice_cells(expr.values, sel), 2)
    assert [r.value for r in dense.filter("gene = 'Dlx1'").orderBy("cell").collect()] == [0.0, 1.0]
    assert S.sub_sample(expr, 5) is expr
    assert S.sub_sample(expr, 3).nr_cells() == 3
    cells = spark.range(1_300_000).withColumnRenamed("id", "cell")
    assert S.random_cells(cells, 100_000).distinct().count() == 100_000
    assert S.random_cells(cells.limit(10), 5, 1).collect() != S.random_cells(cells.limit(10), 5, 2).collect()
    subsets = S.disjoint_subsets(cells.filter("cell < 25"), cells.filter("cell < 5"), 8)
    sizes = {r.subset: r["count"] for r in subsets.groupBy("subset").count().collect()}
    assert sizes == {0: 8, 1: 8, 2: 4} and subsets.filter("cell < 5").isEmpty()


@pytest.mark.parametrize("total,window,sizes", [(10, 3, [4, 3, 3]), (9, 3, [6, 3]), (7, 5, [7])])
def test_phases(spark, total, window, sizes):
    indexed = spark.range(total).select(F.col("id").alias("cell"), F.col("id").alias("new_cell"))
    out = S.assign_phases(indexed, total, window)
    got = {r.phase: r["count"] for r in out.groupBy("phase").count().collect()}
    assert [got[i] for i in range(len(sizes))] == sizes
    assert out.filter(F.col("cell") == total - 1).first().phase == 0
    assert S.assign_phases(indexed, total, window, skip=1).filter("phase = 0").isEmpty()
    with pytest.raises(ValueError):
        S.nr_phases(4, 4)


def test_positions_are_exact_permutations(spark):
    df = spark.range(5000).select((F.col("id") * 7 + 3).alias("cell"))
    got = sorted(r.position for r in hash_position(df, "cell", 1).collect())
    assert got == list(range(5000))
    by_id = id_position(df, "cell").orderBy("cell").collect()
    assert [r.position for r in by_id] == list(range(5000))


def test_densify_chunks_and_empty_rows(spark):
    m = np.zeros((3, 10))
    m[0, [0, 4, 9]] = [1, 2, 3]
    m[1, 5] = -1
    expr = as_expression(spark, m, ["a", "b", "c"])
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    for chunk in (3, 5, 100):
        out = M.densify(expr.values, 10, rows=names, chunk=chunk).collect()
        got = np.full((3, 10), np.nan)
        for r in out:
            got["abc".index(r.gene), r.cell] = r.value
        assert len(out) == 30 and (got == m).all()


def test_pack_unpack_roundtrip_in_chunks(spark):
    m = np.array([[0, 1, 0, 3, 0], [0, 0, 2, 0, 4]], dtype=float)
    expr = as_expression(spark, m, ["a", "b"])
    for width in (2, 100):
        packed = M.pack(expr.values, 5, width)
        assert packed.agg(F.max(F.size("indices"))).first()[0] <= width
        assert sorted(map(tuple, M.unpack(packed).collect())) == sorted(map(tuple, expr.values.collect()))


def test_cell_major_rows_and_drop_column(spark):
    em = np.zeros((4, 6))
    for c, g, v in ((0, 0, 6), (1, 1, 7), (3, 2, 8), (5, 0, 9), (5, 3, 9)):
        em[g, c] = v
    expr = as_expression(spark, em, list("abcd"))
    index = spark.createDataFrame([(g, i) for i, g in enumerate("abcd")], "gene string, idx int")
    label = spark.createDataFrame([(c, float(c + 1)) for c in range(6)], "cell int, label double")
    rows = {r.cell: (r.label, [tuple(e) for e in r.entries]) for r in M.labelled_rows(M.cell_major(expr.values, index), label).collect()}
    assert rows[0] == (1.0, [(0, 6.0)]) and rows[2] == (3.0, []) and rows[5] == (6.0, [(0, 9.0), (3, 9.0)])
    for g in "abcd":
        left = M.drop_column(expr.values, g)
        assert left.count() == expr.values.count() - expr.values.filter(F.col("gene") == g).count()
    assert tuple(M.dimensions(expr).first()) == (4, 6)


def test_missing_values_and_duplicates(spark):
    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, float("nan")), ("a", 2, 0.0), ("a", 3, None), ("b", 0, 1.0), ("b", 0, -1.0)]
    df = spark.createDataFrame(rows, "gene string, cell int, value double")
    assert sorted(r.value for r in M.drop_missing(df).collect()) == [-1.0, 1.0, 1.0, 2.0]
    clean = M.sum_duplicates(M.drop_missing(df)).collect()
    assert [tuple(r) for r in clean] == [("a", 0, 3.0)]


def test_regulator_selection(spark):
    expr = as_expression(spark, np.ones((4, 4)), [f"gene{i}" for i in range(1, 5)])
    regs = S.regulator_index(expr.values, ["gene3", "gene2", "other"])
    assert [tuple(r) for r in regs.orderBy("ridx").collect()] == [("gene2", 0), ("gene3", 1)]
    matrix = S.keep_genes(expr.values, ["gene2", "gene3"])
    assert (matrix.select("cell").distinct().count(), matrix.select("gene").distinct().count()) == (4, 2)
    assert S.keep_genes(expr.values, []) is expr.values
    with pytest.raises(ValueError):
        S.require_regulators(S.regulator_index(expr.values, ["zzz"]))
    assert {r.gene for r in S.fold_case(spark.createDataFrame([("Gad1",), ("GAD1",)], "gene string")).collect()} == {"GAD1"}
    assert S.first_genes(expr.values, None).count() == 4


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("cell"), F.col("id").alias("gene"))
    small = spark.range(60).select((F.col("id") % 50).alias("cell"), F.col("id").alias("f"))
    want = sorted(map(tuple, big.join(small, "cell").select("cell", "gene", "f").collect()))
    got = salted_join(big, small, "cell", "gene", pairs_per_salt=100).select("cell", "gene", "f")
    assert sorted(map(tuple, got.collect())) == want


def test_dump_and_losses(spark):
    # fixed values: lines in the dump format
    lines = [
        "0:[f223<4.5] yes=1,no=2,missing=1,gain=1012.38,cover=2394",
        "\t1:[f220<1.5] yes=3,no=4,missing=3,gain=140.227,cover=1949",
        "\t\t3:[f223<1.5] yes=7,no=8,missing=7,gain=53.1558,cover=1886",
        "\t\t4:leaf=-0.0667736,cover=1558",
    ]
    one = spark.createDataFrame([(0, x) for x in lines], "tree_id int, line string")
    assert parse_dump(one).count() == 3
    both = one.unionByName(one.withColumn("tree_id", F.lit(1)))
    for df, k in ((one, 1), (both, 2)):
        row = dump_importance(df).filter("feature = 223").first()
        assert row.gain == pytest.approx(k * (1012.38 + 53.1558)) and row.frequency == 2 * k
    ev = spark.createDataFrame([(0, "[0]\ttrain-rmse:1.5\ttest-rmse:2.5")], "round int, line string")
    assert tuple(parse_losses(ev).first()) == (0, 1.5, 2.5)


def test_score(spark):
    # fixed values: published p-values of two methods on three networks
    roc = [4.444600e-33, 2.297304e-08, 1.040680e-02]
    pr = [9.982996e-96, 5.687217e-24, 1.763807e-02]
    df = spark.createDataFrame(list(zip(roc, pr)), "p_roc double, p_pr double")
    assert challenge_score(df).first()[0] == pytest.approx(26.996, abs=5e-4)
    assert challenge_score(df.filter("p_roc > 1e-20")).first()[0] == pytest.approx(8.655, abs=5e-4)


def test_vectors(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    got = df.select(interact(assemble("a", "b"), assemble("c", "d")).alias("v")).first().v
    assert got == [3.0, 4.0, 6.0, 8.0]
    assert list(assemble_ml(df, ["a", "b"]).first().expression) == [1.0, 2.0]


def test_rollup_and_sorts(spark):
    rows = [("a", "t", 3.0), ("b", "t", 1.0), ("a", "u", 5.0)]
    df = spark.createDataFrame(rows, "regulator string, target string, gain double")
    total = E.gain_rollup(df).filter("target IS NULL").first()
    assert (total.sum_gain, total.max_gain) == (9.0, 5.0) and total.stddev_gain == pytest.approx(2.0)
    assert [r.gain for r in E.truncate(df, 2).collect()] == [5.0, 3.0]
    assert [(r.regulator, r.target) for r in E.sort_by_names(df).collect()] == [("a", "t"), ("a", "u"), ("b", "t")]
