import math

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import distributions as D, optimise as O, structured as st


def test_densities(spark):
    df = spark.sql("select .3d as x, 2 as k, array(.2d, .8d) as p, array(1, 3) as n, array(0, 1, 1) as v")
    r = df.select(
        D.log_gaussian(F.col("x"), 0.0, 4.0).alias("g"), D.log_beta_density(F.col("x"), 2.0, 2.0).alias("b"), D.log_poisson(F.col("k"), 3.0).alias("p"), D.log_dirichlet(F.col("p"), [1.0, 1.0]).alias("d"),
        D.log_multinomial(F.col("n"), [0.25, 0.75]).alias("m"), D.log_plated(F.col("v"), [0.5, 0.5]).alias("l"), D.log_gamma_density(F.col("x"), 1.0, 2.0).alias("y"),
        D.responsibilities([(0.5, D.log_gaussian(F.col("x"), 0.0, 1.0)), (0.5, D.log_gaussian(F.col("x"), 9.0, 1.0))]).alias("r"),
    ).first()
    assert math.isclose(r.g, -0.5 * math.log(8 * math.pi) - 0.09 / 8) and math.isclose(r.b, math.log(6 * 0.3 * 0.7)) and math.isclose(r.p, math.log(9 / 2 * math.exp(-3)))
    assert math.isclose(r.d, 0, abs_tol=1e-9) and math.isclose(r.m, math.log(0.25) + 3 * math.log(0.75)) and math.isclose(r.l, 3 * math.log(0.5)) and math.isclose(r.y, math.log(2) - 0.6)
    assert r.r[0] > 0.99
    x = spark.createDataFrame([(v, 1.0) for v in (0.2, 0.4, 0.6, 0.5, 0.3)], "x double, w double")
    a, b = D.fit_beta(x, "x")
    assert math.isclose(a / (a + b), 0.4) and math.isclose(D.beta_summary(a, b)["variance"], np.var([0.2, 0.4, 0.6, 0.5, 0.3]))
    assert math.isclose(D.fit_weighted_gaussian(x, "x", "w")[0], 0.4)
    assert np.isclose(D.log_multivariate(np.zeros((1, 2)), np.zeros(2), np.eye(2))[0], -math.log(2 * math.pi))
    assert len(set(D.chinese_restaurant(50, 1.0))) < 20


def test_variational_topics():
    docs = [np.array([0, 1, 0, 1, 1])] * 8 + [np.array([2, 3, 3, 2, 2])] * 8
    theta, phi = D.collapsed_variational(docs, 2, 4)
    assert theta[0].argmax() != theta[-1].argmax() and np.allclose(phi.sum(0), 1)
    p = D.online_topics([docs] * 30, 2, 4, 16)
    assert np.allclose(p.sum(0), 1) and (p[:2].sum(0) > 0.9).sum() == 1


def test_more_rules(spark):
    rows = spark.createDataFrame([(1.0 if i % 2 else -1.0, [i % 2, 2], [1.0, 1.0]) for i in range(40)], "y double, index array<int>, value array<double>")
    rules = (O.ConstantLength(0.5), O.RDA(1.0), O.GroupLassoRDA(np.array([0, 1, 2]), 1.0, 0.001), O.AdaMira(), O.WeightDecay(O.AdaGrad()), O.Multiplex([(0, 2, O.AdaGrad()), (2, 3, O.Constant())]), O.Projected(O.AdaGrad()))
    for rule in rules:
        assert O.train(rows, 3, "log", rule, passes=5).score(rows).where("score * y <= 0").count() == 0, rule
    assert O.train_online(rows, 3, "log", 2, shards=2).score(rows).where("score * y <= 0").count() == 0
    x, y = np.array([[1.0, 0.2], [-1.0, 0.1], [2.0, 0.3]]), np.array([1.0, -1.0, 1.0])
    assert ((x @ O.sdca(x, y)) * y > 0).all()
    zero = O.GroupLassoRDA(np.array([0, 0, 1]), 1.0, 10.0).step(np.ones(3), np.ones(3))
    assert not zero.any()


def test_more_examples():
    m = st.chain_templates(2, 3)
    x, gold = (0, 1, 2), (0, 1, 0)
    whole = st.composite_likelihood(m, x, gold, [(0, 1, 2)])
    assert np.allclose(whole, m.likelihood(x, gold)) and np.allclose(st.composite_likelihood(m, x, gold, [(0,), (1,), (2,)]), m.pseudo_likelihood(x, gold))
    assert np.allclose(st.semi_supervised(m, x, lambda s: s == gold), m.likelihood(x, gold))
    loss, g = st.domination(np.array([1.0, 2.0, 0.0]), np.array([True, False, False]))
    assert loss == 2.0 and g.tolist() == [-1, 1, 0]


def test_examples_and_searches():
    import numpy as np

    from textloom.operators import optimise as O
    from textloom.operators.structured import chain_templates

    r = np.random.default_rng(1)
    x = r.normal(size=(30, 3))
    y = np.sign(x @ np.array([1.0, -2.0, 0.5]))
    f = O.mini_batch([O.predictor(a, b) for a, b in zip(x, y)])
    assert O.check_gradient(f, np.array([0.1, 0.2, -0.3]))
    ridge = lambda w: (f(w)[0] + w @ w / 2, f(w)[1] + w)
    a, b = O.steepest(ridge, np.zeros(3), 2000), O.lbfgs(ridge, np.zeros(3))
    assert abs(ridge(a)[0] - ridge(b)[0]) < 1e-4
    m = chain_templates(2, 3)
    example, gold = [0, 1, 2], (0, 1, 0)
    for _ in range(20):
        m.w = m.w + 0.5 * m.pseudomax(example, gold, 1.0)
    assert tuple(m.best(example)) == gold and not m.pseudomax(example, gold, 1.0).any()
    assert np.allclose(m.case_likelihood(example, gold, [gold]), 0)
