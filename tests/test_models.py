import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import chains, classify, embeddings, evaluation as ev, graphs, mentions as mn, optimise, parsing, relations as rel, resolution, topics
from textloom.plans import annotators


def random_graph(seed, loop=False):
    r = np.random.default_rng(seed)
    g = graphs.Graph([2, 3, 2, 2], [((i,), r.normal(size=n)) for i, n in enumerate([2, 3, 2, 2])] + [((0, 1), r.normal(size=(2, 3))), ((1, 2), r.normal(size=(3, 2))), ((1, 3), r.normal(size=(3, 2)))])
    if loop:
        g.factors.append(((0, 3), r.normal(size=(2, 2)) * 0.2))
    return g


@pytest.mark.parametrize("seed", range(5))
def test_propagation_is_exact_on_trees(seed):
    g = random_graph(seed)
    exact, _, best = graphs.enumerate_all(g)
    got, _ = graphs.propagate(g)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(exact, got))
    assert tuple(graphs.propagate(g, best=True)[1]) == best
    kept, top, bound = graphs.dual_decomposition(g, 500)
    assert g.score(best) <= bound + 1e-9 and top <= g.score(best) + 1e-9
    assert graphs.max_product_lp(g)[1] >= g.score(best) - 1e-9


def test_approximate_inference_is_near():
    g = random_graph(1, loop=True)
    exact, _, best = graphs.enumerate_all(g)
    assert all(np.allclose(a, b, atol=0.08) for a, b in zip(exact, graphs.gibbs(g, 4000, burn=100)[0]))
    assert all(np.allclose(a, b, atol=0.08) for a, b in zip(exact, graphs.metropolis(g, 30000)[0]))
    assert all(np.allclose(a, b, atol=0.08) for a, b in zip(exact, graphs.propagate(g, 50)[0]))
    assert all(abs(q.sum() - 1) < 1e-9 for q in graphs.mean_field(g))
    assert tuple(graphs.anneal(g)) == best and graphs.gibbs(g, 500)[1] == list(best)


def test_chain_decoding_is_the_best_path():
    r = np.random.default_rng(3)
    emit, move = r.normal(size=(5, 3)), r.normal(size=(3, 3))
    score = lambda y: sum(emit[i, t] for i, t in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
    paths = list(itertools.product(range(3), repeat=5))
    assert tuple(chains.viterbi(emit, move)) == max(paths, key=score)
    p, pairs, z = chains.forward_backward(emit, move)
    s = np.exp([score(y) for y in paths])
    assert np.isclose(z, np.log(s.sum())) and np.isclose(p[2, 1], sum(v for v, y in zip(s, paths) if y[2] == 1) / s.sum())
    mask = chains.licit(["O", "B-X", "I-X", "I-Y"])
    assert mask[0, 2] == -np.inf and mask[1, 2] == 0 and mask[1, 3] == -np.inf


@pytest.mark.parametrize("tags", [["O", "B"], ["O", "B", "C"]])
@pytest.mark.parametrize("likelihood", [False, True])
def test_chain_steps_give_the_results_of_steps_word_by_word(tags, likelihood):
    """Against sums and updates a word and a feature at a time, to the last bit; texts of 1 to 9 words, repeated words, tagged words. The
    slots of a known word aren't hashed again."""
    import zlib

    size, rate, k = 64, 0.1, len(tags)
    rng = random.Random(3)
    model = chains.ChainModel(tags, size)
    w, move = np.zeros((size, k)), np.zeros((k, k))
    for n in range(60):
        words = [rng.choice(["a", "Ann", "b2", "x-y", "été", ""]) + ("\x1fT" if n % 7 == 0 and rng.random() < 0.5 else "") for _ in range(rng.randint(1, 9))]
        y = [rng.randrange(k) for _ in words]
        slots = [[zlib.crc32(f.encode()) % size for f in fs] for fs in chains.token_features(words)]
        emit = np.array([w[s].sum(0) for s in slots])
        score, back = emit[0], []
        for e in emit[1:]:
            step = score[:, None] + move
            back.append(step.argmax(0))
            score = step.max(0) + e
        guess = [int(score.argmax())]
        for b in reversed(back):
            guess.append(int(b[guess[-1]]))
        guess = guess[::-1]
        assert model.decode(words) == [tags[t] for t in guess]
        if likelihood:
            p, pairs, _ = chains.forward_backward(emit, move)
        for i, s in enumerate(slots):
            if likelihood:
                g = -p[i]
                g[y[i]] += 1
                np.add.at(w, s, rate * g)
            elif guess[i] != y[i]:
                np.add.at(w[:, y[i]], s, rate)
                np.add.at(w[:, guess[i]], s, -rate)
        if likelihood and len(y) > 1:
            move -= rate * pairs.sum(0)
        for a, b in zip(guess, guess[1:]) if not likelihood else ():
            move[a, b] -= rate
        for a, b in zip(y, y[1:]):
            move[a, b] += rate
        model.step(words, [tags[t] for t in y], rate, likelihood)
        assert (model.weights == w).all() and (model.move == move).all()
    crc, calls = zlib.crc32, []
    chains.zlib = type("", (), {"crc32": lambda f: calls.append(f) or crc(f)})
    try:
        model.decode(["a", "Ann"] * 50)
    finally:
        chains.zlib = zlib
    assert len(calls) < 10


def test_names_are_found_among_tokens_of_names_alone(spark):
    """Runs that end with a sentence or a text, next to each other in two sentences; the same mentions from one shuffle of names alone."""
    r = random.Random(5)
    rows = [(d, p // 7, p, r.choice(["Ann", "NASA", "b", "x"]), r.choice(["NNP", "X"])) for d in range(6) for p in range(40)]
    toks = spark.createDataFrame(rows, "doc_id long, sent int, pos int, string string, pos_tag string").repartition(3)
    got = mn.named_mentions(toks, every_pos=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mn.named_mentions(toks).collect()))
    plan = mn.same_name_entities(got)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression [doc_id") < plan.index("Filter (StartsWith(pos_tag")


def test_chain_learns(spark):
    sents = [(["the", "Cat", "saw", "Bob"], ["O", "O", "O", "B"]), (["Bob", "saw", "the", "dog"], ["B", "O", "O", "O"])] * 10
    df = spark.createDataFrame(sents, "words array<string>, tags array<string>")
    model = chains.train_chain(df, ["O", "B"], passes=3, shards=2)
    assert all(r.tags == r.predicted for r in chains.tag(df, model).collect())


def test_eisner_is_the_best_projective_tree():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 4):
        s = r.normal(size=(n + 1, n + 1))

        def ok(h):
            for i in range(1, n + 1):
                seen, at = set(), i
                while at:
                    if at in seen:
                        return False
                    seen.add(at)
                    at = h[at - 1]
            arcs = [(min(i, h[i - 1]), max(i, h[i - 1])) for i in range(1, n + 1)]
            return not any(a < c < b < d for a, b in arcs for c, d in arcs)

        total = lambda h: sum(s[h[i - 1], i] for i in range(1, n + 1))
        best = max((h for h in itertools.product(range(n + 1), repeat=n) if all(h[i] != i + 1 for i in range(n)) and ok(h)), key=total)
        assert tuple(parsing.eisner(s)) == best


def test_transition_parser_learns(spark):
    train = [(["a", "dog", "barks"], ["D", "N", "V"], [2, 3, 0], ["det", "subj", "root"]), (["dogs", "see", "a", "cat"], ["N", "V", "D", "N"], [2, 0, 4, 2], ["subj", "root", "det", "obj"])]
    p = parsing.TransitionParser(["det", "subj", "obj", "root"]).fit(train, 20)
    assert all(p.run(w, t) == (h, x) for w, t, h, x in train)
    out = parsing.parse(spark.createDataFrame([(w, t) for w, t, *_ in train], "words array<string>, tags array<string>"), p).collect()
    assert [list(r["head"]) for r in out] == [h for _, _, h, _ in train]
    rows = spark.createDataFrame([(1, i + 1, h, "x") for i, h in enumerate([2, 3, 0])], "sent_id long, pos long, head long, label string")
    assert {(r.pos, r.member) for r in parsing.subtrees(rows).collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)}


def test_assignment_is_optimal():
    r = np.random.default_rng(2)
    for a, b in ((3, 3), (2, 4), (4, 2)):
        w = r.random((a, b))
        got = sum(w[i, j] for i, j in ev.best_assignment(w))
        want = max(sum(w[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(b), a)) if a <= b else max(sum(w[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(a), b))
        assert np.isclose(got, want)


def test_cluster_scores(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "2", "x")], "point string, gold string, predicted string")
    assert ev.pairwise(rows).first().f1 == 0.5
    same = rows.withColumn("predicted", F.col("gold"))
    assert all(f(same).first().f1 == 1.0 for f in (ev.pairwise, ev.b_cubed, ev.muc))


def test_trees(spark):
    rows = spark.createDataFrame([(i, float(x), float(x * x)) for i, x in enumerate([-3, -2, 1, 2, 3, 4])], "id long, x double, y double")
    nodes = classify.grow_tree(rows, ["x"], "variance", depth=5, bins=64)
    assert all(abs(r.y - r.predicted) < 1e-9 for r in classify.predict_tree(rows, nodes).collect())
    r = random.Random(1)
    pts = [(i, r.random(), r.random()) for i in range(200)]
    two = spark.createDataFrame([(i, a, b, float(a > 0.5 and b > 0.3)) for i, a, b in pts], "id long, a double, b double, y double")
    for kind in ("gini", "info", "ratio"):
        t = classify.grow_tree(two, ["a", "b"], kind, depth=4)
        assert classify.predict_tree(two, t).where("y = predicted").count() > 150
    assert classify.vote(two, classify.ada_boost(two, ["a", "b"], 3, depth=2), [0.0, 1.0]).where("y = predicted").count() > 150
    assert classify.vote(two, classify.random_forest(two, ["a", "b"], 3, 4, 2), [0.0, 1.0]).where("y = predicted").count() > 150
    assert len(classify.prune_tree(classify.grow_tree(two, ["a", "b"], depth=4), two)) > 0


def test_linear_training(spark):
    rows = spark.createDataFrame([(1.0 if i % 2 else -1.0, [i % 2, 2], [1.0, 1.0]) for i in range(40)], "y double, index array<int>, value array<double>")
    for rule in (optimise.AdaGrad(), optimise.AdaGradRDA(), optimise.FTRL(), optimise.Pegasos(), optimise.Averaged(optimise.Constant(1.0))):
        m = optimise.train(rows, 3, "log", rule, passes=5)
        assert m.score(rows).where("score * y <= 0").count() == 0, rule
    assert optimise.train_batch(rows, 3, "squared", 10).score(rows).where("score * y <= 0").count() == 0


def test_minimisers():
    a = np.array([[3.0, 1.0], [1.0, 2.0]])
    f = lambda w: (0.5 * w @ a @ w - w.sum(), a @ w - 1)
    want = np.linalg.solve(a, np.ones(2))
    assert np.allclose(optimise.lbfgs(f, np.zeros(2)), want, atol=1e-4) and np.allclose(optimise.conjugate_gradient(f, np.zeros(2)), want, atol=1e-4)
    assert optimise.check_gradient(f, np.array([0.3, -0.2]))
    x, y = np.array([[1.0, 0.2], [-1.0, 0.1]]), np.array([1.0, -1.0])
    assert ((x @ optimise.svm_dual(x, y)) * y > 0).all()
    for loss in optimise.OBJECTIVES.values():
        s, y = np.array([0.3, -0.7, 2.0]), np.array([1.0, 1.0, -1.0])
        assert np.allclose((loss(s + 1e-6, y)[0] - loss(s - 1e-6, y)[0]) / 2e-6, loss(s, y)[1], atol=1e-4)


def test_topics_and_vectors(spark):
    docs = spark.createDataFrame([(i, [0, 1, 0, 1] if i % 2 else [2, 3, 2, 3]) for i in range(20)], "doc_id long, words array<int>")
    rows, counts = topics.lda(docs, 2, 4, sweeps=8)
    assert counts.sum() == 80 and rows.count() == 20
    assert topics.left_to_right(np.array([0, 1]), np.full((4, 2), 0.25), np.ones(2)) == pytest.approx(2 * np.log(0.25))
    assert np.allclose(topics.fit_dirichlet(np.random.default_rng(1).multinomial(20, [0.5, 0.5], 200).astype(float)).argmax() in (0, 1), True)
    v = embeddings.skip_grams(docs.select("words"), list("abcd"), [20] * 4, size=4, passes=1)
    assert v.shape == (4, 4)
    cells = embeddings.planted_matrix(20, 10, 60, 2)
    train, test = embeddings.holdout(cells, 0.2)
    assert {r for r, _ in train} == {r for r, _ in cells} and len(train) + len(test) == len(cells)
    u, w = embeddings.rank_cells(spark.createDataFrame(cells, "r int, c int"), 20, 10, 4, passes=2)
    assert embeddings.score_cells(spark.createDataFrame(cells, "r int, c int"), u, w).count() == len(cells)
    x = spark.range(200).select((F.when(F.col("id") % 2 == 0, 0.0).otherwise(10.0) + (F.col("id") % 7) / 10).alias("x"))
    (_, m1, _), (_, m2, _) = topics.mixture_em(x, "x", 2)
    assert m1 < 1 and m2 > 9.5


def test_vectors_of_words_that_share_contexts(spark):
    """Words of one set of sentences come close to each other; and the counts of a vocabulary are summed once, not for each word."""

    class Counts(list):
        walks = 0

        def __iter__(self):
            Counts.walks += 1
            return super().__iter__()

    counts, docs = Counts([720] * 10), spark.createDataFrame([([i % 10, 3, 4],) for i in range(20)], "words array<int>")
    assert embeddings.skip_grams(docs, [str(i) for i in range(10)], counts, size=4, passes=1, bag=True).shape == (10, 4) and Counts.walks < 10
    r = np.random.default_rng(3)
    a, b, n = (r.random((100, 8)) - 0.5) / 8, np.zeros((100, 8)), 1500
    words = np.concatenate([r.integers(0, 50, 12) + 50 * (i % 2) for i in range(n)])
    for _ in range(5):
        embeddings._descend(a, b, words, np.repeat(np.arange(n), 12), topics.AliasTable(np.ones(100)), r, 2, 3, 0.05, False, 133)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert (a @ a.T)[:50, :50].mean() > 0.5 + abs((a @ a.T)[:50, 50:].mean())


def test_resolution():
    s = resolution.Settings(cosines={"w": 4.0})
    mentions = [{"w": Counter(x.split())} for x in ("ann lee", "ann lee", "bob ray", "bob ray")]
    f = resolution.sample(resolution.Forest(mentions, s), 300)
    roots = [f.root(i) for i in range(4)]
    assert roots[0] == roots[1] != roots[2] == roots[3]
    g = resolution.greedy(resolution.Forest(mentions, s))
    assert g.root(0) == g.root(1) != g.root(2)
    assert sum(n.mentions for n in f.nodes.values() if n.parent is None) == 4


def test_trees_are_scored_by_kinds_of_leaves():
    """Scores kept from step to step are those of the whole trees, and equal leaves of a tree are scored once."""
    s = resolution.Settings(cosines={"w": 1.0})
    f = resolution.Forest([{"w": Counter(["tin", ("can", "pan", "rod")[i % 3]])} for i in range(60)], s)
    for seed in range(5):
        resolution.sample(f, 100, seed)
        for r in [i for i, n in f.nodes.items() if n.parent is None]:
            total, stack = s.exists, [r]
            while stack:
                n = f.nodes[stack.pop()]
                total += 0 if n.mention else s.between
                for c in n.children:
                    stack.append(c)
                    total += resolution.child_parent_cosine(f.nodes[c].bags["w"], n.bags["w"]) - s.shift
            assert abs(f.score_tree(r) - total) < 1e-9
    assert max(sum(map(bool, n.alike.values())) + len(n.others) for n in f.nodes.values()) < max(len(n.children) for n in f.nodes.values())


def test_canopies_are_dealt_out_by_mentions(spark):
    rows = spark.range(9_000).selectExpr("concat('c', id % 4500) as canopy", "id", "map('w', 1.0D) as words")
    out = resolution.resolve(rows, resolution.Settings(cosines={"words": 1.0}), ["words"], 1)
    assert out.rdd.getNumPartitions() == 5


def test_components_of_a_path_against_the_order_of_its_nodes(spark):
    path = [0, *range(200, 0, -1)]
    e = spark.createDataFrame(list(zip(path, path[1:], strict=False)) + [(900, 901)], "a long, b long")
    assert {r.node: r.component for r in rel.components(e).collect()} == {**dict.fromkeys(path, 0), 900: 900, 901: 900}


def test_components_and_prune(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in rel.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7)}
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1), (5, 9, 1)], "r long, c long, v long")
    assert {(r.r, r.c) for r in rel.prune(cells, 0, 0).collect()} == {(0, 0), (0, 1), (1, 0)}


def test_mentions(spark):
    words = "Mary Smith met a tall man . She liked him . Smith left".split()
    tags = "NNP NNP VBD DT JJ NN . PRP VBD PRP . NNP VBD".split()
    toks = spark.createDataFrame([(1, 0, i, w, t) for i, (w, t) in enumerate(zip(words, tags))], "doc_id long, sent long, pos long, string string, pos_tag string")
    assert {r.string for r in mn.noun_phrases(toks).collect()} == {"Mary Smith", "tall man", "She", "him", "Smith"}
    m = mn.with_attributes(mn.noun_phrases(toks), spark.createDataFrame([("mary", "f")], "phrase string, gender string"))
    e = {r.string: r.entity for r in mn.sieve_entities(m).collect()}
    assert e["Mary Smith"] == e["She"] == e["Smith"] and e["tall man"] == e["him"] != e["She"]
    pairs = mn.relation_candidates(mn.named_mentions(toks))
    assert mn.match_patterns(mn.relation_candidates(mn.noun_phrases(toks)), toks, spark.createDataFrame([("met a", "met")], "pattern string, relation string")).first().relation == "met"
    assert pairs.count() == 2


def test_annotators_resolve():
    names = [a.name for a in annotators.resolve(["stem", "lemma"], annotators.DEFAULT, {"doc_id", "text"})]
    assert names == ["tokenizer", "normaliser", "stemmer", "lower lemmatiser"]
    with pytest.raises(ValueError):
        annotators.resolve(["parse"], annotators.DEFAULT, {"doc_id", "text"})


def test_constructions(spark):
    words = "International Business Machines , a firm , is big . IBM was a company which grew".split()
    toks = spark.createDataFrame([(1, 0 if i < 10 else 1, i, w) for i, w in enumerate(words)], "doc_id long, sent long, pos long, string string")
    m = spark.createDataFrame([(1, 0, 1, 0, 2, "International Business Machines"), (1, 0, 2, 4, 5, "a firm"), (1, 1, 3, 10, 10, "IBM"), (1, 1, 4, 12, 13, "a company"), (1, 1, 5, 14, 14, "which")], "doc_id long, sent long, id long, first long, last long, string string")
    got = {(r.kind, r.a, r.b) for r in mn.construction_links(m, toks).collect()}
    assert got == {("apposition", 1, 2), ("nominative", 3, 4), ("relative", 4, 5), ("acronym", 1, 3)}
    s = "struct<first:long,last:long,string:string,kind:string,gender:string,number:string>"
    p = spark.createDataFrame([((0, 1, "Ann Lee", "NAM", "f", "s"), (9, 9, "Lee", "NAM", "u", "s"))], f"m1 {s}, m2 {s}")
    r = mn.pair_features(p).first()
    assert (r.same_string, r.same_head, r.words_included, r.gender_match, r.number_match, r.kinds, r.distance) == (False, True, True, None, True, "NAM-NAM", 3)


def test_components_by_two_shared_items(spark):
    """Against all pairs, with links by items that aren't neighbours, ids of one item and nulls; ids are never paired."""
    combinations = itertools.combinations

    for seed, (ids, items, many) in enumerate([(40, 30, 3), (60, 12, 3), (30, 40, 8)]):
        r = random.Random(seed)
        has = {i: set(r.sample(range(items), r.randint(1, many))) for i in range(ids)}
        rows = [(i, x) for i, xs in has.items() for x in xs] * 2 + [(None, 1), (None, 2), (5, None)]
        label = {}
        links = [(a, b) for a, b in combinations(has, 2) if len(has[a] & has[b]) > 1]
        for a, b in links:
            label.setdefault(a, a), label.setdefault(b, b)
        for _ in has:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        got = {x.node: x.component for x in rel.shared_components(spark.createDataFrame(rows, "id long, item long")).collect()}
        assert got == label
    users = spark.range(4000).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("item"))  # pairs would be 8 million
    assert rel.shared_components(users).where("component = 0").count() == 4000


def test_cells_ranked_in_levels_are_those_ranked_one_by_one(spark):
    """Independent steps taken together, in parts of 50 cells, give what a loop over all cells gives."""
    from unittest import mock

    cells = spark.createDataFrame([(i * 7 % 30, i * i % 40) for i in range(600)], "r int, c int").distinct().orderBy("r", "c")
    with mock.patch.object(embeddings, "STEP_CELLS", 50):
        u, v = embeddings.rank_cells(cells, 30, 40, size=4, passes=1, shards=1)
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.1, (30, 4)), rng.normal(0, 0.1, (40, 4))
    pdf = cells.repartition(1, "c").toPandas()
    r, seen = np.random.default_rng([1, 0, int(pdf["c"].iloc[0])]), set(zip(pdf["r"], pdf["c"], strict=True))
    for i, c in pdf.sample(frac=1, random_state=1).itertuples(index=False):
        if ((j := int(r.integers(30))), c) in seen:
            continue
        g = 1 / (1 + np.exp((a[i] - a[j]) @ b[c]))
        di, dj, dc = g * b[c] - 0.01 * a[i], -g * b[c] - 0.01 * a[j], g * (a[i] - a[j]) - 0.01 * b[c]
        a[i], a[j], b[c] = a[i] + 0.1 * di, a[j] + 0.1 * dj, b[c] + 0.1 * dc
    assert np.allclose(u, a) and np.allclose(v, b)


def test_documents_sampled_side_by_side_are_those_sampled_alone():
    r = np.random.default_rng(2)
    words = [r.integers(0, 30, n) for n in (0, 5, 80, 80, 1, 33)]
    zs = [r.integers(0, 4, len(w)) for w in words]
    counts = r.integers(50, 90, (30, 4)).astype(float)
    rngs = lambda: [np.random.default_rng(i) for i in range(6)]
    got = topics.sample_documents(words, zs, counts, counts.sum(0), np.full(4, 0.1), 0.01, rngs())
    for w, z, g, rng in zip(words, zs, got, rngs(), strict=True):
        assert (topics.sample_document(w, z.copy(), counts.copy(), counts.sum(0), np.full(4, 0.1), 0.01, rng) == g).all()
