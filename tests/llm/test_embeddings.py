import numpy as np

from marlstone.llm.embeddings import Index, near_duplicates, op6_embeddings, probed, reach

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    x = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x[k] = np.array(v, np.float64)
    links = {k: {j for j in x if j != k and x[k] @ x[j] / np.sqrt((x[k] @ x[k]) * (x[j] @ x[j])) >= cosine} for k in x}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo += (new := links.get(todo.pop(), set()) - seen)
            seen |= new
        low = min(rows[j][0] for j in seen)
        out.append((i, len(links.get(k, ())), low, i == low))
    return sorted(out)


def groups(seed, n=400, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    near = [base[i % 40] + 0.12 * rng.standard_normal(d) for i in range(300)]
    same = [base[0]] * 60
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate([*base, *near, *same])]


def test_recall_against_brute_force(spark, tmp_path):
    rows = groups(1)
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = sorted(map(tuple, op6_embeddings(spark, str(tmp_path)).collect())), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.97 * there <= found <= there
    whole = near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), margin=3.0, block=50)
    assert sorted((r.vec_id, r.n_links, r.component, r.vec_id == r.component) for r in whole.collect()) == want


def test_odd_vectors(spark, tmp_path):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0]), (9, [float("inf"), 0.0]), (10, [-1.0, 0.0]), (11, [1e-30, 1e-38])]
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in op6_embeddings(spark, str(tmp_path)).collect()}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1, 2, 3, 4, 5, 9, 10))
    assert all(got[i].n_links == 4 and got[i].component_id == 6 for i in (6, 7, 8, 11))
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op6_embeddings(spark, f"{tmp_path}/none").collect() == []


def test_every_pair_meets_in_few_dimensions(spark, tmp_path):
    """Pairs just over the cosine, without clusters, over many lists: none may be lost."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.concatenate([x, y]))]
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), per_list=4)
    assert sorted((r.vec_id, r.n_links, r.component, r.vec_id == r.component) for r in got.collect()) == brute(rows)


def test_probes_reach_one_of_each_pair_at_4096_lists():
    rng = np.random.default_rng(6)
    for width in (4, 16, 64):
        coarse = rng.standard_normal((4096, width))
        coarse /= np.linalg.norm(coarse, axis=1, keepdims=True)
        x = rng.standard_normal((1000, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(0.19) * side / np.linalg.norm(side, axis=1, keepdims=True)
        (a, ours), (b, theirs) = (probed(z @ coarse.T, coarse, 0.9) for z in (x, y))
        assert (ours[np.arange(1000), b] | theirs[np.arange(1000), a]).all()


def test_string_ids_and_null_ids(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.3]), (None, [1.0, 0.6]), ("z", [1.0, 1.0]), ("c", [-1.0, 0.0])], "vec_id string, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component) for r in near_duplicates(vectors).collect()}
    assert got == {"b": (1, "a"), "a": (2, "a"), None: (2, "a"), "z": (1, "a"), "c": (0, "c")}


def test_blocks_and_list_counts_lose_nothing(spark):
    rows = groups(5)
    want = brute(rows)
    for per_list, block in ((20, 16), (100, 60), (1000, 33)):
        got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), per_list=per_list, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component, r.vec_id == r.component) for r in got) == want


def test_the_filter_of_a_list_loses_no_pair_and_passes_few_others():
    """The length of what codes leave out, as a bound, passes over ten times as many pairs of these vectors."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.9000001 * x + np.sqrt(1 - 0.9000001**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    index = Index(x, 8)
    home = (x @ index.coarse.T).argmax(axis=1)
    passed = before = 0
    for which in range(8):
        own = np.flatnonzero(home == which)
        guess = index.decode(which, index.encode(x[own] - index.coarse[which]))
        products = guess.astype(np.float32) @ y.T.astype(np.float32)
        found = products >= reach(x[own], guess, 0.9)[:, None]
        assert found[np.arange(len(own)), own].all()
        # a query in the plane of a home and its guess, on the guess's far side, is as near the bound as one can be
        for worst in (x[own] - guess, guess - x[own]):
            worst -= (worst * x[own]).sum(axis=1, keepdims=True) * x[own]
            z = 0.9000001 * x[own] + np.sqrt(1 - 0.9000001**2) * worst / np.linalg.norm(worst, axis=1, keepdims=True)
            assert ((guess.astype(np.float32) * z.astype(np.float32)).sum(axis=1) >= reach(x[own], guess, 0.9)).all()
        passed += found.sum()
        before += (products >= 0.9 - 1e-5 - np.linalg.norm(x[own] - guess, axis=1)[:, None]).sum()
    assert 10 * (passed - len(x)) < before - len(x)


def test_reach_of_guesses_that_tell_nothing():
    x = np.eye(3)
    assert (reach(x, np.zeros((3, 3)), 0.9) == -np.inf).all() and (reach(x, -x, 0.9) == -np.inf).all()
    assert np.allclose(reach(x, x, 0.9), 0.9, atol=2e-5)
