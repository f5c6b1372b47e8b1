import datetime as dt
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.llm import consensus, overlap, sampling, splits

RATING = "reviewer string, model_type string, experiment_id string, assemblability string, prompt_satisfaction string, design_quality string, rated_at timestamp_ntz, loaded_at timestamp_ntz, slice int, metric string"
T0 = dt.datetime(2024, 1, 1)


def rating(spark, rows):
    full = [(r, m, e, *v, T0 if t is None else T0 + dt.timedelta(seconds=t), T0, 7, "clash") for r, m, e, v, t in rows]
    return spark.createDataFrame(full, RATING)


def simulated(n_items=300, n_good=20, n_bad=4, per_item=7, seed=1):
    rng = random.Random(seed)
    truth = {(f"m{i % 3}", str(i), k): rng.randint(1, 3) for i in range(n_items) for k in range(3)}
    good = {f"g{i}": rng.uniform(0.65, 0.95) for i in range(n_good)} | {f"b{i}": rng.uniform(0.25, 0.45) for i in range(n_bad)}
    rows = []
    for i in range(n_items):
        for r in rng.sample(sorted(good), per_item):
            v = [truth[f"m{i % 3}", str(i), k] if rng.random() < good[r] else rng.choice([x for x in (1, 2, 3) if x != truth[f"m{i % 3}", str(i), k]]) for k in range(3)]
            rows.append((r, f"m{i % 3}", str(i), [str(x) for x in v], 5))
    return truth, good, rows


def test_usable_ratings(spark):
    rows = [
        ("a", " M ", "007", ["1", " 2.0 ", " 3"], 1),
        ("a", "m", "7.0", ["2", "x", ""], 2),  # later; only its first cell is usable
        ("a", "m", "x7", ["1", "1", "1"], 1),
        ("a", None, "7", ["1", "1", "1"], 1),
        (None, "m", "7", ["1", "1", "1"], 1),
        ("b", "m", "7", ["4", None, "2-3"], 1),
        ("c", "m", "7", ["1", "2", "3"], 1),
        ("c", "m", "7", ["3", "2", "1"], 1),  # equally late: the higher label
    ]
    got = {r["reviewer"]: tuple(r[m] for m in consensus.METRICS) for r in consensus.usable_ratings(rating(spark, rows)).collect()}
    assert got == {"a": (2, 2, 3), "c": (3, 2, 3)}


def test_equally_late_ratings_by_load_time(spark):
    """Of rows with one rated_at the one loaded last counts, per metric; a later rated_at comes first, a missing load time last."""
    day = dt.timedelta(days=1)
    rows = [
        ("a", ["3", "2", "3"], T0, T0), ("a", ["1", "3", "x"], T0, T0 + day),
        ("b", ["1", "1", "1"], T0 + day, T0 + day), ("b", ["3", "3", "3"], T0, T0 + 9 * day),
        ("c", ["1", "2", "1"], T0, T0), ("c", ["3", "3", "3"], T0, None),
        ("d", ["1", "1", "1"], None, T0 + day), ("d", ["2", "2", "2"], None, T0),
    ]
    df = spark.createDataFrame([(r, "m", "7", *v, at, late, 7, "clash") for r, v, at, late in rows], RATING)
    got = {r["reviewer"]: tuple(r[m] for m in consensus.METRICS) for r in consensus.usable_ratings(df).collect()}
    assert got == {"a": (1, 3, 3), "b": (1, 1, 1), "c": (1, 2, 1), "d": (1, 1, 1)}


def test_consensus_finds_truth_and_bad(spark):
    truth, good, rows = simulated()
    c = consensus.Consensus(rating(spark, rows))
    got = c.labels().collect()
    right = sum(truth[r["model_type"], str(r["experiment_id"]), consensus.METRICS.index(r["metric"])] == r["label"] for r in got)
    assert len(got) == 900 and right > 0.93 * len(got)
    bad = {(r["reviewer"], r["metric"]) for r in consensus.unreliable(rating(spark, rows)).collect()}
    assert bad == {(f"b{i}", m) for i in range(4) for m in consensus.METRICS}
    one = next(r for r in got if r["ratings"] == 7)
    assert 0 <= one["agreement"] <= 1


def test_hot_items_in_slices_change_nothing(spark, monkeypatch):
    _, _, rows = simulated(n_items=40, per_item=20)
    plain = {(r["reviewer"], r["metric"]): r["right_share"] for r in consensus.Consensus(rating(spark, rows)).reliability().collect()}
    monkeypatch.setattr(consensus, "HOT", 6)
    c = consensus.Consensus(rating(spark, rows))
    assert c.n_hot == 40
    hot = {(r["reviewer"], r["metric"]): r["right_share"] for r in c.reliability().collect()}
    assert hot.keys() == plain.keys() and all(hot[k] == pytest.approx(plain[k], abs=1e-6) for k in hot)
    assert c.labels().count() == 120


def settled(rows, m):
    """Reliabilities from the whole agreement matrix, iterated to the end in half steps."""
    names, items = sorted({r[0] for r in rows}), sorted({r[1:3] for r in rows})
    given_ = np.zeros((len(names), len(items)), int)
    for r, model, e, v, _ in rows:
        given_[names.index(r), items.index((model, e))] = int(v[m])
    shares = np.array([(given_ == k).sum() for k in (1, 2, 3)]) / (given_ > 0).sum()
    points = np.where((given_ > 0)[..., None], (given_[..., None] == [1, 2, 3]) - shares, 0).reshape(len(names), -1)
    product, overlap_ = points @ points.T, ((given_ > 0) * 1) @ ((given_ > 0) * 1).T
    np.fill_diagonal(product, 0)
    np.fill_diagonal(overlap_, 0)
    v, scale = np.full(len(names), 0.6), np.sqrt(1 - (shares**2).sum())
    for _ in range(1000):
        v = (v + np.clip(product @ v / (overlap_ @ v**2), -1, 1)) / 2
    return dict(zip(names, v / scale))


def test_reliabilities_settle_for_every_reviewer(spark, monkeypatch):
    """A small community beside a large one, without common items, is as settled as the large one when the steps end."""
    rng = random.Random(4)
    rows = []
    for side, reviewers, items, each, right in (("x", 12, 400, 300, 0.85), ("y", 16, 24, 20, 0.6)):
        for i in range(reviewers):
            for e in rng.sample(range(items), each):
                rows.append((f"{side}{i}", side, str(e), [str(1 + e % 3 if rng.random() < right else rng.randint(1, 3)) for _ in consensus.METRICS], 1))
    c = consensus.Consensus(rating(spark, rows))
    got = {(r["reviewer"], r["metric"]): r["reliability"] for r in c.reliability().collect()}
    for k, m in enumerate(consensus.METRICS):
        for who, want in settled(rows, k).items():
            assert got[who, m] == pytest.approx(want, abs=0.005), who
    monkeypatch.setattr(consensus, "STEPS", 1)
    with pytest.warns(UserWarning, match="still move"):
        consensus.Consensus(rating(spark, rows))


def test_names_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """The first seeds give few different hashes; the result is that of full hashes."""
    from pyspark.sql import functions as F

    _, _, rows = simulated(n_items=40)
    want = sorted((r["reviewer"], r["metric"], r["ratings"], round(r["right_share"], 6)) for r in consensus.reliabilities(rating(spark, rows)).collect())
    whole = consensus._hashed
    monkeypatch.setattr(consensus, "_hashed", lambda seed, *names: whole(seed, *names) % F.lit(50) if seed < 44 else whole(seed, *names))
    held = spark._jsc.sc().getPersistentRDDs().size()
    got = consensus.reliabilities(rating(spark, rows))
    assert spark._jsc.sc().getPersistentRDDs().size() == held
    assert sorted((r["reviewer"], r["metric"], r["ratings"], round(r["right_share"], 6)) for r in got.collect()) == want
    assert 1 <= got.first()["steps"] <= consensus.STEPS and 0 <= got.first()["last_move"] < consensus.CLOSE


def test_consensus_small_cases(spark):
    assert consensus.unreliable(rating(spark, []).filter("false")).count() == 0
    one = consensus.Consensus(rating(spark, [("a", "m", "1", ["2", "2", ""], 1)]))
    assert {r["metric"]: r["label"] for r in one.labels().collect()} == {"assemblability": 2, "prompt_satisfaction": 2}
    assert one.reliability().count() == 2


TARGET = "target_id int, request_id int, pool string, distribution string, difficulty_level int, model_cat string, target_share double, min_rows int, sample_frac double, rows int, met string"


def test_sampling(spark):
    cats = ["Chair"] * 60 + ["table "] * 30 + ["Bed"] * 8 + ["Lamp"] * 2 + [None, "", "-"]
    cat = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cats)], "dir_id bigint, model_cat string, request_id string")
    exp = spark.createDataFrame([(1, "p", "in distribution", 1), (1, "p", "in distribution", 1), (2, "p", "IN-Distribution", 2), (3, "p", "unknown", 1), (4, "p", "out-of-distribution", 9), (None, "p", "in-distribution", 1)], "prompt_id int, prompt string, distribution string, difficulty_level int")
    pool = sampling.usable(exp, cat)
    assert pool.count() == 102
    P, E = "partnet_meta", "experiments"
    rows = [(1, 1, P, None, None, "Chair", 0.4, 1, 0.5), (2, 1, P, None, None, "Table", 0.3, 1, 0.5), (3, 1, P, None, None, "Bed", 0.2, 1, 0.5), (4, 1, P, None, None, "Lamp", 0.1, 2, 0.5), (5, 2, E, "in-distribution", 1, None, 0.5, 2, 1.0), (6, 2, E, "out-of-distribution", None, None, None, None, 1.0), (7, 3, P, None, None, "None such", 0.5, 1, 0.1), (8, 3, P, None, None, None, 0.5, 1, 0.1)]
    targets = spark.createDataFrame([(*r, 1, "m") for r in rows], TARGET)
    got = {r["target_id"]: r for r in sampling.report(pool, targets).collect()}
    assert [got[i]["goal"] for i in range(1, 9)] == [20, 15, 10, 5, 2, 0, 5, 5]
    assert {r["target_id"] for r in sampling.unmet(pool, targets).collect()} == {3, 4, 5, 7, 8}
    assert got[3]["drawn"] == 8 and got[4]["drawn"] == 2 and got[1]["met"] and got[2]["met"]
    # what Bed and Lamp lack goes to Chair and Table by their shares, nothing outside the targets
    assert (got[1]["drawn"], got[2]["drawn"]) == (23, 17) and [got[i]["outside"] for i in range(1, 9)] == [0] * 4 + [1, 1, 10, 10]
    assert "CoGroup" in sampling.unmet(pool, targets)._jdf.queryExecution().optimizedPlan().toString()  # the repaired sample takes part
    s = sampling.sample(pool, targets)
    assert {r["request_id"]: r["count"] for r in s.groupBy("request_id").count().collect()} == {1: 50, 2: 2, 3: 10}
    assert s.distinct().count() == 62
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sampling.sample(pool, targets).collect()))
    assert sampling.report(pool.filter("false"), targets).filter("not can_be_met").count() == 7  # only the target without a share is met
    assert sampling.report(pool, targets.filter("false")).count() == 0 and sampling.sample(pool, targets.filter("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=5), st.integers(0, 60), st.integers(0, 9))
def test_swap_repair_is_best_for_apart_categories(size, n, seed):
    size = np.array(size)
    n = int(min(n, size.sum()))
    rng = np.random.default_rng(seed)
    goal = rng.multinomial(n, np.ones(len(size)) / len(size))
    floor = np.minimum(goal, 1)
    if np.minimum(floor, size).sum() > n:
        return
    take = sampling.repair(size, np.eye(len(size), dtype=int), goal, floor, n, rng)
    assert take.sum() == n and (take >= np.minimum(floor, size)).all() and (take <= size).all()
    want = sampling.wanted(size, goal, goal / max(1, n), n)
    assert want.sum() == n and (want >= np.minimum(goal, size)).all() and (take == want).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=5), st.integers(1, 40), st.integers(0, 60), st.integers(0, 9))
def test_no_row_outside_the_targets_while_others_are_left(size, outside, n, seed):
    size = np.array([*size, outside])
    rng = np.random.default_rng(seed)
    share = rng.dirichlet(np.ones(len(size) - 1))
    n = int(min(n, size.sum()))
    meets = np.eye(len(size), dtype=int)[:, :-1]
    take = sampling.repair(size, meets, np.floor(share * n).astype(int), np.zeros(len(size) - 1, int), n, rng, share)
    assert take.sum() == n and take[-1] == max(0, n - size[:-1].sum())
    half = sampling.repair(size, meets, np.floor(share / 2 * n).astype(int), np.zeros(len(size) - 1, int), n, rng, share / 2)
    assert half.sum() == n and half[-1] >= min(size[-1], n // 2)


CAT = "dir_id bigint, model_id string, upload_id string, model_cat string, root bigint, id string"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for d, m, u, *_ in rows:
        for k in (f"m{m}" if m else None, f"u{u}" if u else None):
            if k:
                a, b = find(d), find(k)
                parent[b] = a
    groups = {}
    for d in {r[0] for r in rows}:
        groups.setdefault(find(d), []).append(d)
    return groups


@pytest.mark.parametrize("shape", ["random", "chain", "star", "alone"])
def test_components(spark, shape):
    rng = random.Random(7)
    if shape == "random":
        rows = [(i, f"{rng.randint(1, 90):x}", f"up{rng.randint(1, 90)}" if rng.random() < 0.7 else None) for i in range(1, 121)]
    elif shape == "chain":
        order = list(range(1, 61))
        rng.shuffle(order)
        rows = [(d, f"{k // 2 + 1:x}", f"up{(k + 1) // 2 + 1}") for k, d in enumerate(order)]
    elif shape == "star":
        rows = [(i, f"{i:x}", "up7") for i in range(1, 200)]
    else:
        rows = [(i, None, ["unknown", "up000", "", None][i % 4]) for i in range(8)]
    cat = spark.createDataFrame([(d, m, u, "Chair", 0, "clash") for d, m, u in rows + rows[:3]], CAT)
    got = sorted(map(tuple, splits.related(splits.records(cat)).collect()))
    groups = brute([(d, m, u) for d, m, u in rows] if shape != "alone" else [(d, None, None) for d, *_ in rows])
    assert got == sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=4), st.integers(0, 60))
def test_closest_subset(sizes, target):
    s = sorted(sizes, reverse=True)
    got = splits.closest_subset(s, [sizes[x] for x in s], target)
    assert all(0 <= g <= sizes[x] for g, x in zip(got, s))
    every = {sum(x * n for x, n in zip(s, t)) for t in itertools.product(*[range(sizes[x] + 1) for x in s])}
    best = min(every, key=lambda t: (abs(t - target), t))
    assert sum(x * n for x, n in zip(s, got)) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 5), st.integers(0, 90), max_size=4), st.integers(0, 700))
def test_closest_subset_of_many(sizes, target):
    """More components than the proximity bound leaves open."""
    s = sorted(sizes, reverse=True)
    got = splits.closest_subset(s, [sizes[x] for x in s], target)
    assert all(0 <= g <= sizes[x] for g, x in zip(got, s))
    totals = {0}
    for x in s:
        totals = {t + x * n for t in totals for n in range(sizes[x] + 1)}
    best = min(totals, key=lambda t: (abs(t - target), t))
    assert sum(x * n for x, n in zip(s, got)) == best


def test_closest_subset_memory():
    """Millions of small components take no more memory than thousands."""
    tracemalloc.start()
    got = splits.closest_subset([300, 7, 2, 1], [3, 400_000, 1_000_000, 5_000_000], 900_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(a * b for a, b in zip(got, [300, 7, 2, 1])) == 900_001 and peak < 20_000_000


def test_assign(spark):
    rng = random.Random(3)
    rows = [(i, f"{i:x}", f"up{rng.randint(1, 150)}", rng.choice(["Chair", "chair ", "Table", None])) for i in range(1, 401)]
    rows += [(1000 + i, "ff" * 8, None, "Table") for i in range(200)]  # a third of all records are one group
    cat = spark.createDataFrame([(*r, 0, "clash") for r in rows], CAT)
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", None)], "split_name string, target_share double")
    rec = splits.records(cat)
    got = {r["dir_id"]: r["split_name"] for r in splits.assign(rec, targets).collect()}
    assert len(got) == 600
    for g in brute(rows).values():
        assert len({got[x] for x in g}) == 1
    n = {s: sum(v == s for v in got.values()) for s in ("train", "val", "test")}
    assert abs(n["val"] - 60) <= 3 and abs(n["test"] - 60) <= 3
    assert splits.assign(rec.filter("false"), targets).count() == 0
    assert {r[1] for r in splits.assign(rec, targets.filter("false")).collect()} == {None}


FINE = "entry_id bigint, split_name string, source string, messages array<struct<role:string,content:string>>, class string, n int"


def entry(i, split, design, role="assistant"):
    return (i, split, "s", [{"role": "system", "content": "1 2 3 4 5 6 7 8 9"}, {"role": role, "content": design}], "clash", 0)


def test_overlap_against_all_pairs(spark):
    rng = random.Random(5)
    designs, rows = [], []
    for i in range(150):
        if designs and rng.random() < 0.75:
            base = [list(p) for p in rng.choice(designs[:15])]
            for p in base:
                for k in range(9):
                    p[k] += rng.choice([0] * 50 + [1, -1, 2, -2, 3])
            rng.shuffle(base)
            base = base[: rng.randint(max(1, len(base) - 1), len(base))]
        else:
            base = [[rng.choice([18, 30, 62, 100]) + rng.randint(-2, 2) for _ in range(6)] + [0, 0, rng.choice([0, 90])] for _ in range(rng.randint(1, 12))]
        designs.append(base)
        rows.append(entry(i, rng.choice(["train", "val", "test ", "Train", "other", None, "train", "val"]), "\n".join(" ".join(map(str, p)) for p in base), rng.choice(["assistant", " Assistant "])))
    df = spark.createDataFrame(rows, FINE)
    side = {i: (r[1] or "").strip().lower() for i, r in enumerate(rows)}
    want = set()
    for i, j in itertools.combinations(range(150), 2):
        if {side[i], side[j]} in ({"train", "val"}, {"train", "test"}):
            a, b = np.array(designs[i], float), np.array(designs[j], float)
            if overlap.matched(a, b, 2) * 5 >= 4 * max(len(a), len(b)):
                want.add((i, j))
    got = overlap.found(df)
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    links = {r["entry_id"]: r["links"] for r in overlap.membership(df).collect()}
    assert {i for i, n in links.items() if n} == {x for p in want for x in p}
    rep = overlap.report(df).agg({"overlapping": "sum"}).first()[0]
    assert rep == len({x for p in want for x in p if side[x] != "train"})


def test_equal_designs_have_cosine_one(spark):
    p = "7 7 7 7 7 7 7 7 7"
    near = "9 7 7 7 7 7 7 7 7"
    df = spark.createDataFrame([entry(1, "train", p), entry(2, "val", p), entry(3, "test", near), entry(4, "val", f"{p}\n{p}\n90 9 9 9 9 9 9 9 9")], FINE)
    _, classes = overlap.design_classes(df)
    got = {(r["left"], r["right"]): r["cosine"] for r in overlap.class_pairs(classes).collect()}
    assert got[1, 1] == pytest.approx(1.0) and set(got) == {(1, 1), (1, 3)} and 0 <= got[1, 3] < 1  # another cell


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=7))
def test_matching_against_brute_force(a, b):
    x, y = (np.array([[p, q, 0, 0, 0, 0, 0, 0, 0] for p, q in v], float).reshape(-1, 9) for v in (a, b))
    if len(a) > len(b):
        x, y, a, b = y, x, b, a
    fits = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 2
    want = max((sum(fits(p, b[j]) for p, j in zip(a, order)) for order in itertools.permutations(range(len(b)), len(a))), default=0)
    assert overlap.matched(x, y, 2) == want


def test_matching_of_many_pieces():
    """A chain that takes the longest augmenting paths, and many equal pieces; neither recursion nor a table of all pairs."""
    n = 3000
    x = np.zeros((n, 9))
    x[:, 0] = np.arange(n) * 3
    assert overlap.matched(x, x[::-1] + 1.5, 2) == n
    assert overlap.matched(np.zeros((700, 9)), np.ones((500, 9)), 2) == 500


def test_overlap_forms(spark):
    p = "10 20 30 40 50 60 0 0 0"
    rows = [
        entry(1, "train", f"Here it is\n{p}\r\n11 11 11 11 11 11 0 0 0\n"),
        entry(2, "val", f"11,11, 11 11\t11 11 0 0 0 {p.replace(' ', '  ')}"),
        entry(3, "test", "10.0 20.0 30.0 40 50 62 0 0 0\n12 12 12 12 12 12 0 0 0"),
        entry(4, "val", p.replace(" ", "-")),
        entry(5, "val", ""),
        entry(6, "val", None),
        (7, "val", "s", None, "clash", 0),
        (8, "val", "s", [], "clash", 0),
        (None, "val", "s", rows_messages(p), "clash", 0),
        entry(9, "val", f"{p}\n13 11 11 11 11 11 0 0 3"),
        entry(2, "val", f"11,11, 11 11\t11 11 0 0 0\n{p}"),
        entry(10, "val", "\n".join(f"{i * 50} 9 9 9 9 9 0 0 0" for i in range(3000))),
    ]
    df = spark.createDataFrame(rows, FINE)
    assert sorted(map(tuple, overlap.found(df).collect())) == [(1, 2), (1, 3)]
    assert overlap.found(df.filter("false")).count() == 0 and overlap.report(df.filter("split_name = 'train'")).count() == 0


def rows_messages(text):
    return [{"role": "assistant", "content": text}]


def test_copies_are_one_class(spark):
    p = "\n".join(f"{i * 40 + 10} 20 30 40 50 60 0 0 0" for i in range(5))
    rows = [entry(i, "train", p) for i in range(300)] + [entry(1000 + i, "val", p) for i in range(3)]
    member, classes = overlap.design_classes(spark.createDataFrame(rows, FINE))
    assert classes.count() == 1 and overlap.class_pairs(classes).count() == 1
    assert overlap.membership(spark.createDataFrame(rows, FINE)).count() == 303


MAY_BE_EMPTY = {"p1_found"}  # few ratings


def test_every_query_runs(spark):
    from joinery.llm import queries

    for name, f in queries.queries().items():
        rows = f(spark, "/root/testdata/sf0.001")
        assert rows.count() > 0 or name in MAY_BE_EMPTY, name
        assert len(set(rows.columns)) == len(rows.columns), name
