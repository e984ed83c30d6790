import numpy as np
import pytest

from cadenza.llm.clusters import chosen_clusters, condense, contract, density_clusters, enrolled, linked_groups, local_forest, vertex
from cadenza.llm.forest import spanning_forest
from cadenza.llm.neighbours import nearest_vectors, neighbour_pairs
from cadenza.llm.pivots import decode, encode, files, sample_pivots, unit_rows

SCHEMA = "id string, embedding array<float>, duration float, pivot int, code string, h long"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def voices(seed=0, groups=(60, 25, 9, 4, 2, 2, 1, 1, 1), dim=256):
    rng = np.random.default_rng(seed)
    out = []
    for g in groups:
        centre = unit(rng.normal(size=dim))
        out.append(unit(centre + rng.normal(size=(g, dim)) * 0.5 / np.sqrt(dim)) * rng.uniform(0.5, 20))
    return np.vstack(out).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(f"S{i:05d}", v.tolist(), 5.0, 1, "c", 2) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + rows[:3] + list(extra), SCHEMA)


DIRTY = [
    (None, [1.0] * 256, 5.0, 0, "", 0), ("n1", None, 5.0, 0, "", 0), ("n2", [], 5.0, 0, "", 0), ("n3", [1.0] * 192, 5.0, 0, "", 0),
    ("n4", [float("nan")] * 256, 5.0, 0, "", 0), ("n5", [1.0] * 255 + [float("inf")], 5.0, 0, "", 0), ("n6", [0.001] * 256, 5.0, 0, "", 0),
    ("n7", [0.0] * 256, 5.0, 0, "", 0), ("n8", [1.0] * 255 + [None], 5.0, 0, "", 0),
]


def brute_pairs(ids, x, k=5, least=0.6):
    s = np.round(unit(x.astype(np.float64)) @ unit(x.astype(np.float64)).T, 6)
    out = set()
    for i in range(len(x)):
        best = sorted((-s[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out |= {(min(ids[i], b), max(ids[i], b)) for v, b in best if -v >= least}
    return out


def test_codes_are_close():
    x = unit(np.random.default_rng(1).normal(size=(50, 256))).astype(np.float32)
    assert np.abs(decode(encode(x)) @ x.T - x @ x.T).max() < 5e-4


def test_neighbours_reach_recall(spark):
    x = voices()
    want = brute_pairs([f"S{i:05d}" for i in range(len(x))], x)
    got = {tuple(r) for r in neighbour_pairs(nearest_vectors(frame(spark, x, DIRTY))).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def recall(spark, x, **params):
    want = brute_pairs([f"S{i:05d}" for i in range(len(x))], x)
    got = {tuple(r) for r in neighbour_pairs(nearest_vectors(frame(spark, x), **params)).collect()}
    return len(want & got) / len(want)


def test_neighbours_ranked_by_footrule_reach_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/speaker_params.parquet").select("id", "embedding").dropDuplicates(["id"])
    got = table.filter("id IS NOT NULL AND size(embedding) = 256").toArrow()
    at, x = unit_rows(got.column("embedding"), 256, 0.1)
    want = brute_pairs(got.column("id").take(at).to_pylist(), x)
    pivots = sample_pivots(table, 5, 256, 0.1)
    assert len(x) * 5 / len(pivots) > 2 * 64  # so files are ranked
    found = {tuple(r) for r in neighbour_pairs(nearest_vectors(table, rerank=64)).collect()}
    assert len(want & found) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(want)


def test_files_of_popular_pivots_are_split_and_keep_recall(spark):
    x = voices(3, (150, 150, 100, *[4] * 60))
    assert recall(spark, x, largest=80) >= 0.9
    groups = linked_groups(frame(spark, x), largest=150).collect()
    assert len({r["cluster_id"] for r in groups}) == 63 and len(groups) == len(x)


def test_files_of_pairs_are_the_same_from_either_pivot():
    near = np.array([[0, 1, 2, 3], [1, 0, 3, 2], [2, 0, 1, 3]], np.int16)
    popular = np.array([True, True, False, False])
    held = {}
    for rows, file in files(near, 2, popular):
        for r, f in zip(rows.tolist(), file.tolist()):
            assert r not in held.setdefault(f, [])
            held[f].append(r)
    assert sorted(held[(0 << 16) + 1 + 1]) == [0, 1, 2]
    assert held[2 << 16] == [2]


def test_copies_are_complete_and_bounded(spark):
    x = voices(5, (3, 1, 1))
    rows = [(f"K{i:05d}", x[0].tolist(), 5.0, 0, "", 0) for i in range(3000)]
    found = nearest_vectors(frame(spark, x, rows).repartition(6)).collect()
    by = {}
    for r in found:
        by.setdefault(r["id"], []).append(r["neighbour"])
    assert all(len(v) <= 5 for v in by.values())
    assert by["K02999"] == [f"K{i:05d}" for i in range(5)]
    assert by["K00002"] == ["K00000", "K00001", "K00003", "K00004", "K00005"]
    assert by["S00000"] == [f"K{i:05d}" for i in range(5)]
    groups = linked_groups(frame(spark, x, rows)).collect()
    assert {r["id"] for r in groups if r["cluster_id"] == "K00000"} == {r[0] for r in rows} | {"S00000", "S00001", "S00002"}


def test_outsiders_meet_the_smallest_of_many_copies(spark):
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=256)).astype(np.float32)
    rows = [(f"K{i:05d}", x.tolist(), 5.0, 0, "", 0) for i in range(600)]
    rows += [(f"T{i}", unit(x + rng.normal(size=256) * 0.5 / 16).tolist(), 5.0, 0, "", 0) for i in range(3)]
    by = {}
    for r in nearest_vectors(spark.createDataFrame(rows, SCHEMA).repartition(40)).collect():
        by.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(3):
        assert sorted(by[f"T{i}"]) == [(j + 1, f"K{j:05d}") for j in range(5)]


def test_one_direction_at_many_scales_is_one_class(spark):
    x = voices(5, (3, 1, 1))
    flat = [(f"K{i:05d}", [i + 1.0] * 256, 5.0, 0, "", 0) for i in range(600)]
    scaled = [(f"L{i:05d}", (x[3] * np.float32(2.0 ** (i % 8))).tolist(), 5.0, 0, "", 0) for i in range(600)]
    table = frame(spark, x, flat + scaled).repartition(3)
    by = {}
    for r in nearest_vectors(table).collect():
        by.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for name in "KL":
        for i in range(600):
            smallest = [f"{name}{j:05d}" for j in range(6) if j != i][:5]
            assert sorted(by[f"{name}{i:05d}"]) == list(enumerate(smallest, 1))
    groups = {r["id"]: r["cluster_id"] for r in linked_groups(table).collect()}
    assert {i for i, c in groups.items() if c == "K00000"} == {r[0] for r in flat}
    assert {i for i, c in groups.items() if c == "L00000"} == {r[0] for r in scaled} | {"S00003"}


def test_empty_and_invalid_tables(spark):
    for t in (frame(spark, np.empty((0, 256))), spark.createDataFrame(DIRTY, SCHEMA)):
        assert nearest_vectors(t).count() == 0
        assert linked_groups(t).count() == 0
        assert density_clusters(t).count() == 0


def test_groups_match_brute_force(spark):
    x = voices(7, (40, 12, 5, 3, 2, 2, 2, 1, 1))
    a, b = unit(np.random.default_rng(2).normal(size=(2, 256)))
    b = unit(b - (a @ b) * a)
    chain = np.array([a * np.cos(t) + b * np.sin(t) for t in (0, 0.8, 1.6, 2.4)], np.float32)  # neighbours alike, ends not
    x = np.vstack([x, chain])
    s = unit(x.astype(float)) @ unit(x.astype(float)).T >= 0.6
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[row].min() for row in s])
    want = {(f"S{label[i]:05d}", f"S{i:05d}") for i in range(len(x)) if (label == label[i]).sum() > 1}
    short = [("short", x[0].tolist(), 3.9, 0, "", 0), ("nan", x[0].tolist(), float("nan"), 0, "", 0), ("null", x[0].tolist(), None, 0, "", 0)]
    assert {tuple(r) for r in linked_groups(enrolled(frame(spark, x, DIRTY + short))).collect()} == want


def test_forest_of_random_graph(spark):
    rng = np.random.default_rng(4)
    edges = {}
    for _ in range(300):
        a, b = sorted(rng.integers(0, 90, 2).tolist())
        if a != b:
            edges[f"v{a:03d}", f"v{b:03d}"] = float(rng.integers(1, 20))
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    total, count = 0.0, 0
    for (a, b), w in sorted(edges.items(), key=lambda e: -e[1]):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total, count = total + w, count + 1
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a string, b string, w double")
    for jumps in (0, 3):
        forest, members = spanning_forest(table, jumps)
        got = forest.collect()
        assert (len(got), sum(r["w"] for r in got)) == (count, total)
        root = {r["id"]: r["root"] for r in members.collect()}
        assert len({(root[v], find(v)) for v in root}) == len(set(root.values())) == len({find(v) for v in root})
    a, b = np.array([[int(x[1:]) for x in e] for e in edges]).T
    w = np.array(list(edges.values()))
    kept = local_forest(90, a, b, w)
    assert (len(kept), w[kept].sum()) == (count, total)


def tree_clusters(a, b, w, n, min_size, cut=None):
    """Chosen clusters at one go, or with the edges of at least ``cut`` condensed first."""
    a, b, w = map(np.array, (a, b, w))
    names = [f"v{i:03d}" for i in range(n)]
    parts = [vertex(x) for x in names]
    if cut is not None:
        label = np.arange(n)
        for _ in range(n):
            for x, y in zip(a[w >= cut], b[w >= cut]):
                label[[x, y]] = min(label[x], label[y])
        made = []
        for v in np.unique(label):
            inner = np.flatnonzero(label == v)
            e = np.flatnonzero((w >= cut) & np.isin(a, inner))
            made.append(condense(np.searchsorted(inner, a[e]), np.searchsorted(inner, b[e]), w[e], [parts[i] for i in inner], min_size) if len(e) else parts[v])
        code = np.searchsorted(np.unique(label), label)
        a, b, w, parts = code[a[w < cut]], code[b[w < cut]], w[w < cut], made
        if not len(w):
            return chosen_clusters(parts[0], 0.6)
    return chosen_clusters(condense(a, b, w, parts, min_size), 0.6)


def test_condensed_hierarchy_chooses_two_dense_parts():
    # two chains of eight dense members, one weak bridge, one straggler
    a = [*range(0, 7), *range(8, 15), 7, 15]
    b = [*range(1, 8), *range(9, 16), 8, 16]
    w = [0.95] * 14 + [0.65, 0.62]
    got = tree_clusters(a, b, w, 17, 5)
    assert sorted((n, low) for n, _, _, low in got) == [(8, "v000"), (8, "v008")]
    (size, gain, top, low), = tree_clusters(np.arange(5), np.arange(1, 6), np.full(5, 0.8), 6, 5)
    assert (size, low, [m for _, m in top]) == (6, "v000", ["v000", "v001", "v002"]) and gain == pytest.approx(6 * (5 - 2.5))


def test_condensing_in_bands_changes_nothing():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(2, 60))
        b = np.arange(1, n)
        a = np.array([rng.integers(max(0, i - 6), i) for i in b])
        w = np.round(rng.uniform(0.6, 0.99, n - 1), int(rng.integers(1, 4)))
        def shape(found):
            return sorted((s, round(g, 6), tuple(top), low) for s, g, top, low in found)
        for min_size in (2, 4):
            whole = shape(tree_clusters(a, b, w, n, min_size))
            assert sum(s for s, *_ in whole) <= n
            for cut in (0.65, 0.8, 0.95):
                assert shape(tree_clusters(a, b, w, n, min_size, cut)) == whole


def test_clusters_do_not_depend_on_bands(spark):
    x = voices(9, (90, 40, 20, 6, 3, 1))
    def found(bound):
        return sorted((r["cluster_id"], r["tree_id"], r["size"], round(r["stability"], 3), tuple(r["exemplars"])) for r in density_clusters(frame(spark, x), bound=bound).collect())
    whole = found(1000)
    assert whole and found(20) == whole


def test_trees_of_one_level_contract_as_they_condense(spark):
    rng = np.random.default_rng(11)
    for _ in range(2):
        n = int(rng.integers(12, 40))
        b = np.arange(1, n)
        a = np.array([rng.integers(max(0, i - 9), i) for i in b])
        w = rng.choice([1.0, 0.9, 0.7], n - 1, p=[0.5, 0.3, 0.2])
        names = [f"v{i:03d}" for i in range(n)]
        root = condense(a, b, w, [vertex(x) for x in names], 3)
        table = spark.createDataFrame([("t", names[i], names[j], float(v)) for i, j, v in zip(a, b, w)], "part string, a string, b string, w double")
        row, = contract(table, None, 3, 2).collect()
        assert (row["size"], row["ids"]) == (root.size, root.ids) and row["fallen"] == pytest.approx(root.fallen)
        assert (row["best"] is None) == (root.best is None) and (row["best"] or 0) == pytest.approx(root.best or 0)
        assert [(t["d"], t["id"]) for t in row["top"]] == [(pytest.approx(d), i) for d, i in root.top]
        assert sorted((c["size"], c["id"], round(c["stability"], 6)) for c in row["inside"]) == sorted((n, i, round(g, 6)) for n, g, _, i in root.inside)
