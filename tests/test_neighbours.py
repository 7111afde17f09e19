import random

import numpy as np
import pyarrow as pa
import pytest

from kindred.functions.distance import Weights
from kindred.operators import tiles
from kindred.operators.neighbours import top_neighbours

SCHEMA = (
    "id string, sku_id string, group_id string, category_id string, brand string, price_hint double, "
    "title_vec array<double>, image_vec array<double>"
)


def angle(degrees):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]


def brute_force(rows, w, k, digits, null_safe_brand=False):
    out = set()
    for q in rows:
        block = [c for c in rows if c[3] == q[3] and q[3] is not None]
        if len(block) == 1:
            out.add((q[0], None, None))
        units = {}
        for c in sorted(block, key=lambda c: c[1]):
            if c[0] == q[0]:
                continue
            total = w.title * 0.5 * (1 - np.dot(c[6], q[6])) + w.image * (1 - np.dot(c[7], q[7]))
            same = c[4] == q[4] and (null_safe_brand or c[4] is not None)
            total += w.brand * (0 if same else 1)
            i, j = c[5], q[5]
            gap = (i - j) if j < i else (j - 1.1 * i) if j > 1.1 * i else 0
            total += w.price * (gap / (i + j) if i + j else 0)
            sim = round((1 - total) * 10**digits) / 10**digits
            unit = ("g", c[2]) if c[2] else ("i", c[0])
            if unit not in units or sim > units[unit][0]:
                units[unit] = (sim, c[0])
        out |= {(q[0], y, s) for s, y in sorted(units.values(), reverse=True)[:k]}
    return out


def run(spark, rows, w, k, **options):
    got = top_neighbours(spark.createDataFrame(rows, SCHEMA), w, k, digits=6, **options).collect()
    assert len({(r.idX, r.idY) for r in got}) == len(got)
    return {(r.idX, r.idY, r.score) for r in got}


def test_worked_example(spark):
    # similarity of a and b is 1 - (1 - cos) / 2
    base = lambda i, g, deg: (i, i, g, "c", None, 1.0, angle(deg), [1.0])
    rows = [base("A", None, 0), base("B", "g1", 20), base("C", "g1", 30), base("D", None, 60)]
    got = {x: [] for x in "ABCD"}
    for x, y, score in sorted(run(spark, rows, Weights(1, 0), 48), key=lambda r: -r[2]):
        got[x].append(y)
    assert got["A"] == ["B", "D"]
    assert got["B"] == ["C", "A", "D"]


def random_rows(n, seed, copies=0.4):
    rng, out = random.Random(seed), []
    for i in range(n):
        hot = rng.random() < copies
        deg = 45 if hot else rng.randrange(0, 90, 5)
        out.append((
            f"p{i:04}", f"s{rng.randrange(10**6):06}-{i}", rng.choice([None, None, f"g{rng.randrange(n // 6 + 1)}"]),
            "hot" if rng.random() < 0.6 else rng.choice(["c1", "c2", None]),
            None if rng.random() < 0.1 else rng.choice(["x", "y"]) if not hot else "x",
            100.0 if hot else float(rng.randrange(0, 300)),
            angle(deg), angle(0 if hot else rng.randrange(0, 180, 30)),
        ))
    return out


@pytest.mark.parametrize(
    "weights,k,tile_rows",
    [
        (Weights(), 5, None), (Weights(), 5, 40), (Weights(1, 0), 3, 50), (Weights(0.5, 0.2, 0, 0.2, 0.1), 4, 30),
        (Weights(1, 0, 0, -0.3, 0.5), 4, 60), (Weights(1, 0), 1000, 40),
    ],
)
def test_equals_brute_force(spark, weights, k, tile_rows):
    rows = random_rows(260, seed=k) + [("solo", "solo", None, "lonely", "x", 1.0, angle(3), angle(3))]
    want = brute_force(rows, weights, k, 6)
    assert run(spark, rows, weights, k, tile_rows=tile_rows) == want
    if tile_rows and k == 4:
        assert run(spark, rows, weights, k, tile_rows=tile_rows, prune=False) == want


@pytest.mark.parametrize("weights", [Weights(), Weights(0.3, 0.2, 0, 0.2, 0.3)])
def test_bounded_search_alone(spark, monkeypatch, weights):
    from kindred.operators import pruning

    monkeypatch.setattr(pruning, "WORTHWHILE", 2.0)  # never fall back to all comparisons
    rows = random_rows(300, seed=11, copies=0.2)
    assert run(spark, rows, weights, 3, tile_rows=25) == brute_force(rows, weights, 3, 6)


def test_copies_of_one_product(spark):
    # most rows are equal in everything compared, some of them in one group
    rows = [
        (f"x{i:04}", f"x{i:04}", "big" if i % 4 == 0 else None, "hot", "x", 5.0, angle(10), angle(10)) for i in range(300)
    ] + random_rows(60, seed=2)
    for tile_rows in (None, 64):
        assert run(spark, rows, Weights(), 6, tile_rows=tile_rows) == brute_force(rows, Weights(), 6, 6)


def test_null_safe_brand(spark):
    rows = random_rows(80, seed=5)
    w = Weights(0.5, 0, 0, 0.5, 0)
    assert run(spark, rows, w, 4, null_safe_brand=True) == brute_force(rows, w, 4, 6, True)


def test_integer_ids_and_rerun(spark):
    df = spark.createDataFrame(random_rows(120, seed=8), SCHEMA)
    df = df.withColumn("id", df.id.substr(2, 9).cast("long"))
    first, again = (
        sorted(map(tuple, top_neighbours(df, k=5, digits=6, tile_rows=t).na.drop().collect())) for t in (40, None)
    )
    assert first == again and isinstance(first[0][0], int)


def test_bound_is_never_above_a_distance(spark):
    from pyspark.sql import functions as F

    from kindred.operators import pruning

    rng = np.random.default_rng(6)
    w = Weights(0.5, 0.2, 0, 0.2, 0.1)
    rows = [r for r in random_rows(80, seed=9, copies=0.0) if r[3] == "hot"]
    u = np.array([np.r_[np.sqrt(0.25) * np.array(r[6]), np.sqrt(0.2) * np.array(r[7])] for r in rows])
    pivots = u[rng.integers(0, len(u), 4)]
    reach = np.linalg.norm(u[:, None] - pivots, axis=2)
    cell = reach.argmin(axis=1)
    schema = "id string, category_id string, brand string, price_hint double, cell int, reach double, norm double, reaches array<double>, candidate_part long"
    data = [
        (r[0], "hot", r[4], r[5], int(cell[i]), float(reach[i, cell[i]]), float(u[i] @ u[i]), reach[i].tolist(), int(cell[i]))
        for i, r in enumerate(rows)
    ]
    df = spark.createDataFrame(data, schema).withColumn("shell", F.lit(0))
    facts = pruning._part_facts(df, w)
    bounds = df.drop("candidate_part").join(facts, "category_id").select("id", "candidate_cell", pruning.least_distance(w))
    bounds = {(a, b): c for a, b, c in bounds.collect()}
    everything = brute_force([(*r[:2], None, *r[3:]) for r in rows], w, len(rows), 12)
    cells = {r[0]: int(cell[i]) for i, r in enumerate(rows)}
    assert all(bounds[x, cells[y]] <= 1 - s + 1e-7 for x, y, s in everything)
    assert max(bounds.values()) > 0.05


@pytest.mark.parametrize("tile_rows,prune", [(None, True), (8, False), (8, True)])
def test_ties_inside_groups_in_any_tiles(spark, tile_rows, prune):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(f"p{i:02}", f"s{rng.random():.6f}", rng.choice([None, "g1", "g2", "g3", "g4"]), "c", "b", 1.0,
                 angle(rng.choice([0, 40])), [1.0]) for i in range(60)]
        w = Weights(1, 0)
        assert run(spark, rows, w, 3, tile_rows=tile_rows, prune=prune) == brute_force(rows, w, 3, 6)


def test_many_digits_and_missing_vectors(spark):
    rows = [(i, i, None, "c", None, 1.0, v, v) for i, v in (("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 1.0]))]
    got = top_neighbours(spark.createDataFrame(rows, SCHEMA), Weights(1, 1), 2, digits=13).collect()
    assert len(got) == 6
    broken = spark.createDataFrame([*rows, ("d", "d", None, "c", None, 1.0, None, [1.0, 0.0])], SCHEMA)
    with pytest.raises(Exception, match="one length"):
        top_neighbours(broken, Weights(1, 0), 2).collect()


def test_ties_of_groups_are_cut_in_every_tile(spark):
    from pyspark.sql import functions as F

    from kindred.operators.tiles import build_grid, shortlist_kernel

    # 150 groups of two whose members all tie, and one large group that has to be parted
    rows = [(f"p{i:03}", f"s{i * 7 % 400:03}", f"g{i // 2}" if i < 300 else "big", "c", "b", 1.0, angle(i % 2 * 1e-6), [1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.col("sku_id")).drop("sku_id")
    grid = build_grid(df, df, 16, 80)
    out = "idX string, idY string, group_id string, pos string, score double"
    from pyspark.sql.types import _parse_datatype_string

    found = grid.apply(shortlist_kernel(4, Weights(1, 0), 6, False), _parse_datatype_string(out))
    most = found.where("group_id <> 'big'").groupBy("idX").count().agg(F.max("count")).first()[0]
    assert not grid.single_pass and most <= 4 * 5  # k rows of each of the five parts
    for prune in (True, False):
        assert run(spark, rows, Weights(1, 0), 4, tile_rows=80, prune=prune) == brute_force(rows, Weights(1, 0), 4, 6)


def test_few_copies_in_one_group_are_dropped(spark):
    from kindred.operators.neighbours import without_surplus_copies

    rows = [(f"p{i:03}", f"s{i * 7 % 60:03}", f"g{i % 2}" if i < 40 else None, "c", "b", 1.0, angle(10), [1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("sku_id", "pos")
    kept = sorted((r.group_id, r.pos) for r in without_surplus_copies(df, Weights(1, 0), 48).where("group_id IS NOT NULL").collect())
    assert kept == sorted(p for g in ("g0", "g1") for p in sorted((r[2], r[1]) for r in rows if r[2] == g)[:2])
    assert run(spark, rows, Weights(1, 0), 48) == brute_force(rows, Weights(1, 0), 48, 6)


@pytest.mark.parametrize("final", [True, False])
def test_cells_ruled_out_without_their_price_change_nothing(monkeypatch, final):
    rng = np.random.default_rng(4)
    n, w = 1500, Weights(title=0.5, image=0.0, brand=0.2, price=0.3)
    vectors = rng.normal(size=(n, 6))
    vectors[:200] = vectors[200:400]  # copies, so that there are ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    price = rng.uniform(900, 1000, n)
    price[::50] = np.nan
    rows = pa.table({
        "id": [str(i) for i in range(n)],
        "pos": [f"S{i}" for i in range(n)],
        "group_id": pa.array([None if i % 5 == 0 else f"g{g}" for i, g in enumerate(rng.integers(0, 200, n))]),
        "title_vec": list(vectors),
        "brand": [f"b{b}" for b in rng.integers(0, 8, n)],
        "price_hint": price,
        "whole": rng.random(n) < 0.7,
    })
    exact, seen = tiles.TileDistances.price_share, []

    def counting(self, j, i):
        seen.append(np.broadcast(j, i).size)
        return exact(self, j, i)

    monkeypatch.setattr(tiles.TileDistances, "price_share", counting)
    found = {}
    for share in (tiles.CLOSE_SHARE, -1.0):  # the second compares every cell
        monkeypatch.setattr(tiles, "CLOSE_SHARE", share)
        seen.clear()
        out = tiles.shortlist_kernel(10, w, 6, False, final=final)(rows.slice(0, 300), rows)
        found[share] = sorted(zip(*(out.column(c).to_pylist() for c in ("idX", "idY", "score")))), sum(seen)
    assert found[0.25][0] == found[-1.0][0]
    assert found[0.25][1] < 300 * n / 4 < 300 * n <= found[-1.0][1]


@pytest.mark.parametrize("prune", [True, False])
def test_candidates_pass_by_in_waves_and_leave_no_shortlists(spark, monkeypatch, prune):
    from kindred.operators import neighbours, pruning

    # a group of more rows than are compared at a time, groups that lie across its ends, and ties between all of them
    rng = random.Random(7)
    rows = [
        (f"p{i:03}", f"s{rng.random():.6f}", "big" if i % 3 == 0 else rng.choice([None, "a", "g1", "g2", "z"]), "c", rng.choice("xy"), float(rng.randrange(90, 120)),
         angle(rng.choice([0, 40, 41])), [1.0]) for i in range(240)
    ]
    w, seen = Weights(0.5, 0, 0, 0.2, 0.3), []
    monkeypatch.setattr(tiles, "WAVE_BYTES", 30_000)
    monkeypatch.setattr(pruning, "WORTHWHILE", 2.0)
    for module, name in ((neighbours, "search_all"), (neighbours, "pruned_search")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real: seen.append(real(*a)) or seen[-1])
    assert run(spark, rows, w, 4, tile_rows=25, prune=prune) == brute_force(rows, w, 4, 6)
    # ten parts a side, and yet no more rows than the result has
    assert len(seen) == 1 and seen[0].count() == 240 * 4
    assert "neighbours-" in seen[0].inputFiles()[0]


def test_written_tables_give_back_their_shuffles(spark):
    import time

    from pyspark.sql import functions as F

    from kindred.session import materialise

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle" in manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size()))
    before = shuffles()
    written = [materialise(spark.range(1000).groupBy(F.col("id") % 7).agg(F.sum("id").alias("s"))) for _ in range(3)]
    until = time.time() + 20
    while shuffles() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffles() <= before and all(w.count() == 7 for w in written)
