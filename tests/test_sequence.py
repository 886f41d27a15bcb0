"""Passes in order against plain loops."""

import math
import random

from parcelspark.plans import decisions, site


def test_outliers_are_fixed_one_after_another(spark):
    """Long chains of neighbours, in which a building that has been turned turns the next one; all at once would end elsewhere."""
    r = random.Random(2)
    n = 120
    turn = lambda t: (round(math.cos(t), 5), round(math.sin(t), 5))
    dirs = {i: (*turn(r.choice([0.0, math.pi]) + r.uniform(-0.3, 0.3)), r.choice(["road", "road", "road", "address"])) for i in range(n)}
    links = {i: r.sample([j for j in range(max(0, i - 8), min(n, i + 9)) if j != i], 5) for i in range(n)}

    def plain(at_once):
        state = {i: d[:2] for i, d in dirs.items()}
        seen, out = dict(state), {}
        for i in range(n):
            from_ = seen if at_once else state
            mx, my = (round(sum(from_[j][k] for j in links[i]) / len(links[i]), 9) for k in (0, 1))
            norm = math.hypot(mx, my)
            if dirs[i][2] == "road" and len(links[i]) >= 4 and norm > 0.6 and (state[i][0] * mx + state[i][1] * my) / norm < -0.7:
                out[i] = state[i] = (round(mx / norm, 9), round(my / norm, 9))
        return out

    df = spark.createDataFrame([(i, *d) for i, d in dirs.items()], "building_id long, ux double, uy double, source string")
    near = spark.createDataFrame([(i, j) for i, js in links.items() for j in js], "building_id long, other long")
    got = {x["building_id"]: (x["ux"], x["uy"]) for x in decisions.fix_outliers(df, near).collect()}
    want = plain(False)
    assert set(got) == set(want) and all(math.dist(got[i], want[i]) < 1e-6 for i in want)
    assert set(want) != set(plain(True)) and len(want) > 4
    assert decisions.fix_outliers(df.where("building_id < 10"), near).count() == 0


def test_labels_flip_one_after_another(spark):
    r = random.Random(5)
    n = 150
    dirs = {i: ((1.0 if r.random() < 0.2 else -1.0) * (-1) ** i, 0.0, r.random() < 0.1) for i in range(n)}
    links = {(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n and r.random() < 0.9}

    def plain(at_once):
        old = {i: d[0] for i, d in dirs.items()}
        state, out = dict(old), set()
        for i in range(n):
            from_ = old if at_once else state
            same = [from_[j] * state[i] > 0 for k, j in sorted(links) if k == i]
            if not dirs[i][2] and same.count(False) >= 2 and not any(same):
                state[i] = -state[i]
                out.add(i)
        return out

    df = spark.createDataFrame([(i, *d) for i, d in dirs.items()], "building_id long, dx double, dy double, fixed boolean")
    near = spark.createDataFrame(sorted(links), "building_id long, other long")
    got = {x["building_id"] for x in decisions.flip_by_neighbours(df, near).collect()}
    assert got == plain(False) != plain(True) and len(got) > 5
    assert decisions.flip_by_neighbours(df, near.limit(0)).count() == 0


def place(left):
    for i in (6, 7):
        left = [x for x in left if x[i] == min(y[i] for y in left)]
    left = [x for x in left if x[8] >= 0.5 * max(y[8] for y in left)]
    my, mx = (sum(x[i] for x in left) / len(left) for i in (2, 3))
    return min(left, key=lambda x: (round((x[2] - my) ** 2 + (x[3] - mx) ** 2, 6), x[2], x[3]))


def test_pins_of_one_side_are_parted(spark):
    r = random.Random(11)
    middles = {o: (40 * (o // 4) + 30, 40 * (o % 4) + 30) for o in range(16)}
    rows = sorted({(o, k, middles[o][0] + r.randint(-14, 14), middles[o][1] + r.randint(-14, 14)) for o in range(16) for k in ("front", "back") for _ in range(6 if o % 3 else 2)})
    rows = [(*x, *middles[x[0]], r.randint(1, 2), r.randint(1, 2), float(r.randint(10, 99))) for x in rows]  # owner, kind, y, x, my, mx, attempt, tier, score
    candidates = spark.createDataFrame(rows, "owner long, kind string, y long, x int, my long, mx int, attempt int, tier int, score double")
    pins = site.settle(candidates)
    roads = {(y, x): (y - 7) ** 2 for y in range(-20, 220) for x in range(-20, 220)}
    road = spark.createDataFrame([(y, x, d) for (y, x), d in roads.items()], "y long, x int, road_d2 long")
    got = {(p["owner"], p["kind"]): (p["y"], p["x"], p["score"]) for p in site.part_same_side(pins, candidates, spark.createDataFrame([(o, *m) for o, m in middles.items()], "owner long, my long, mx int"), road).collect()}

    state = {(p["owner"], p["kind"]): (p["y"], p["x"], p["score"]) for p in pins.collect()}
    redo = {}
    for o, (my, mx) in middles.items():
        f, b = state.get((o, "front")), state.get((o, "back"))
        if f and b and (f[0] - b[0]) ** 2 + (f[1] - b[1]) ** 2 < 256:
            keep, kind = (f, "back") if f[2] >= b[2] else (b, "front")
            if abs(keep[0] - my) >= 1 or abs(keep[1] - mx) >= 1:
                redo[o] = kind, keep[0] - my, keep[1] - mx
    fixed = {k: v for k, v in state.items() if k[0] not in redo or k[1] != redo[k[0]][0]}
    want, placed, placeholders, swaps = dict(fixed), {}, 0, 0
    for o, (kind, ey, ex) in sorted(redo.items()):
        claims = [v for (p, k), v in fixed.items() if k == kind and p != o] + [v for (p, k), v in placed.items() if k == kind]
        left = [x for x in rows if x[:2] == (o, kind) and (x[2] - x[4]) * ey + (x[3] - x[5]) * ex <= 0 and all((x[2] - y) ** 2 + (x[3] - z) ** 2 > 100 for y, z, _ in claims)]
        if left:
            x = place(left)
            want[o, kind] = placed[o, kind] = (x[2], x[3], x[8])
        else:
            n = math.hypot(ey, ex)
            want[o, kind] = (math.floor(middles[o][0] - ey / n * 10 + 0.5), math.floor(middles[o][1] - ex / n * 10 + 0.5), 0.0)
            placeholders += 1
        f, b = (math.sqrt(roads[want[o, k][:2]]) for k in ("front", "back"))
        if f > b * 1.05:
            want[o, "front"], want[o, "back"] = want[o, "back"], want[o, "front"]
            swaps += 1
    assert got == want and len(redo) > 3 and placeholders and swaps and placeholders < len(redo)
