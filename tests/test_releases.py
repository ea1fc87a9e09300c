"""Release checks on hand-made windows."""

from __future__ import annotations

import random

from tidewater.operators import releases


def whole(rows, horizon):
    return [(rows + [rows[-1]] * horizon)[i : i + horizon] for i in range(len(rows))]


def test_untouched_windows_pass_and_any_single_change_is_found(spark):
    rng = random.Random(4)
    source, release, want = [], [], {}
    for k in range(60):
        rows = [[rng.choice([None, 0.0, 1.0, 2.5]), float(rng.randint(0, 3))] for _ in range(rng.randint(1, 12))]
        windows = whole(rows, 4)
        source += [(k, i, a) for i, a in enumerate(rows)]
        if k % 2:
            i, j = rng.randrange(len(windows)), rng.randrange(4)
            broken = [list(a) for a in windows[i]]
            broken[j] = rng.choice([[broken[j][1], broken[j][0]], [broken[j][0], 9.0], list(broken[(j + 1) % 4])])
            windows = [*windows[:i], broken, *windows[i + 1 :]]
        want[k] = windows == whole(rows, 4)
        release += [(k, i, w) for i, w in enumerate(windows)]
    s = spark.createDataFrame(source, "k int, frame long, action array<double>")
    r = spark.createDataFrame(release, "k int, frame long, w array<array<double>>")
    got = {x.k: x for x in releases.checked_windows(r, s, ["k"], "frame", "w", "action", 4).collect()}
    assert {k: x.ok for k, x in got.items()} == want
    assert all(x.windows == x.frames and x.missing == x.foreign == x.repeated == x.unfit == 0 for x in got.values())


def test_lost_null_and_foreign_windows(spark):
    s = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [1.0])], "k int, frame long, action array<double>")
    r = spark.createDataFrame([(1, 0, None), (3, 5, [[1.0], [1.0]]), (2, 0, [[1.0], [1.0]]), (2, 0, [[1.0], [7.0]])], "k int, frame long, w array<array<double>>")
    got = {x.k: (x.frames, x.windows, x.missing, x.foreign, x.repeated, x.unfit, x.changed, x.first_bad, x.ok) for x in releases.checked_windows(r, s, ["k"], "frame", "w", "action", 2).collect()}
    assert got == {1: (2, 1, 1, 0, 0, 1, 0, 0, False), 2: (1, 2, 0, 0, 1, 0, 1, 0, False), 3: (0, 1, 0, 1, 0, 0, 0, 5, False)}
    assert releases.checked_windows(r.limit(0), s.limit(0), ["k"], "frame", "w", "action", 2).count() == 0


def test_windows_are_neither_shuffled_nor_made(spark):
    s = spark.createDataFrame([(1, 0, [1.0])], "k int, frame long, action array<double>")
    r = spark.createDataFrame([(1, 0, [[1.0]])], "k int, frame long, w array<array<double>>")
    plan = releases.checked_windows(r, s, ["k"], "frame", "w", "action", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
