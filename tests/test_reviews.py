"""Reviews under contracts against a search for the intervals that satisfy them, and trials with stated verdicts."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.contracts import CONTRACTS, FREE_TURNS
from tidewater.operators import evidence, reviews

STEP = 50_000


def truth(p, row):
    """A declared predicate of a row of plain values: True, False or None."""
    x = row.get(p["field"])
    if x is None:
        return None
    if p["op"] == "is":
        return x == p["value"]
    if "reduce" in p:
        if not x or ("length" in p and len(x) != p["length"]) or any(v is None or not math.isfinite(v) or not p.get("low", v) <= v <= p.get("high", v) for v in x):
            return None
        x = {"min": min, "max": max, "sum": sum, "mean": lambda v: sum(v) / len(v)}[p["reduce"]](x)
    elif not math.isfinite(x) or not p.get("low", x) <= x <= p.get("high", x):
        return None
    x = x - p.get("center", 0)
    op = p["op"]
    if op.startswith("abs_"):
        x, op = abs(x), op[4:]
    v = p["value"]
    return {"lt": x < v, "le": x <= v, "gt": x > v, "ge": x >= v, "eq": x == v}[op]


def both(xs):
    xs = list(xs)
    return False if False in xs else None if None in xs else True


def some(xs):
    return True if True in xs else None if None in xs else False


class Trial:
    """A trial's rows with the questions that contracts ask of them."""

    def __init__(self, task, rows):
        self.c, self.rows, self.t = CONTRACTS[task], rows, [r["t"] for r in rows]
        self.cut = {i for i in range(1, len(rows)) if self.t[i] - self.t[i - 1] > 1.5 * STEP}
        self.state = [{n: both(truth(p, r) for p in ps) for n, ps in self.c.conditions.items()} for r in rows]

    def holds(self, i, names):
        return both(self.state[i][n] for n in names) is True

    def runs(self, good, start=0, cut=()):
        """The longest intervals of good rows from ``start`` on that no gap and no further cut divides."""
        out = []
        for i in range(start, len(self.rows)):
            if good(i):
                if out and out[-1][1] == i - 1 and i not in self.cut and i not in cut:
                    out[-1][1] = i
                else:
                    out.append([i, i])
        return out

    def lasting(self, runs, dwell):
        """The first row that ends an interval of at least ``dwell`` inside one of the runs."""
        return min((i for a, b in runs for i in range(a, b + 1) if self.t[i] - self.t[a] >= dwell), default=None)

    def too_wide(self, runs, names, limit, back=None):
        """Rows that make a value's range too wide since the run's start or the last such row, ``back`` at most."""
        out = set()
        for a, b in runs:
            for i in range(a, b + 1):
                older = [j for j in range(a, i + 1) if back is not None and self.t[j] <= self.t[i] - back]
                for n in names:
                    seen = [self.rows[j][n] for j in range(max([a, *older]), i + 1)]
                    if max(seen) - min(seen) > limit:
                        out.add(i)
                if i in out:
                    a = i
        return out

    def phase(self, k, start):
        """Where phase ``k`` is reached if it is looked for from row ``start`` on."""
        name, names, dwell = self.c.phases[k]
        one_of = self.c.alternatives.get(name)
        good = lambda i: self.holds(i, names) and (not one_of or some(self.state[i][n] for n in one_of) is True)
        if self.c.engine == "bulb_screw" and k == 0:
            turning = lambda i: good(i) and self.rows[i]["bulb_yaw_rad"] is not None
            runs = self.runs(turning, start, self.too_wide(self.runs(turning, start), ["bulb_yaw_rad"], math.radians(0.3), 300_000))
        elif name == "settled" and self.c.engine == "sponge":
            fields = ["sponge_pin_z_m", "sponge_centroid_z_m", "sponge_bottom_z_m"]
            lying = lambda i: good(i) and all(self.rows[i][f] is not None for f in [*fields, "plate_base_support_impulse_ns"])
            cuts = self.too_wide(self.runs(lying, start), fields, 0.003)
            weak = {i for a, b in self.runs(lying, start, cuts) for i in range(a, b + 1) if self.t[i] - self.t[a] >= 1_000_000 and self.gain(a, i) < 0.2}
            runs = self.runs(lambda i: lying(i) and i not in weak, start, cuts)
        else:
            runs = self.runs(good, start)
        return self.lasting(runs, int(dwell * 1e6))

    def gain(self, a, i):
        return (self.rows[i]["plate_base_support_impulse_ns"] - self.rows[a]["plate_base_support_impulse_ns"]) / ((self.t[i] - self.t[a]) / 1e6)

    def reached(self):
        """The row at which each phase is reached, one after the other."""
        out = []
        while len(out) < len(self.c.phases):
            i = self.phase(len(out), out[-1] + 1 if out else 0)
            if i is None:
                break
            out.append(i)
        return out

    def seated(self):
        """Engines ram and usb: how far the trial has come at its last row."""
        usb, last = self.c.engine == "usb", len(self.rows) - 1
        near, loaded = self.runs(lambda i: self.holds(i, ["near_bottom"])), ["near_bottom", "stationary", "bottom_load"] + ["current_bottom_support"] * usb
        dwell = [int(d * 1e6) for *_, d in self.c.phases]
        bottomed = set()
        for a, b in near:
            i = self.lasting([r for r in self.runs(lambda i: self.holds(i, loaded)) if a <= r[0] and r[1] <= b], dwell[0])
            bottomed |= set() if i is None else set(range(i, b + 1))
        seats = self.runs(lambda i: self.holds(i, ["near_bottom", "stationary"]) and (i in bottomed or self.holds(i, ["current_bottom_support"])))
        sits = any(b == last and self.t[last] - self.t[a] >= dwell[1] for a, b in seats)
        return 2 if sits and (usb or last in bottomed) else int(last in bottomed)

    def failed(self, reached):
        """A failure that was seen, given when phases were reached."""
        before = lambda i: sum(r < i for r in reached)
        if self.c.engine == "sponge":
            lost = lambda i: self.state[i]["grasp"] is False
            dropped = lambda i: self.state[i]["carry"] is False and some([self.state[i]["placement_zone"], self.state[i]["placement_support"]]) is False
            return any((before(i) in (1, 2) and lost(i)) or (before(i) == 2 and dropped(i)) for i in range(len(self.rows)))
        if self.c.engine == "bulb_unscrew":
            told = [i for i, r in enumerate(self.rows) if r["engaged"] is not None]
            loose = [j for i, j in zip(told, told[1:], strict=False) if self.rows[i]["engaged"] and not self.rows[j]["engaged"]]
            off = lambda j: max([0.0, *(100 / 360 - r["clockwise_turns"] for r in self.rows[: j + 1] if r["engaged"] and r["clockwise_turns"] is not None)])
            return any(before(j) < 3 or off(j) < FREE_TURNS for j in loose)
        return False


def searched(task, rows):
    """(phases completed, failure, success at the end)."""
    trial = Trial(task, rows)
    end = both(trial.state[-1][n] for n in trial.c.terminal) is True
    if trial.c.engine in ("ram", "usb"):
        n = trial.seated()
        return n, False, n == 2 and end
    reached = trial.reached()
    failed = trial.failed(reached)
    return len(reached), failed, len(reached) == len(trial.c.phases) and end and not failed


def recent_support(rows, i):
    """A sponge's mean support over the last quarter second: unknown if the counter was unknown, fell or had a gap, 0 if the time is too short."""
    old = [j for j in range(i + 1) if rows[j]["t"] <= rows[i]["t"] - 250_000]
    window = rows[old[-1] if old else 0 : i + 1]
    counts = [r["plate_base_support_impulse_ns"] for r in window]
    if None in counts or sorted(counts) != counts or any(b["t"] - a["t"] > 1.5 * STEP for a, b in zip(window, window[1:], strict=False)):
        return None
    span = window[-1]["t"] - window[0]["t"]
    return (counts[-1] - counts[0]) / (span / 1e6) if span >= 240_000 else 0.0


def satisfying(specs, rng):
    """Values that make all predicates of a condition true."""
    out = {}
    for p in specs:
        v, at = p["value"], p.get("center", 0)
        good = v if p["op"] in ("is", "eq") else at if p["op"].startswith("abs") else v + 1e-6 if p["op"] in ("gt", "ge") else v - 1e-6 - rng.random() * 1e-7
        if p["field"] in out and p["op"] in ("lt", "le"):
            continue  # both ends of a range: the lower one is inside
        out[p["field"]] = [good / (5 if p.get("reduce") == "sum" else 1)] * p.get("length", 3) if "reduce" in p else good
    return out


def trial(task, rng):
    """Rows that mostly follow the contract's phases in order, with disturbances."""
    c, rows, t, impulse, yaw = CONTRACTS[task], [], 0, 0.0, 0.0
    blank = {f: None for f in c.fields}
    plan = [c.phases[0]] if rng.random() < 0.2 else list(c.phases)
    if c.engine in ("ram", "usb"):
        plan = plan * 2
    for name, names, dwell in plan:
        wanted = [*names, *c.alternatives.get(name, [])[:1]]
        for _ in range(int(dwell * 1e6 / STEP) + rng.choice([1, 2, 4, 24 if c.engine == "sponge" else 3])):
            row = dict(blank)
            for f in c.fields:  # what a phase does not ask for is something else
                specs = [p for ps in c.conditions.values() for p in ps if p["field"] == f]
                row[f] = None if not specs else rng.choice([True, False]) if specs[0]["op"] == "is" else [1.0] * specs[0].get("length", 3) if "reduce" in specs[0] else 0.5
            for n in wanted:
                row.update(satisfying(c.conditions[n], rng))
            if c.engine in ("ram", "usb"):
                row.update(satisfying(c.conditions["near_bottom"], rng), **satisfying(c.conditions["stationary"], rng))
            impulse += rng.choice([0.5, 0.5, 0.0]) * STEP / 1e6
            yaw += rng.choice([0.0, 0.0002, 0.0002, 0.004])
            row |= {"plate_base_support_impulse_ns": impulse, "sponge_pin_z_m": 0.69 + rng.choice([0, 0.001, 0.004 if rng.random() < 0.05 else 0]), "sponge_centroid_z_m": 0.7, "bulb_yaw_rad": yaw}
            if rng.random() < 0.03:
                row[rng.choice(c.fields)] = None
            if c.engine == "sponge" and rng.random() < 0.01:
                impulse = max(0.0, impulse - 0.1)  # a counter that falls
            t += STEP * (1 if rng.random() > 0.01 else 4)
            rows.append({**row, "t": t})
    return rows


@pytest.mark.parametrize("task", ["pick-place", "whiteboard-wipe-horizontal", "install-ram", "usb-insert", "usb-unplug", "bulb-screw", "bulb-unscrew", "sponge-grasp", "poker-draw"])
def test_reviews_equal_a_search(spark, task):
    rng, c = random.Random(task), CONTRACTS[task]
    trials = [trial(task, rng) for _ in range(40)]
    specs = {p["field"]: p for ps in c.conditions.values() for p in ps}
    kind = lambda f: "array<double>" if "reduce" in specs.get(f, {}) else "boolean" if specs.get(f, {}).get("op") == "is" else "double"
    fields = [f for f in sorted({*c.fields, "plate_base_support_impulse_ns", "sponge_pin_z_m", "sponge_centroid_z_m", "bulb_yaw_rad"}) if f != "recent_plate_base_mean_support_force_n"]
    cast = lambda f, v: float(v) if kind(f) == "double" and v is not None else [float(x) for x in v] if kind(f).startswith("array") and v is not None else v
    rows = [(k, i, r["t"], *(cast(f, r.get(f)) for f in fields)) for k, one in enumerate(trials) for i, r in enumerate(one)]
    df = spark.createDataFrame(rows, "k int, i int, t long, " + ", ".join(f"{f} {kind(f)}" for f in fields))
    out = {r.k: r for r in reviews.review(df, ["k"], "t", "i", task, c.digest, fields, F.lit(True), F.lit(True)).collect()}
    if c.engine == "sponge":
        for one in trials:
            for i, r in enumerate(one):
                r["recent_plate_base_mean_support_force_n"] = recent_support(one, i)
    reached = set()
    for k, one in enumerate(trials):
        n, failed, success = searched(task, one)
        assert (out[k].completed, out[k].observed_failure) == (n, failed), (k, out[k])
        assert out[k].status in (("pass" if success else "fail"), "unknown") and (out[k].status == "unknown") == (not out[k].covered)
        reached.add(n)
    assert len(reached) > 1


def test_other_digests_and_undeclared_fields_decide_nothing(spark):
    c = CONTRACTS["usb-unplug"]
    rows = [(1, i, i * STEP, -0.01, 0.0, 2.0, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i int, t long, insertion_depth_m double, socket_contact_count double, right_hand_contact_count double, table_contact_count double")
    ask = lambda digest, fields, ok=True: reviews.review(df, ["k"], "t", "i", "usb-unplug", digest, fields, F.lit(True), F.lit(ok)).first().status
    assert ask(c.digest, c.fields) == "pass" and ask("0" * 64, c.fields) == "unknown"
    assert ask(c.digest, c.fields[1:]) == "unknown" and ask(c.digest, c.fields, False) == "unknown"
    assert len({x.digest for x in CONTRACTS.values()}) == len(CONTRACTS) - 1  # the two flat boards share one


def ask(spark, task, columns, rows, **gates):
    c = CONTRACTS[task]
    df = spark.createDataFrame([(1, i, i * STEP, *r) for i, r in enumerate(rows)], "k int, i int, t long, " + columns)
    fields = [x.split()[0] for x in columns.split(", ")]
    gates = {k: F.lit(v) for k, v in gates.items()}
    return reviews.review(df, ["k"], "t", "i", task, c.digest, fields, F.lit(True), F.lit(True), **gates).first()


def test_values_outside_their_domain_are_unknown(spark):
    dirt = lambda v: ask(spark, "vase-wipe", "dirt_remaining array<double>", [(v,)] * 3).status
    assert [dirt([0.0, 0.05]), dirt([-5.0, 0.05]), dirt([0.0, 1.5]), dirt([0.5, 0.05]), dirt([])] == ["pass", "unknown", "unknown", "fail", "unknown"]
    ram = "insertion_depth_m double, aperture_clearance_xy_m array<double>, orientation_error_rad double, maximum_socket_penetration_m double, linear_speed_m_s double, angular_speed_rad_s double, backstop_load_n double"
    seat = lambda turn, deep: ask(spark, "install-ram", ram, [(0.006, [0.0, 0.0], turn, deep, 0.0, 0.0, 2.0)] * 30).status
    assert [seat(0.001, 0.0), seat(-0.001, 0.0), seat(0.001, -1e-6), seat(0.1, 0.0)] == ["pass", "unknown", "unknown", "fail"]


def test_a_falling_counter_is_unknown_and_a_short_look_back_is_none(spark):
    df = lambda n: spark.createDataFrame([(1, i, i * 100_000, None if x is None else float(x), False) for i, x in enumerate(n)], "k int, i int, t long, n double, gap boolean")
    mean = lambda n, least=None: [(None if r.mean is None else round(r.mean, 6), r.brief) for r in evidence.lookback_mean(df(n), ["k"], "t", "i", "n", "gap", 250_000, 1_000_000, least).orderBy("i").collect()]
    assert mean([5, None, 3, 4]) == [(None, True), (None, False), (None, False), (None, False)]
    assert mean([0, 1, 2, 3, 4]) == [(None, True)] * 3 + [(10.0, False)] * 2
    assert mean([0, 1, 2, 3, 2, 3, 4, 5]) == [(None, True)] * 3 + [(10.0, False)] + [(None, False)] * 3 + [(10.0, False)]
    assert mean([0, 1, 2, 3], 200_000) == [(None, True)] * 2 + [(10.0, False)] * 2


def test_trials_that_are_not_final_or_not_sound_decide_nothing(spark):
    dirt = lambda **g: ask(spark, "vase-wipe", "dirt_remaining array<double>", [([0.0],)] * 3, **g).status
    assert dirt(finalised=True, physics_valid=True, conflicting=False) == "pass"
    for gate in ({"finalised": False}, {"physics_valid": False}, {"conflicting": True}, {"finalised": None}, {"conflicting": None}):
        assert dirt(**gate) == "unknown"


def test_fields_are_derived_from_declared_ones(spark):
    pose = [0.0, 0.0, 0.0, math.cos(0.4), 0.0, 0.0, math.sin(0.4)]
    rows = [(1, [1.0, 0.5, 0.5, 0.25, 0.25], 5.0, 2.0, pose), (2, [1.0, None, 0.5, 0.25, 0.25], 1.0, 2.0, [2 * x for x in pose]), (3, [1.0], None, 2.0, None)]
    df = spark.createDataFrame(rows, "k int, fingertip_normal_force_n array<double>, robot_contact_count double, right_hand_contact_count double, bulb_pose_wxyz array<double>")
    names = ["thumb_normal_force_n", "other_fingers_normal_force_n", "other_robot_contact_count", "bulb_yaw_rad"]
    got = reviews.derived(df, names).orderBy("k").collect()
    assert [[None if x is None else round(x, 9) for x in (r[n] for n in names)] for r in got] == [[1.0, 1.5, 3.0, 0.8], [None] * 4, [None] * 4]
    assert "thumb_normal_force_n" not in reviews.derived(df.drop("fingertip_normal_force_n"), names).columns


def test_coverage_and_intervals_of_conditions(spark):
    c = CONTRACTS["usb-unplug"]
    depth = [-0.01, -0.01, None, -0.01, 0.1, -0.01]
    rows = [(1, i, i * STEP + (10 * STEP if i == 5 else 0), d, 0.0, 2.0, 0.0) for i, d in enumerate(depth)]
    df = spark.createDataFrame(rows, "k int, i int, t long, insertion_depth_m double, socket_contact_count double, right_hand_contact_count double, table_contact_count double")
    args = (df, ["k"], "t", "i", "usb-unplug", c.fields, F.lit(True))
    told = {r.name: (r.samples, r.known, r.positive, round(r.coverage, 4), r.status, r.last) for r in reviews.condition_coverage(*args).collect()}
    assert told == {"fully_clear": (6, 5, 4, 0.8333, "observed", "true"), "hand_held": (6, 6, 6, 1.0, "observed", "true")}
    spans = sorted((r.name, r.start // STEP, r.end // STEP, r.samples) for r in reviews.condition_intervals(*args).collect())
    assert spans == [("fully_clear", 0, 1, 2), ("fully_clear", 3, 3, 1), ("fully_clear", 15, 15, 1), ("hand_held", 0, 4, 5), ("hand_held", 15, 15, 1)]
