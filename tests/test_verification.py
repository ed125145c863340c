"""Verification under budgets: the cases one by one, and random pools against a plain search and the front of everything."""

import random

import pytest
from pyspark.sql import functions as F

from transitlake.operators import verification

VOT = 456.0
POOL = "request string, id string, est_s double, est_fare double, low_s double, low_fare double, tier int, queries array<string>"
BASE = "request string, id string, time_s double, fare double"
REAL = "request string, id string, result string, real_s double, real_fare double"


def cand(cid, time, fare, queries, low=(0, 0), tier=0):
    return (cid, float(time), float(fare), float(low[0]), float(low[1]), tier, list(queries))


class Case:
    """Pools of several requests: name -> (candidates, outcomes, baseline, failing queries)."""

    def __init__(self, spark, cases):
        self.spark = spark
        self.pool = spark.createDataFrame([(r, *c) for r, (cs, _, _, _) in cases.items() for c in cs], POOL)
        self.base = spark.createDataFrame([(r, i, float(t), float(f)) for r, (_, _, b, _) in cases.items() for i, (t, f) in b.items()], BASE)
        real = [(r, i, *(("verified", float(o[0]), float(o[1])) if isinstance(o, tuple) else ("infeasible" if o is None else o, None, None))) for r, (_, out, _, _) in cases.items() for i, o in out.items()]
        self.real = spark.createDataFrame(real, REAL)
        self.bad = spark.createDataFrame([(r, q) for r, (_, _, _, bad) in cases.items() for q in bad], "request string, query string").withColumn("bad", F.lit(True))

    def start(self):
        return verification.Verification.start(self.pool, self.base, VOT)

    def fetch(self, asked):
        return asked.join(self.bad, ["request", "query"], "left").select("request", "query", F.col("bad").isNull().alias("ok"), F.concat(F.lit("answer "), "query").alias("answer"))

    def evaluate(self, asked):
        # Only a candidate's own answers, all of them, come along.
        told = asked.join(self.pool.select("request", "id", F.array_sort(F.array_distinct("queries")).alias("q")), ["request", "id"])
        wrong = F.transform("answers", lambda a: F.concat(F.lit("answer "), a["query"])) != F.transform("answers", lambda a: a["answer"])
        told = told.withColumn("_", F.when((F.transform("answers", lambda a: a["query"]) != F.col("q")) | wrong, F.raise_error(F.lit("other answers"))))
        return told.filter("_ is null").select("request", "id").join(self.real, ["request", "id"])

    def advance(self, search, budget):
        return search.advance(budget, self.fetch, self.evaluate)


def fronts(search):
    out = {}
    for r in search.front().collect():
        out.setdefault(r.request, set()).add((r.time_s, r.fare))
    return out


def order(search):
    out = {}
    for r in sorted(search.paid().collect(), key=lambda r: (r.request, r.n)):
        out.setdefault(r.request, []).append(r.query)
    return out


def status(search):
    out = {}
    for r in search.status().collect():
        out.setdefault(r.request, {})[r.id] = r.status
    return out


CASES = {
    "misjudged": ([cand("promising", 10, 10, ["a"]), cand("misjudged", 1000, 1000, ["b"])], {"promising": (90, 90), "misjudged": (1, 1)}, {"transit": (100, 100)}, ()),
    "shared": ([cand("fast", 10, 200, ["s"]), cand("cheap", 100, 10, ["s"]), cand("same", 10, 200, ["s", "s"])], {"fast": (10, 200), "cheap": (100, 10), "same": (10, 200)}, {}, ()),
    "free": ([cand("free", 100, 100, []), cand("paid", 1, 1, ["q"])], {"free": (20, 5), "paid": (1, 1)}, {}, ()),
    "failed": ([cand("a", 1, 1, ["bad", "unneeded"]), cand("b", 2, 2, ["bad"]), cand("valid", 3, 3, ["good"])], {"valid": (30, 30)}, {}, ("bad",)),
    "unknown": ([cand("unknown", 1, 1, ["a"]), cand("infeasible", 2, 2, ["b"])], {"unknown": "unavailable", "infeasible": None}, {}, ()),
    "bundle": ([cand("a", 1, 1, ["second", "first"]), cand("b", 2, 2, ["other"])], {"a": (10, 10), "b": (20, 5)}, {}, ()),
    "certified": ([cand("certified", 500, 500, ["skip"], (100, 100)), cand("estimate", 500, 500, ["fetch"])], {"estimate": (50, 50)}, {"transit": (100, 100)}, ()),
    "new bound": ([cand("winner", 1, 1, ["q"]), cand("bounded", 2, 2, ["unneeded"], (30, 30))], {"winner": (20, 20)}, {}, ()),
    "slow seed": ([cand("seed", 1, 1, ["seed"]), cand("a", 100, 100, ["a1", "a2"]), cand("b", 200, 200, ["b"])], {"seed": (900, 900), "a": (100, 100), "b": (200, 200)}, {"transit": (1000, 1000)}, ()),
    "fast seed": ([cand("seed", 1, 1, ["seed"]), cand("a", 100, 100, ["a1", "a2"]), cand("b", 200, 200, ["b"])], {"seed": (10, 1), "a": (100, 100), "b": (200, 200)}, {"transit": (1000, 1000)}, ()),
    "tiers": ([cand("near", 500, 500, ["n"]), cand("deferred", 1, 1, ["d"], tier=1)], {"near": (500, 500), "deferred": (10, 10)}, {"transit": (1000, 1000)}, ()),
    "trade": ([cand("seed", 0, 1, ["seed"]), cand("fast", 100, 10000, ["f1", "f2"]), cand("middle", 400, 6000, ["m"]), cand("cheap", 2000, 0, ["c"])], {"seed": (1000, 1000), "fast": (100, 10000), "middle": (400, 6000), "cheap": (2000, 0)}, {"transit": (1000, 1000)}, ()),
    "zero": ([cand("a", 1, 1, ["s"]), cand("b", 1, 1, ["s"]), cand("c", 2, 2, ["unneeded"])], {"a": (0, 0), "b": (0, 0)}, {}, ()),
}


def test_cases_at_budgets(spark, tmp_path):
    case = Case(spark, CASES)
    search = case.advance(case.start(), 0)
    assert fronts(search)["free"] == {(20, 5)} and order(search) == {} and status(search)["free"]["paid"] == "pending"
    case.advance(search, 1)
    got, at = fronts(search), status(search)
    assert got["misjudged"] == {(90, 90)} and at["misjudged"]["misjudged"] == "pending"
    assert got["shared"] == {(10, 200), (100, 10)} and set(at["shared"].values()) == {"verified"}
    assert "failed" not in got and at["failed"] == {"a": "unavailable", "b": "unavailable", "valid": "pending"}
    assert "bundle" not in got and order(search)["bundle"] == ["first"] and at["bundle"] == {"a": "pending", "b": "pending"}
    assert got["new bound"] == {(20, 20)} and at["new bound"]["bounded"] == "pruned" and got["zero"] == {(0, 0)}
    assert order(search)["tiers"] == ["n"] and at["tiers"]["deferred"] == "pending"
    with pytest.raises(ValueError, match="spent"):
        case.advance(search, 0)
    # Stopped, kept in files, and gone on with.
    search.save(str(tmp_path / "state"))
    search = case.advance(verification.Verification.load(spark, str(tmp_path / "state"), VOT), 2)
    assert order(search)["slow seed"] == ["seed", "b"] and order(search)["fast seed"] == ["seed", "a1"] and order(search)["trade"] == ["seed", "m"]
    assert fronts(search)["misjudged"] == {(1, 1)} and fronts(search)["tiers"] == {(10, 10)} and order(search)["bundle"] == ["first", "second"]
    case.advance(search, 9)
    bought, at = order(search), status(search)
    assert bought["failed"] == ["bad", "good"] and fronts(search)["failed"] == {(30, 30)}
    assert bought["unknown"] == ["a", "b"] and at["unknown"] == {"unknown": "unavailable", "infeasible": "infeasible"} and "unknown" not in fronts(search)
    assert bought["bundle"] == ["first", "second", "other"] and bought["shared"] == ["s"] and bought["zero"] == ["s"]
    assert at["zero"] == {"a": "verified", "b": "verified", "c": "pruned"} and len(fronts(search)["zero"]) == 1
    assert bought["certified"] == ["fetch"] and at["certified"]["certified"] == "pruned" and fronts(search)["certified"] == {(50, 50)}


def plain(cands, outcomes, baseline, bad, budget):
    """One request's search by looking at everything in each turn."""
    pool = {c[0]: c for c in cands}
    known, paid, state, current, seeded = dict(baseline), [], {}, None, False
    beats = lambda p, q: p[0] <= q[0] and p[1] <= q[1]

    def front():
        return {p for p in known.values() if not any(q != p and beats(q, p) for q in known.values())}

    while True:
        now = front()
        for cid, c in pool.items():
            if cid in state:
                continue
            if any(beats(p, c[3:5]) for p in now):
                state[cid] = "pruned"
            elif set(c[6]) & set(bad) & set(paid):
                state[cid] = "unavailable"
            elif set(c[6]) <= set(paid):
                state[cid] = "verified" if isinstance(outcomes[cid], tuple) else "infeasible" if outcomes[cid] is None else outcomes[cid]
                if isinstance(outcomes[cid], tuple):
                    known[cid] = outcomes[cid]
        now = front()
        for cid, c in pool.items():
            if state.get(cid) in (None, "unavailable") and any(beats(p, c[3:5]) for p in now):
                state[cid] = "pruned"
        open_ = [c for cid, c in pool.items() if cid not in state]
        if len(paid) >= budget or not open_:
            return known, paid, {cid: state.get(cid, "pending") for cid in pool}, now
        if current is None or current in state:
            first = [c for c in open_ if c[5] == min(x[5] for x in open_)]
            score = lambda c: c[2] + c[1] / 60 * VOT
            if not seeded or not now:
                current, seeded = min(first, key=lambda c: (score(c), c[0]))[0], True
            else:
                best = min(f + t / 60 * VOT for t, f in now)

                def rank(c):
                    n = len(set(c[6]) - set(paid))
                    gain = max(0, best - score(c))
                    gap = max(0, min(max((t - c[1]) / 60 * VOT, f - c[2]) for t, f in now))
                    return (-(gain > 0), -gain / n, -gap / n, score(c), c[0])

                current = min(first, key=rank)[0]
        paid.append(min(q for q in pool[current][6] if q not in paid))


def random_case(seed):
    rng = random.Random(seed)
    base = {"transit": (float(rng.randint(0, 100)), float(rng.randint(0, 100)))} if seed % 5 else {}
    rows, out = [], {}
    for i in range(rng.randint(2, 16)):
        real = (float(rng.randint(0, 100)), float(rng.randint(0, 100)))
        out[f"c{i:02}"] = real if rng.random() > 0.15 else rng.choice([None, "unavailable"])
        low = (rng.randint(0, int(real[0])), rng.randint(0, int(real[1]))) if rng.random() < 0.4 else (0, 0)
        rows.append(cand(f"c{i:02}", rng.randint(0, 200), rng.randint(0, 200), [f"q{rng.randrange(9)}" for _ in range(rng.randrange(4))], low, rng.randrange(2)))
    rng.shuffle(rows)
    return rows, out, base, tuple(f"q{q}" for q in rng.sample(range(9), seed % 3))


def test_random_pools(spark):
    cases = {f"r{seed:03}": random_case(seed) for seed in range(120)}
    case = Case(spark, cases)
    search = case.start()
    for budget in (2, 4, 9):
        case.advance(search, budget)
        got, bought, at = fronts(search), order(search), status(search)
        for name, (rows, out, base, bad) in cases.items():
            known, paid, state, front = plain(rows, out, base, bad, budget)
            assert bought.get(name, []) == paid, (name, budget)
            assert at.get(name, {}) == state and got.get(name, set()) == front
    for name, (rows, out, base, bad) in cases.items():  # nothing is pending: the front of all that can be had
        had = [o for c in rows if isinstance(o := out[c[0]], tuple) and not set(c[6]) & set(bad)] + list(base.values())
        assert got.get(name, set()) == {p for p in had if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in had)}


def test_errors(spark):
    case = Case(spark, {"r": ([cand("a", 20, 20, ["q"], (10, 10))], {"a": (9, 10)}, {}, ())})
    with pytest.raises(Exception, match="certified lower bound"):
        case.advance(case.start(), 1)
    case = Case(spark, {"r": ([cand("a", 1, 1, ["q"])], {"a": (9, 10)}, {"a": (1, 1)}, ())})
    with pytest.raises(ValueError, match="differ"):
        case.start()


def test_nothing(spark):
    case = Case(spark, {"r": ([cand("a", 1, 1, ["q"])], {"a": (9, 10)}, {}, ())})
    case.pool, case.base = case.pool.limit(0), case.base.limit(0)
    search = case.advance(case.start(), 5)
    assert search.front().count() == 0 and search.status().count() == 0


def test_rounds_write_no_candidates(spark, monkeypatch):
    many = [cand(f"c{i:03}", 50 + i, 500 - i, ["a", f"q{i % 5}"]) for i in range(200)]
    case = Case(spark, {"r": (many, {}, {}, ()), "s": (many, {}, {}, ("a",))})
    search, rows = case.start(), []
    for name in ("settled", "bucketed"):
        write = getattr(verification, name, None)
        if write:
            monkeypatch.setattr(verification, name, lambda df, *rest, write=write: (out := write(df, *rest), rows.append(out.count()))[0])
    case.advance(search, 3)
    assert max(rows) <= 80  # two of five queries more for 40 candidates each
    assert "Exchange" not in search._chosen(9)._jdf.queryExecution().executedPlan().toString()
    assert sum(r.status == "unavailable" for r in search.status().collect()) == 280
