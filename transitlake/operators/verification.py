"""Verification of candidates under a budget of paid answers, for all requests at once, in rounds of one answer each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.operators import skyline
from transitlake.plans.storage import bucketed, settled

#: fetch: (request, query) to (request, query, ok, answer); evaluate: (request, id, answers) to (request, id, result, real_s, real_fare).
Fetch = Callable[[DataFrame], DataFrame]
Evaluate = Callable[[DataFrame], DataFrame]
_PARTS = ("pool", "done", "requests", "baseline")
_BOUGHT = "array<struct<n:int,query:string,ok:boolean,answer:string>>"
#: Candidates of a bucket, and the fewest for which there is more than one.
_BUCKET, _FEW = 250_000, 2_000
_FRONT = "array<struct<time_s:double,fare:double>>"


def _dominated(front: Column, time: Column, fare: Column) -> Column:
    return F.exists(front, lambda p: (p["time_s"] <= time) & (p["fare"] <= fare))


class Verification:
    """A search that can be stopped at any budget and gone on with; its state lies in shared files.

    candidates(request, id, est_s, est_fare, low_s, low_fare, tier, queries array<string>); baseline(request, id, time_s,
    fare), costs known for nothing. Estimates only say what is asked first. A candidate whose lower bound the front
    of known costs reaches in time and fare is pruned for good; so when none is pending, the front is that of all
    candidates. Answers are bought once a request and shared by its candidates; a failed one is paid too and makes
    those that need it unavailable. evaluate gets candidates all of whose answers are there, and nothing else, and
    says verified, infeasible or unavailable; a cost under the lower bound is an error.

    In each round each request with budget left buys one answer: of the candidate it is in the midst of, or else of the
    one that comes first: by tier; then, once the front has a point and a first choice was made, by whether the estimate
    improves on the best generalised cost, the improvement for each answer still to buy, and by how much it is off being
    dominated, for each answer; then by estimate, at per_minute won, and id. A request's first choice is by estimate.
    Answers of a candidate are bought in the order of their names. The budget has no say in the order.
    Candidates are written once, in buckets of requests, and never change; every request has one row of state, in
    buckets alike: what it bought and its front, of which what has become of a candidate follows. So a round shuffles and
    writes rows of requests and not of candidates, but for those that are evaluated, each once. Choices are minima, so a
    request may hold any share of all candidates; only its front and what it bought are one value. evaluate gets
    est_s, est_fare, low_s and low_fare with the answers.
    """

    def __init__(self, spark: SparkSession, parts: dict[str, DataFrame], per_minute: float, buckets: int):
        self.spark, self.parts, self.per_minute, self.buckets = spark, parts, per_minute, buckets

    @classmethod
    def start(cls, candidates: DataFrame, baseline: DataFrame, per_minute: float) -> Verification:
        if not per_minute > 0:
            raise ValueError("per_minute must be positive")
        queries = F.array_sort(F.array_distinct(F.filter(F.coalesce("queries", F.array().cast("array<string>")), lambda q: q.isNotNull())))
        costs = [F.col(c).cast("double").alias(c) for c in ("est_s", "est_fare", "low_s", "low_fare")]
        n = max(1, min(candidates.sparkSession.sparkContext.defaultParallelism, candidates.count() // _FEW), candidates.count() // _BUCKET)
        pool = bucketed(candidates.select("request", "id", *costs, F.coalesce(F.col("tier"), F.lit(0)).alias("tier"), queries.alias("queries")), "request", "pool", n)
        known = settled(baseline.select("request", "id", F.col("time_s").cast("double").alias("time_s"), F.col("fare").cast("double").alias("fare")), "baseline")
        if not pool.select("request", "id").unionByName(known.select("request", "id")).groupBy("request", "id").count().filter("count > 1").isEmpty():
            raise ValueError("the ids of a request's candidates and baselines must differ")
        requests = pool.select("request").distinct().unionByName(known.select("request").distinct()).distinct()
        kind = pool.schema["request"].dataType.simpleString(), pool.schema["id"].dataType.simpleString()
        state = requests.select("request", F.lit(0).alias("spent"), F.lit(-1).alias("seen"), F.lit(False).alias("seeded"), F.lit(None).cast(kind[1]).alias("current"), F.array().cast(_FRONT).alias("front"), F.array().cast(_BOUGHT).alias("bought"))
        done = settled(pool.sparkSession.createDataFrame([], f"request {kind[0]}, id {kind[1]}, status string, real_s double, real_fare double"), "none")
        state = bucketed(cls._with_front(state, known.select("request", "time_s", "fare")), "request", "requests", n)
        return cls(pool.sparkSession, {"pool": pool, "done": done, "requests": state, "baseline": known}, per_minute, n)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, per_minute: float) -> Verification:
        parts = {name: spark.read.parquet(f"{folder}/{name}") for name in _PARTS}
        n = max(1, min(spark.sparkContext.defaultParallelism, parts["pool"].count() // _FEW), parts["pool"].count() // _BUCKET)
        return cls(spark, parts | {name: bucketed(parts[name], "request", name, n) for name in ("pool", "requests")}, per_minute, n)

    def save(self, folder: str) -> None:
        for name in _PARTS:
            self.parts[name].write.parquet(f"{folder}/{name}")

    @staticmethod
    def _with_front(requests: DataFrame, found: DataFrame) -> DataFrame:
        """requests with fronts that found(request, time_s, fare) are taken into; only those that found anything are worked on."""
        old = requests.join(found.select("request").distinct(), "request", "left_semi").select("request", F.explode("front").alias("p")).select("request", "p.time_s", "p.fare")
        new = skyline.front(old.unionByName(found).withColumn("_t", F.lit(0)), ["request"], "time_s", "fare", "_t")
        listed = new.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("time_s", "fare"))).alias("new"))
        return requests.join(listed.hint("merge"), "request", "left").withColumn("front", F.coalesce("new", "front")).drop("new")

    def _met(self, requests: DataFrame) -> DataFrame:
        """The candidates of requests with their state: unpaid queries, failed, out if the front reaches their lower bound, and n of the last answer of theirs."""
        met = self.parts["pool"].hint("merge").join(requests.hint("merge"), "request")
        mine = F.filter("bought", lambda x: F.array_contains("queries", x["query"]))
        met = met.withColumn("mine", mine).withColumn("unpaid", F.array_except("queries", F.transform("mine", lambda x: x["query"])))
        out = F.coalesce(_dominated(F.col("front"), F.col("low_s"), F.col("low_fare")), F.lit(False))
        return met.withColumns({"failed": F.exists("mine", lambda x: ~x["ok"]), "out": out, "last": F.coalesce(F.array_max(F.transform("mine", lambda x: x["n"])), F.lit(0))})

    def _settle(self, evaluate: Evaluate) -> None:
        """Evaluates the candidates whose last answer has come and takes their costs into the fronts."""
        met = self._met(self.parts["requests"].filter("seen < spent"))
        ready = met.filter(~F.col("out") & ~F.col("failed") & (F.size("unpaid") == 0) & (F.col("last") > F.col("seen")))
        answers = F.array_sort(F.transform("mine", lambda x: F.struct(x["query"].alias("query"), x["answer"].alias("answer"))))
        ready = settled(ready.select("request", "id", answers.alias("answers"), "est_s", "est_fare", "low_s", "low_fare"), "ready")
        seen = self.parts["requests"].withColumn("seen", F.col("spent"))
        if not ready.isEmpty():
            result = evaluate(ready).select("request", "id", "result", F.col("real_s").cast("double").alias("real_s"), F.col("real_fare").cast("double").alias("real_fare"))
            judged = ready.select("request", "id", "low_s", "low_fare").join(result, ["request", "id"], "left")
            ok = F.col("result") == "verified"
            wrong = ok & ~((F.col("real_s") >= F.col("low_s")) & (F.col("real_fare") >= F.col("low_fare")))
            status = F.when(wrong, F.raise_error(F.lit("a verified cost is under its certified lower bound"))).otherwise(F.coalesce("result", F.lit("unavailable")))
            judged = settled(judged.select("request", "id", status.alias("status"), F.when(ok, F.col("real_s")).alias("real_s"), F.when(ok, F.col("real_fare")).alias("real_fare")), "judged")
            seen = self._with_front(seen, judged.filter("status = 'verified'").select("request", F.col("real_s").alias("time_s"), F.col("real_fare").alias("fare")))
            self.parts["done"] = self.parts["done"].unionByName(judged)
        self.parts["requests"] = bucketed(seen, "request", "requests", self.buckets)

    def _chosen(self, budget: int) -> DataFrame:
        """request, id, query of the answer to buy next, ranked if the request made a new choice."""
        # The last answer may have proved others beside the point without one more.
        met = self._met(self.parts["requests"].filter(F.col("spent") < budget)).filter(~F.col("out") & ~F.col("failed") & (F.size("unpaid") > 0))
        score = F.col("est_fare") + F.col("est_s") / 60 * self.per_minute
        best = F.array_min(F.transform("front", lambda p: p["fare"] + p["time_s"] / 60 * self.per_minute))
        gain = F.greatest(F.lit(0.0), best - score)
        off = F.array_min(F.transform("front", lambda p: F.greatest((p["time_s"] - F.col("est_s")) / 60 * self.per_minute, p["fare"] - F.col("est_fare"))))
        gap = F.greatest(F.lit(0.0), off)
        plain = ~F.col("seeded") | (F.size("front") == 0)
        by = lambda c: F.when(plain, F.lit(0.0)).otherwise(-c)
        n = F.size("unpaid")
        mine = F.coalesce(F.col("id") == F.col("current"), F.lit(False))
        order = F.struct((~mine).alias("new"), "tier", by((gain > 0).cast("double")).alias("a"), by(gain / n).alias("b"), by(gap / n).alias("c"), score.alias("score"), "id", F.col("unpaid")[0].alias("query"))
        return met.groupBy("request").agg(F.min(order).alias("o")).select("request", "o.id", "o.query", F.col("o.new").alias("ranked"))

    def advance(self, budget: int, fetch: Fetch, evaluate: Evaluate) -> Verification:
        """Buys answers until each request has paid for budget in all, or has no candidate pending."""
        if not self.parts["requests"].filter(F.col("spent") > budget).isEmpty():
            raise ValueError("a budget can't take back what is spent")
        while True:
            self._settle(evaluate)
            chosen = settled(self._chosen(budget), "chosen")
            if chosen.isEmpty():
                break
            bought = settled(fetch(chosen.select("request", "query")).select("request", "query", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("answer").cast("string").alias("answer")), "bought")
            took = chosen.select("request", F.col("id").alias("_id"), "ranked").join(bought, "request", "left")
            moved = self.parts["requests"].join(took.hint("merge"), "request", "left")
            answer = F.array(F.struct((F.col("spent") + 1).alias("n"), "query", "ok", "answer"))
            spent = (F.col("spent") + F.col("_id").isNotNull().cast("int")).alias("spent")
            now = moved.select("request", spent, "seen", (F.col("seeded") | F.coalesce("ranked", F.lit(False))).alias("seeded"), F.coalesce("_id", "current").alias("current"), "front", F.when(F.col("query").isNull(), F.col("bought")).otherwise(F.concat("bought", answer)).alias("bought"))
            self.parts["requests"] = bucketed(now, "request", "requests", self.buckets)
        self.parts["done"] = settled(self.parts["done"], "done")
        return self

    def status(self) -> DataFrame:
        """request, id, status, real_s, real_fare: pending, pruned, unavailable, infeasible or verified. An unavailable one that the front rules out is pruned."""
        met = self._met(self.parts["requests"])
        complete = ~F.col("failed") & (F.size("unpaid") == 0)
        none = F.lit(None).cast("double")
        left = met.filter(~complete).select("request", "id", F.when(F.col("out"), "pruned").when(F.col("failed"), "unavailable").otherwise("pending").alias("status"), none.alias("real_s"), none.alias("real_fare"))
        # Of those with all their answers, the ones that were not evaluated had been pruned.
        had = met.filter(complete).select("request", "id", "out", F.col("last") > F.col("seen")).toDF("request", "id", "out", "new").join(self.parts["done"], ["request", "id"], "left")
        told = F.when(F.col("status").isNull(), F.when(F.col("out") | ~F.col("new"), "pruned").otherwise("pending")).when((F.col("status") == "unavailable") & F.col("out"), "pruned").otherwise(F.col("status"))
        return left.unionByName(had.select("request", "id", told.alias("status"), "real_s", "real_fare"))

    def front(self) -> DataFrame:
        """request, id, time_s, fare: the front of all known costs, one row for each cost, the least id of those that have it."""
        found = self.parts["done"].filter("status = 'verified'").select("request", "id", F.col("real_s").alias("time_s"), F.col("real_fare").alias("fare"))
        return skyline.front(self.parts["baseline"].unionByName(found), ["request"], "time_s", "fare", "id").select("request", "id", "time_s", "fare")

    def paid(self) -> DataFrame:
        """request, n, query, ok: what was bought, in order."""
        return self.parts["requests"].select("request", F.explode("bought").alias("b")).select("request", "b.n", "b.query", "b.ok")
