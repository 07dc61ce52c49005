"""Mixing overlapping sources to target weights by minimum-cost flow.

1. Documents are aggregated by membership pattern, the set of sources they belong to.
2. The flow network has a node for each pattern and each source: a pattern gives its words up to
   `max_repeats` times, each time at a higher cost (convex), to any of its sources; a source takes
   its quota. Least cost means fresh words first.
3. In each pattern documents are taken in seeded order until its flow is used: every one as often as
   the flow goes round, those at the head of the order once more.

The network has as many nodes as there are patterns and sources, not documents; it is solved on the
driver. Documents stay distributed: seeded order goes through buckets of a digest, so no task holds
a pattern.

Edge cases: null or wordless text has size 0 and is never taken; a null source is a source of its
own, last in order; with no words at all targets and taken words are 0; repeated rows are documents
of their own; reruns agree, as order depends on id, text digest and seed only.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from condensq.llm.common import buckets_for, n_words, stored

def quotas(sizes: dict, weights: dict, max_repeats: int = 3) -> dict[object, float]:
    """Share of all words by weight; above `max_repeats` times a source's size the excess goes to
    the others by weight, until none is above."""
    total = float(sum(sizes.values()))
    capped: dict[object, float] = {}
    while True:
        open_ = {s: weights[s] for s in sizes if s not in capped}
        rest, share = total - sum(capped.values()), sum(open_.values())
        targets = {s: rest * w / share for s, w in open_.items()} if share else {}
        over = [s for s, t in targets.items() if t > max_repeats * sizes[s]]
        if not over:
            return {**targets, **capped}
        capped |= {s: float(max_repeats * sizes[s]) for s in over}


def cheapest_flow(
    capacity: dict[int, int], members: dict[int, list], quota: dict[object, int], max_repeats: int = 3
) -> dict[int, int]:
    """Words taken from each pattern at the least total cost for as much flow as can go.

    The k-th round of a pattern's words costs k per word. Augmenting paths of least cost, found by
    label correction, carry the flow.
    """
    arcs: list[list] = []  # to, left, cost
    leaving: dict[object, list[int]] = defaultdict(list)

    def arc(a: object, b: object, room: int, cost: int) -> None:
        leaving[a].append(len(arcs))
        arcs.append([b, room, cost])
        leaving[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for p, words in capacity.items():
        for k in range(1, max_repeats + 1):
            arc("from", ("p", p), words, k)
        for s in members[p]:
            arc(("p", p), ("s", s), max_repeats * words, 0)
    for s, words in quota.items():
        arc(("s", s), "to", words, 0)
    while True:
        cost, via, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for i in leaving[a]:
                b, room, c = arcs[i]
                if room > 0 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + c, i
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in via:
            break
        path, at = [], "to"
        while at != "from":
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        moved = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= moved
            arcs[i ^ 1][1] += moved
    taken: dict[int, int] = defaultdict(int)
    for i in leaving["from"]:
        if i % 2 == 0:
            taken[arcs[i][0][1]] += arcs[i ^ 1][1]
    return taken


def cyclic_weights(sources: list) -> dict:
    """1, 2, 3, 1, ... by code point, null last."""
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def allocate(
    docs: DataFrame, weights: dict | None = None, max_repeats: int = 3, seed: int = 42
) -> DataFrame:
    """(doc_id, key, size, source_size, target, times, taken): a row for each row of `docs`.

    `docs` has doc_id, text and either `sources` (an array: the document belongs to each) or
    `source`. source_size and target are sums over the document's sources. `weights` by source; one
    it leaves out counts 0, and without it `cyclic_weights` hold. `key` is the seeded digest of id
    and text that orders documents.
    """
    pattern = F.array_sort(F.array_distinct("sources")) if "sources" in docs.columns else F.array("source")
    narrow = stored(
        docs.select(
            "doc_id", pattern.alias("pattern"), n_words(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text", F.lit(seed)).alias("key"),
        ),
        "mix",
    )
    totals = narrow.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: [(x is None, x or "") for x in r["pattern"] or []])
    members = {i: list(r["pattern"] or []) for i, r in enumerate(totals)}
    sizes: dict = defaultdict(int)
    for i, r in enumerate(totals):
        for s in members[i]:
            sizes[s] += r["words"]
    given = cyclic_weights(list(sizes)) if weights is None else {s: weights.get(s, 0) for s in sizes}
    # Sources that overlap hold more words together than there are: quotas share what there is.
    words, held = sum(r["words"] for r in totals), sum(sizes.values())
    target = {s: t * (words / held if held else 0) for s, t in quotas(dict(sizes), given, max_repeats).items()}
    flow = cheapest_flow(
        {i: r["words"] for i, r in enumerate(totals)}, members,
        {s: round(t) for s, t in target.items()}, max_repeats,
    )
    plan = []
    for i, r in enumerate(totals):
        rounds, rest = divmod(flow.get(i, 0), r["words"]) if r["words"] else (0, 0)
        size, quota = sum(sizes[s] for s in members[i]), sum(target.get(s, 0) for s in members[i])
        plan.append((r["pattern"], i, rounds, rest, size, float(quota), buckets_for(r["n"], 2_000)))
    plans = docs.sparkSession.createDataFrame(
        plan, "_p array<string>, _i int, _rounds long, _rest long, source_size long, target double, _parts int"
    )
    keyed = narrow.join(plans, F.col("pattern").eqNullSafe(F.col("_p")))
    keyed = keyed.withColumn("_b", F.pmod(F.shiftrightunsigned("key", 20), F.col("_parts").cast("long")))
    sums = keyed.groupBy(F.col("_i").alias("_oi"), F.col("_b").alias("_ob")).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_oi").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_oi", "_ob", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_i", "_b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_upto", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, (F.col("_i") == F.col("_oi")) & (F.col("_b") == F.col("_ob"))
    )
    # Once more while most of the document lies within the rest of the flow.
    more = (F.col("_before") + F.col("_upto") + F.col("size") / 2) <= F.col("_rest")
    times = F.col("_rounds") + F.when(more & (F.col("_rounds") < max_repeats), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(0).cast("long")
    return run.select(
        "doc_id", "key", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken")
    )


def mixed(
    docs: DataFrame, weights: dict | None = None, max_repeats: int = 3, seed: int = 42
) -> DataFrame:
    """The rows of the mix, with all columns of `docs`: each as often as it is taken.

    Rows of equal id and text are one document here; it comes as often as they are taken together.
    """
    taken = allocate(docs, weights, max_repeats, seed).groupBy("key").agg(F.sum("times").alias("_times"))
    taken = taken.filter("_times > 0").select(F.col("key").alias("_key"), "_times")
    keyed = docs.select(  # one struct, so no name of theirs clashes
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
        F.xxhash64("doc_id", "text", F.lit(seed)).alias("_own"),
    )
    one = keyed.join(taken, F.col("_own") == F.col("_key")).dropDuplicates(["_own"])
    return one.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
