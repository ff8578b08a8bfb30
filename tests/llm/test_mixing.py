from collections import defaultdict

from hydrolake.llm import mixing

from .conftest import words_of


def water_level(sizes, weights, share=1.5, most=2.0):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, budget, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if budget * weight[s] / total > most * sizes[s]]
        if not full:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
        budget -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


def test_targets_are_met_and_reruns_agree(spark, awkward, awkward_rows):
    got = [tuple(r) for r in mixing.mix(awkward).select("doc_id", "size", "source_size", "target", "taken", "source").collect()]
    assert sorted(got, key=repr) == sorted([tuple(r) for r in mixing.mix(awkward.repartition(5)).select("doc_id", "size", "source_size", "target", "taken", "source").collect()], key=repr)
    assert sorted((r[0], r[1]) for r in got if r[0] is not None) == sorted((a, len(words_of(b))) for a, b, *_ in awkward_rows if a is not None)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, size, _, _, n, source in got:
        sizes[source] += size
        taken[source] += n
        assert 0 <= n <= 2 * size
    want = water_level(sizes, mixing.WEIGHTS)
    for _, _, source_size, target, _, source in got:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 * max(1, target)
        assert abs(taken[source] - target) <= 0.5 + 1e-6


def test_an_empty_table_and_one_without_words(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_the_schedule_keeps_proportions_all_along(spark):
    goals = spark.createDataFrame([("a", 5000, 5000), ("b", 3000, 3000), ("c", 2000, 2000)], "source string, source_size long, goal long")
    slots = mixing._schedule(goals, 1, 10_000)
    assert {r["source"]: r["n"] for r in slots.groupBy("source").agg({"take": "sum"}).withColumnRenamed("sum(take)", "n").collect()} == {"a": 5000, "b": 3000, "c": 2000}
    x = [(i + 0.5) * mixing.GOLDEN % 1.0 for i in range(10_000)]
    for n in (10, 100, 1000, 10_000):  # discrepancy of the first n points
        assert abs(sum(v < 0.5 for v in x[:n]) - 0.5 * n) <= 3
