import random
from collections import Counter, defaultdict

from hydrolake.llm import graph, near_duplicates

from .conftest import words_of

SF = "/root/testdata/sf0.01"


def by_hand(rows):
    """(doc_id, class_id, n_links, n_shingles) of each row, by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, least.get(find(i)), links[i], len(sets[i])) for i, (doc, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r)[:4] for r in near_duplicates.joined(df).collect()), key=repr)


def test_all_links_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows_and_large_groups(spark, awkward, awkward_rows, nothing, monkeypatch):
    rows = [(a, b) for a, b, *_ in awkward_rows]
    want = by_hand(rows)
    assert found(awkward) == want
    # the group path: nodes above 3 classes, blocks of 4
    monkeypatch.setattr(near_duplicates, "SMALL", 3)
    monkeypatch.setattr(near_duplicates, "GROUP_BLOCK", 4)
    monkeypatch.setattr(near_duplicates, "COLUMNS", 16)
    assert found(awkward) == want
    assert found(nothing) == []


def test_one_of_each_class_stays(awkward, awkward_rows, nothing):
    kept = near_duplicates.deduplicated(awkward).collect()
    want = by_hand([(a, b) for a, b, *_ in awkward_rows])
    classes = {c for _, c, _, n in want if n}
    assert Counter(r["doc_id"] for r in kept if words_of(r["text"])) == Counter(classes)
    assert Counter((r["doc_id"], r["text"]) for r in kept if not words_of(r["text"])) == Counter((a, b) for a, b, *_ in awkward_rows if not words_of(b))
    assert near_duplicates.deduplicated(nothing).count() == 0


def test_the_prefix_shortens_until_the_recall_is_met():
    d = near_duplicates.matched_depth()
    recall = lambda d: 1 - (1 - 0.8**d) ** near_duplicates.TREES
    assert recall(d) >= near_duplicates.TARGET > recall(d + 1)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    edges = chain + star + [(5, 5), (300, 299), (299, 300)]
    rng.shuffle(edges)
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(200, 260)]}, 299: 299, 300: 299}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
