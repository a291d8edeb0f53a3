import random
from collections import Counter

import pyarrow as pa

from graphloom.llm.binpacking import best_fit, cross, evolve, tight_fit
from graphloom.llm.packing import _island, pack_documents, packing_report


def check(sizes, capacity, bins):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)


def test_genetic_steps_keep_packings_whole():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    one, room = [], []
    best_fit(sizes, list(range(300)), one, room, 100)
    check(sizes, 100, one)
    for seed in range(5):
        other, room = [], []
        order = list(range(300))
        random.Random(seed).shuffle(order)
        for i in order:
            best_fit(sizes, [i], other, room, 100)
        check(sizes, 100, other)
        check(sizes, 100, cross(sizes, 100, one, other, rng))
        best = evolve(sizes, 100, [other], seed, 4, 3)
        check(sizes, 100, best)
        assert len(best) <= len(other)


def test_evolution_beats_best_fit_where_the_optimum_is_known():
    rng = random.Random(4)
    triplets, cuts = [], []
    for _ in range(666):  # each bin is exactly three items
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        triplets += [a, b, 1000 - a - b]
        places = [0, *sorted(rng.sample(range(1, 1000), rng.randint(1, 3))), 1000]
        cuts += [y - x for x, y in zip(places, places[1:])]
    for sizes, gap, gain in ((triplets, 8, 90), (cuts, 1, 0)):
        greedy: list = []
        best_fit(sizes, list(range(len(sizes))), greedy, [], 1000)
        best = evolve(sizes, 1000, [], 1, 6, 4)
        check(sizes, 1000, best)
        assert len(best) <= 666 + gap and len(best) <= len(greedy) - gain
    few: list = []
    best_fit(triplets[:60], list(range(60)), few, [], 1000)
    first = len(tight_fit(triplets[:60], 1000, random.Random(1)))
    assert len(evolve(triplets[:60], 1000, [], 1, 60, 8)) <= min(first, len(few))


def test_documents_in_containers(spark):
    rng = random.Random(2)
    docs = [(n, " word" * rng.choice([1, 3, 7, 20, 45, 130])) for n in range(400)] + [(400, None), (401, ""), (402, "x"), (402, "x"), (None, "gone")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    kinds = spark.createDataFrame([("small", 16, "k"), ("big", 64, "k"), ("big", 64, "k"), ("none", 0, "k"), (None, 5, "k")], "container_kind string, capacity_tokens int, bin string")
    packed = pack_documents(df, kinds, shard_items=60)
    rows = packed.collect()
    capacity = {"small": 16, "big": 64}
    for kind in capacity:
        own = [r for r in rows if r["container_kind"] == kind]
        used = Counter()
        for r in own:
            used[r["container_id"]] += r["tokens"]
        assert max(used.values()) <= capacity[kind]
        for doc, text in docs[:400]:
            parts = sorted((r["part"], r["tokens"]) for r in own if r["doc_id"] == doc)
            total = text.count("word")
            assert sum(t for _, t in parts) == total and [p for p, _ in parts] == list(range(len(parts)))
            assert len(parts) == 1 or total > capacity[kind] and all(t == capacity[kind] for _, t in parts[:-1])
        assert {r["tokens"] for r in own if r["doc_id"] in (400, 401)} == {0} and sum(r["doc_id"] == 402 for r in own) == 2
    report = {r["container_kind"]: r for r in packing_report(packed, kinds.filter("capacity_tokens > 0")).collect()}
    sizes = [n % 64 for n in (t.count("word") for _, t in docs[:400]) if n % 64] + [1, 1]
    bins = []
    best_fit(sizes, list(range(len(sizes))), bins, [], 64)
    full = sum(t.count("word") // 64 for _, t in docs[:400])
    assert report["big"]["n_containers"] <= 1.02 * (len(bins) + full) and report["small"]["n_containers"] >= report["small"]["least_possible"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("small", 4)], "container_kind string, capacity_tokens int")
    assert pack_documents(docs.limit(0), kinds).count() == 0 and pack_documents(docs, kinds.limit(0)).count() == 0


def test_an_island_takes_and_gives_arrow_tables():
    rng = random.Random(5)
    tokens = [rng.randint(1, 90) for _ in range(50)]
    rows = [{"container_kind": "k", "capacity": 100, "shard": 3, "home": 1, "island": i, "item_id": 7 * n, "doc_id": n, "part": 0, "tokens": t, "bin": n} for n, t in enumerate(tokens) for i in (0, 1)]
    rng.shuffle(rows)
    out = _island(3, 4)(pa.Table.from_pylist(rows)).to_pylist()
    assert [(r["item_id"], r["doc_id"], r["tokens"], r["island"]) for r in out] == [(7 * n, n, t, 1) for n, t in enumerate(tokens)]
    used = Counter()
    for r in out:
        used[r["bin"]] += r["tokens"]
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used))) and len(used) < 50
