"""The llm operators against brute force and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from branchloom.llm import queries as q
from branchloom.llm.components import connected_components, local_forest
from branchloom.llm.mixing import allocate, budget_tree, choose_borders, largest_even_total, leaf_budgets, mix
from branchloom.llm.packing import DIMENSIONS, hilbert_key, pack, sized_on_curve
from branchloom.llm.tokens import count_tokens
from branchloom.llm.topn import top_n
from branchloom.llm.truncation import find_truncated

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- groups ----------------------------------------------------------------


def brute_groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def random_edges(seed, n, nodes):
    r = random.Random(seed)
    return [(r.choice([None, *[f"n{i:03}" for i in range(nodes)]]), f"n{r.randrange(nodes):03}") for _ in range(n)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]


@pytest.mark.parametrize("kw", [{}, {"edges_per_task": 40}, {"edges_per_task": 15, "hot_rows": 15}])
def test_components(spark, kw):
    edges = random_edges(1, 120, 150)
    df = spark.createDataFrame(edges, "root string, node string").repartition(5)
    got = {r.node: r.root for r in connected_components(df, "root", "node", **kw).collect()}
    assert got == brute_groups(edges)


def test_components_merge_in_falling_levels(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(900):04}", f"n{r.randrange(900):04}") for _ in range(700)] + [("hub", f"n{i:04}") for i in range(0, 400, 9)] + [("zz", f"s{i:03}") for i in range(60)]
    trace = []
    df = spark.createDataFrame(edges, "a string, b string").repartition(8)
    got = {x.node: x.root for x in connected_components(df, "a", "b", edges_per_task=20, hot_rows=50, trace=trace).collect()}
    assert got == brute_groups(edges)
    sizes = [n for n, _ in trace]
    assert len(trace) >= 3 and sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes), trace
    assert all(n / parts <= 20 for n, parts in trace)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    assert connected_components(spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string"), "a", "b").count() == 0


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(f"{i + 1:04}", f"{i:04}") for i in range(300)], "node string, root string").repartition(4)
    groups = connected_components(df, "node", "root", edges_per_task=60).collect()
    assert len(groups) == 301 and {r.root for r in groups} == {"0000"}


def test_local_forest_spans():
    a, b = pa.chunked_array([["b", "d", "b"], ["z"]]), pa.chunked_array([["a", "c", "c"], ["y"]])
    node, root = local_forest(a, b)
    assert dict(zip(node.to_pylist(), root.to_pylist())) == {"b": "a", "c": "a", "d": "a", "z": "y"}


def test_p3_against_brute_force(spark):
    clean = lambda x: None if x is None or x.strip(" \t").lower() in ("", ".", "na") else x.strip(" \t").lower()
    m = spark.read.parquet(f"{SF}/segment_matches.parquet").collect()
    h = spark.read.parquet(f"{SF}/segment_homology.parquet").collect()
    edges = [(clean(r.query_occurrence_id), clean(r.subject_occurrence_id)) for r in m if clean(r.match_status) == "mapped"]
    by = {}
    for r in h:
        if clean(r.homology_id) and clean(r.occurrence_id):
            edges.append((by.setdefault(clean(r.homology_id), clean(r.occurrence_id)), clean(r.occurrence_id)))
    want = brute_groups(edges)
    assert {r.occurrence_id: r.group_id for r in q.p3_found(spark, SF).collect()} == want


# --- top N -----------------------------------------------------------------


@pytest.mark.parametrize("kw", [{}, {"heavy_share": 0.2, "light_rows": 6, "ranges": 3, "parts": 2}])
def test_top_n(spark, kw):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([0.5, 0.5, 0.7, -0.0, 0.0, None, float("nan")]), f"i{r.randrange(30):02}") for _ in range(120)]
    rows += rows[:30] + [("a", 0.9, None)]
    best = {}
    for g, s, i in set(x for x in rows if x[1] == x[1]):
        if g is not None and s is not None and i is not None:
            best.setdefault(g, set()).add((-(s + 0.0), i))
    want = sorted((g, i, n) for g, x in best.items() for n, (_, i) in enumerate(sorted(x)[:3], 1))
    df = spark.createDataFrame(rows, "g string, s double, i string").withColumn("rank", F.lit(1))
    got = sorted((x.g, x.i, x["rank"]) for x in top_n(df, "g", "s", "i", 3, **kw).collect())
    assert got == want
    assert top_n(df.limit(0), "g", "s", "i", 3, **kw).count() == 0


def test_p5_sends_its_largest_query_through_the_salted_sort(spark):
    plan = q.p5_found(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "_part" in plan


# --- containers ------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_key((grid + 0.5) / (1 << bits), bits)
    assert sorted(key) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pack_keeps_every_token(spark):
    r = random.Random(5)
    items = [(i, r.choice([0, 1, 7, 100, 300, 512, 513, 5000]), r.randrange(1000)) for i in range(600)]
    df = spark.createDataFrame(items, "item bigint, n_tokens int, place bigint").repartition(3)
    rows = pack(df, {"small": 512, "large": 2048}, items_per_task=150).collect()
    for kind, cap in (("small", 512), ("large", 2048)):
        mine = [x for x in rows if x.container == kind]
        used = {}
        for x in mine:
            if x.container_no is not None:
                used[x.container_no] = used.get(x.container_no, 0) + x.n_tokens
        assert max(used.values()) <= cap
        for i, n, _ in items:
            pieces = sorted((x.token_start, x.n_tokens) for x in mine if x.item == i)
            assert sum(n for _, n in pieces) == n and pieces[0][0] == 0
            assert all(s + n == t for (s, n), (t, _) in zip(pieces, pieces[1:]))
            assert len(pieces) == 1 or n > cap
        assert sum(used.values()) / (len(used) * cap) > 0.9
    assert pack(df.limit(0), {"small": 512}).count() == 0 and pack(df, {}).count() == 0


def test_sizes_and_places(spark):
    texts = [None, "", "a", "word " * 500, "acgt" * 5000, "grün ☃ <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "place bigint, text string")
    got = {r.item: r for r in sized_on_curve(df, "place", "text").collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == count_tokens(texts, TOKENIZER)
    assert all(0 <= r.place < 1 << 10 * DIMENSIONS for r in got.values())


def test_p7_fills_containers(spark):
    fill = {r.container: r.fill_share for r in q.p7_fill(spark, "/root/testdata/sf0.01").collect()}
    assert min(fill.values()) > 0.97, fill


def test_containers_hold_neighbours(spark):
    r = random.Random(11)
    items = [(i, r.randrange(20, 400), r.randrange(10**9)) for i in range(4000)]
    rank = {item: n for n, (item, _, _) in enumerate(sorted(items, key=lambda x: (x[2], x[0])))}
    held = {}
    for x in pack(spark.createDataFrame(items, "item bigint, n_tokens int, place bigint"), {"large": 4096}).collect():
        held.setdefault(x.container_no, []).append(rank[x.item])
    assert np.mean([np.std(x) for x in held.values()]) / len(items) < 0.289 / 3


# --- mixture ---------------------------------------------------------------


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [(("x", "en", "a"), 0.3, 10.0), (("x", "en", "b"), 0.3, 1000.0), (("y", "en", "c"), 0.4, 1000.0)]
    t = budget_tree(leaves)
    allocate(t, 100.0)
    assert {k[-1]: round(v, 6) for k, v in leaf_budgets(t).items()} == {"a": 10.0, "b": 50.0, "c": 40.0}
    t = budget_tree([(p, w, c if p[-1] != "b" else 20.0) for p, w, c in leaves])
    allocate(t, 100.0)
    assert {k[-1]: round(v, 6) for k, v in leaf_budgets(t).items()} == {"a": 10.0, "b": 20.0, "c": 70.0}
    assert round(largest_even_total(leaves), 6) == round(10 / 0.3, 6)


@pytest.mark.parametrize("bucket_items", [50_000, 5])
def test_mixture(spark, bucket_items):
    r = random.Random(9)
    rows = [(i, r.choice(["a", "a", "a", "b", None, "odd"]), r.choice(["en", "de", None, "??"]), r.choice([0, 1, 5, 9])) for i in range(900)] + [(1000 + i, "c", "en", 3) for i in range(12)]
    df = spark.createDataFrame(rows, "item bigint, source string, language string, n_tokens int").repartition(3)
    m = mix(df, [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.1, 4), ("none", 0.1, 2), (None, 0.2, 1)], {"a": "x", "b": "x", "c": "y", "none": "y"}, bucket_items=bucket_items)
    uses = m.rows.collect()
    assert all(sum(1 for x in uses if x.item == i) <= 4 for i in {x.item for x in uses if x.source == "c"})
    assert len({(x.item, x.epoch) for x in uses}) == len(uses) and all(x.epoch == 0 for x in uses if x.source in "ab")
    shares = {x.source: x for x in m.shares.collect()}
    assert shares["none"].used_tokens == 0 and shares["odd"].used_tokens == 0 and shares["odd"].available_tokens > 0
    total = sum(x.n_tokens for x in uses)
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(x.n_tokens for x in uses if x.source == s) / total - want) < 0.05
        assert abs(shares[s].used_tokens - shares[s].budget_tokens) <= 5
    again = mix(df.repartition(7), [("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.1, 4), ("none", 0.1, 2)], {"a": "x", "b": "x", "c": "y", "none": "y"}, bucket_items=bucket_items)
    assert sorted(map(str, again.rows.collect())) == sorted(map(str, uses))


def test_border_items_are_chosen_for_the_source():
    assert choose_borders([(90.0, 50, 100.0), (80.0, 31, 100.0)]) == [False, True]
    assert choose_borders([(0.0, 10, 1.0)]) == [False] and choose_borders([]) == []
    many = [(0.0, 10, 6.0)] * 20
    assert sum(choose_borders(many)) == 12


def test_large_mixture_moves_shortages_to_siblings_first(spark):
    rows = {r.source: r for r in q.p8_large_shares(spark, "/root/testdata/sf0.01").collect()}
    total = sum(r.budget_tokens for r in rows.values())
    short = [r for r in rows.values() if r.target_share and r.budget_tokens < r.target_share * total * 0.999]
    assert short and all(r.budget_tokens >= 0.999 * r.available_tokens * r.max_repeats for r in short)
    assert all(r.epochs <= r.max_repeats for r in rows.values())
    assert len({r.domain for r in rows.values() if r.target_share}) == 2


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "item bigint, source string, language string, n_tokens int")
    m = mix(df, [("a", 1.0, 1)], {})
    assert m.rows.count() == 0 and [(x.source, x.used_tokens) for x in m.shares.collect()] == [("a", 0)]
    assert mix(df, [], {}).rows.count() == 0


# --- texts cut off ---------------------------------------------------------


def cut_corpus():
    r = random.Random(2)
    subjects = ["the first reader", "every copy", "this long intron", "the second panel", "our newest table"]
    verbs = ["confirms the older call", "shows the same boundary", "keeps the conserved exon", "moves by three bases"]
    tails = ["in most of the species", "because coverage was low", "after the filter was set", "on the reverse strand"]
    docs, cut = [], set()
    for i in range(1500):
        t = " ".join(f"{r.choice(subjects).capitalize()} {r.choice(verbs)} {r.choice(tails)}." for _ in range(r.randrange(3, 9)))
        if i % 15 == 0:
            last = t.rfind(".", 0, -1)
            t = t[: r.randrange(last + 8, len(t) - 3)].rstrip() + r.choice(["", "", "", "...", " [cut]", "�"])
            cut.add(i)
        docs.append((i, t, "notes"))
    docs += [(2000, None, "notes"), (2001, "", "notes"), (2002, " \n", None), (2003, "n/a", "notes"), (2004, "", "other")]
    return docs, cut


def test_truncation(spark):
    docs, cut = cut_corpus()
    df = spark.createDataFrame(docs, "reason int, text string, source string")
    t = find_truncated(df, "reason", "text", "source")
    rows = t.documents.collect()
    assert sorted(r.item for r in rows) == sorted(d[0] for d in docs)
    found = {r.item for r in rows if r.truncated}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 2
    assert {r.source: (r.n_texts, r.n_truncated) for r in t.sources.collect()} == {"notes": (1503, len(found)), "": (1, 0), "other": (1, 0)}


def test_copies_of_one_text_cut_no_others(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    line = lambda: " ".join(r.choice(words) for _ in range(6)) + "."
    docs = [(i, f"{line()} {line()} {line()}", "notes") for i in range(1000)]
    whole = {2000 + i for i in range(10)}
    docs += [(i, f"{line()} {line()} so we rest here.", "notes") for i in whole]
    docs += [(3000 + i, f"{line()} so we rest here. {line()}", "notes") for i in range(505)]
    copied = docs[-1][1]
    docs[-505:] = [(i, copied, source) for i, _, source in docs[-505:]]
    df = spark.createDataFrame(docs, "item int, text string, source string")
    found = {x.item for x in find_truncated(df, "item", "text", "source").documents.filter("truncated").collect()}
    assert not found & whole


def test_truncation_of_tiny_tables(spark):
    empty = spark.createDataFrame([], "doc int, text string, source string")
    assert find_truncated(empty, "doc", "text", "source").documents.count() == 0
    few = spark.createDataFrame([(1, "One whole text.", "a"), (2, "cut off he...", "a"), (3, "x" * 200_000, "b")], "doc int, text string, source string")
    assert {r.item: r.truncated for r in find_truncated(few, "doc", "text", "source").documents.collect()} == {1: False, 2: True, 3: False}
