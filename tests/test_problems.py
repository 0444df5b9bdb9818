"""The four general data problems against brute force on small and on given tables."""

import json
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from branchloom.operators.hierarchy import descendants, resolve_hierarchy
from branchloom.operators.intervals import merge_intervals
from branchloom.operators.nested import SPAN, TEXT, ValueArray, flatten, top_keys, whole_json
from branchloom.operators.references import bloom_filter, may_contain, orphan_references

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


# --- references ------------------------------------------------------------


def orphans(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, "ref_id string, at timestamp_ntz, no int, since int")
    p = spark.createDataFrame(parents, "parent_id string, since timestamp_ntz, until timestamp_ntz, at string")
    return sorted(x.no for x in orphan_references(r, p, ["no"], **kw).collect())


def brute_orphans(refs, parents):
    ok = lambda i, t: any(p == i and s is not None and t is not None and s <= t and (u is None or u > t) for p, s, u, _ in parents)
    return sorted(n for i, t, n, _ in refs if i is not None and not ok(i, t))


def day(x):
    return None if x is None else T0 + timedelta(days=x)


@pytest.mark.parametrize("kw", [{}, {"max_bytes": 0}, {"hot_rows": 5, "salts": 3}])
def test_orphans(spark, kw):
    refs = [(i, day(t), n, 0) for n, (i, t) in enumerate([("a", 5), ("a", 1), ("b", 5), ("gone", 5), (None, 5), ("a", None), ("b", 9), ("b", 3), *[("h", x % 7) for x in range(40)], ("a", 5)])]
    parents = [("a", day(2), None, "x"), ("a", day(2), None, "x"), ("b", day(3), day(6), "x"), ("b", day(8), day(9), "x"), (None, day(0), None, "x"), ("n", None, None, "x"), ("h", day(1), day(2), "x"), ("h", day(4), day(6), "x"), ("h", day(0), day(1), "x")]
    assert orphans(spark, refs, parents, **kw) == brute_orphans(refs, parents)


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], []) == []
    assert orphans(spark, [("a", day(1), 1, 0)], []) == [1]
    assert orphans(spark, [], [("a", day(1), None, "x")]) == []


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    b = bloom_filter(keys, "k")
    tested = may_contain(spark.range(40_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("k")), "k", b, "hit")
    inside, outside = tested.filter("id < 20000 AND hit").count(), tested.filter("id >= 20000 AND hit").count()
    assert inside == 20_000 and outside < 0.04 * 20_000


# --- intervals -------------------------------------------------------------


def brute_gaps(rows):
    out = []
    for key in {r[0] for r in rows if r[0]}:
        covered = set()
        for k, s, e in rows:
            if k == key and s is not None and e is not None:
                covered.update(range(min(s, e), max(s, e) + 1))
        run = None
        for x in range(min(covered, default=0), max(covered, default=-1) + 1):
            if x not in covered:
                run = [x, x] if run is None else [run[0], x]
            elif run:
                out.append((key, *run))
                run = None
    return sorted(out)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(1, 60)), st.one_of(st.none(), st.integers(1, 60))), max_size=25))
def test_gaps(spark, rows):
    df = spark.createDataFrame(rows, "k string, start bigint, `end` bigint")
    for kw in ({}, {"hot_rows": 3, "chunks": 4}):
        r = merge_intervals(df, ["k"], "start", "end", **kw)
        assert sorted(tuple(x) for x in r.gaps.collect()) == brute_gaps(rows)
        covered = {(k, x) for k, s, e in rows if k and s is not None and e is not None for x in range(min(s, e), max(s, e) + 1)}
        assert covered == {(p.k, x) for p in r.periods.collect() for x in range(p.start, p.end + 1)}


def test_intervals_with_clashing_columns(spark):
    df = spark.createDataFrame([("a", 5, 1, 9, 9), ("a", 6, 8, 9, 9), ("a", 20, 20, 9, 9), ("a", 20, 20, 9, 9)], "k0 string, s bigint, e bigint, n int, reach int")
    r = merge_intervals(df, ["k0"], "s", "e")
    assert sorted(map(tuple, r.periods.collect())) == [("a", 1, 8, 2), ("a", 20, 20, 2)]
    assert [tuple(x) for x in r.gaps.collect()] == [("a", 9, 19)]


# --- hierarchies -----------------------------------------------------------


def brute_tree(rows):
    up = {}
    for i, p in rows:
        if i is not None:
            up[i] = min([x for x in (up.get(i), p) if x is not None], default=None)
    out = {}
    for n in up:
        path, x = [n], n
        while up[x] in up and up[x] not in path:
            x = up[x]
            path.append(x)
        if up[x] in up:
            ring = path[path.index(up[x]) :]
            out[n] = (min(ring), -1, None)
        else:
            out[n] = (x, len(path) - 1, path[::-1])
    return out


IDS = st.one_of(st.none(), st.sampled_from("abcdefghijkl"))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(IDS, IDS), max_size=14))
def test_hierarchy(spark, rows):
    df = spark.createDataFrame(rows, "id string, root string")
    for kw in ({"level_share": 0.0}, {"level_share": 2.0}, {"hot_rows": 1, "salts": 3, "level_share": 0.4}):
        got = {r.node_id: (r.root_id, r.depth, r.path) for r in resolve_hierarchy(df, "id", "root", **kw).collect()}
        assert got == brute_tree(rows)


def test_long_chain_circle_and_descendants(spark):
    rows = [(f"n{i:03}", f"n{i - 1:03}" if i else "absent") for i in range(40)] + [(f"c{i:02}", f"c{(i + 1) % 13:02}") for i in range(13)] + [("tail", "c05"), ("below", "tail"), ("own", "own")]
    r = resolve_hierarchy(spark.createDataFrame(rows, "id string, parent string"), "id", "parent")
    assert {x.node_id: (x.root_id, x.depth, x.path) for x in r.collect()} == brute_tree(rows)
    assert descendants(r).count() == 40 * 39 // 2


def test_p4_descendants_come_out_as_pairs(spark):
    up = {}
    for name, node, parent in (("raw_gene_features", "id", "parent"), ("species_tree", "node_id", "parent_id")):
        clean = lambda x: None if x is None or x.strip(" \t\r\n").lower() in ("", ".", "na") else x.strip(" \t\r\n").lower()
        for x in spark.read.parquet(f"{SMALL}/{name}.parquet").select(node, parent).collect():
            if clean(x[0]) is not None:
                up.setdefault((name, clean(x[0])), []).append(clean(x[1]))
    up = {n: min((x for x in ups if x is not None), default=None) for n, ups in up.items()}
    pairs, circular = [], set()
    for t, n in up:
        chain, at = [], up[t, n]
        while at is not None and (t, at) in up and len(chain) <= len(up):
            chain.append(at)
            at = up[t, at]
        if len(chain) > len(up):
            circular.add((t, n))
        else:
            pairs.extend((t, a, n, i + 1) for i, a in enumerate(chain))
    got = entry.queries()["p4_descendants"](spark, SMALL)
    assert sorted(tuple(x) for x in got.select("source_table", "ancestor_id", "descendant_id", "distance").collect()) == sorted(pairs)
    below = {n: [] for n in up}
    for t, a, _, distance in pairs:
        below[t, a].append(distance)
    want = {n: (None, None, None) if n in circular else (len(b), b.count(1), max(b, default=0)) for n, b in below.items()}
    counts = entry.queries()["p4_descendant_counts"](spark, SMALL)
    assert {(x.source_table, x.node_id): (x.n_descendants, x.n_children, x.height) for x in counts.collect()} == want


# --- nested records --------------------------------------------------------


def brute_nested(text, spans, cons):
    def valid(t):
        try:
            return json.loads(t) if t is not None else None
        except ValueError:
            return None

    def layers(v, wrapper=True):
        for _ in range(3):
            if isinstance(v, str):
                p = valid(v)
                v = p if isinstance(p, (list, dict)) else v
            elif isinstance(v, dict) and wrapper and v.get("events") is not None:
                v = v["events"]
        return v

    def some(v):
        return [x for x in (v if isinstance(v, list) else [v]) if x is not None]

    out = []

    def span(x):
        s, e = (x.get("start"), x.get("end")) if isinstance(x, dict) else (x[0], x[1])
        return f"{'NA' if s is None else int(s)}-{'NA' if e is None else int(e)}"

    def walk(v, at):
        for i, e in enumerate(some(layers(v))):
            e = layers(e, False)
            if not isinstance(e, dict):
                continue
            path = f"{at}/{i}" if at else str(i)
            op = e.get("operation")
            out.append((path, "event", 0, op.strip() if isinstance(op, str) else op))
            a = e.get("affected_spans")
            a = [a] if isinstance(a, list) and len(a) == 2 and all(isinstance(x, (int, str)) for x in a) else some(a)
            out.extend((path, "span", n, span(x)) for n, x in enumerate(a))
            out.extend((path, "consequence", n, x.strip()) for n, x in enumerate(some(e.get("consequences"))))
            walk(e.get("steps"), path)

    walk(valid(text), "")
    out.extend(("", "span", n, f"{x[0]}-{x[1]}") for n, x in enumerate(some(spans)))
    out.extend(("", "consequence", n, x.strip()) for n, x in enumerate(some(cons)))
    return out


def test_nested_records_of_the_given_table(spark):
    for sf in (SMALL, "/root/testdata/sf0.01"):
        rows = {r.history_id: r for r in spark.read.parquet(f"{sf}/exon_history.parquet").collect()}
        want = sorted((h, *x) for h, r in rows.items() for x in brute_nested(r.events, r.affected_spans, r.consequences))
        assert sorted(tuple(x) for x in entry.queries()["p6_found"](spark, sf).collect()) == want


def test_uneven_shapes(spark):
    e = {"operation": " split ", "affected_spans": [3, "9"], "consequences": "x ", "steps": {"operation": "inner", "steps": json.dumps([None, {"operation": "deep"}])}}
    texts = ["", None, "null", "5", "[1,2] x", '[{"operation":"a"}] trailing', '{"operation":"a"},{"operation":"b"}', json.dumps(e), json.dumps({"events": [None, 7, e]}), json.dumps(json.dumps([e, e])), "[]", json.dumps([{"operation": None, "affected_spans": [{"start": 1}], "consequences": [None, ""]}])]
    df = spark.createDataFrame(list(enumerate(texts)), "object int, value string")
    f = flatten(df.select("object", F.expr(whole_json("value")).alias("key")), "object", "key", "steps", [ValueArray("span", "affected_spans", SPAN, True), ValueArray("consequence", "consequences", TEXT)], "events")
    got = [(r.key, r.path, "event", 0, r.op) for r in f.objects.select("key", "path", F.expr("trim(try_variant_get(object, '$.operation', 'string')) op")).collect()] + [(r.key, r.path, r.kind, r.ordinal, r.value) for r in f.values.collect()]
    want = [(n, *x) for n, t in enumerate(texts) for x in brute_nested(t, None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert top_keys("OBJECT<a: OBJECT<b: BIGINT, c: VARIANT>, steps: ARRAY<VARIANT>>") == {"a", "steps"}


def test_nested_empty_table(spark):
    df = spark.createDataFrame([], "h int, value string")
    f = flatten(df.select("h", F.expr(whole_json("value")).alias("doc")), "h", "doc", "steps", [ValueArray("span", "affected_spans", SPAN, True)])
    assert f.objects.count() == 0 and f.values.count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_members_nobody_named_come_out(spark):
    df = spark.createDataFrame([(1, '[{"operation": "gain", "scores": [1.5, null, {"a": [true]}], "conditions": {"low": 2, "deep": {"x": "y"}}, "steps": [{"marks": ["m"]}]}]')], "h int, value string")
    f = flatten(df.select("h", F.expr(whole_json("value")).alias("doc")), "h", "doc", "steps", [ValueArray("span", "affected_spans", SPAN, True)])
    got = sorted((r.path, r.field, r.place, r.value) for r in f.fields.collect())
    assert got == [("0", "conditions.deep.x", "", "y"), ("0", "conditions.low", "", "2"), ("0", "operation", "", "gain"), ("0", "scores", "0", "1.5"), ("0", "scores.a", "2/0", "true"), ("0/0", "marks", "0", "m")]


def test_whole_json_takes_whole_texts_only(spark):
    texts = ['[1]', '{"a": 1}', ' 1 ', '"x"', '[1', '[1] x', '1,2', '1],[2', '1,"end":0},{"x":1', '', '{"a": 1}}', "null"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.j for r in df.select(F.expr(f"to_json({whole_json('t')})").alias("j")).collect()]
    assert got == ['[1]', '{"a":1}', '1', '"x"', None, None, None, None, None, None, None, "null"]
