"""Trees, joins, sources, streaming and scalar functions against small brute-force versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchloom.functions import sequence, spans, text
from branchloom.functions.values import key, strand_sign
from branchloom.operators.joins import densify, nearest_before, overlap_join, reciprocal_best, upsert
from branchloom.operators.statistics import bh_adjust, chi_square_sf1
from branchloom.operators.trees import RATE_MAX, RATE_MIN, Topology, equal_cost_parsimony, fit_rates, fit_two_state, grid_loglik, sankoff, transition, two_state_loglik, two_state_posteriors
from branchloom.plans import skew
from branchloom.plans.lineage import collect_bounded
from branchloom.sources import readers, writers
from branchloom.streaming import events

NODES = [("r", None, 0.0), ("x", "r", 0.4), ("a", "x", 0.5), ("b", "x", 0.6), ("c", "r", 0.7)]


def enumerate_states(k):
    names = [n for n, _, _ in NODES]
    for s in itertools.product(range(k), repeat=len(names)):
        yield dict(zip(names, s))


def test_sankoff_against_enumeration():
    cost, tree = np.array([[0.0, 1, 3], [2, 0, 1], [1, 2, 0]]), Topology(NODES)
    for tips in itertools.product([0, 1, 2, None], repeat=3):
        want = dict(zip("abc", tips))
        best = min(sum(cost[s[p], s[n]] for n, p, _ in NODES if p) for s in enumerate_states(3) if all(v is None or s[t] == v for t, v in want.items()))
        assert sankoff(tree, want, cost)[0] == best


def test_two_state_likelihood_against_enumeration():
    tree, gain, loss = Topology(NODES), 0.7, 0.3
    for tips in itertools.product([0, 1, None], repeat=3):
        want = dict(zip("abc", tips))
        total = 0.0
        for s in enumerate_states(2):
            if all(v is None or s[t] == v for t, v in want.items()):
                p = (loss, gain)[s["r"]] / (gain + loss)
                for n, up, length in NODES:
                    if up:
                        p *= transition(gain, loss, length)[s[up], s[n]]
                total += p
        assert math.isclose(two_state_loglik(tree, want, gain, loss), math.log(total), rel_tol=1e-9)
    er, _, ard, _ = fit_two_state(tree, {"a": 1, "b": 1, "c": 0})
    assert ard >= er - 1e-12
    assert np.allclose(transition(0.3, 0.2, 0.0), np.eye(2)) and np.allclose(transition(1, 2, 3).sum(1), 1)


def test_two_state_fit_is_a_maximum():
    names = [f"t{i}" for i in range(12)]
    nodes = [("r", None, 0.0), *[(f"x{i}", "r", 0.1 + 0.05 * i) for i in range(4)], *[(t, f"x{i % 4}", 0.2 + 0.07 * i) for i, t in enumerate(names)]]
    tree, fine = Topology(nodes), np.geomspace(RATE_MIN, RATE_MAX, 201)
    for k, seen in enumerate(("101100111011", "000000000001", "110000001111", "111111111111")):
        states = {t: int(v) for t, v in zip(names, seen)}
        er, rate, ard, gain, loss, status = fit_rates(tree, states)
        assert math.isclose(two_state_loglik(tree, states, rate, rate), er, abs_tol=1e-9) and math.isclose(two_state_loglik(tree, states, gain, loss), ard, abs_tol=1e-9)
        assert er >= grid_loglik(tree, states, fine, fine).max() - 1e-9
        assert ard >= max(er, grid_loglik(tree, states, np.repeat(fine, 201), np.tile(fine, 201)).max()) - 1e-9
        assert RATE_MIN <= min(rate, gain, loss) * (1 + 1e-9) and max(rate, gain, loss) <= RATE_MAX * (1 + 1e-9)
        assert (status == "no_observed_contrast") == (k == 3) and status != "not_converged"
    assert fit_rates(Topology([("r", None, 0.0), ("a", "r", 0.0), ("b", "r", 0.0)]), {"a": 0, "b": 1})[-1] == "impossible"


def test_overlap_join(spark):
    rows = [("k", 1, 5), ("k", 5, 9), ("k", 10, 40), ("k", 12, 13), ("j", 1, 100)]
    df = spark.createDataFrame(rows, "g string, s bigint, e bigint")
    want = sorted((a, b) for a in rows for b in rows if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    for size in (1, 4, 1000):
        got = sorted(((r.g, r.s, r.e), (r.r_g, r.r_s, r.r_e)) for r in overlap_join(df, df, ["g"], bin_size=size).collect())
        assert got == want
    left = overlap_join(df, df.filter("s = 12"), ["g"], bin_size=7, how="left").collect()
    assert sorted((r.s, r.r_s) for r in left if r.g == "k") == [(1, None), (5, None), (10, 12), (12, 12)]


def test_nearest_before(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", None, "q")], "g string, t int, v string")
    points = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 5, 3), ("a", 9, 4), ("c", 1, 5)], "g string, t int, no int")
    assert {r.no: r.hit for r in nearest_before(df, points, ["g"], "t", "v", "hit").collect()} == {1: None, 2: "x", 3: "z", 4: "z", 5: None}


def test_upsert_densify_reciprocal(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, upsert(base, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    d = densify(spark.createDataFrame([("a", "x", 5)], "r string, c string, v int"), base.select(F.col("k").alias("r")), spark.createDataFrame([("x",), ("y",)], "c string"), ["r", "c"], {"v": F.lit(0)})
    assert sorted(map(tuple, d.collect())) == [("a", "x", 5), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0)]
    p = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.9), ("b", "x", 0.5)], "l string, r string, s double")
    assert {(x.l, x.r): x.status for x in reciprocal_best(p, "l", "r", "s").collect()} == {("a", "x"): "reciprocal_best", ("a", "y"): "reciprocal_best", ("b", "x"): "query_best_only"}


def test_bh_and_chi_square(spark):
    p = [0.01, 0.02, 0.03, 0.5, 0.02]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    order = sorted(range(5), key=lambda i: (p[i], i))
    want, low = {}, 1.0
    for rank in range(5, 0, -1):
        low = min(low, p[order[rank - 1]] * 5 / rank)
        want[order[rank - 1]] = low
    got = {r.i: r.q_value for r in bh_adjust(df, "p", [], ["i"]).collect()}
    assert all(math.isclose(got[i], want[i]) for i in want)
    assert math.isclose(spark.createDataFrame([(3.841458820694124,)], "x double").select(chi_square_sf1("x")).first()[0], 0.05, rel_tol=1e-6)


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "rk string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, left.join(right, left.k == right.rk, how).collect()))
        assert sorted(map(str, skew.salted_join(left, right, "k", "rk", how, hot_rows=20, salts=4).collect())) == plain


def test_values_and_strings(spark):
    df = spark.createDataFrame([(" \tAb ",), ("NA",), (" . ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(key("x")).collect()] == ["ab", None, None, None, None]
    signs = spark.createDataFrame([(x,) for x in (" +", "-1", "Plus", "MINUS", "?", "+1", None)], "x string")
    assert [r[0] for r in signs.select(strand_sign("x")).collect()] == ["+", "-", "+", "-", None, "+", None]
    s = spark.createDataFrame([("AUGGCCNNNT", "3M1I2D")], "s string, c string")
    got = s.select(sequence.reverse_complement(F.col("s")), sequence.translate_codons(F.col("s")), sequence.cigar_length(F.col("c"), "MD"), sequence.run_lengths(F.lit("AAB")), sequence.same_positions(F.col("s"), F.lit("ATGG"))).first()
    assert tuple(got) == ("ANNNGGCCAT", "MAX", 5, "2A1B", 4)
    b = s.select(spans.blocks_length(spans.parse_blocks(F.lit("1-5;4-9;x;20-20"))), spans.format_blocks(spans.parse_blocks(F.lit("4-9;1-5"))), spans.blocks_overlap(spans.parse_blocks(F.lit("1-5")), spans.parse_blocks(F.lit("6-7")))).first()
    assert tuple(b) == (10, "1-5;4-9", False)
    t = s.select(text.attribute(F.lit("ID=a;Parent=b;parent=c"), "parent"), F.array_join(text.split_ids(F.lit('a; "b",NA,')), "|"), text.url_id(F.lit("a b"), F.lit("c/d"))).first()
    assert tuple(t) == ("c", "a|b", "a%20b/c%2Fd")


def test_newick():
    rows = readers.parse_newick("((A:0.1,'B b':0.2)x:0.3,C)r;")
    assert rows == [("r", None, "r", None), ("x", "r", "x", 0.3), ("A", "x", "A", 0.1), ("B b", "x", "B b", 0.2), ("C", "r", "C", None)]
    for bad in ("((A,B);", "A,B;", "(A,A);"):
        with pytest.raises(ValueError):
            readers.parse_newick(bad)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nacg\nT\n\n>two\n>three x\nGG>G\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("record_id").collect()] == [("one", "one first", "ACGT"), ("three", "three x", "GG>G"), ("two", "two", "")]
    part = readers.read_fasta_interval(readers.read_fasta(spark, str(tmp_path / "a.fa")), "one", 2, 3)
    assert part.first().part == "CG"
    (tmp_path / "a.gff").write_text("##gff\nc1\ts\tgene\t1\t9\t.\t+\t.\tID=g1\nbroken line\nc1\ts\tmRNA\tx\t9\t.\t+\t0\tID=t1;Parent=g1\n")
    assert [(r.id, r.parent, r.start, r.phase) for r in readers.read_gff(spark, str(tmp_path / "a.gff")).orderBy("id").collect()] == [("g1", None, 1, None), ("t1", "g1", None, 0)]
    df = spark.createDataFrame([("a", 1.5), (None, float("nan"))], "k string, v double")
    writers.write_tsv(df, str(tmp_path / "t"), ["v", "k"])
    assert sorted(r.k for r in readers.read_tsv(spark, str(tmp_path / "t"), ["k"]).collect()) == ["NA", "a"]
    with pytest.raises(ValueError):
        readers.read_tsv(spark, str(tmp_path / "t"), ["k", "absent"])


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    e.limit(5).write.mode("append").parquet(str(tmp_path / "in"))  # delivered again
    stream = events.read_events(spark, str(tmp_path / "in"), 100)
    events.run_to_table(events.windowed_counts(events.first_deliveries(stream, "3650 days"), lateness=None), str(tmp_path / "cp"), str(tmp_path / "out"), "append")
    events.run_to_table(events.first_deliveries(stream, "3650 days"), str(tmp_path / "cp2"), str(tmp_path / "out2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == e.count()
    batch = events.windowed_counts(e)
    assert batch.agg(F.sum("n")).first()[0] == e.count()
    assert events.sessions(e).agg(F.sum("n")).first()[0] == e.count()


def test_small_tables_are_read_whole_or_not_at_all(spark, tmp_path):
    assert len(collect_bounded(spark.range(5), 5, "five")) == 5
    with pytest.raises(ValueError, match="more than 4 rows"):
        collect_bounded(spark.range(5), 4, "five")
    (tmp_path / "t.nwk").write_text("(a,b)r;\n" + "\n" * 100_000)
    with pytest.raises(ValueError, match="more than 100000 rows"):
        readers.read_newick(spark, str(tmp_path / "t.nwk"))


TIP_ROWS = np.array(list(itertools.product((-1, 0, 1), repeat=3)))


def test_equal_cost_parsimony_against_enumeration():
    tree = Topology(NODES)
    got = equal_cost_parsimony(tree, TIP_ROWS)
    up = {n: p for n, p, _ in NODES}
    for k, tips in enumerate(TIP_ROWS):
        seen = dict(zip(tree.tips, tips))
        fits = [s for s in enumerate_states(2) if all(v < 0 or s[t] == v for t, v in seen.items())]
        cost = lambda s: sum(s[n] != s[p] for n, p in up.items() if p)
        best = min(map(cost, fits))
        top = [s for s in fits if cost(s) == best]
        assert got.cost[k] == best
        for i, n in enumerate(tree.order):
            assert {z for z in (0, 1) if got.states[k, i, z]} == {s[n] for s in top}
            if up[n]:
                assert {(a, b) for a in (0, 1) for b in (0, 1) if got.pairs[k, i, a, b]} == {(s[up[n]], s[n]) for s in top}
        assert dict(zip(tree.order, got.history[k].tolist())) in top


def test_posteriors_against_enumeration():
    tree = Topology(NODES)
    gain, loss = np.linspace(0.2, 0.9, len(TIP_ROWS)), np.linspace(0.7, 0.3, len(TIP_ROWS))
    loglik, shown, same = two_state_posteriors(tree, TIP_ROWS, gain, loss)
    for k, tips in enumerate(TIP_ROWS):
        def weight(s, k=k):
            w = (loss[k], gain[k])[s["r"]] / (gain[k] + loss[k])
            for n, p, t in NODES:
                w *= transition(gain[k], loss[k], t)[s[p], s[n]] if p else 1.0
            return w

        seen = dict(zip(tree.tips, tips))
        fits = [s for s in enumerate_states(2) if all(v < 0 or s[t] == v for t, v in seen.items())]
        total = sum(map(weight, fits))
        assert math.isclose(loglik[k], math.log(total), rel_tol=1e-9)
        for i, n in enumerate(tree.order):
            assert math.isclose(shown[k, i], sum(weight(s) for s in fits if s[n]) / total, rel_tol=1e-9, abs_tol=1e-12)
        known = [t for t, v in seen.items() if v >= 0]
        even = sum(weight(s) for s in enumerate_states(2) if len({s[t] for t in known}) == 1) if known else 2.0
        assert math.isclose(same[k], math.log(even), rel_tol=1e-9, abs_tol=1e-9)
