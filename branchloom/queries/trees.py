"""Operators over the species tree: traversal, distances, common ancestors, coverage, parsimony and likelihood."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from branchloom.functions import scoring
from branchloom.operators import trees
from branchloom.operators.hierarchy import resolve_hierarchy
from branchloom.operators.statistics import chi_square_sf1, likelihood_ratio
from branchloom.functions.text import element_id
from branchloom.plans.lineage import collect_bounded, materialize
from branchloom.queries.registry import Registry, r6
from branchloom.queries.relational import _SITE, cells
from branchloom.queries.rules import _MEMBERS, members
from branchloom.queries.scalars import ELEMENT
from branchloom.queries.views import FEAT, MATCH, TREE, features, matches, tree

query = Registry()
C = F.col

DOWN = f"""{TREE}, down AS (SELECT l.node, l.node AS root, 0::BIGINT AS depth, [l.node] AS path FROM tr l LEFT JOIN tr p ON p.node = l.up WHERE p.node IS NULL
  UNION ALL SELECT l.node, d.root, d.depth + 1, list_append(d.path, l.node) FROM down d JOIN tr l ON l.up = d.node)"""
LIFT = """anc AS (SELECT node, root, depth, unnest(path) AS ancestor, unnest(range(0, len(path))) AS adepth FROM down),
lift AS (SELECT a.*, coalesce(sum(CASE WHEN (SELECT bool_or(t2.length IS NULL) FROM down d2 JOIN tr t2 ON t2.node = d2.node WHERE d2.depth > 0) THEN 1.0 ELSE coalesce(t.length, 0.0) END) OVER (PARTITION BY a.node ORDER BY a.adepth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS dist FROM anc a JOIN tr t ON t.node = a.ancestor)"""
TIPS = "tips AS (SELECT node FROM down d WHERE NOT EXISTS (SELECT 1 FROM tr c WHERE c.up = d.node))"


def resolved(spark, d):
    t = tree(spark, d)
    return t, resolve_hierarchy(t.select("node", "up"), "node", "up")


def _tips(t, r):
    return r.filter("path IS NOT NULL").join(t.select(C("up").alias("_u")).distinct(), C("node_id") == C("_u"), "left_anti").select(C("node_id").alias("tip"))


@query(f"WITH RECURSIVE {DOWN} SELECT node, root, depth, row_number() OVER (PARTITION BY root ORDER BY array_to_string(path, '/')) AS preorder FROM down")
def preorder(spark, d):
    _, r = resolved(spark, d)
    r = r.filter("path IS NOT NULL")
    return r.select(C("node_id").alias("node"), C("root_id").alias("root"), "depth", F.row_number().over(Window.partitionBy("root_id").orderBy(F.array_join("path", "/"))).alias("preorder"))


@query(f"WITH RECURSIVE {DOWN} SELECT 'nodes' AS check_, count(*) AS n FROM tr UNION ALL SELECT 'roots', count(*) FROM down WHERE depth = 0 UNION ALL SELECT 'unreached', (SELECT count(*) FROM tr) - count(*) FROM down UNION ALL SELECT 'bad_length', count(*) FROM tr WHERE length IS NULL UNION ALL SELECT 'absent_parent', count(*) FROM tr WHERE up IS NOT NULL AND up NOT IN (SELECT node FROM tr) UNION ALL SELECT 'duplicate_label', count(*) FROM (SELECT label FROM tr WHERE label IS NOT NULL GROUP BY label HAVING count(*) > 1)")
def tree_validate(spark, d):
    t, r = resolved(spark, d)
    dup = t.filter("label IS NOT NULL").groupBy("label").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_label").alias("check_"), "n")
    absent = t.filter("up IS NOT NULL").join(t.select(C("node").alias("_n")), C("up") == C("_n"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("absent_parent").alias("check_"), "n")
    marks = r.join(t.select(C("node").alias("node_id"), "length"), "node_id").agg(F.count("*").alias("nodes"), F.count_if(C("depth") == 0).alias("roots"), F.count_if(C("depth") < 0).alias("unreached"), F.count_if(C("length").isNull()).alias("bad_length"))
    return marks.unpivot([], ["nodes", "roots", "unreached", "bad_length"], "check_", "n").unionByName(absent).unionByName(dup)


@query(f"""WITH RECURSIVE {DOWN}, {LIFT}, {TIPS} SELECT a.node AS left_tip, b.node AS right_tip, arg_max(a.ancestor, a.adepth) AS mrca, round(arg_max(a.dist + b.dist, a.adepth), 6) + 0.0 AS distance FROM lift a JOIN lift b ON a.ancestor = b.ancestor AND a.node < b.node JOIN tips x ON x.node = a.node JOIN tips y ON y.node = b.node GROUP BY a.node, b.node""")
def tree_distance(spark, d):
    t, r = resolved(spark, d)
    return trees.tip_distances(trees.lifted(r, t), _tips(t, r)).withColumn("distance", r6(C("distance")))


@query(f"""WITH RECURSIVE {DOWN}, {LIFT}, {TIPS}, p AS (SELECT arg_max(a.dist + b.dist, a.adepth) AS distance FROM lift a JOIN lift b ON a.ancestor = b.ancestor AND a.node < b.node JOIN tips x ON x.node = a.node JOIN tips y ON y.node = b.node GROUP BY a.node, b.node)
SELECT CASE WHEN round(distance, 6) <= 2 THEN 'nearest_species_support' WHEN round(distance, 6) <= 4 THEN 'within_clade_support' ELSE 'deep_tree_support' END AS tier, count(*) AS pairs FROM p GROUP BY tier""")
def distance_tier(spark, d):
    t, r = resolved(spark, d)
    return trees.tip_distances(trees.lifted(r, t), _tips(t, r)).groupBy(scoring.distance_tier(F.round("distance", 6)).alias("tier")).agg(F.count("*").alias("pairs"))


_COV = f"""{DOWN}, {LIFT}, {TIPS}, {_SITE}, mem AS (SELECT DISTINCT family, species AS node FROM cell JOIN tips ON tips.node = cell.species WHERE state = 'present'), sz AS (SELECT family, count(*) AS n FROM mem GROUP BY family),
hit AS (SELECT family, ancestor, adepth, count(DISTINCT mem.node) AS n FROM mem JOIN lift USING (node) GROUP BY ALL),
best AS (SELECT hit.family, arg_max(ancestor, adepth) AS mrca, max(adepth) AS depth FROM hit JOIN sz ON sz.family = hit.family AND sz.n = hit.n GROUP BY hit.family)"""


@query(f"""WITH RECURSIVE {_COV} SELECT f.family, coalesce(sz.n, 0) AS species, mrca, depth::BIGINT AS depth, round(coalesce(sz.n, 0) / (SELECT count(*) FROM tips), 6) + 0.0 AS ratio, CASE WHEN sz.n IS NULL THEN 'absent_or_unplaced' WHEN sz.n = (SELECT count(*) FROM tips) THEN 'tree_spanning' WHEN sz.n = 1 THEN 'tip_specific' ELSE 'partial' END AS coverage FROM (SELECT DISTINCT family FROM cell) f LEFT JOIN sz USING (family) LEFT JOIN best USING (family)""")
def tree_coverage(spark, d):
    t, r = resolved(spark, d)
    tips = _tips(t, r)
    n_tips = tips.agg(F.count("*").alias("n_tips"))
    seen = cells(spark, d)
    mem = seen.filter("state = 'present'").join(tips, C("species") == C("tip")).select("family", C("species").alias("node_id")).distinct()
    size = mem.groupBy("family").agg(F.count("*").alias("species"))
    best = trees.mrca(trees.lifted(r, t), mem, "family")
    out = seen.select("family").distinct().join(size, "family", "left").join(best, "family", "left").crossJoin(F.broadcast(n_tips))  # one row
    n = F.coalesce("species", F.lit(0))
    return out.select("family", n.alias("species"), "mrca", C("depth").cast("bigint").alias("depth"), r6(n / C("n_tips")).alias("ratio"), F.when(n == 0, "absent_or_unplaced").when(n == C("n_tips"), "tree_spanning").when(n == 1, "tip_specific").otherwise("partial").alias("coverage"))


@query(f"""WITH RECURSIVE {_COV}, keep AS (SELECT DISTINCT ancestor AS node FROM lift JOIN (SELECT DISTINCT node FROM mem) x USING (node)) SELECT k.node, d.depth, (SELECT count(*) FROM tr c JOIN keep kk ON kk.node = c.node WHERE c.up = k.node) AS kept_children FROM keep k JOIN down d USING (node)""")
def tree_prune(spark, d):
    """Root paths of the species in which anything is present, with the children each node keeps."""
    t, r = resolved(spark, d)
    mem = cells(spark, d).filter("state = 'present'").select(C("species").alias("tip")).distinct().join(_tips(t, r), "tip")
    keep = r.filter("path IS NOT NULL").join(mem, C("node_id") == C("tip")).select(F.explode("path").alias("node")).distinct()
    kids = t.join(keep, "node").groupBy(C("up").alias("_u")).agg(F.count("*").alias("kept_children"))
    return keep.join(r.select(C("node_id").alias("node"), "depth"), "node").join(kids, C("node") == C("_u"), "left").select("node", "depth", F.coalesce("kept_children", F.lit(0)).alias("kept_children"))


@query(f"""WITH RECURSIVE {DOWN}, kids AS (SELECT up, count(*) AS n FROM tr WHERE up IS NOT NULL GROUP BY up), flag AS (SELECT d.node, d.path, coalesce(k.n, 0) = 1 AND d.depth > 0 AS unary FROM down d LEFT JOIN kids k ON k.up = d.node),
up_ AS (SELECT f.node, unnest(f.path) AS anc, unnest(range(0, len(f.path))) AS ad FROM flag f WHERE NOT unary), kept AS (SELECT u.node, u.anc, u.ad FROM up_ u JOIN flag g ON g.node = u.anc WHERE NOT g.unary AND u.anc <> u.node)
SELECT f.node, (SELECT arg_max(anc, ad) FROM kept WHERE kept.node = f.node) AS parent_ FROM flag f WHERE NOT unary""")
def collapse_unary(spark, d):
    """The tree without inner nodes of one child: every kept node with its nearest kept ancestor."""
    t, r = resolved(spark, d)
    one = t.filter("up IS NOT NULL").groupBy("up").count().filter("count = 1").select(C("up").alias("_u"))
    r = r.filter("path IS NOT NULL")
    unary = r.filter("depth > 0").join(one, C("node_id") == C("_u"), "left_semi").select(C("node_id").alias("_x"))
    kept = r.join(unary, C("node_id") == C("_x"), "left_anti")
    ups = kept.select("node_id", F.posexplode("path").alias("ad", "anc")).filter("anc <> node_id").join(unary, C("anc") == C("_x"), "left_anti").groupBy("node_id").agg(F.max(F.struct("ad", "anc")).alias("m"))
    return kept.join(ups, "node_id", "left").select(C("node_id").alias("node"), C("m.anc").alias("parent_"))


@query(f"""WITH RECURSIVE {FEAT}, e AS (SELECT DISTINCT id, unnest(string_split(replace(parents, ',', ';'), ';')) AS p FROM f WHERE id IS NOT NULL AND parents IS NOT NULL), l AS (SELECT DISTINCT id, trim(p) AS up FROM e WHERE trim(p) NOT IN ('', '.', 'na') AND trim(p) <> id), g AS (SELECT DISTINCT id FROM f WHERE type = 'gene' AND id IS NOT NULL),
c AS (SELECT id AS gene, id FROM g UNION SELECT c.gene, l.id FROM c JOIN l ON l.up = c.id) SELECT gene, count(*) - 1 AS below FROM c GROUP BY gene""")
def hierarchy_closure(spark, d):
    """Features below every gene in the graph of several parents, by frontier joins until nothing new is reached."""
    f = features(spark, d)
    links = materialize(f.filter("id IS NOT NULL AND parents IS NOT NULL").select("id", F.explode(F.split(F.replace(C("parents"), F.lit(","), F.lit(";")), ";")).alias("up")).select("id", F.trim("up").alias("up")).filter("up NOT IN ('', '.', 'na') AND up <> id").distinct(), "links")
    seen = front = f.filter("type = 'gene' AND id IS NOT NULL").select(C("id").alias("gene"), C("id").alias("node")).distinct()
    while True:
        step = front.join(links, C("node") == C("up")).select("gene", C("id").alias("node")).distinct()
        front = materialize(step.join(seen, ["gene", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "seen")
    return seen.groupBy("gene").agg((F.count("*") - 1).alias("below"))


#: Nodes of all species trees together; they travel to the patterns.
MAX_TREE_NODES = 100_000


def _forest(spark, d):
    """Nodes (name, parent, length) of every tree with two tips or more, by root."""
    t, r = resolved(spark, d)
    rows = collect_bounded(r.filter("path IS NOT NULL").join(t.select(C("node").alias("node_id"), "length"), "node_id").select("root_id", "node_id", "parent_id", "depth", "length"), MAX_TREE_NODES, "species_tree")
    forest: dict[str, list] = {}
    for x in rows:
        forest.setdefault(x.root_id, []).append((x.node_id, x.parent_id if x.depth else None, x.length))
    return {root: sorted(nodes) for root, nodes in forest.items() if len(trees.Topology(nodes).tips) > 1}


def _patterns(spark, d, forest):
    """root, family and pattern: the states of the family in the species of each tree; families with none there have no row for it."""
    known = spark.createDataFrame([(root, n) for root, nodes in forest.items() for n in trees.Topology(nodes).tips], "root string, species string")
    c = cells(spark, d).filter("state IN ('present', 'absent')").join(F.broadcast(known), "species")
    return c.groupBy("root", "family").agg(F.array_join(F.array_sort(F.collect_list(F.concat("species", F.lit("="), F.substring("state", 1, 1)))), ";").alias("pattern"))


def _states(pattern):
    return {x.rsplit("=", 1)[0]: int(x.endswith("=p")) for x in pattern.split(";")}


def _scored(spark, d, kernel, schema):
    """Run ``kernel`` (topology, frame of one root's patterns) -> frame with pattern, once for each distinct pattern."""
    forest = _forest(spark, d)
    p = _patterns(spark, d, forest)

    def run(batches):
        built = {}
        for x in batches:
            for root, g in x.groupby("root"):
                if root not in built:
                    built[root] = trees.Topology(forest[root])
                yield kernel(built[root], g["pattern"].tolist()).assign(root=root)

    names = [f.split()[0] for f in schema.split(", ")]
    done = p.select("root", "pattern").distinct().repartition("pattern").mapInPandas(lambda b: (y[["root", "pattern", *names]] for y in run(b)), f"root string, pattern string, {schema}")
    return p.join(done, ["root", "pattern"]).drop("pattern")


def _tip_matrix(topology, patterns):
    out = np.full((len(patterns), len(topology.tips)), -1)
    for i, x in enumerate(patterns):
        s = _states(x)
        out[i] = [s.get(tip, -1) for tip in topology.tips]
    return out


@query()
def sankoff_parsimony(spark, d):
    """Least change cost per family and tree, with gain 2 and loss 1.5."""
    cost = np.array([[0.0, 2.0], [1.5, 0.0]])

    def kernel(topology, patterns):
        got = [(p, best, float(root[0]), float(root[1])) for p in patterns for best, root in [trees.sankoff(topology, _states(p), cost)]]
        return pd.DataFrame(got, columns=["pattern", "min_cost", "root_absent", "root_present"])

    return _scored(spark, d, kernel, "min_cost double, root_absent double, root_present double")


_PARSIMONY = "node string, parent string, states string, history_state int, event string, placement string, min_changes int"


def _parsimony(spark, d):
    def kernel(topology, patterns):
        r = trees.equal_cost_parsimony(topology, _tip_matrix(topology, patterns))
        out = []
        for k, x in enumerate(patterns):
            for i, node in enumerate(topology.order):
                p = topology.parent[i]
                a, b = (int(r.history[k, p]), int(r.history[k, i])) if p >= 0 else (None, int(r.history[k, i]))
                changes = p >= 0 and a != b
                only = p >= 0 and r.pairs[k, i].sum() == 1
                out.append((x, node, topology.order[p] if p >= 0 else None, ";".join(str(z) for z in (0, 1) if r.states[k, i, z]), b, None if p < 0 else "no_change" if not changes else "sequence_gain" if b else "sequence_loss", None if p < 0 else "no_change" if not changes else "required" if only else "possible", int(r.cost[k])))
        return pd.DataFrame(out, columns=["pattern", *[f.split()[0] for f in _PARSIMONY.split(", ")]])

    return _scored(spark, d, kernel, _PARSIMONY)


@query()
def parsimony_nodes(spark, d):
    """States of every node that occur in some history of fewest changes, and its state in one such history."""
    return _parsimony(spark, d).select("root", "family", "node", "states", "history_state", "min_changes")


@query()
def parsimony_changes(spark, d):
    """Changes of one history of fewest changes, and whether every such history has them."""
    return _parsimony(spark, d).filter("event <> 'no_change'").select("root", "family", "parent", C("node").alias("child"), "event", "placement")


@query()
def change_summary(spark, d):
    """Characters, those with both states and the sum of fewest changes per tree."""
    return _parsimony(spark, d).filter("parent IS NULL").groupBy("root").agg(F.count("*").alias("observed_characters"), F.count_if(C("min_changes") > 0).alias("variable_characters"), F.sum("min_changes").alias("minimum_changes"))


def _fits(topology, patterns):
    return [trees.fit_rates(topology, _states(p)) for p in patterns]


@query()
def binary_ctmc(spark, d):
    """Equal-rate and gain/loss maximum likelihood fits per family and tree with likelihood ratio, p value and the status of the fit."""

    def kernel(topology, patterns):
        got = [(p, er, rate, ard, gain / loss, status) for p, (er, rate, ard, gain, loss, status) in zip(patterns, _fits(topology, patterns))]
        return pd.DataFrame(got, columns=["pattern", "er_loglik", "er_rate", "ard_loglik", "ard_ratio", "fit_status"])

    f = _scored(spark, d, kernel, "er_loglik double, er_rate double, ard_loglik double, ard_ratio double, fit_status string")
    return f.withColumn("lrt", likelihood_ratio(C("er_loglik"), C("ard_loglik"))).withColumn("p_value", chi_square_sf1("lrt"))


@query()
def ctmc_posteriors(spark, d):
    """Probability of presence at every node under the equal-rate fit of a family."""

    def kernel(topology, patterns):
        rate = np.array([f[1] for f in _fits(topology, patterns)], dtype=float)
        _, shown, _ = trees.two_state_posteriors(topology, _tip_matrix(topology, patterns), rate, rate)
        return pd.DataFrame([(x, node, float(shown[k, i])) for k, x in enumerate(patterns) for i, node in enumerate(topology.order)], columns=["pattern", "node", "p_present"])

    return _scored(spark, d, kernel, "node string, p_present double")


@query()
def ctmc_ascertainment(spark, d):
    """Log likelihood under the equal-rate fit given that the tips differ, as only such characters are kept."""

    def kernel(topology, patterns):
        rate = np.array([f[1] for f in _fits(topology, patterns)], dtype=float)
        loglik, _, same = trees.two_state_posteriors(topology, _tip_matrix(topology, patterns), rate, rate)
        varies = np.log(np.maximum(-np.expm1(np.minimum(same, 0.0)), 1e-300))
        return pd.DataFrame({"pattern": patterns, "loglik": loglik, "log_p_variable": varies, "corrected_loglik": loglik - varies})

    return _scored(spark, d, kernel, "loglik double, log_p_variable double, corrected_loglik double")


# --- coverage and support along the tree -----------------------------------------


@query(f"""WITH RECURSIVE {DOWN}, {LIFT}, {TIPS}, {_MEMBERS}, pm AS (SELECT DISTINCT homology, species, copy FROM mem WHERE presence = 'present'), mt AS (SELECT DISTINCT homology, species AS node FROM pm JOIN tips ON tips.node = pm.species), sz AS (SELECT homology, count(*) AS n FROM mt GROUP BY homology),
hit AS (SELECT homology, ancestor, adepth, count(DISTINCT mt.node) AS n FROM mt JOIN lift USING (node) GROUP BY ALL), best AS (SELECT hit.homology, arg_max(ancestor, adepth) AS mrca FROM hit JOIN sz ON sz.homology = hit.homology AND sz.n = hit.n GROUP BY hit.homology),
cp AS (SELECT homology, count(DISTINCT species || ':' || copy) AS copies FROM pm GROUP BY homology)
SELECT h.homology, coalesce(sz.n, 0) AS species, coalesce(cp.copies, 0) AS copies, round(coalesce(sz.n, 0) / (SELECT count(*) FROM tips), 6) + 0.0 AS ratio, mrca, CASE WHEN sz.n IS NULL THEN 'absent_or_unplaced' WHEN sz.n = (SELECT count(*) FROM tips) THEN 'tree_spanning' WHEN sz.n = 1 THEN 'tip_specific' ELSE 'partial' END AS coverage
FROM (SELECT DISTINCT homology FROM mem) h LEFT JOIN sz USING (homology) LEFT JOIN best USING (homology) LEFT JOIN cp USING (homology)""")
def homology_coverage(spark, d):
    """Species and copies in which a homology id is present, the common ancestor of the species, and its class."""
    t, r = resolved(spark, d)
    tips = _tips(t, r)
    m = members(spark, d)
    here = m.filter("presence = 'present'").select("homology", "species", "copy").distinct()
    mt = here.join(tips, C("species") == C("tip")).select("homology", C("species").alias("node_id")).distinct()
    n_tips = tips.agg(F.count("*").alias("n_tips"))
    out = m.select("homology").distinct().join(mt.groupBy("homology").agg(F.count("*").alias("species")), "homology", "left").join(trees.mrca(trees.lifted(r, t), mt, "homology"), "homology", "left")
    out = out.join(here.groupBy("homology").agg(F.count_distinct(F.concat("species", F.lit(":"), "copy")).alias("copies")), "homology", "left").crossJoin(F.broadcast(n_tips))  # one row
    n = F.coalesce("species", F.lit(0))
    return out.select("homology", n.alias("species"), F.coalesce("copies", F.lit(0)).alias("copies"), r6(n / C("n_tips")).alias("ratio"), "mrca", F.when(n == 0, "absent_or_unplaced").when(n == C("n_tips"), "tree_spanning").when(n == 1, "tip_specific").otherwise("partial").alias("coverage"))


_PAIRS = "p AS (SELECT a.node AS l, b.node AS r, round(arg_max(a.dist + b.dist, a.adepth), 6) AS distance FROM lift a JOIN lift b ON a.ancestor = b.ancestor AND a.node < b.node JOIN tips x ON x.node = a.node JOIN tips y ON y.node = b.node GROUP BY a.node, b.node)"


@query(f"""WITH RECURSIVE {DOWN}, {LIFT}, {TIPS}, {_PAIRS} SELECT l AS left_species, r AS right_species, CASE WHEN distance <= 2 THEN greatest(0.55, 0.75) WHEN distance > 4 THEN greatest(0.45, 0.55 - 0.15) ELSE 0.55 END AS threshold FROM p""")
def pair_threshold(spark, d):
    """Identity a pair of species must reach: more for near ones, less for far ones; the base is 0.55."""
    t, r = resolved(spark, d)
    p = trees.tip_distances(trees.lifted(r, t), _tips(t, r))
    return p.select(C("left_tip").alias("left_species"), C("right_tip").alias("right_species"), scoring.class_threshold(F.lit(0.55), F.round("distance", 6)).alias("threshold"))


@query(f"""WITH RECURSIVE {DOWN}, {LIFT}, {TIPS}, {_PAIRS}, {_MEMBERS}, {MATCH}, e AS (SELECT * FROM mem WHERE homology IN (SELECT homology FROM el)),
s AS (SELECT a.homology, m.total_score AS score, CASE WHEN a.species = b.species AND a.species IN (SELECT node FROM tips) THEN 0.0 ELSE p.distance END AS distance FROM m JOIN e a ON a.occ = m.q JOIN e b ON b.occ = m.t AND b.homology = a.homology LEFT JOIN p ON p.l = least(a.species, b.species) AND p.r = greatest(a.species, b.species) WHERE m.status IS DISTINCT FROM 'unmapped'),
x AS (SELECT homology, sum((distance <= 2)::INT) AS near, sum((distance > 2 AND distance <= 4)::INT) AS within, sum((distance > 4)::INT) AS deep, max(coalesce(score, 0)) AS best, (sum(round(coalesce(score, 0) * 1000000)::BIGINT) // count(*)) / 1000000.0 AS mean FROM s GROUP BY homology),
g AS (SELECT homology, count(*) AS members, count(DISTINCT species) AS species, count(DISTINCT species || ':' || copy) AS copies FROM e GROUP BY homology)
SELECT {ELEMENT.format('homology')} AS element_id, members, species, copies, coalesce(near, 0)::BIGINT AS near, coalesce(within, 0)::BIGINT AS within_clade, coalesce(deep, 0)::BIGINT AS deep, round(best, 6) + 0.0 AS best_score, round(mean, 6) + 0.0 AS mean_score,
CASE WHEN coalesce(near, 0) + coalesce(within, 0) > 0 THEN 'progressive_supported' WHEN coalesce(deep, 0) > 0 THEN 'deep_only_support' WHEN species >= 2 THEN 'membership_supported_without_pair_score' ELSE 'single_tip_or_low_support' END AS progressive_call FROM g LEFT JOIN x USING (homology)""")
def progressive_elements(spark, d):
    """Members of every element and the matches between them by the distance of their species. Matches are joined to memberships on both ids, so no pairs within an element are formed. The mean is taken in millionths, rounded down."""
    t, r = resolved(spark, d)
    tips = _tips(t, r)
    dist = trees.tip_distances(trees.lifted(r, t), tips).select(C("left_tip").alias("l"), C("right_tip").alias("r"), F.round("distance", 6).alias("distance"))
    dist = dist.unionByName(tips.select(C("tip").alias("l"), C("tip").alias("r"), F.lit(0.0).alias("distance")))
    e = members(spark, d).filter("is_element")
    side = lambda x: e.select(C("homology").alias(f"{x}_h"), C("occ").alias(f"{x}_occ"), C("species").alias(f"{x}_sp"))
    m = matches(spark, d).filter("status IS NULL OR status <> 'unmapped'").select("q", "t", "total_score")
    s = m.join(side("a"), C("q") == C("a_occ")).join(side("b"), (C("t") == C("b_occ")) & (C("a_h") == C("b_h")))
    s = s.join(dist, C("a_sp").isNotNull() & C("b_sp").isNotNull() & (F.least("a_sp", "b_sp") == C("l")) & (F.greatest("a_sp", "b_sp") == C("r")), "left")
    tier = scoring.distance_tier(C("distance"))
    score = F.coalesce("total_score", F.lit(0.0))
    x = s.groupBy(C("a_h").alias("homology")).agg(F.count_if(tier == "nearest_species_support").alias("near"), F.count_if(tier == "within_clade_support").alias("within_clade"), F.count_if(tier == "deep_tree_support").alias("deep"), F.max(score).alias("best"), (F.expr("sum(cast(round(coalesce(total_score, 0D) * 1000000) AS bigint)) div count(*)") / 1_000_000).alias("mean"))
    g = e.groupBy("homology").agg(F.count("*").alias("members"), F.count_distinct("species").alias("species"), F.count_distinct(F.concat("species", F.lit(":"), "copy")).alias("copies"))
    n = lambda c: F.coalesce(c, F.lit(0))
    call = F.when(n("near") + n("within_clade") > 0, "progressive_supported").when(n("deep") > 0, "deep_only_support").when(C("species") >= 2, "membership_supported_without_pair_score").otherwise("single_tip_or_low_support")
    return g.join(x, "homology", "left").select(element_id(C("homology")).alias("element_id"), "members", "species", "copies", n("near").alias("near"), n("within_clade").alias("within_clade"), n("deep").alias("deep"), r6(C("best")).alias("best_score"), r6(C("mean")).alias("mean_score"), call.alias("progressive_call"))


QUERIES, SQL = query.queries, query.sql
