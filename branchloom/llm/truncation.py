"""Texts cut off before their author's end, found by counting word trigrams inside texts and at their ends, in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchloom.plans import skew
from branchloom.plans.lineage import materialize

#: A word is common if it stands in this share of the texts (and in MIN_WORD_TEXTS at least); the rest are known by their shape only.
COMMON_SHARE = 0.02
MIN_WORD_TEXTS = 5
#: A pattern is judged from this share of the source's texts on (and MIN_PATTERN at least).
PATTERN_SHARE = 0.0005
MIN_PATTERN = 8
#: "Almost never terminal": it ends a text less than this many times as often as any token of the source does.
TERMINAL_LIFT = 0.5
#: A token that ends texts this many times as often as any token is an ending by itself, as a full stop is.
CLOSING_LIFT = 2.0
#: Texts that an ending of its kind would have closed at this frequency, for a pattern that closes none to be judged.
MISSED_ENDINGS = 12
#: Any other last token must show that its pattern ends texts: the share of terminal occurrences, less chance and the
#: text itself, must reach SURE_ENDING, or STRONG_ENDING after weighting with the token's lift.
SURE_ENDING = 0.3
STRONG_ENDING = 0.05
#: A shorter word is no beginning of a longer one if it stands itself in this share of the longer one's places.
OWN_WORD = 0.01

# Marks that say a text goes on elsewhere, as regular expressions.
DOTS = [r"\.\.", "…"]
BRACKETS = [r"\[\s*(?:\.{2,}|…)\s*\]", r"\(\s*(?:\.{2,}|…)\s*\)", r"[\[(<]\s*(?:cut|more|truncated|continued|cont\.?|snip|read more|to be continued)\s*[\])>]"]
# Remains of a character or escape that was cut or damaged.
DAMAGE = ["�+", r"\\u[0-9a-fA-F]{0,4}", r"\\x[0-9a-fA-F]{0,2}", r"&(?:#x?[0-9a-fA-F]*|[a-zA-Z]{1,8})", r"%[0-9a-fA-F]?"]
# Texts that stand for no text.
FILLERS = ["", "n/a", "na", ".", "-", "--", "none", "null", "nil", "tbd", "todo", "test", "lorem ipsum", "empty", "xxx", "?", "..."]

TOKEN = r"\p{L}[\p{L}\p{M}]*|[0-9]+|\n|[^\s\p{L}0-9]"
#: Characters at the end of a text whose tokens are cut first; any length gives the same result.
TAIL = 96
#: Characters a single mark may take.
MARK_SPAN = 64
#: A kind of mark counts as a sign of a cut if this share of the texts that carry it stop, before the mark, where texts
#: don't end by the counts; PRIOR_TEXTS are added as if seen so, since that is what the marks are made for.
MARK_SHARE = 0.25
PRIOR_TEXTS = 8
#: A longer token is no word; it is known by its shape.
LONGEST_WORD = 64
BLANKS = r"' \t\r\n'"


@dataclass
class Truncation:
    """``documents``: item, source, truncated, reason. ``sources``: source, n_texts, n_truncated, truncated_share."""

    documents: DataFrame
    sources: DataFrame


def _text(s: str) -> str:
    """SQL literal of a text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_truncated(docs: DataFrame, item: str, text: str, source: str, terminal_lift: float = TERMINAL_LIFT, pattern_share: float = PATTERN_SHARE, min_pattern: int = MIN_PATTERN, common_share: float = COMMON_SHARE, min_word_texts: int = MIN_WORD_TEXTS, hot_rows: int = skew.HOT_ROWS) -> Truncation:
    """Judge every document by the trigram it ends with.

    Texts are cut into words, numbers (known by their length), signs and line
    ends. Words that stand in few texts are known by their shape only, so that
    names share one pattern. Every trigram is counted per source, inside
    (something follows) and terminal (the text ends), both over the same texts:
    equal texts of a source count once, marked ones not at all. A text is cut
    off if its last trigram is frequent inside and almost never terminal. A
    last word that a frequent trigram with the same beginning continues
    (`restor` for `restored`) is cut inside. Where a source shows a trigram too
    rarely, its last two tokens decide, then the last one, then all sources
    together. Marks of continuation and damaged characters at the end are taken
    off first and weighed by the same counts: a kind of mark makes its texts
    cut off if enough of the texts that carry it stop where texts don't end.

    Texts are tokenized once, the tokens are written and every count comes from
    them. The common tokens are put into the plan as one set; their number is
    bounded by the distinct tokens of a mean text over ``common_share``,
    whatever the number of texts.

    Defined results: null, empty, blank and filler texts are never cut off;
    a missing source is a source of its own; with too few texts to know any
    pattern only marks and damage decide; no rows give no rows.
    """
    spark = docs.sparkSession
    tag = uuid.uuid4().hex[:8]
    made: list[str] = []

    def view(name: str, df: DataFrame) -> str:
        made.append(f"cut_{name}_{tag}")
        df.createOrReplaceTempView(made[-1])
        return made[-1]

    try:
        return _judge(spark, view, docs.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"), F.col(f"`{text}`").alias("raw")), terminal_lift, pattern_share, min_pattern, common_share, min_word_texts, hot_rows)
    finally:
        for name in made:  # the plans made from them stay valid
            spark.catalog.dropTempView(name)


def _tokens(part: str) -> str:
    """SQL for the tokens of a text; numbers keep their length up to three."""
    return f"transform(regexp_extract_all({part}, {_text(TOKEN)}, 0), w -> CASE WHEN w >= '0' AND w < ':' THEN repeat('0', least(3, length(w))) ELSE w END)"


def _at_end(parts: list[str]) -> str:
    return _text(rf"(?s)(?:{'|'.join(parts)})\s*$")


def _kind() -> str:
    """SQL for the kind of mark a text ends with."""
    tail = f"right(trimmed, {MARK_SPAN})"
    return f"CASE WHEN {tail} RLIKE {_at_end(DOTS)} THEN 'dots' WHEN {tail} RLIKE {_at_end(BRACKETS)} THEN 'bracket' WHEN {tail} RLIKE {_at_end(DAMAGE)} THEN 'damage' END"


def _bodies(texts: str) -> str:
    """SQL for item, source, mark and the text without its marks.

    A marked text is in no count; its rest is only looked at where it ends, so a few rounds on its end are enough.
    """
    sql = f"SELECT item, source, mark, trimmed, CASE WHEN mark IS NOT NULL THEN rtrim('.…� \\t\\r\\n', trimmed) END AS r FROM {texts}"
    for _ in range(2):
        end = f"right(r, {MARK_SPAN})"
        sql = f"SELECT item, source, mark, trimmed, CASE WHEN mark IS NOT NULL THEN rtrim('.…� \\t\\r\\n', concat(left(r, length(r) - length({end})), regexp_replace({end}, {_at_end(BRACKETS + DAMAGE)}, ''))) END AS r FROM ({sql})"
    return f"(SELECT item, source, mark, coalesce(r, trimmed) AS body FROM ({sql}))"


def _judge(spark: SparkSession, view: Callable[[str, DataFrame], str], rows: DataFrame, terminal_lift: float, pattern_share: float, min_pattern: int, common_share: float, min_word_texts: int, hot_rows: int) -> Truncation:
    base = view("base", rows)
    filler = f"lower(trim({BLANKS}, trimmed)) IN ({', '.join(_text(x) for x in FILLERS)})"
    texts = view("texts", spark.sql(f"SELECT item, source, trimmed, {_kind()} AS mark FROM (SELECT item, source, rtrim({BLANKS}, raw) AS trimmed FROM {base}) WHERE NOT {filler}"))
    # all counts, sizes and floors are taken over these rows: a text counts once per source, however many copies it has,
    # and one that carries a mark takes no part, as it tells nothing about how texts end; two empty tokens stand before the first
    words = view("words", materialize(spark.sql(f"SELECT source, concat(array('', ''), {_tokens('body')}) AS t FROM (SELECT DISTINCT source, trimmed AS body FROM {texts} WHERE mark IS NULL)"), "tokens"))
    # the last three tokens of a text are those of its tail, if that has more than three; else the whole text is cut
    tails = view("tails", materialize(spark.sql(f"""
      SELECT item, source, xxhash64(body) AS copy, mark, slice(concat(array('', ''), CASE WHEN size(tail) > 3 THEN tail ELSE {_tokens('body')} END), -3, 3) AS t
      FROM (SELECT *, {_tokens(f'right(body, {TAIL})')} AS tail FROM {_bodies(texts)})"""), "tails"))
    per_source = materialize(spark.sql(f"SELECT source, count(*) AS n FROM {words} GROUP BY source"), "source_sizes")
    n_texts = per_source.agg(F.sum("n")).first()[0] or 0
    floor_all = max(min_pattern, pattern_share * n_texts)
    floors = view("floors", per_source.selectExpr("source", f"greatest({min_pattern}, {pattern_share} * n) AS floor"))
    common = [r.w for r in spark.sql(f"""
      SELECT w FROM (SELECT explode(array_distinct(t)) AS w FROM {words})
      WHERE w <> '' AND length(w) <= {LONGEST_WORD} GROUP BY w HAVING count(*) >= {max(min_word_texts, common_share * n_texts)}""").collect()]
    known = ", ".join(_text(w) for w in sorted(common) or [""])

    def shaped(tokens: str) -> str:
        """Rare words by their shape."""
        return f"transform({tokens}, w -> CASE WHEN w IN ({known}) THEN w WHEN lower(w) = upper(w) THEN left(w, {LONGEST_WORD}) WHEN left(w, 1) <> lower(left(w, 1)) THEN 'Xx' ELSE 'xx' END)"

    # the trigram that ends the text is left out here and counted below
    inside = spark.sql(f"""
      SELECT source, a, b, c, count(*) AS inside, CAST(0 AS bigint) AS terminal FROM (
        SELECT source, inline(arrays_zip(a, b, c)) AS (a, b, c) FROM (
          SELECT source, slice(s, 1, size(s) - 3) AS a, slice(s, 2, size(s) - 3) AS b, slice(s, 3, size(s) - 3) AS c
          FROM (SELECT source, {shaped('t')} AS s FROM {words} WHERE size(t) > 3))) GROUP BY source, a, b, c""")
    ends = view("ends", materialize(spark.sql(f"SELECT item, source, copy, mark, t[2] AS word, s[0] AS a, s[1] AS b, s[2] AS c FROM (SELECT *, {shaped('t')} AS s FROM {tails} WHERE size(t) = 3)"), "ends"))
    terminal = spark.sql(f"SELECT source, a, b, c, CAST(0 AS bigint) AS inside, count(DISTINCT copy) AS terminal FROM {ends} WHERE mark IS NULL GROUP BY source, a, b, c")

    def folded(rows: str | DataFrame, by: str, label: str) -> str:
        df = rows if isinstance(rows, DataFrame) else spark.table(rows)
        keys = by.split(", ")
        return view(label, materialize(df.groupBy(*keys).agg(F.sum("inside").alias("inside"), F.sum("terminal").alias("terminal")), label))

    # each coarser level is folded from the next finer one
    tri = folded(inside.unionByName(terminal), "source, a, b, c", "tri")
    fold = {"source, a, b, c": tri, "source, b, c": folded(tri, "source, b, c", "pairs"), "a, b, c": folded(tri, "a, b, c", "tri_all")}
    fold["source, c"] = folded(fold["source, b, c"], "source, c", "ones")
    fold["b, c"] = folded(fold["source, b, c"], "b, c", "pairs_all")
    fold["c"] = folded(fold["source, c"], "c", "ones_all")
    asked = view("asked", spark.sql(f"SELECT DISTINCT source, a, b, c, word FROM {ends}"))
    bases = view("bases", spark.sql(f"SELECT source, sum(terminal) / sum(inside + terminal) AS base FROM {fold['source, c']} GROUP BY source"))
    base_all = float(spark.sql(f"SELECT sum(terminal) / sum(inside + terminal) FROM {fold['c']}").first()[0] or 0.0)

    def level(by: str) -> str:
        """Inside and terminal occurrences of every pattern that is frequent enough, and how often any token ends a text there."""
        if "source" not in by:
            return f"(SELECT {by}, inside AS i, terminal AS t, CAST({base_all!r} AS double) AS base FROM {fold[by]} WHERE inside + terminal >= {floor_all})"
        return f"(SELECT {by}, inside AS i, terminal AS t, base FROM {fold[by]} JOIN {floors} USING (source) JOIN {bases} USING (source) WHERE inside + terminal >= floor)"

    def continued(by: str, place: str) -> str:
        """Last words that are the beginning of a longer one in the same place, and hardly ever stand there themselves. Longer words give all their beginnings, so this is a join of equals."""
        seen = f"(SELECT {place}, c, inside AS longer_n, inside + greatest(0, terminal - 1 - sqrt(terminal)) AS n FROM {fold[by]})"
        same = lambda x: " AND ".join(f"q.{c} = {x}.{c}" for c in place.split(", "))
        starts = f"""(SELECT {place}, start, min(longer_n) AS longer_n FROM (SELECT {place}, longer_n, explode(transform(sequence(1, length(c) - 1), i -> left(c, i))) AS start
          FROM {seen} WHERE longer_n >= {floor_all} AND length(c) > 1 AND c NOT IN ('xx', 'Xx')) GROUP BY {place}, start)"""
        return f"""SELECT q.source, q.a, q.b, q.c, q.word FROM {asked} q JOIN {starts} l ON {same('l')} AND q.word = l.start
        LEFT JOIN {seen} o ON {same('o')} AND q.word = o.c
        WHERE q.word RLIKE '^[\\\\p{{L}}0-9]' AND coalesce(o.n, 0) < {OWN_WORD} * l.longer_n"""

    levels = {"s3": "source, a, b, c", "s2": "source, b, c", "s1": "source, c", "a3": "a, b, c", "a2": "b, c", "a1": "c"}
    joins = "\n".join(f"LEFT JOIN {level(by)} {name} ON " + " AND ".join(f"q.{c} = {name}.{c}" for c in by.split(", ")) for name, by in levels.items())
    lift = lambda at: f"greatest(0, {at}.t - 1 - sqrt({at}.t)) / ({at}.i + {at}.t) / {at}.base"
    verdicts = spark.sql(f"""
      SELECT struct(q.source, q.a, q.b, q.c, q.word) AS v_key, k.word IS NOT NULL AS inside_word,
             greatest(coalesce(s1.t / (s1.i + s1.t), a1.t / (a1.i + a1.t)), s2.t / (s2.i + s2.t)) AS token_share, coalesce((s2.t - 1 - sqrt(s2.t)) / (s2.i + s2.t) / s2.base, 0) AS pair_lift, coalesce(a1.t / (a1.i + a1.t), 0) AS a_share, CASE WHEN (s1.i + s1.t) * s1.base >= {MISSED_ENDINGS} THEN {lift('s1')} ELSE greatest({lift('s1')}, {lift('a1')}) END AS token_lift,
             {', '.join(f'{n}.i AS {n}i, {n}.t AS {n}t, {n}.base AS {n}b' for n in levels)}
      FROM {asked} q {joins}
      LEFT JOIN ({continued('a, b, c', 'a, b')} UNION {continued('b, c', 'b')}) k ON q.source = k.source AND q.a = k.a AND q.b = k.b AND q.c = k.c AND q.word = k.word""")

    def never(at: str) -> str:
        """Frequent inside and almost never terminal, although its last token closes texts elsewhere."""
        return f"(({at}t - 1 - sqrt({at}t)) / ({at}i + {at}t) < {terminal_lift} * {at}b AND {at}i * {'token_share' if at[0] == 's' else 'a_share'} >= {MISSED_ENDINGS})"

    def sure(at: str) -> str:
        share = f"(({at}t - 1 - sqrt({at}t)) / ({at}i + {at}t))"
        return f"({share} >= {terminal_lift} * {at}b AND ({share} >= {SURE_ENDING} OR {share} * least(1, token_lift) >= {STRONG_ENDING}))"

    why = {"s3": "trigram", "s2": "bigram", "s1": "token", "a3": "trigram of all sources", "a2": "bigram of all sources", "a1": "token of all sources"}
    closing = f"CASE WHEN s3i IS NOT NULL THEN CASE WHEN {never('s3')} THEN '{why['s3']}' END WHEN {never('a3')} THEN '{why['a3']}' END"
    other = " ".join(["CASE WHEN", sure("s3"), "THEN NULL", *[f"WHEN {n}i IS NOT NULL THEN CASE WHEN NOT {sure(n)} THEN '{why[n]}' END" for n in levels], "END"])
    rule = f"CASE WHEN inside_word THEN 'inside a word' WHEN greatest(token_lift, pair_lift) >= {CLOSING_LIFT} THEN {closing} ELSE {other} END"
    verdicts = verdicts.withColumn("why", F.expr(rule))
    verdicts = verdicts.select("v_key", "why")
    verdicts = materialize(verdicts, "verdicts")
    keyed = spark.table(ends).select("item", "source", "mark", F.struct("source", "a", "b", "c", "word").alias("key"))
    judged = materialize(skew.salted_join(keyed, verdicts, "key", "v_key", "left", hot_rows, spread="item").select("item", "source", "mark", "why"), "judged")
    weights = judged.filter("mark IS NOT NULL").groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count("why").alias("cut")).collect()  # one row per kind
    weak = [r.mark for r in weights if (r.cut + PRIOR_TEXTS) / (r.n + PRIOR_TEXTS) < MARK_SHARE]
    marked = F.col("mark").isNotNull() & ~F.col("mark").isin(weak) if weak else F.col("mark").isNotNull()
    told = judged.select("item", "source", F.coalesce("why", F.when(marked, F.lit("mark"))).alias("reason"))
    rest = spark.sql(f"SELECT item, source, CAST(NULL AS string) AS reason FROM (SELECT *, rtrim({BLANKS}, raw) AS trimmed FROM {base}) WHERE raw IS NULL OR {filler}")
    few = spark.sql(f"SELECT item, source, mark FROM {tails} WHERE size(t) < 3").select("item", "source", F.when(marked, F.lit("mark")).alias("reason"))
    documents = told.unionByName(rest).unionByName(few).select("item", "source", F.col("reason").isNotNull().alias("truncated"), "reason")
    sources = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated")).withColumn("truncated_share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
    return Truncation(documents, sources)
