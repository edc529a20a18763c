"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) of each cell (source, language, topic) are raked to the target marginals. Targets
are given by the caller as weights of classes; without them a target is the observed marginal
tempered by an exponent under 1, so small classes gain. In each round the factors of sources,
languages and topics are set so that their marginal is met, until no factor moves by more than
TOLERANCE; where the targets contradict each other and rounds run out, a warning says by how
much they are missed. A document's sampling probability is proportional to its cell's weight per
token, capped at 1; the freed mass goes to the other cells until no further cell is capped, so
that the expected tokens are the budget. It is sampled if a keyed hash of its doc_id lies below
the probability, which is never rounded.

The topic of a text is a column `topic` if the table has one. Else the terms of TOPICS, in four
languages, are counted: the topic with most of them counts if it has MIN_TERMS, ties by the
smaller name. Texts without a topic are told apart by their form: table, markup or shouted, by
the share of pipes, symbols and capitals, else general.

Scale: one pass over texts; then one row per source with the tokens of its (language, topic)
pairs. A round is one partially aggregated pass over those rows, which sets the factors of all
sources and returns one number for each pair of language and topic; languages and topics are then
raked against each other to the end. Those pairs are all that the driver holds.

Defined cases: null source or language is the class ''; null or empty text has no tokens, is
`empty`, probability 0; texts of any length are taken whole; rows of equal doc_id share their
draw, and if one is sampled all are; a row without doc_id is never sampled; a class without a
given target has weight 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut, listed, passing_cuts, stable_unit
from tideline.llm.exprs import WORD, let

BUDGET, TOLERANCE, MAX_ROUNDS = 0.5, 1e-11, 100
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Terms of a topic in English, German, French and Spanish.
TOPICS = {
    "arts": "music film novel museum theatre painting musik roman gemälde musée théâtre música",
    "economy": "market bank price company investment trade markt preis unternehmen marché entreprise mercado",
    "health": "health patient doctor disease medicine hospital gesundheit krankheit santé maladie salud enfermedad",
    "law": "court law judge contract lawyer rights gericht gesetz tribunal loi ley juez",
    "politics": "government election president parliament minister party regierung wahl gouvernement élection gobierno elecciones",
    "science": "research theory experiment physics university study forschung theorie recherche théorie investigación ciencia",
    "sport": "football match team league player championship spieler mannschaft équipe joueur equipo jugador",
    "technology": "software computer internet algorithm network server rechner netzwerk logiciel ordinateur ordenador programa",
}
MIN_TERMS = 3
SEED = "mixing"

#: Weights of classes by dimension (source, lang, topic).
Targets = dict[str, dict[str, float]]


def blank(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def topic_of(text, tokens):
    """The topic of a text by its terms, else its form."""
    count = lambda r: F.regexp_count(text, F.lit(r))
    half = lambda r: 2 * count(r) >= tokens
    form = F.when(half("[|]"), "table").when(half("[#$%&*]{3}"), "markup").when(half("[A-Z]{4}"), "shouted").otherwise("general")
    every = [w for terms in TOPICS.values() for w in terms.split()]
    found = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(every))

    def best(hits):
        held = lambda terms: F.size(F.filter(hits, lambda w: w.isin(terms.split())))
        scored = F.array(*[F.struct((-held(terms)).alias("n"), F.lit(name).alias("name")) for name, terms in TOPICS.items()])
        return let(F.array_min(scored), lambda x: F.when(x["n"] <= -MIN_TERMS, x["name"]))

    themed = let(found, lambda hits: F.when(F.size(hits) >= MIN_TERMS, best(hits)))
    return F.coalesce(themed, form)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) per row of docs."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    topic = blank("topic") if "topic" in docs.columns else topic_of(text, tokens)
    return docs.select(F.col("doc_id").cast("long"), blank("source"), blank("lang"), F.when(tokens == 0, "empty").otherwise(topic).alias("topic"), tokens.alias("tokens"))


def goals(cells: DataFrame, dim: str, given: dict[str, float] | None) -> DataFrame:
    """(dim, goal): the tokens that each class of a dimension shall have; together all tokens."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("mass"))
    if given is None:
        share = F.pow("mass", F.lit(POWERS[dim]))
    else:
        table = listed(cells.sparkSession, [(k, repr(float(v))) for k, v in given.items()], f"{dim} string, weight double")
        sums, share = sums.join(table, dim, "left"), F.coalesce("weight", F.lit(0.0))
    whole = Window.partitionBy()
    if dim == "source":
        shares = sums.withColumn("share", share)
        total = shares.agg(F.sum("mass"), F.sum("share")).first()
        return shares.select(dim, (F.lit(total[0]) * F.col("share") / F.lit(total[1])).alias("goal")) if total[1] else shares.select(dim, F.lit(0.0).alias("goal"))
    return sums.select(dim, F.coalesce(F.try_divide(F.sum("mass").over(whole) * share, F.sum(share).over(whole)), F.lit(0.0)).alias("goal"))


def literal(values: np.ndarray):
    return F.expr("array(" + ",".join(f"{v!r}D" for v in values.tolist()) + ")")


def cell_rates(rows: DataFrame, targets: Targets | None = None) -> DataFrame | None:
    """(source, lang, topic, tokens, rate): raked weight per token of each cell with tokens."""
    spark, targets = rows.sparkSession, targets or {}
    cells = cut(rows.where("tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("tokens")))
    if cells.isEmpty():
        return None
    goal = {dim: {r[0]: r[1] for r in goals(cells, dim, targets.get(dim)).collect()} for dim in ("lang", "topic")}
    by_source = goals(cells, "source", targets.get("source"))
    if not (any(goal["lang"].values()) and any(goal["topic"].values()) and by_source.where("goal > 0").head(1)):
        raise ValueError("no class with a target occurs in the table")
    langs, topics = sorted(goal["lang"]), sorted(goal["topic"])
    number = lambda dim, names, to: listed(spark, [(x, str(k)) for k, x in enumerate(names)], f"{dim} string, {to} int")
    numbered = cells.join(number("lang", langs, "l"), "lang").join(number("topic", topics, "t"), "topic")
    grouped = numbered.groupBy("source").agg(F.collect_list(F.struct("l", "t", "tokens")).alias("cells"))
    table = cut(grouped.join(by_source, "source"))
    wanted = np.array([goal["lang"][x] for x in langs]), np.array([goal["topic"][x] for x in topics])
    b, c = np.ones(len(langs)), np.ones(len(topics))

    def own():
        """The factor of a source that meets its marginal; 0 where nothing can."""
        held = literal(b), literal(c)
        dot = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["tokens"] * F.get(held[0], x["l"]) * F.get(held[1], x["t"]))
        return F.when(dot > 0, F.col("goal") / dot).otherwise(0.0)

    for _ in range(MAX_ROUNDS):
        each = table.select(own().alias("a"), F.explode("cells").alias("x")).select("x.l", "x.t", (F.col("a") * F.col("x.tokens")).alias("v"))
        pairs = each.groupBy("l", "t").agg(F.sum("v").alias("v")).collect()
        new_b, new_c = rake(*(np.array([r[k] for r in pairs]) for k in range(3)), *wanted, b, c)
        change = max(moved(new_b, b), moved(new_c, c))
        b, c = new_b, new_c
        if change <= TOLERANCE:
            break
    else:
        warnings.warn(f"targets are not met within {MAX_ROUNDS} rounds; the last one moved a factor by {change:.1e}", stacklevel=2)
    rate = F.col("a") * F.get(literal(b), F.col("x.l")) * F.get(literal(c), F.col("x.t"))
    rates = table.withColumn("a", own()).select("source", "a", F.explode("cells").alias("x")).select("source", "x.l", "x.t", "x.tokens", rate.alias("rate"))
    return cut(rates.join(number("lang", langs, "l"), "l").join(number("topic", topics, "t"), "t").select("source", "lang", "topic", "tokens", "rate"))


def moved(new: np.ndarray, old: np.ndarray) -> float:
    """The greatest relative change of a factor."""
    return float(np.max(np.abs(new - old) / np.maximum(np.maximum(np.abs(new), np.abs(old)), 1e-300)))


def rake(l: np.ndarray, t: np.ndarray, v: np.ndarray, lang: np.ndarray, topic: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Factors of languages and topics that meet their marginals of the pairs (l, t, v), from given ones."""
    over = lambda goal, sums: np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)
    for _ in range(MAX_ROUNDS):
        old = c
        b = over(lang, np.bincount(l, v * c[t], len(lang)))
        c = over(topic, np.bincount(t, v * b[l], len(topic)))
        if moved(c, old) <= TOLERANCE / 10:
            break
    # one scale for both, so that rounds compare
    top = c.max()
    return b * top, c / top


def scale_of(rates: DataFrame, budget: float) -> float:
    """The number by which rates become probabilities, capped at 1, whose expected tokens are the budget."""
    goal, kappa, seen = budget * rates.agg(F.sum("tokens")).first()[0], 0.0, None
    while True:
        capped = F.lit(kappa) * F.col("rate") >= 1
        n, full, rest = rates.agg(F.sum(capped.cast("long")), F.sum(F.when(capped, F.col("tokens")).otherwise(0.0)), F.sum(F.when(~capped, F.col("tokens") * F.col("rate")).otherwise(0.0))).first()
        if not rest or n == seen:
            return kappa
        kappa, seen = max(kappa, (goal - full) / rest), n


def probabilities(docs: DataFrame, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, prob, sampled) per row of docs."""
    with passing_cuts(docs.sparkSession):
        rows = cut(measured(docs), result=True)
        rates, prob = cell_rates(rows, targets), F.lit(0.0)
        if rates is not None:
            kappa = scale_of(rates, budget)
            kept = cut(rates.select("source", "lang", "topic", F.least(F.lit(1.0), F.lit(kappa) * F.col("rate")).alias("p")), result=True)
            rows, prob = rows.join(kept, ["source", "lang", "topic"], "left"), F.coalesce("p", F.lit(0.0))
    out = rows.select("doc_id", "source", "lang", "topic", "tokens", prob.alias("prob"))
    return out.withColumn("sampled", F.coalesce(stable_unit(F.col("doc_id"), SEED) < F.col("prob"), F.lit(False)))


def rounded(docs: DataFrame) -> DataFrame:
    """The registered query: probabilities, shown to six places."""
    return probabilities(docs).withColumn("prob", F.round("prob", 6))


def mix(docs: DataFrame, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """The sampled documents, their columns, and prob (prob_ where docs has a prob, and so on)."""
    name = "prob"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    chosen = probabilities(docs, budget, targets).where("sampled").groupBy(F.col("doc_id").alias("__tl_id")).agg(F.max("prob").alias("__tl_prob"))
    joined = docs.withColumn("__tl_id", F.col("doc_id").cast("long")).join(chosen, "__tl_id")
    return joined.select(*docs.columns, F.col("__tl_prob").alias(name))


def oracle(docs_sql: str = "documents", budget: float = BUDGET, result: str | None = None, rounds: int = 40, caps: int = 8) -> str:
    """The same in SQL over a relation; enough rounds are unrolled."""
    power = lambda dim: f"power(sum(tokens), {POWERS[dim]})"
    goal = lambda dim: f"g_{dim} AS MATERIALIZED (SELECT {dim}, (SELECT sum(tokens) FROM cells) * {power(dim)} / sum({power(dim)}) OVER () AS goal FROM cells GROUP BY {dim})"
    topics = ", ".join(f"{{'n': len(list_filter(f, lambda x: x IN ({', '.join(map(repr, terms.split()))}))), 'name': '{name}'}}" for name, terms in TOPICS.items())
    every = ", ".join(repr(w) for terms in TOPICS.values() for w in terms.split())
    parts = [
        rf"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
  list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}]+'), lambda x: x IN ({every})) AS f FROM {docs_sql})""",
        f"best AS (SELECT *, list_sort([{topics}], 'DESC') AS scored FROM d)",
        f"""m AS MATERIALIZED (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'empty'
  WHEN scored[1].n >= {MIN_TERMS} THEN list_min(list_transform(list_filter(scored, lambda x: x.n = scored[1].n), lambda x: x.name))
  WHEN 2 * len(regexp_extract_all(text, '[|]')) >= tokens THEN 'table'
  WHEN 2 * len(regexp_extract_all(text, '[#$%&*]{{3}}')) >= tokens THEN 'markup'
  WHEN 2 * len(regexp_extract_all(text, '[A-Z]{{4}}')) >= tokens THEN 'shouted' ELSE 'general' END AS topic FROM best)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM m WHERE tokens > 0 GROUP BY ALL)",
        *(goal(dim) for dim in POWERS),
        "b0 AS (SELECT lang, 1.0::DOUBLE AS b FROM g_lang), c0 AS (SELECT topic, 1.0::DOUBLE AS c FROM g_topic)",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"a{k} AS MATERIALIZED (SELECT source, goal / sum(tokens * b * c) AS a FROM cells JOIN g_source USING (source) JOIN b{k - 1} USING (lang) JOIN c{k - 1} USING (topic) GROUP BY source, goal)",
            f"b{k} AS MATERIALIZED (SELECT lang, goal / sum(tokens * a * c) AS b FROM cells JOIN g_lang USING (lang) JOIN a{k} USING (source) JOIN c{k - 1} USING (topic) GROUP BY lang, goal)",
            f"c{k} AS MATERIALIZED (SELECT topic, goal / sum(tokens * a * b) AS c FROM cells JOIN g_topic USING (topic) JOIN a{k} USING (source) JOIN b{k} USING (lang) GROUP BY topic, goal)",
        ]
    parts += [
        f"a AS MATERIALIZED (SELECT source, goal / sum(tokens * b * c) AS a FROM cells JOIN g_source USING (source) JOIN b{rounds} USING (lang) JOIN c{rounds} USING (topic) GROUP BY source, goal)",
        f"r AS MATERIALIZED (SELECT source, lang, topic, tokens, a * b * c AS rate FROM cells JOIN a USING (source) JOIN b{rounds} USING (lang) JOIN c{rounds} USING (topic))",
        "k0 AS (SELECT 0.0::DOUBLE AS k)",
    ]
    for k in range(1, caps + 1):
        parts.append(f"k{k} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(k, ({budget} * total - filled) / rest) ELSE k END AS k FROM (SELECT any_value(k) AS k, sum(tokens) AS total, sum(CASE WHEN k * rate >= 1 THEN tokens ELSE 0 END) AS filled, sum(CASE WHEN k * rate >= 1 THEN 0 ELSE tokens * rate END) AS rest FROM r, k{k - 1}))")
    parts.append(f"p AS (SELECT doc_id, m.source, m.lang, m.topic, m.tokens, coalesce(least(1.0::DOUBLE, k * rate), 0.0::DOUBLE) AS p FROM m LEFT JOIN (SELECT source, lang, topic, rate, k FROM r, k{caps}) q ON m.source = q.source AND m.lang = q.lang AND m.topic = q.topic)")
    parts.append(f"o AS (SELECT *, round(p, 6) AS prob, CAST(('0x' || substr(md5('{SEED}:' || doc_id), 1, 13)) AS BIGINT) / power(16.0::DOUBLE, 13) < p AS sampled FROM p)")
    return "WITH " + ",\n".join(parts) + "\n" + (result or "SELECT doc_id, source, lang, topic, tokens, prob, sampled FROM o")
