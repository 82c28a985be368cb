"""Mixing sources to target weights by hierarchical budgeting (native).

Leaves are (domain, language, source). Each holds at most max_epochs times its tokens. From the root
down, a node's budget is divided among its children in proportion to their weights; a child that holds
less than its share keeps what it holds and its siblings share the rest, by weight again. As a node's
holding is the sum of its leaves', a shortage is made up by siblings first and reaches an ancestor's
siblings only when the whole subtree is used up. Shares are whole tokens, rounded down.

A leaf's budget buys whole epochs and then a prefix of one more: documents in the order of
md5(seed:epoch:doc_id) while their tokens fit. The prefix is stored as the first digest that does not
fit, so applying the plan to documents needs one small table and moves no text.

Defined results: null language or source is the leaf part '(none)'; null and empty texts hold 0 tokens
and come with their prefix; documents repeated with one doc_id are taken or left together within an
epoch; a node without a weight weighs 1, one of weight 0 gets nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import attach, cut, packed, ranked, table

SEED = 17
#: Target weights, whole numbers: any domain, language or source that is not named weighs 1.
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "forum": 20, "code": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
#: Share of all tokens that the mixture has, in hundredths.
BUDGET_PERCENT = 90
MAX_EPOCHS = 2
DOMAINS = ("web", "books", "forum", "code")
SEPARATOR = "\x1f"


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number modulo four."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number % 4 + 1).cast("int"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """_doc (the document's columns), _domain, _lang, _source, _leaf and _tokens of docs."""
    source = F.coalesce(F.col("_doc.source").cast("string"), F.lit("(none)"))
    lang = F.coalesce(F.col("_doc.lang").cast("string"), F.lit("(none)"))
    return packed(docs).withColumns({
        "_domain": domain_of(source), "_lang": lang, "_source": source,
        "_leaf": F.concat_ws(SEPARATOR, domain_of(source), lang, source),
        "_tokens": F.regexp_count(F.coalesce(F.col("_doc.text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    })


def weighted(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for k, w in weights.items():
        out = F.when(F.col(name) == k, F.lit(w).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent columns, name, w, held, budget of the parent as given) with got: each node's own budget."""
    order = [F.when(F.col("w") > 0, F.col("held") / F.col("w")).otherwise(F.lit(0.0)), F.col(name)]
    each = Window.partitionBy(*parent, F.lit(0)) if not parent else Window.partitionBy(*parent)
    before = each.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    can = F.when(F.col("w") > 0, F.col("held")).otherwise(F.lit(0).cast("long"))
    stepped = nodes.withColumn("can", can).withColumns({
        "can_before": F.coalesce(F.sum("can").over(before), F.lit(0)),
        "w_left": F.sum("w").over(each) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    full = (F.col("w") == 0) | (F.col("can") * F.col("w_left") <= F.col("w") * (F.col("given") - F.col("can_before")))
    marked = stepped.withColumn("full", full)
    rest = marked.withColumns({
        "full_can": F.sum(F.when(F.col("full"), F.col("can")).otherwise(F.lit(0))).over(each),
        "open_w": F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(each),
    })
    got = F.when(F.col("full"), F.col("can")).otherwise(F.expr("(w * (given - full_can)) div open_w"))
    return rest.withColumn("got", got).drop("can", "can_before", "w_left", "full", "full_can", "open_w", "given")


def budgets(leaf: DataFrame, percent: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaf (domain, lang, source, tokens) with budget, from the root down."""
    levels = ["domain", "lang", "source"]
    held = leaf.withColumn("held", F.col("tokens") * max_epochs)
    given = leaf.agg(F.expr(f"coalesce(sum(tokens), 0L) * {int(percent)} div 100").alias("given"))
    above: DataFrame | None = None
    for k, name in enumerate(levels):
        key, parent = levels[: k + 1], levels[:k]
        nodes = held.groupBy(*key).agg(F.sum("held").alias("held")).withColumn("w", weighted(name, weights.get(name, {})))
        if above is None:
            nodes = nodes.join(F.broadcast(given))  # one row
        else:
            nodes = nodes.join(above.select(*parent, F.col("got").alias("given")), parent)
        above = share_out(nodes, parent, name)
    return leaf.join(above.select(*levels, F.col("got").alias("budget")), levels)


def mixing_plan(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """One row per leaf: leaf, domain, lang, source, tokens, n, budget, epochs (whole ones) and stop (first digest left out; null: none)."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    rows = leaves_of(docs).select(
        F.col("_doc.doc_id").cast("string").alias("id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"),
        F.col("_source").alias("source"), F.col("_leaf").alias("leaf"), F.col("_tokens").alias("n_tokens"),
    )
    rows = cut(rows, "mixing-rows")
    total = rows.count()
    leaf = rows.groupBy("domain", "lang", "source", "leaf").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    planned = cut(
        budgets(cut(leaf, "mixing-leaves"), percent, max_epochs, weights)
        .withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0L END"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")),
        "mixing-budgets",
    )
    # rows of one doc_id share a digest and are taken or left together: they are one row before any is ranked
    one = rows.groupBy("leaf", "id").agg(F.sum("n_tokens").alias("n_tokens"))
    ordered = attach(one, planned.select("leaf", "n", "epochs", "rest"), "leaf", "n", total).withColumn(
        "digest", digest(F.col("epochs"), F.col("id"), seed)
    )
    sums = ranked(ordered, ["leaf"], F.col("digest"), total, add=F.col("n_tokens"), unique=["id"])
    stops = sums.groupBy("leaf").agg(F.min(F.when(F.col("before") + F.col("n_tokens") > F.col("rest"), F.col("digest"))).alias("stop"))
    return cut(planned.join(stops, "leaf"), "mixing-plan")


def digest(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("(none)"))))


def mix(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """_doc (the document's columns), _domain, _lang, _source, _leaf, _tokens and epoch: a row for each epoch in which a document is taken."""
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = attach(leaves_of(docs), plan.select(F.col("leaf").alias("_leaf"), F.col("n").alias("_n"), F.col("epochs").alias("_epochs"), F.col("stop").alias("_stop")), "_leaf", "_n", total)
    extra = F.col("_stop").isNull() | (digest(F.col("_epochs"), F.col("_doc.doc_id"), seed) < F.col("_stop"))
    times = F.col("_epochs") + F.when(extra, 1).otherwise(0)
    return named.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = mix(docs, mixing_plan(docs))
    return taken.select("_doc.doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), "epoch")


def _cases(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


def _level_sql(name: str, parent: str, key: str, weight: str, given: str) -> str:
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_n AS (SELECT {key}, sum(tokens) * {MAX_EPOCHS} AS held, {weight} AS w FROM leaf GROUP BY {key}),
{name}_g AS (SELECT x.*, {given}),
{name}_s AS (SELECT *, coalesce(sum(held) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS can_before,
  sum(w) OVER ({over}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM {name}_g WINDOW o AS ({over} ORDER BY held / w, {name})),
{name}_f AS (SELECT *, held * w_left <= w * (given - can_before) AS is_full FROM {name}_s),
{name}_b AS (SELECT *, CASE WHEN is_full THEN held ELSE
  w * (given - sum(CASE WHEN is_full THEN held ELSE 0 END) OVER ({over})) // greatest(1, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({over})) END AS got FROM {name}_f)"""


def sql(source: str = "documents", percent: int = BUDGET_PERCENT, prefix: str = "") -> str:
    """DuckDB SQL of the mixture over a relation; ends with the CTE taken(doc_id, ..., epoch)."""
    rows = f"""
doc AS (SELECT doc_id, text, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
  list_extract(['web', 'books', 'forum', 'code'], coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}'), '') AS BIGINT), 0) % 4 + 1) AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {source}),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM doc GROUP BY ALL),"""
    one = _level_sql("domain", "", "domain", _cases("domain", DOMAIN_WEIGHTS), f"(SELECT coalesce(sum(tokens), 0) * {percent} // 100 FROM leaf) AS given FROM domain_n x")
    two = _level_sql("lang", "domain", "domain, lang", _cases("lang", LANG_WEIGHTS), "p.got AS given FROM lang_n x JOIN domain_b p USING (domain)")
    three = _level_sql("source", "domain, lang", "domain, lang, source", "1", "p.got AS given FROM source_n x JOIN lang_b p USING (domain, lang)")
    return f"""{rows}{one},{two},{three},
planned AS (SELECT l.*, b.got AS budget, CASE WHEN tokens > 0 THEN b.got // tokens ELSE 0 END AS epochs FROM leaf l JOIN source_b b USING (domain, lang, source)),
placed AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest,
  md5('{SEED}:' || CAST(p.epochs AS BIGINT) || ':' || d.doc_id) AS digest FROM doc d JOIN planned p USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest) AS upto FROM placed),
taken AS (SELECT doc_id, text, domain, lang, source, n_tokens,
  unnest(range(CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM summed)"""


OP7_SQL = f"WITH {sql()} SELECT doc_id, domain, lang, source, n_tokens, epoch FROM taken"
