"""Wording: a greedy phrase matcher over a dictionary that is a parameter, category scores and summaries.

The dictionary is a table (category, tier, phrase), tier strong or broad. It is compiled once and broadcast;
it is small by nature, and MOST_PHRASES is checked. Texts are matched whole, one pass each, in an Arrow-batched UDF,
because which match wins depends on those before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import fixed

MOST_PHRASES = 200_000
WORD = re.compile(r"[^\W_]+(?:'[^\W\d_]+)*")
QUOTES = str.maketrans({"’": "'", "‘": "'", "`": "'"})
#: Patterns read texts with plain quotes and blanks, at the same places.
PLAIN = QUOTES | dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF], " ")
MATCH = "array<struct<category:string,tier:string,start:int,length:int,phrase:string>>"

#: A starting dictionary; deployments pass their own table.
PHRASES = {
    "urgency": ["act now", "immediate action", "within 24 hours", "final notice", "expires today", "last warning"],
    "authority": ["your account has been suspended", "legal action", "law enforcement", "compliance department", "court order"],
    "financial": ["bank details", "outstanding balance", "overdue invoice", "refund is pending", "payment failed"],
    "credential": ["confirm your password", "verify your account", "update your login", "unusual sign-in", "validate your mailbox"],
    "bec": ["wire transfer", "gift card", "cannot talk", "keep this confidential", "change of bank details", "urgent payment"],
    "lure": ["won a prize", "claim your reward", "free gift", "exclusive offer", "lucky winner"],
    "advancefee": ["processing fee", "next of kin", "unclaimed fund", "inheritance", "release of the fund", "beneficiary"],
    "social": ["click the link below", "call this number", "remote session", "do not ignore"],
    "extortion": ["recorded you", "your webcam", "send bitcoin", "pay the ransom", "your secret"],
}
PATTERNS = fixed.LANGUAGE_PATTERNS

#: Words a worker remembers as beginnings of phrases or none.
REMEMBERED = 200_000


def default_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, "strong", p) for c, ps in PHRASES.items() for p in ps], "category string, tier string, phrase string")


def normal(token: str) -> str:
    token = token.lower().translate(QUOTES)
    return token[:-2] if token.endswith("'s") else token


def words(text: str) -> list[tuple[str, int, int]]:
    return [(normal(m[0]), m.start(), m.end()) for m in WORD.finditer(text.translate(QUOTES))]


def singulars(token: str) -> list[str]:
    out = [token]
    if len(token) > 3 and token.endswith("ies"):
        out.append(token[:-3] + "y")
    if len(token) > 3 and token.endswith("es"):
        out.append(token[:-2])
    if len(token) > 2 and token.endswith("s"):
        out.append(token[:-1])
    return out


class Matcher:
    """Phrases as a trie of words, a leaf for each (category, tier)."""

    def __init__(self, phrases: list[tuple[str, str, str]], patterns: list[tuple[str, str, str]] = ()) -> None:
        self.root: dict = {}
        for category, tier, phrase in phrases:
            tokens = [w for w, _, _ in words(phrase)]
            if tokens:
                node = self.root
                for w in tokens:
                    node = node.setdefault(w, {})
                node.setdefault(None, set()).add((category, tier))
        self.patterns = [(c, t, re.compile(p, re.ASCII)) for c, t, p in patterns]
        self.begins: dict[str, bool] = {}

    def may_begin(self, token: str) -> bool:
        """Whether a phrase begins with this word; remembered, as texts share most words."""
        known = self.begins.get(token)
        if known is None:
            known = any(form in self.root for form in singulars(token))
            if len(self.begins) < REMEMBERED:
                self.begins[token] = known
        return known

    def at(self, found: list, i: int) -> dict[str, tuple[bool, int, int]]:
        """Best match by category that begins at word i: (strong, characters, words)."""
        best: dict[str, tuple[bool, int, int]] = {}
        begin = found[i][1]

        def leaf(node: dict, last: int) -> None:
            for category, tier in node.get(None, ()):
                one = (tier == "strong", found[last][2] - begin, last - i + 1)
                if category not in best or one[:2] > best[category][:2]:
                    best[category] = one

        node, j = self.root, i
        while node is not None and j < len(found):
            for form in singulars(found[j][0]):
                if (end := node.get(form)) is not None:
                    leaf(end, j)
            node, j = node.get(found[j][0]), j + 1
        return best

    def matches(self, text: str) -> list[tuple[str, str, int, int, str]]:
        """(category, tier, start, length, phrase) in order of category and place, without overlaps in a category."""
        found, free, by = words(text), {}, {}
        for i in [k for k, w in enumerate(found) if self.may_begin(w[0])]:
            for category, (strong, length, n) in self.at(found, i).items():
                if free.get(category, 0) <= i:
                    by.setdefault(category, []).append(("strong" if strong else "broad", found[i][1], length))
                    free[category] = i + n
        plain = text.translate(PLAIN) if self.patterns else text
        for category, tier, pattern in self.patterns:
            for m in pattern.finditer(plain):
                phrase = m[0].strip()
                if phrase:
                    by.setdefault(category, []).append((tier, m.start() + m[0].index(phrase), len(phrase)))
        out = []
        for category in sorted(by):
            kept: list = []
            for tier, start, length in sorted(by[category], key=lambda x: (x[1], -x[2])):
                if kept and start < kept[-1][1] + kept[-1][2]:
                    if (tier == "strong", length) > (kept[-1][0] == "strong", kept[-1][2]):
                        kept[-1] = (tier, start, length)
                else:
                    kept.append((tier, start, length))
            out += [(category, t, s, n, text[s : s + n]) for t, s, n in kept]
        return out


def matcher(dictionary: DataFrame, patterns: list[tuple[str, str, str]] = PATTERNS) -> Matcher:
    rows = dictionary.select("category", "tier", "phrase").limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"the dictionary has more than {MOST_PHRASES} phrases")
    return Matcher([tuple(r) for r in rows if r["phrase"]], list(patterns))


def match(rows: DataFrame, column: str, dictionary: DataFrame, patterns: list[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """rows with matches: array of (category, tier, start, length, phrase); offsets are code points, null texts have none."""
    shared = rows.sparkSession.sparkContext.broadcast(matcher(dictionary, patterns))  # bounded by MOST_PHRASES

    @F.pandas_udf(MATCH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            place, once = pd.factorize(texts)
            found = pd.Series([[dict(zip(("category", "tier", "start", "length", "phrase"), m)) for m in own.matches(t or "")] for t in once], dtype=object)
            yield found.take(place).reset_index(drop=True)

    return rows.withColumn("matches", run(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def scores(matched: DataFrame, key: list[str]) -> DataFrame:
    """key, category, strong, broad, score of each category with matches, within the row: nothing is shuffled."""
    weight = F.lit(1.0)
    for name, (w, _) in fixed.LANGUAGE_WEIGHTS.items():
        weight = F.when(F.col("category") == name, F.lit(w)).otherwise(weight)
    of = lambda tier: F.size(F.filter("matches", lambda m: (m["category"] == F.col("category")) & (m["tier"] == tier))).cast("long")
    each = matched.select(*key, "matches", F.explode(F.array_distinct(F.transform("matches", lambda m: m["category"]))).alias("category"))
    counted = each.select(*key, "category", of("strong").alias("strong"), of("broad").alias("broad"))
    return counted.withColumn("score", F.floor(F.least(F.col("strong") * weight * 10, F.lit(100.0)) + 0.5).cast("long"))


def summary(matched: Column) -> Column:
    """Map of category to strong phrases."""
    own = F.filter(matched, lambda m: m["tier"] == "strong")
    kinds = F.array_distinct(F.transform(own, lambda m: m["category"]))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(own, lambda m: m["category"] == k))))


#: Categories whose strong phrases make the wording a high risk by themselves.
BAD = ["credential", "financial", "bec", "extortion", "advancefee"]


def groups(matched: Column) -> Column:
    """array of struct(category, strong, broad): most strong phrases first, then most broad ones, then by name."""
    kinds = F.array_distinct(F.transform(matched, lambda m: m["category"]))
    n = lambda k, tier: F.size(F.filter(matched, lambda m: (m["category"] == k) & (m["tier"] == tier)))
    ranked = F.array_sort(F.transform(kinds, lambda k: F.struct((-n(k, "strong")).alias("a"), (-n(k, "broad")).alias("b"), k.alias("k"))))
    return F.transform(ranked, lambda r: F.struct(r["k"].alias("category"), (-r["a"]).cast("long").alias("strong"), (-r["b"]).cast("long").alias("broad")))


def groups_risk(grouped: Column) -> Column:
    bad = F.exists(grouped, lambda g: (g["strong"] > 0) & g["category"].isin(BAD))
    return F.when(bad, "high").when(F.exists(grouped, lambda g: g["strong"] > 0), "medium").otherwise("low")


def category_scores(counts: Column) -> Column:
    """Map of category to score from a map of strong phrases."""
    def score(k: Column, v: Column) -> Column:
        weight = F.lit(1.0)
        for name, (w, _) in fixed.LANGUAGE_WEIGHTS.items():
            weight = F.when(k == name, F.lit(w)).otherwise(weight)
        return F.floor(F.least(v * weight * 10, F.lit(100.0)) + 0.5).cast("long")

    return F.transform_values(counts, score)


def total(counts: Column) -> Column:
    """Sum of the categories' scores, 100 at most, from a map of strong phrases."""
    return F.least(F.aggregate(F.map_values(category_scores(counts)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(100).cast("long"))


def sentence(matched: Column) -> Column:
    """What was found, in words: strong phrases by category, in the categories' order, then the number of broad terms."""
    n = lambda test: F.size(F.filter(matched, test))
    plural = lambda c, word: F.concat(c.cast("string"), F.lit(f" {word}"), F.when(c == 1, "").otherwise("s"))
    strong = lambda k: n(lambda m: (m["category"] == k) & (m["tier"] == "strong"))
    parts = [(strong(k), f"{label.lower()} phrase") for k, label in fixed.LANGUAGE_LABELS.items()]
    named = F.array_compact(F.array(*[F.when(c > 0, plural(c, word)) for c, word in parts]))
    broad = n(lambda m: m["tier"] != "strong")
    also = F.when(broad > 0, F.concat(F.lit(" Also noted: "), plural(broad, "broader money, pressure or persuasion term"), F.lit("."))).otherwise("")
    return F.concat(F.when(F.size(named) > 0, F.concat(F.lit("Detected: "), F.array_join(named, ", "), F.lit("."))).otherwise("No suspicious phrases detected."), also)


def highlights(matched: DataFrame, key: list[str]) -> DataFrame:
    """key, start, end of the merged spans of all matches of a text: gaps and islands."""
    each = matched.select(*key, F.inline("matches"))
    order = Window.partitionBy(*key).orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = each.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end")).drop("_island")


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"))


def phrase_counts(matched: DataFrame) -> DataFrame:
    """phrase (lower case), n over all texts."""
    return matched.select(F.explode("matches").alias("m")).groupBy(F.lower("m.phrase").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
