"""URL filters: explicit rules, and association rules mined from labelled URLs.

URLs become sets of tokens. FP-growth finds frequent token combinations that imply a label; the
rules that survive the confidence and support limits are matched through an inverted index from
token to rules. All of it is column expressions and Spark's own FP-growth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.carried import quoted, rows_with, whole_rows

MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.8
BLOCK_RULES = 500
"""Association rules in one index; more rules are matched index after index."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Scheme, host labels, last label, path parts (digits as ``#``), query keys, fragment."""
    rest = _rest(url)
    scheme = F.translate(url.substr(F.lit(1), F.locate("://", url) - 1), UPPER, LOWER)
    labels = F.split(host_of(url), r"\.")
    parts = F.split(F.regexp_replace(path_of(url), "[0-9]+", "#"), "/")
    query = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda q: F.regexp_extract(q, r"^([^=]*)", 1))

    def named(kind: str, values: Column) -> Column:
        kept = F.filter(values, lambda v: v != "")
        return F.transform(kept, lambda v: F.concat(F.lit(kind + ":"), v))

    found = F.concat(
        named("s", F.array(scheme)), named("h", labels), named("t", F.slice(labels, -1, 1)),
        named("p", parts), named("q", keys),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def of(verdict: str, text: str) -> UrlRule:
        host, slash, path = text.partition("/")
        return UrlRule(verdict, host, slash + path)


def with_rule(pages: DataFrame, rules: list[UrlRule], host: str, path: str) -> DataFrame:
    """``pages`` with ``rule`` (text or null) and ``rule_verdict`` of the longest rule that fits.

    ``rules`` is a short list, a parameter of the job. Equally long ones go by their text.
    """
    found = F.array(*(F.struct(
        F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"),
        F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"),
    ) for r in rules)) if rules else F.lit(None).cast(
        "array<struct<size:int,rule:string,verdict:string,host:string,path:string>>"
    )
    fits = F.filter(found, lambda r: (
        (F.col(host) == r["host"]) | F.endswith(F.col(host), F.concat(F.lit("."), r["host"]))
    ) & F.startswith(F.col(path), r["path"]))
    best = F.array_max(fits)
    return pages.withColumn("rule", best["rule"]).withColumn("rule_verdict", best["verdict"])


@dataclass(frozen=True)
class Association:
    tokens: tuple[str, ...]
    label: str
    confidence: float
    support: float

    def rank(self) -> tuple:
        return -self.confidence, -self.support, len(self.tokens), self.tokens, self.label


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> list[Association]:
    """Association rules from (tokens, label), best first.

    A rule goes by confidence, then support, then fewer tokens, then text. One whose tokens
    include those of a better rule never decides and is left out. Rows without a label or tokens
    take no part; without rows there are no rules. Only rules reach the driver: every one holds
    for at least ``min_support`` of the rows.
    """
    rows = labelled.where("label is not null and size(tokens) > 0")
    if rows.isEmpty():
        return []
    mark = "label="
    items = rows.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "label"))).alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    implied = F.col("consequent")[0]
    found = growth.fit(items).associationRules.where(
        F.startswith(implied, F.lit(mark))
        & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(mark)))
    )
    rules = sorted((
        Association(tuple(sorted(r["antecedent"])), r["label"], r["confidence"], r["support"])
        for r in found.select(
            "antecedent", F.replace(implied, F.lit(mark)).alias("label"), "confidence", "support"
        ).collect()
    ), key=Association.rank)
    kept: list[Association] = []
    by_token: dict[str, list[set[str]]] = {}
    for rule in rules:
        own = set(rule.tokens)
        if not any(other <= own for t in own for other in by_token.get(t, ())):
            kept.append(rule)
            by_token.setdefault(rule.tokens[0], []).append(own)
    return kept


def matched(tokens: Column, rules: list[Association], block: int = BLOCK_RULES) -> Column:
    """The label of the best association rule whose tokens are all there, or null.

    For each token the index gives the numbers of its rules; a rule fits if it is given once for
    each of its tokens. Rules are numbered best first.
    """
    answers = [
        _best(tokens, rules[first:first + block]) for first in range(0, len(rules), block)
    ]
    return F.coalesce(*answers) if answers else F.lit(None).cast("string")


def _best(tokens: Column, rules: list[Association]) -> Column:
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for token in rule.tokens:
            index.setdefault(token, []).append(k)
    names, postings = F.lit(list(index)), F.array(*(F.lit(v) for v in index.values()))
    sizes, labels = F.lit([len(r.tokens) for r in rules]), F.lit([r.label for r in rules])
    given = F.array_sort(F.flatten(F.transform(
        F.array_intersect(tokens, names),
        lambda t: F.element_at(postings, F.array_position(names, t).cast("int")),
    )))
    # a rule's number stands once more, size - 1 places on, if all its tokens gave it
    fit = F.filter(given, lambda k, i: F.coalesce(
        F.get(given, (i + F.element_at(sizes, k + 1) - 1).cast("int")) == k, F.lit(False)
    ))
    return F.when(F.size(fit) > 0, F.element_at(labels, F.array_min(fit) + 1))


def judge(
    pages: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    URLs that an explicit rule judges are the labelled examples; association rules mined from
    them judge the others, and ``default`` is for URLs that neither knows. A null URL or one
    without ``://`` has an empty host and path. Rows are judged one by one, repeated ones alike; an
    empty table stays one; URLs of any length are read as a whole; columns named like the results
    are replaced, all others are kept.
    """
    url = F.col("url")
    parsed = whole_rows(pages, url=F.col(quoted(url_col)))
    parsed = parsed.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    parsed = with_rule(parsed, rules, "host", "path")
    labelled = parsed.select(tokens_of(url).alias("tokens"), F.col("rule_verdict").alias("label"))
    found = mine(labelled, min_support, min_confidence)
    parsed = parsed.withColumn("tokens", tokens_of(url))
    verdict = F.coalesce(F.col("rule_verdict"), matched(F.col("tokens"), found), F.lit(default))
    return rows_with(parsed.withColumn("verdict", verdict), pages.columns, "host", "path", "rule", "verdict")
