"""URL filtering by fixed rules and by mined association rules, in DataFrame functions alone.

Fixed rules name a host and the start of a path; a rule fits its host and all
subdomains, and the longest that fits decides.  URLs that none fits are judged
by token combinations which FP-growth finds to go with bad labels.  A
combination becomes a rule if its confidence is well above the share of bad
pages, by its lift and by a test that allows for the number of combinations
looked at; those that a part of them makes redundant go.  Rules are found
through an index from a rule's rarest token.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no tokens and the default verdict; repeated rows count each; without labels,
or without a rule that holds, all else is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.llm._run import Scope

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label=block"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host's ends of one to three labels, its first label, path steps (digits as one sign), names of query arguments, a fragment."""
    labels = F.split(host, r"\.")
    ends = [F.concat(F.lit("host="), F.array_join(F.slice(labels, -n, n), ".")) for n in (1, 2, 3)]
    hosts = F.array(*[F.when(F.size(labels) >= n, e) for n, e in zip((1, 2, 3), ends)], F.concat(F.lit("first="), F.get(labels, F.lit(0))))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    mark = F.array(F.when(F.col("__url").contains("#"), F.lit("fragment")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(hosts, steps, names, mark))))


def _parts(pages: DataFrame, keep: tuple[str | Column, ...], url: str) -> DataFrame:
    out = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("__url"))
    out = out.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    return out.withColumn("__tokens", tokens_of(F.col("__url"), F.col("host"), F.col("path")))


@dataclass
class Rule:
    """Tokens that go together with bad pages, the share of bad ones among the pages that have all, and their number."""

    tokens: list[str]
    confidence: float
    pages: int


@dataclass
class Mined:
    """``rules``, best first; of all labelled pages the number and the share of bad ones; how many combinations were looked at, and the highest confidence of those with enough support."""

    rules: list[Rule] = field(default_factory=list)
    pages: int = 0
    bad_share: float = 0.0
    looked_at: int = 0
    best_confidence: float = 0.0


def mine(labelled: DataFrame, *, url: str = "url", bad: str = "bad", min_support: float = 0.002, min_lift: float = 1.2, chance: float = 0.05, most_rules: int = 10_000) -> Mined:
    """Token sets that go with bad pages.

    ``labelled`` has a page's ``url`` and ``bad`` (boolean; a null leaves the
    row out).  ``min_support`` is the share of labelled pages that have the set
    and are bad.  A rule's confidence is at least ``min_lift`` times the share
    of bad pages, and its lower limit (Wilson's, at ``chance`` over all sets
    looked at) lies above that share.  A set goes if a part of it has at least
    its confidence.  More than ``most_rules`` rules, counted before any is
    collected, are an error: ask for more support.
    """
    scope = Scope(labelled.sparkSession)
    rows = _parts(labelled.where(F.col(bad).isNotNull()), (F.col(bad).alias("__bad"),), url)
    baskets = scope.written(rows.select("__bad", F.concat(F.col("__tokens"), F.when(F.col("__bad"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items")).where(F.size("items") > 0), "baskets")
    n, share = baskets.agg(F.count("*"), F.avg(F.col("__bad").cast("double"))).first()
    if not n or not share:
        scope.close()
        return Mined(pages=n or 0)
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(baskets).associationRules
    found = found.where((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == LABEL)).select("antecedent", "confidence", F.round(F.col("support") * n / F.col("confidence")).cast("long").alias("pages"))
    found = scope.written(found, "rules")
    looked_at, best = found.agg(F.count("*"), F.max("confidence")).first()
    z = NormalDist().inv_cdf(1 - chance / max(1, looked_at))
    c, m = F.col("confidence"), F.col("pages")
    lower = (c + z * z / (2 * m) - z * F.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    found = found.where((c >= min_lift * share) & (lower > share))
    if (kinds := found.count()) > most_rules:
        raise ValueError(f"{kinds} rules: more than {most_rules}; raise min_support")
    kept: list[Rule] = []
    for r in sorted(found.collect(), key=lambda r: (len(r[0]), -r[1], sorted(r[0]))):
        if not any(set(x.tokens) <= set(r[0]) and x.confidence >= r[1] for x in kept):
            kept.append(Rule(sorted(r[0]), r[1], r[2]))
    scope.close()
    return Mined(sorted(kept, key=lambda x: (-x.confidence, x.tokens)), n, share, looked_at, best or 0.0)


def _fixed(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest that fits, null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda x: (len(x[1] + x[2]), x)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: Mined, *, keep: tuple[str | Column, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """The ``keep`` columns, host, path, rule, verdict; ``mined``, ``confidence`` and ``rule_pages``: tokens, confidence and labelled pages of the mined rule that decided, else null.

    Of several that fit, the rule of the highest confidence decides.
    ``rules``: (verdict, host, start of the path) each, a plan-time list.
    """
    out = _parts(pages, keep, url)
    rule, verdict = _fixed(rules, F.col("host"), F.col("path"))
    kind = "struct<place:int,tokens:array<string>,confidence:double,pages:bigint>"
    hit = F.lit(None).cast(kind)
    if mined.rules:
        seen: dict[str, int] = {}
        for r in mined.rules:
            for x in r.tokens:
                seen[x] = seen.get(x, 0) + 1
        index: dict[str, list[Column]] = {}
        for i, r in enumerate(mined.rules):
            entry = F.struct(F.lit(i), F.array(*map(F.lit, r.tokens)), F.lit(r.confidence), F.lit(r.pages)).cast(kind)
            index.setdefault(min(r.tokens, key=lambda x: (seen[x], x)), []).append(entry)
        by = F.create_map(*[c for k, entries in index.items() for c in (F.lit(k), F.array(*entries))])
        reached = F.flatten(F.array_compact(F.transform(F.col("__tokens"), lambda x: F.try_element_at(by, x))))
        hit = F.array_min(F.filter(reached, lambda r: F.size(F.array_except(r["tokens"], F.col("__tokens"))) == 0))
    out = out.withColumn("__hit", hit).withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("__hit").isNotNull(), "block").otherwise(default))})
    decided = F.when(F.col("rule").isNull(), F.col("__hit"))
    return out.withColumns({"mined": F.array_join(decided["tokens"], " "), "confidence": decided["confidence"], "rule_pages": decided["pages"]}).drop("__url", "__tokens", "__hit")
