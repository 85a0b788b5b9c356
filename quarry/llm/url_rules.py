"""URL filters by association rules.

Fixed rules decide first: a rule fits its host and all subdomains if the URL's
path starts with the rule's path, and the longest fitting rule wins.  For the
rest, FP-growth mines token combinations of labelled URLs (host labels, path
segments, query keys); combinations that imply the label ``bad`` with enough
confidence and support, and none of whose parts does so as surely, are kept.
A rule is a list of groups, each the tokens that are in the same labelled URLs;
it stands for every choice of one token of each, and is never written out as
such.  Rules are matched by an inverted index from token to groups of rules: a
rule fires when all its groups have a token there, and a URL is blocked by any
rule that fires.

All tokens of a URL count; support (a share and a least number of bad URLs) and
confidence (itself, and its lower bound over the share of bad URLs among all)
alone bound the rules.  Two
exact steps keep the mining small: a token that is in too few bad URLs can be in
no rule, and of tokens that are always in the same URLs one is mined for all,
as no rule that is kept holds two of them (either alone is as sure).  Only
rules that differ in the URLs they cover are so mined; their number still grows
with the combinations of tokens that are frequent together but not always.
Everything runs in the JVM and URLs are judged in place, without a shuffle; only
labelled token sets move.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule and the method's verdict on no tokens, allow; null labels teach nothing;
repeated rows are kept as they come; with no labels nothing is blocked by a mined
rule; columns of the names that are made are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path) to verdict (fixed values).
RULES: Mapping[tuple[str, str], str] = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
SUPPORT = 0.001
CONFIDENCE = 0.4
#: Bad URLs that a rule must have been seen on, however few the labels are.
LEAST = 20
#: A rule's confidence must lie this many standard deviations over the share of bad URLs among all (Wilson's lower bound).
SURE = 3.0
_BAD = "=bad"
#: Groups of tokens, confidence, support.
Rule = tuple[list[list[str]], float, float]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Mapping[tuple[str, str], str] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for (h, p), verdict in sorted(rules.items(), key=lambda r: (len(r[0][0]) + len(r[0][1]), r[0])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The different tokens: host labels, path segments, query keys."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    segments = F.split(path, "/")
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(named("h", F.split(host, r"\.")), named("p", segments), named("q", keys))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def lower_bound(share: float, n: float, deviations: float) -> float:
    """Wilson's lower bound of a share seen in n cases."""
    if n <= 0:
        return 0.0
    square = deviations**2 / n
    return (share + square / 2 - deviations * math.sqrt(share * (1 - share) / n + square / n / 4)) / (1 + square)


def mine_rules(urls: DataFrame, url_col: str, bad_col: str, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, sure: float = SURE) -> list[Rule]:
    """(groups of tokens, confidence, support) of the rules kept, the surest first; all that labels teach by chance is left out."""
    from pyspark.ml.fpm import FPGrowth

    known = urls.where(F.col(bad_col).isNotNull()).select(F.array_sort(tokens_of(F.col(url_col))).alias("items"), F.col(bad_col).alias("bad"))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(1, least, math.ceil(support * total["n"]))
    # bounded: a token set has few tokens, and each token kept is in the support's share of all sets
    each = known.select(F.explode("items").alias("t"), "bad", *[F.xxhash64("items", F.lit(i)).cast("decimal(20,0)").alias(f"h{i}") for i in (0, 1)])
    found = each.groupBy("t").agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where(F.col("n_bad") >= least).collect()
    alike: dict[tuple, list[str]] = {}
    for r in sorted(found, key=lambda r: r["t"]):
        alike.setdefault((r["n"], r["h0"], r["h1"]), []).append(r["t"])
    if not alike:
        return []
    members = {tokens[0]: tokens for tokens in alike.values()}
    mined = F.concat(F.filter("items", lambda t: t.isin(list(members))), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>")))
    model = FPGrowth(itemsCol="items", minSupport=least / total["n"], minConfidence=confidence).fit(known.select(mined.alias("items")))
    rows = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BAD)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").collect()
    base = total["bad"] / total["n"]
    rows = [r for r in rows if r["support"] * total["n"] > least - 0.5 and lower_bound(r["confidence"], r["support"] * total["n"] / r["confidence"], sure) >= base]
    kept: list[Rule] = []
    by_first: dict[str, list[tuple[set[str], float]]] = {}
    for r in sorted(rows, key=lambda r: (len(r["tokens"]), -r["confidence"], -r["support"], r["tokens"])):
        own = set(r["tokens"])
        if not any(c >= r["confidence"] and t <= own for x in own for t, c in by_first.get(x, ())):
            by_first.setdefault(r["tokens"][0], []).append((own, r["confidence"]))
            kept.append(([members[x] for x in r["tokens"]], r["confidence"], r["support"]))
    return sorted(kept, key=lambda k: (-k[1], -k[2], k[0]))


def _fired(tokens: Column, rules: list[Rule]) -> Column:
    """Numbers of the rules of which every group has a token there, smallest (surest) first."""
    index: dict[str, list[dict[str, int]]] = {}
    for i, (groups, _, _) in enumerate(rules):
        for g, members in enumerate(groups):
            for t in members:
                index.setdefault(t, []).append({"r": i, "g": g, "n": len(groups)})
    if not index:
        return F.array().cast("array<int>")
    table = F.from_json(F.lit(json.dumps(index)), "map<string, array<struct<r: int, g: int, n: int>>>")
    none = F.array().cast("array<struct<r: int, g: int, n: int>>")
    hits = F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), none))))
    whole = F.transform(F.array(hits), lambda h: F.filter(h, lambda x: (x["g"] == 0) & (F.size(F.filter(h, lambda y: y["r"] == x["r"])) == x["n"])))[0]
    return F.array_sort(F.transform(whole, lambda x: x["r"]))


def judge_urls(pages: DataFrame, labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, sure: float = SURE) -> DataFrame:
    """All columns of pages, and host, path, rule, verdict, mined_rule (the surest rule that fires: groups with a blank, their tokens with a bar between; else null).

    labelled: rows with a URL and a boolean bad_col.
    """
    rules = mine_rules(labelled, url_col, bad_col, support, confidence, least, sure)
    url = F.col(url_col)
    names = F.array(*[F.lit(" ".join("|".join(g) for g in groups)) for groups, _, _ in rules]) if rules else F.array().cast("array<string>")
    out = pages.withColumns({"__host": host_of(url), "__path": path_of(url), "__fired": _fired(tokens_of(url), rules)})
    out = out.withColumn("__base", rule_for(F.col("__host"), F.col("__path")))
    made = {
        "host": F.col("__host"),
        "path": F.col("__path"),
        "rule": F.col("__base")["rule"],
        "verdict": F.coalesce(F.col("__base")["verdict"], F.when(F.size("__fired") > 0, "block").otherwise("allow")),
        "mined_rule": F.when(F.size("__fired") > 0, F.get(names, F.get("__fired", F.lit(0)))),
    }
    return out.withColumns(made).drop("__host", "__path", "__fired", "__base")
