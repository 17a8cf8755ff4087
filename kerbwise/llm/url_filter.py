"""URL filter: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over host and path written together (a host never holds a slash). ``tokens`` are literals that every match holds as
    whole URL tokens (runs of a-z and 0-9, lower-cased). Among matching rules the highest
    ``rank`` wins, then the smallest name; ``named`` rules are reported by name."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int = 0
    named: bool = True


def host_rule(verdict: str, rule: str) -> PatternRule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's path."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = re.findall(TOKEN, host) + re.findall(f"(?<![a-z0-9]){TOKEN}(?=[^a-z0-9])", path.lower())
    end = re.escape(path) or r"(?=/|\Z)"
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}{end}"
    return PatternRule(rule, pattern, verdict, tuple(dict.fromkeys(whole)), len(rule))


def word_rule(word: str, verdict: str = "block") -> PatternRule:
    """A word of the host's labels, between dots, hyphens or the ends."""
    return PatternRule(word, rf"\A(?:[^/]*[.-])?{re.escape(word)}(?:[./-]|\Z)", verdict, (word,), -1, named=False)


# The method's own verdict where no given rule fits.
BLOCK_WORDS = ("casino", "pills", "bets", "spam", "ads")


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many rows of (host, path) hold each wanted token. As many rows come back as were asked for."""
    spark = urls.sparkSession
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), 1))
    asked = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))  # the caller's own rules
    found = urls.select(F.explode(tokens).alias("token")).join(asked, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def index_rules(rules: list[PatternRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest literal token, and the rules without a literal, which are tried on every URL."""
    by_token, always = defaultdict(list), []
    for i, rule in enumerate(rules):
        if rule.tokens:
            by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
        else:
            always.append(i)
    return dict(by_token), always


def url_filter(pages: DataFrame, rules: list[PatternRule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every URL: ``key``, host, path, rule (name of the winning named rule, else null), verdict,
    tried (regular expressions run).

    Null urls and urls without ``://`` have empty host and path. The rarest token of a rule is that
    found in fewest of these very URLs. Repeated rows are judged one by one; other columns are not read.
    """
    urls = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    by_token, always = index_rules(rules, counts)
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, rules[i].name))
    place = {i: k for k, i in enumerate(order)}

    @F.pandas_udf("rule string, verdict string, tried int")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        patterns = [re.compile(r.pattern, re.DOTALL) for r in rules]
        out = []
        for subject in host + path:
            found = {i for t in set(re.findall(TOKEN, subject.lower())) for i in by_token.get(t, ())}
            winner, tried = None, 0
            for i in sorted(found.union(always), key=place.__getitem__):
                tried += 1
                if patterns[i].search(subject):
                    winner = rules[i]
                    break
            out.append((winner.name if winner and winner.named else None, winner.verdict if winner else default, tried))
        return pd.DataFrame(out, columns=["rule", "verdict", "tried"])

    return urls.withColumn("j", judge("host", "path")).select(key, "host", "path", "j.rule", "j.verdict", "j.tried")
