"""URL filter with rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over host and path plus the literal tokens that any matching url must hold as whole tokens. The
pages' own token counts decide under which of them a rule is filed. Each page sends its distinct tokens; equal tokens fetch the rules filed there,
and only those run their expression. Rules without a whole token are filed under the empty token, which every page sends once.

Cases: a null url, or one without "://", has empty host and path and no rule; repeated rows come back as often as they went in; longer
rules win and equal lengths fall to the larger rule number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import UPPER

SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    pattern: str  # over host and path
    tokens: tuple[str, ...]  # whole tokens of every url that matches
    block: bool
    name: str | None  # None: a pattern of the method, which decides only where no named rule fits
    length: int


def prefix_rule(host: str, path: str, block: bool) -> Rule:
    """Fits the host and its subdomains where the url's path starts with `path`."""
    rest = path if path.endswith("/") else path.rpartition("/")[0]
    tokens = tuple(t for t in re.split(SPLIT, (host + rest).lower()) if t)
    return Rule(f"^(?:[^/?#]*\\.)?{re.escape(host + path)}", tokens, block, host + path, len(host + path))


def token_rule(token: str) -> Rule:
    """Blocks urls that hold the token as a whole label or path word."""
    return Rule(f"(?i)(?:^|[^a-z0-9]){token}(?:[^a-z0-9]|$)", (token,), True, None, len(token))


RULES = (prefix_rule("org", "/", False), prefix_rule("example.org", "/es/", True), prefix_rule("example.org", "/en/1", True),
         prefix_rule("com", "/fr/", False), prefix_rule("com", "/de/", True))
PATTERNS = tuple(token_rule(t) for t in ("adserver", "casino", "doubleclick", "porn", "xxx"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES + PATTERNS, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, the winning rule's name and the verdict for every row."""
    spark = pages.sparkSession
    full = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(full, "^(?s).*?://([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(full, "^(?s).*?://[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    low = F.translate(F.concat("host", "path"), UPPER, UPPER.lower())
    # The empty token is sent by every row exactly once: it fetches the rules without a token and counts equal rows.
    sent = parts.select(key, "host", "path", F.explode(F.array_union(F.array(F.lit("")), F.split(low, SPLIT))).alias("token"))

    numbered = spark.createDataFrame([(i, r.pattern, list(r.tokens), r.block, r.name, r.length) for i, r in enumerate(rules)],
                                     "rule_no long, pattern string, tokens array<string>, block boolean, rule string, length long")
    wanted = numbered.select("rule_no", F.explode("tokens").alias("token"))
    seen = sent.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = (wanted.join(seen, "token", "left").groupBy("rule_no")
             .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    index = (numbered.join(filed, "rule_no", "left")
             .select(F.coalesce("token", F.lit("")).alias("token"), "rule_no", "pattern",
                     # named rules before patterns, then the longer rule, then the number
                     F.struct(F.col("rule").isNotNull().alias("named"), "length", F.col("rule_no").alias("no")).alias("order")))
    fits = F.rlike(F.concat("host", "path"), F.col("pattern"))
    best = (sent.join(index, "token", "left").groupBy(key, "host", "path")
            .agg(F.max(F.when(fits, F.col("order"))).alias("order"),
                 F.count("rule_no").alias("n_run"), F.count_if(F.col("token") == "").alias("sentinels")))
    # Rules filed under the empty token multiply the sentinel, all rows alike.
    blank = max(1, sum(not r.tokens for r in rules))
    copies = (F.col("sentinels") / blank).cast("int")
    named = numbered.select("rule_no", "rule", "block")
    return (best.select(key, "host", "path", (F.col("n_run") / copies).cast("long").alias("n_rules_run"), F.col("order.no").alias("rule_no"), F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
            .join(named, "rule_no", "left")
            .select(key, "host", "path", "rule", F.when(F.col("block"), "block").otherwise("allow").alias("verdict"), "n_rules_run"))
