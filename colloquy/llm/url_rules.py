"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` of a URL (the host lower-cased), an action and
the literal tokens that any URL it fits must hold. A token is a run of letters and digits. How many
URLs hold each token of any rule is counted over all URLs; a rule is filed under its rarest one, so
a URL's own tokens fetch few candidate rules, and only those run their expression. Rules without a
token are tried on every URL. Of the named rules that fit, the longest wins (then block before
allow, then the name); where none fits, the unnamed pattern rules decide: one that fits gives its
action, block before allow, and none gives ``allow``.

The rule set is a parameter of at most ``MAX_RULES`` rules (checked); it travels with the tasks.
URLs are not shuffled, so no host can be a hot key.

Defined results: a null URL, or one without ``://``, has an empty host and path and is allowed;
repeated rows are judged one by one; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm.common import ascii_lower, table
from colloquy.llm.registry import query

MAX_RULES = 100_000
TOKEN = r"[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is None for a pattern rule of the method's own."""

    name: str | None
    action: str
    pattern: str
    tokens: tuple[str, ...]

    @property
    def order(self) -> tuple:
        return (-len(self.name or ""), self.action != "block", self.name or "")


def host_rule(action: str, host: str, path: str) -> Rule:
    """A host with its subdomains, and paths that begin with ``path``."""
    whole = re.findall(TOKEN, host) + re.findall(TOKEN + r"(?![0-9A-Za-z]|$)", path)  # not a token that may go on
    return Rule(host + path, action, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole))


def pattern_rule(action: str, pattern: str, *tokens: str) -> Rule:
    return Rule(None, action, pattern, tokens)


def parts(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns(
        {
            "host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """URLs that hold each token of any rule; one row per such token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    own = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0)))
    # the list is bounded by the rules; tokens that no rule has leave before the shuffle
    flat = urls.select(F.explode(own).alias("token")).filter(F.col("token").isin(wanted))
    return {r["token"]: r["n"] for r in flat.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(pages: DataFrame, page_id: str, url: str, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel with the tasks")
    urls = parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url")), "__url").drop("__url")
    counts = token_counts(urls, rules)
    index: dict[str, list[Rule]] = {}
    always: list[Rule] = []
    for rule in sorted(rules, key=lambda r: r.order):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    schema = T.StructType([*urls.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = re.compile(TOKEN)
        fits = {r: re.compile(r.pattern) for some in [*index.values(), always] for r in some}

        def one(place: str) -> tuple[str | None, str]:
            found = [r for t in set(tokens.findall(place)) for r in index.get(t, ())]
            for r in sorted([*found, *always], key=lambda r: r.order):
                if fits[r].search(place):
                    return r.name, r.action
            return None, "allow"

        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            out = [one(h + p) for h, p in zip(host, path)]
            new = [pa.array([x[k] for x in out], pa.string()) for k in (0, 1)]
            cols = [c.cast(f.type) for c, f in zip([*batch.columns, *new], arrow)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return urls.mapInArrow(run, schema)


# The rules asked for, and the method's own patterns.
NAMED = [
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]
OWN = [
    pattern_rule("block", r"(?:^|[.-])casino(?:[.-]|$|/)", "casino"),
    pattern_rule("block", r"(?:^|[.-])bets(?:[.-]|$|/)", "bets"),
    pattern_rule("block", r"(?:^|[.-])poker(?:[.-]|$|/)", "poker"),
    pattern_rule("block", r"(?:^|[.-])porn(?:[.-]|$|/)", "porn"),
    pattern_rule("block", r"(?:^|[.-])xxx(?:[.-]|$|/)", "xxx"),
]

_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM hp)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '(^|[.-])(casino|bets|poker|porn|xxx)([.-]|$|/)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM named
"""


@query("op10_url_rules", _SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), "page_id", "url", [*NAMED, *OWN])
