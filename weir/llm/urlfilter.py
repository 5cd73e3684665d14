"""URL verdicts by rules that are indexed by their rarest literal token (operator 8). Native expressions only.

Two kinds of rules: a *place* (host and path prefix, fits the host and its subdomains; the longest wins) and a
*pattern* (``*`` any characters, ``^`` a separator or the end, ``||`` the start of a host label, ``|`` an end of the
url). A literal token of a rule is a run of a-z and 0-9 that stands between two fixed non-token signs, so every url
that fits the rule has it as a whole token. Each rule is filed under the one of its tokens that fewest urls of the
table have; rules without one are tried on every url. A url's tokens fetch candidate rules, and only those run their
regular expressions.

Up to ``LITERAL_RULES`` rules the index is part of the plan and nothing is shuffled; beyond, urls are made distinct,
their tokens joined with the index, and verdicts joined back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.shared import small_or_not

LITERAL_RULES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Place:
    """A rule for a host with its subdomains and a path prefix."""

    host: str
    path: str
    action: str

    name = property(lambda self: self.host + self.path)
    regex = property(lambda self: r"^(?:[^/]*\.)?" + quoted(self.host + self.path))
    #: The signs around the text: a label begins after a dot or the start, and the path may go on.
    tokens = property(lambda self: literal_tokens("." + self.host.lower() + self.path.lower() + "*"))


@dataclass(frozen=True)
class Pattern:
    """A rule for a whole url in lower case."""

    text: str
    action: str

    name = property(lambda self: self.text)
    tokens = property(lambda self: literal_tokens(self.text if self.text[:1] == "|" else "*" + self.text, self.text[-1:] != "|"))

    @property
    def regex(self) -> str:
        text, head, tail = self.text, "", ""
        if text.startswith("||"):
            text, head = text[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
        elif text.startswith("|"):
            text, head = text[1:], "^"
        if text.endswith("|"):
            text, tail = text[:-1], "$"
        body = "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c) or quoted(c) for c in text)
        return head + body + tail


#: Places of the default query (fixed values): an action, a host, a path prefix.
PLACES = (
    Place("org", "/", "allow"),
    Place("example.org", "/es/", "block"),
    Place("example.org", "/en/1", "block"),
    Place("com", "/fr/", "allow"),
    Place("com", "/de/", "block"),
)
#: Patterns of the default query (fixed values), all blocking: spam shops, gambling, adult sites, adverts, trackers.
PATTERNS = tuple(
    Pattern(text, "block")
    for text in (
        "-pills.", "-pills-", "||adult.", "||adult-", "||casino-", "||bets.", "-bets.", "||ads-", "||spam.", "||spam-", "||pills.", "||viagra.", "-viagra.", "||casino.", "-casino.", "||poker.", "-poker.", "||porn.", "-porn.", "||xxx.", "-xxx.",
        "||ads.", "||adserver.", "||doubleclick.net^", "/adserver/", "/banners/", "/tracking-pixel.", "||malware.", "-malware.", "||phishing.", "-phishing.",
    )
)


def parse_rules(lines) -> tuple[list[Place], list[Pattern]]:
    """Rules of a list's lines: ``allow`` or ``block`` and a place, or a pattern, which blocks unless ``@@`` stands before it.

    Lines that are blank or begin with ``!`` or ``#`` are notes. Options and rules for parts of pages aren't understood
    and raise, since leaving them out would change verdicts. Repeated rules count once.
    """
    places, patterns = {}, {}
    for number, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text[0] in "!#":
            continue
        action, _, place = text.partition(" ")
        if action in ("allow", "block") and place.strip():
            host, slash, path = place.strip().partition("/")
            places[Place(host.lower(), slash + path, action)] = None
            continue
        allow = text.startswith("@@")
        text = text.removeprefix("@@").lower()
        if "$" in text or "##" in text or "#@#" in text or " " in text or not text.strip("|*^"):
            raise ValueError(f"line {number} isn't a rule: {line.strip()!r}")
        patterns[Pattern(text, "allow" if allow else "block")] = None
    return list(places), list(patterns)


def read_rules(spark: SparkSession, path: str) -> tuple[list[Place], list[Pattern]]:
    """``parse_rules`` of a file; rules are held by the driver, as lists of rules are small beside tables."""
    return parse_rules(r.value for r in spark.read.text(path).collect())


def quoted(text: str) -> str:
    """A literal for Java's and RE2's regular expressions."""
    return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", text)


def literal_tokens(text: str, open_end: bool = True) -> tuple[str, ...]:
    """Runs of a-z and 0-9 that fixed other signs enclose; ``*`` doesn't enclose."""
    found = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text + ("*" if open_end else "|"))
    return tuple(dict.fromkeys(found))


def lowered(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.split(lowered(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """Urls of the whole table that have each of the rules' tokens; as many rows as rules have tokens at most."""
    one = urls.select(F.explode(tokens_of(F.col("url"))).alias("token"))
    if len(tokens) <= LITERAL_RULES:
        one = one.where(F.col("token").isin(sorted(tokens)))
    else:
        wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
        one = one.join(small_or_not(wanted), "token", "left_semi")
    return {r.token: r["count"] for r in one.groupBy("token").count().collect()}


def build_index(urls: DataFrame, rules: list) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; under the empty string those that have none."""
    counts = token_counts(urls, {t for rule in rules for t in rule.tokens})
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(rarest, []).append(i)
    return index


def _subject(rule: Column, places: int, site: Column, url: Column) -> Column:
    return F.when(rule < places, site).otherwise(url)


def _decide(found: Column, rules: list, n_places: int, default: str) -> tuple[Column, Column]:
    """The longest place's name, and the verdict, of an array of fitting rule numbers."""
    # places by length, longest first; equal lengths by host length, then name
    order = sorted(range(n_places), key=lambda i: (-len(rules[i].name), -len(rules[i].host), rules[i].name))
    rank = F.array(*[F.lit(order.index(i)) for i in range(n_places)]) if n_places else None
    best = F.array_min(F.transform(F.filter(found, lambda i: i < n_places), lambda i: F.get(rank, i))) if n_places else F.lit(None)
    names = F.array(*[F.lit(rules[i].name) for i in order]) if n_places else F.array(F.lit(None).cast("string"))
    actions = F.array(*[F.lit(rules[i].action) for i in order]) if n_places else F.array(F.lit(None).cast("string"))
    allows = [i for i in range(n_places, len(rules)) if rules[i].action == "allow"]
    patterns = F.filter(found, lambda i: i >= n_places)
    by_pattern = F.when(F.size(patterns) == 0, F.lit(default))
    if allows:
        by_pattern = by_pattern.when(F.exists(patterns, lambda i: i.isin(allows)), F.lit("allow"))
    return F.get(names, best), F.coalesce(F.get(actions, best), by_pattern.otherwise(F.lit("block")))


def judge(df: DataFrame, id_col: str, url_col: str, places=PLACES, patterns=PATTERNS, *, default: str = "allow", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``rule`` is the longest fitting place (else null); ``verdict`` its action, else ``allow`` for a fitting allowing
    pattern, ``block`` for a blocking one, else ``default``. A null url or one without ``://`` has an empty host and
    path and fits no place. Repeated rows and null ids give a row each; other columns are left behind.
    """
    rules, n = [*places, *patterns], len(places)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    index = build_index(rows, rules)
    parts = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if len(rules) <= literal_rules:
        found = _fitting_by_plan(rules, n, index)
        name, verdict = _decide(F.col("found"), rules, n, default)
        return parts.withColumn("found", found).select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))
    # a null url is judged as an empty one
    parts = parts.withColumn("url", F.coalesce("url", F.lit("")))
    verdicts = _verdicts_by_join(parts.select("url", "host", "path").distinct(), rules, n, index, default)
    verdicts = verdicts.withColumnRenamed("url", "of")
    joined = parts.join(verdicts, parts["url"] == verdicts["of"], "left")
    return joined.select("page_id", "host", "path", F.col("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _fitting_by_plan(rules: list, n: int, index: dict[str, list[int]]) -> Column:
    """Numbers of the fitting rules of a row, by an index that is part of the plan."""
    entries = [x for token, ids in sorted(index.items()) if token for x in (F.lit(token), F.array(*map(F.lit, ids)))]
    always = F.array(*map(F.lit, index.get("", []))).cast("array<int>")
    candidates = always
    if entries:
        lookup = F.create_map(*entries)
        hits = F.filter(F.transform(tokens_of(F.col("url")), lambda t: F.try_element_at(lookup, t)), lambda x: x.isNotNull())
        candidates = F.concat(always, F.flatten(hits))
    regexes = F.array(*[F.lit(r.regex) for r in rules]) if rules else F.array(F.lit(""))
    site, url = F.concat("host", "path"), lowered(F.coalesce(F.col("url"), F.lit("")))
    return F.filter(candidates, lambda i: F.rlike(_subject(i, n, site, url), F.get(regexes, i)))


def _verdicts_by_join(urls: DataFrame, rules: list, n: int, index: dict[str, list[int]], default: str) -> DataFrame:
    """Verdicts of distinct urls, with the index as a table; a host's commonest token can't gather rows in one task."""
    order = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (-len(rules[i].name), -len(rules[i].host), rules[i].name)))}
    table = urls.sparkSession.createDataFrame(
        [(t, i, i < n, rules[i].regex, order.get(i), rules[i].name, rules[i].action) for t, ids in index.items() for i in ids],
        "token string, id int, place boolean, regex string, rank int, name string, action string",
    )
    tokens = F.concat(tokens_of(F.col("url")), F.array(F.lit("")))
    exploded = urls.withColumn("token", F.explode(F.array_distinct(tokens)))
    subject = F.when(F.col("place"), F.concat("host", "path")).otherwise(lowered(F.col("url")))
    hits = exploded.join(small_or_not(table), "token").where(F.rlike(subject, F.col("regex")))
    best = hits.groupBy("url").agg(
        F.min(F.when(F.col("place"), F.struct("rank", "name", "action"))).alias("best"),
        F.max(F.when(~F.col("place") & (F.col("action") == "allow"), F.lit(1))).alias("allowed"),
        F.max(F.when(~F.col("place") & (F.col("action") == "block"), F.lit(1))).alias("blocked"),
    )
    by_pattern = F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").otherwise(default)
    return best.select("url", F.col("best.name").alias("rule"), F.coalesce("best.action", by_pattern).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for the default rules."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(PLACES, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fits = [f"regexp_matches(host || path, {lit(r.regex)})" for r in order]
    blocked = " OR ".join(f"regexp_matches(low, {lit(p.regex)})" for p in PATTERNS)
    rule = " ".join(f"WHEN {f} THEN {lit(r.name)}" for f, r in zip(fits, order, strict=True))
    verdict = " ".join(f"WHEN {f} THEN {lit(r.action)}" for f, r in zip(fits, order, strict=True))
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
  CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
