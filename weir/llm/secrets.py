"""Secret scans by a trigram inverted index (operator 1). Native expressions only.

From each rule's regular expression a Boolean query over trigrams is derived: an AND of clauses, each an OR of
trigram sets that a match must contain. One scan posts the trigrams that any query names, by text; postings are
intersected into candidates (text, rule). A second scan verifies: each text is joined with its candidate rules and
only those run. Rules whose expression forces no trigram (long hexadecimal runs) run on every text.

Texts are known by two 64-bit hashes, so copies share their postings, and a result is right even for repeated ids.
"""

from __future__ import annotations

import itertools
import re._constants as codes
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import BROADCAST_ROWS, small_or_not, written

#: Alternatives up to which a clause is kept; a larger set of strings forces nothing.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java and RE2 read ``regex`` alike; matches failing ``keep`` (SQL of group 0 and ``value``) go."""

    kind: str
    regex: str
    #: The group and the characters that it must have, else the match is dropped after it has been consumed.
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed values of the base rules. Runs of [A-Z0-9] and [0-9a-f] are maximal, so their least length can stand in the
#: expression; that of ``assign`` can't, since a short match still uses up its text.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: Further rules (fixed values): issuers' prefixes and key headers.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
)
RULES = (*BASE, *MORE)


def _strings(node) -> set[str] | None:
    """All strings that a piece of an expression can be, if few; None otherwise."""
    op, arg = node
    if op is codes.LITERAL:
        return {chr(arg).lower()}
    if op is codes.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is codes.LITERAL:
                out.add(chr(value).lower())
            elif kind is codes.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is codes.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is codes.BRANCH:
        each = [_sequence_strings(b) for b in arg[1]]
        return None if None in each else set().union(*each)
    if op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[1] <= 2:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(one, repeat=n)}
    if op is codes.AT:
        return {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """An OR of trigram sets, or None if some alternative has no trigram and so nothing is forced."""
    sets = {_trigrams(s) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


def trigram_query(regex: str) -> tuple[frozenset[frozenset[str]], ...]:
    """The Boolean query of an expression, in lower case: all clauses must hold, of each any trigram set."""
    clauses = []

    def walk(nodes):
        run = {""}

        def flush():
            nonlocal run
            if (clause := _clause(run)) is not None:
                clauses.append(clause)
            run = {""}

        for node in nodes:
            strings = _strings(node)
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            flush()
            op, arg = node
            if strings is not None:
                run = strings
            elif op is codes.SUBPATTERN:
                walk(arg[-1])
            elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush()

    walk(parser.parse(regex))
    return tuple(dict.fromkeys(clauses))


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``trigram, h1, h2`` for each distinct text that has one of the trigrams in any case."""
    low = rows.select("h1", "h2", F.lower("text").alias("low"))
    hits = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return low.select("h1", "h2", F.explode(hits).alias("trigram")).select("trigram", "h1", "h2")


def candidates(rows: DataFrame, rules) -> DataFrame:
    """``h1, h2, rules``: of each text the rules whose trigram queries its postings satisfy; texts with none are absent."""
    queries = {rule.kind: q for rule in rules if (q := trigram_query(rule.regex))}
    trigrams = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    if not trigrams:
        return rows.select("h1", "h2", F.array().cast("array<string>").alias("rules")).limit(0)
    place = {t: i for i, t in enumerate(trigrams)}
    words = range(0, len(trigrams), 60)
    # a text's postings meet in bit sets, combined before the shuffle
    number = F.array_position(F.array(*map(F.lit, trigrams)), F.col("trigram")) - 1
    bits = [F.expr(f"bit_or(if(n >= {w} AND n < {w + 60}, shiftleft(1L, CAST(n - {w} AS INT)), 0L))").alias(f"b{w}") for w in words]
    met = postings(rows, trigrams).withColumn("n", number).groupBy("h1", "h2").agg(*bits)

    def holds(trigram_set) -> Column:
        out = F.lit(True)
        for w in words:
            mask = sum(1 << (place[t] - w) for t in trigram_set if w <= place[t] < w + 60)
            if mask:
                out = out & (F.col(f"b{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return out

    def any_of(clause) -> Column:
        out = F.lit(False)
        for s in sorted(clause, key=sorted):
            out = out | holds(s)
        return out

    def satisfied(query) -> Column:
        out = F.lit(True)
        for clause in query:
            out = out & any_of(clause)
        return out

    named = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(kind)) for kind, q in queries.items()]))
    return met.select("h1", "h2", named.alias("rules")).where(F.size("rules") > 0)


#: Matches that are folded into one array before it is passed on: appending to one array of all would copy it each time.
FOLDED = 256
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def spans_of(text: Column, rule: Rule) -> Column:
    """``array<struct<kind, start, end>>`` of a rule's matches, in code points, end exclusive.

    The text between matches and the matches themselves add up to places: Spark has no function that gives them.
    """
    regex = F.lit(rule.regex)
    between, matches = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matches
    lengths = [F.transform(c, lambda x: F.length(x)) for c in (between, matches, values)]
    step = F.arrays_zip(*[c.alias(name) for c, name in zip(lengths, ("gap", "match", "value"), strict=True)])
    kind = F.lit(rule.kind)

    def add(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["match"], F.lit(0))
        kept = x["match"].isNotNull() & (x["value"] >= rule.least)
        one = F.array(F.struct(kind.alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(kept, F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    def fold(state, block):
        own = F.aggregate(block, F.struct(state["at"].alias("at"), _none().alias("spans")), add)
        return F.struct(own["at"].alias("at"), F.concat(state["blocks"], F.array(own["spans"])).alias("blocks"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / FOLDED).cast("int")), lambda i: F.slice(step, i * FOLDED + 1, F.lit(FOLDED)))
    folded = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("blocks")), fold)
    return F.when(F.rlike(text, regex), F.flatten(folded["blocks"])).otherwise(_none())


def scan(df: DataFrame, text_col: str, rules=RULES, *, out: str = "spans", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with ``out``: the spans of every rule's matches in each whole text, by start, then rules as listed.

    A null or empty text has none. Matches are leftmost and non-overlapping within a rule; rules may overlap. Rows
    are neither lost nor multiplied, whatever their ids, copies and other columns (a column called ``out`` is replaced).

    Up to ``broadcast_rows`` candidates meet their texts by a broadcast. More are joined with the texts that they name
    (Spark sends these by a Bloom filter where the scan is large), and their spans go back to the rows by hash: the
    rows then move without their text, unless the caller asks for it.
    """
    rules = tuple(rules)
    others = [c for c in df.columns if c.lower() != out.lower()]
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    rows = df.select(*inner, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = rows.select("*", *_keys(F.col("text")))
    found = written(candidates(keyed, rules), "candidates").withColumnsRenamed({"h1": "g1", "h2": "g2"})
    by_trigram, always = [r for r in rules if trigram_query(r.regex)], [r for r in rules if not trigram_query(r.regex)]
    few = found.count() <= broadcast_rows
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))

    def verified() -> Column:
        each = [F.when(F.array_contains("rules", r.kind), spans_of(F.col("text"), r)).otherwise(_none()) for r in by_trigram]
        return F.flatten(F.array(*each)) if each else _none()

    fully = F.flatten(F.array(*[spans_of(F.col("text"), r) for r in always])) if always else _none()
    kept = [f"c{i}" for i in range(len(others))]
    if few:
        joined = keyed.join(F.broadcast(found), same, "left").select(*kept, F.concat(verified(), fully).alias("all"))
    else:
        copies = keyed.join(found, same).groupBy("g1", "g2").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
        hits = written(copies.select("g1", "g2", verified().alias("some")).where(F.size("some") > 0), "hits")
        slim = keyed.select(*kept, "h1", "h2", fully.alias("fully"))
        joined = slim.join(small_or_not(hits), same, "left").select(*kept, F.concat(F.coalesce("some", _none()), "fully").alias("all"))
    rank = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(i) for i in range(len(rules))]))
    ordered = F.transform(
        F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], ordered.alias(out))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of base spans, and all spans."""
    out = scan(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span (sorted by start; overlapping ones as one) replaced by its first kind in brackets."""

    def add(state, s):
        fresh = s["start"] >= state["at"]
        piece = F.concat(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.when(fresh, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, rest))


def oracle() -> str:
    """DuckDB SQL of ``digest``."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, rule in enumerate(RULES):
        regex = lit(rule.regex)
        parts.append(f"""SELECT d.row, {i} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
      list_sum(list_transform(d.gaps[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(d.hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS s,
      length(d.hits[k]) AS n, length(d.vals[k]) AS v, {rule.least} AS least
    FROM (SELECT row, string_split_regex(text, {regex}) AS gaps, regexp_extract_all(text, {regex}, 0) AS hits, regexp_extract_all(text, {regex}, {rule.group}) AS vals
          FROM docs WHERE regexp_matches(text, {regex})) d, unnest(range(1, len(d.hits) + 1)) AS u(k)""")
    union = "\n    UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT *, kind || ':' || s || ':' || (s + n) AS span FROM ({union}) WHERE v >= least),
folded AS (SELECT row, {counts}, string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE base) AS base_spans,
  string_agg(span, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN folded USING (row)"""
