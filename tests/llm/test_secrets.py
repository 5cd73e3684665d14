"""Operator 1 against Python's regular expressions and DuckDB."""

import hashlib
import re

from pyspark.sql import functions as F

from weir.llm import secrets
from weir.llm.queries import ORACLES, QUERIES

from .oracle import compare

HEX = "0123456789abcdef0123456789abcdef"
TEXTS = [
    None, "", "plain", f'token = "{HEX}"', "token=token:abcdef password : 'hunter2hunter'", "é😀 API_KEY=abcdef12 APIKEY:'short' apikey:longer_value",
    "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 11 + "AKIA" + "C" * 15 + "-", f"x{HEX}y{HEX[:23]}", f"secret={HEX}{HEX}", "PASSWD==abc passwd=abcdef, token= =secret=abcdefg",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890-abc", "tokenx=abcdef", "x" * 50_000 + " token:abcdef " + "y" * 50_000, "sk_live_" + "a" * 16, "token=" + "q" * 5 + " " + HEX,
]


def plain(text):
    spans = []
    for i, r in enumerate(secrets.RULES):
        spans += [(m.start(), i, m.end(), r.kind) for m in re.finditer(r.regex, text or "") if len(m[r.group]) >= r.least]
    return sorted(spans)


def digest(doc, text):
    spans = plain(text)
    show = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    base = [x for x in spans if x[1] < 3]
    n = [sum(x[1] == i for x in spans) for i in range(3)]
    return (str(doc), *map(str, n), hashlib.sha256(show(base).encode()).hexdigest(), show(spans))


def test_digest_matches_plain_scan(spark):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate([*TEXTS, TEXTS[5], TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, h1 string")
    out = secrets.digest(df, "doc_id", "text")
    assert sorted(tuple(map(str, r)) for r in out.collect()) == sorted(digest(i, t) for i, t, *_ in rows)
    assert secrets.digest(df.limit(0), "doc_id", "text").count() == 0
    assert set(secrets.scan(df, "text").columns) == {"doc_id", "text", "spans", "h1"}


def test_candidates_miss_no_match(spark):
    df = spark.createDataFrame([(t or "",) for t in TEXTS], "text string")
    keyed = df.select("text", *secrets._keys(F.col("text")))
    found = keyed.join(secrets.candidates(keyed, secrets.RULES), ["h1", "h2"], "left").collect()
    for r in found:
        for rule in secrets.RULES:
            if secrets.trigram_query(rule.regex) and re.search(rule.regex, r.text):
                assert rule.kind in r.rules, (rule.kind, r.text[:50])
    assert sum(len(r.rules or []) for r in found) < len(TEXTS) * 2


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == (frozenset({frozenset({"abc", "bcd"})}),)
    assert q("(abc|def)x?ghi") == q("(?:abc|def)x?ghi") != ()
    assert q("[0-9a-f]{24,}") == () and q("ab|cde") == () and q("a*bcd") == (frozenset({frozenset({"bcd"})}),)


def test_redaction(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    out = secrets.scan(df, "text").select("text", secrets.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    for r in out:
        at, want = 0, ""
        for s, _, e, kind in plain(r.text):
            if s >= at:
                want += r.text[at:s] + f"[{kind}]"
            at = max(at, e)
        assert r.clean == (want + r.text[at:] if r.text is not None else None)


def test_oracle(spark):
    assert compare(spark, QUERIES["op1_secrets"], ORACLES["op1_secrets"])


def test_joined_by_hash_beyond_the_broadcast(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[5], TEXTS[3], None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, fully string").repartition(3)
    for out in (secrets.scan(df, "text", broadcast_rows=-1), secrets.scan(df, "text")):
        got = sorted((r.doc_id, r.fully, secrets_text(r.spans)) for r in out.collect())
        assert got == sorted((i, x, secrets_text([dict(kind=k, start=s, end=e) for s, _, e, k in plain(t)])) for i, t, x in rows)
    assert secrets.scan(df.limit(0), "text", broadcast_rows=-1).count() == 0


def secrets_text(spans):
    return [(s["kind"], s["start"], s["end"]) for s in spans]


def test_many_matches_in_one_long_text(spark):
    """Far more matches than are folded at once, dropped ones between them."""
    text = "".join(f"é token=value{i:06d} {HEX} token=ab " for i in range(3000))
    (out,) = secrets.scan(spark.createDataFrame([(text,)], "text string"), "text").collect()
    want = plain(text)
    assert len(want) == 6000 and [(s.start, s.end, s.kind) for s in out.spans] == [(s, e, k) for s, _, e, k in want]
