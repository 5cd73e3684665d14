"""Scalar text functions: timestamps of capture indexes, targets, status lines, tokens, CSV and JSON fields."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def cdx_timestamp(text: Column, end: bool = False) -> Column:
    """A date of 4, 6, 8 or 14 digits (and anything between them) as 14 digits, at the range's start or end; else null.

    Years from 1996, months 1-12, days 1-31 without regard to the month; the time isn't checked.
    """
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    ok = n.isin(4, 6, 8, 14) & F.rlike(text, F.lit(r"^[0-9][0-9 :/TZ.-]*$"))
    ok &= F.substring(digits, 1, 4) >= "1996"
    ok &= (n < 6) | F.substring(digits, 5, 2).between("01", "12")
    ok &= (n < 8) | F.substring(digits, 7, 2).between("01", "31")
    rest = F.lit("00001231235959" if end else "00000101000000")
    return F.when(ok, F.concat(digits, F.substring(rest, n + 1, F.lit(14) - n)))


def cdx_time(text: str, end: bool = False) -> str | None:
    """``cdx_timestamp`` of one text, on the driver."""
    digits = re.sub("[^0-9]", "", text)
    if len(digits) not in (4, 6, 8, 14) or not re.fullmatch(r"[0-9][0-9 :/TZ.-]*", text) or digits[:4] < "1996":
        return None
    if not (len(digits) < 6 or "01" <= digits[4:6] <= "12") or not (len(digits) < 8 or "01" <= digits[6:8] <= "31"):
        return None
    return digits + ("00001231235959" if end else "00000101000000")[len(digits) :]


def target_host(text: Column) -> Column:
    """The host of a target as users write it: a host, a host with a path, or a URL; null if there is none."""
    t = F.trim(text)
    url = F.regexp_extract(F.lower(t), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(t, r"^//", ""), r"^([^/?#]*)", 1), r"[.]+$", ""))
    host = F.when(F.contains(t, F.lit("://")), url).otherwise(bare)
    return F.when(host != "", host)


#: Reasons of status codes.
REASONS = {
    100: "Continue", 101: "Switching Protocols", 200: "OK", 201: "Created", 202: "Accepted", 203: "Non Authoritative Information", 204: "No Content",
    205: "Reset Content", 206: "Partial Content", 300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified",
    307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found",
    405: "Method Not Allowed", 406: "Not Acceptable", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed",
    413: "Payload Too Large", 414: "URI Too Long", 415: "Unsupported Media Type", 418: "I'm a teapot", 421: "Misdirected Request", 422: "Unprocessable Entity",
    425: "Too Early", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests", 431: "Request Header Fields Too Large",
    451: "Unavailable For Legal Reasons", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable",
    504: "Gateway Timeout", 505: "HTTP Version Not Supported", 511: "Network Authentication Required",
}


def status_text(code: Column) -> Column:
    """``200 OK``; codes without a known reason end in the space."""
    table = F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (k, v)])
    return F.concat(code.cast("string"), F.lit(" "), F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("")))


def split_status(line: Column) -> tuple[Column, Column]:
    """``url - status`` at its last `` - ``; without one the status is null."""
    has = F.contains(line, F.lit(" - "))
    return F.when(has, F.regexp_extract(line, r"^(?s)(.*) - (.*)$", 1)).otherwise(line), F.when(has, F.regexp_extract(line, r"^(?s)(.*) - (.*)$", 2))


def first_url_token(line: Column) -> Column:
    """The first token between white space that begins with http:// or https://; null without one."""
    token = F.regexp_extract(line, r"(?:^|\s)(https?://\S+)", 1)
    return F.when(token != "", token)


def csv_field(text: Column) -> Column:
    """Quoted only for a comma, a quote or a line feed; null is empty."""
    needs = F.rlike(text, F.lit('[,"\n]'))
    return F.coalesce(F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def elapsed_text(seconds: Column) -> Column:
    """From one second on ``1.23s``, below ``123ms``."""
    return F.when(seconds >= 1, F.format_string("%.2fs", seconds.cast("double"))).otherwise(F.concat(F.floor(seconds * 1000).cast("string"), F.lit("ms")))


def short_error(text: Column) -> Column:
    """The first line, cut to 80 characters."""
    line = F.substring_index(text, "\n", 1)
    return F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 80), F.lit("…"))).otherwise(line)


def preview(text: Column, size: int = 100) -> Column:
    """At most ``size`` bytes, without a broken character at the end."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, size)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.regexp_replace(F.make_valid_utf8(F.decode(cut, "UTF-8")), "�+$", ""))


#: Terminal colours by the first digit of a status.
COLOURS = {"2": 32, "3": 33, "4": 31, "5": 35}


def coloured(status: Column) -> Column:
    """A status text for a terminal; others stay as they are."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for k, v in COLOURS.items() for x in (k, v)]), F.substring(status, 1, 1))
    return F.coalesce(F.concat(F.lit("\x1b["), code.cast("string"), F.lit("m"), status, F.lit("\x1b[0m")), status)


def fingerprint(fields: list) -> str:
    """SHA-256 over fields with their lengths before them, so that no two lists of fields collide; lists by count."""
    digest = hashlib.sha256()

    def add(value) -> None:
        if isinstance(value, (list, tuple)):
            digest.update(len(value).to_bytes(8, "little"))
            for v in value:
                add(v)
        else:
            raw = "" if value is None else str(value)
            digest.update(len(raw.encode()).to_bytes(8, "little") + raw.encode())

    add(list(fields))
    return digest.hexdigest()
