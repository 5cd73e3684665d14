"""URL parts and normal form as column expressions.

Regular http(s) URLs, nearly all of any crawl, are taken apart by native expressions. Only irregular strings (upper-case
schemes or hosts, user names, ports, dot segments, non-ASCII or characters that need escaping) go to an Arrow UDF that
parses them as browsers do; it gets nulls for all other rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
#: A URL that is its own normal form but for its query order and trailing slash.
REGULAR = r"^https?://(?=[a-z0-9-]*[a-z-])?[a-z0-9]([a-z0-9.-]*[a-z0-9])?(/[A-Za-z0-9_~!$&'()*+,;=:@%-]+([.][A-Za-z0-9_~!$&'()*+,;=:@%-]+)*)*/?([?][A-Za-z0-9._~!$&()*+,;=:@%/?-]*)?(#[A-Za-z0-9._~!$&'()*+,;=:@%/?-]*)?$"
PARTS = r"^(https?)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"


def is_regular(url: Column) -> Column:
    """Whether the native expressions below are exact for a URL."""
    host = F.regexp_extract(url, PARTS, 2)
    numeric = F.rlike(host, F.lit(r"(^|[.])(0x)?[0-9a-f]*[0-9][0-9a-f]*$")) & F.rlike(host, F.lit(r"^[0-9a-fx.]+$"))
    return F.rlike(url, F.lit(REGULAR)) & ~F.contains(url, F.lit("%2e")) & ~F.contains(url, F.lit("%2E")) & ~numeric & ~F.contains(host, F.lit("xn--")) & ~F.contains(host, F.lit(".."))


# --- irregular strings: a parser of the living URL standard's special schemes ----------------------------------------

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_C0 = "".join(map(chr, range(0x21)))
_PATH_SAFE = "!$&'()*+,;=:@%/-._~|[]\\"
_QUERY_SAFE = "!$&()*+,;=:@%/?-._~|[]\\^`{}"
_FRAGMENT_SAFE = "!$&'()*+,;=:@%/?-._~|[]\\^{}#"
_USER_SAFE = "!$&'()*+,-._~%"


def _host(raw: str, special: bool) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    if not special:
        return raw
    from urllib.parse import unquote

    host = unquote(raw, errors="replace")
    if not host.isascii():
        try:
            import idna

            host = idna.encode(host.lower(), uts46=True).decode()
        except Exception:  # noqa: BLE001  any failure of the encoder means an invalid host
            return None
    host = host.lower()
    if not host or re.search(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]", host):
        return None
    last = host.rstrip(".").rpartition(".")[2]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        return _ipv4(host)
    return host


def _ipv4(host: str) -> str | None:
    parts = host.rstrip(".").split(".")
    if len(parts) > 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p, 16) if p.startswith("0x") and len(p) > 2 else 0 if p == "0x" else int(p, 8) if len(p) > 1 and p.startswith("0") else int(p))
        except ValueError:
            return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> 8 * k & 255) for k in (3, 2, 1, 0))


def parse(text: str | None) -> dict | None:
    """Parts of a URL with an authority, or None; the path of special schemes begins with ``/``."""
    if text is None:
        return None
    text = text.strip(_C0).replace("\t", "").replace("\n", "").replace("\r", "")
    if not (m := _SCHEME.match(text)):
        return None
    scheme, rest = m[0][:-1].lower(), text[m.end() :]
    special = scheme in DEFAULT_PORTS
    rest, _, fragment = rest.partition("#")
    has_fragment = "#" in text[m.end() :]
    rest, mark, query = rest.partition("?")
    if special:
        rest = "//" + rest.replace("\\", "/").lstrip("/")
    if not rest.startswith("//"):
        return {"scheme": scheme, "user": "", "host": None, "port": None, "path": quote(rest, safe=_PATH_SAFE), "query": quote(query, safe=_QUERY_SAFE) if mark else None, "fragment": quote(fragment, safe=_FRAGMENT_SAFE) if has_fragment else None}
    authority, slash, path = rest[2:].partition("/")
    user, at, place = authority.rpartition("@")
    m = re.fullmatch(r"(\[.*\]|[^:]*)(?::([0-9]*))?", place)
    host = _host(m[1], special) if m else None
    if host is None:
        return None
    port = int(m[2]) if m[2] else None
    if port is not None and port > 65535:
        return None
    name, colon, password = user.partition(":")
    shown = quote(name, safe=_USER_SAFE) + (":" + quote(password, safe=_USER_SAFE) if password else "")
    out: list[str] = []
    segments = (slash + path).split("/")[1:] if slash else ([""] if special else [])
    for i, segment in enumerate(segments):
        plain = segment.lower().replace("%2e", ".")
        if plain == "..":
            del out[-1:]
            if i == len(segments) - 1:
                out.append("")
        elif plain == ".":
            if i == len(segments) - 1:
                out.append("")
        else:
            out.append(quote(segment, safe=_PATH_SAFE))
    return {
        "scheme": scheme, "user": shown + "@" if at and shown else "", "host": host, "port": None if port == DEFAULT_PORTS.get(scheme) else port,
        "path": "".join("/" + s for s in out) if segments else "", "query": quote(query, safe=_QUERY_SAFE) if mark else None, "fragment": quote(fragment, safe=_FRAGMENT_SAFE) if has_fragment else None,
    }


def serialise(p: dict) -> str:
    authority = "" if p["host"] is None else f"//{p['user']}{p['host']}" + (f":{p['port']}" if p["port"] is not None else "")
    return f"{p['scheme']}:{authority}{p['path']}" + (f"?{p['query']}" if p["query"] is not None else "") + (f"#{p['fragment']}" if p["fragment"] is not None else "")


_STRUCT = T.StructType(
    [T.StructField("ok", T.BooleanType())]
    + [T.StructField(k, T.IntegerType() if k == "port" else T.StringType()) for k in ("scheme", "user", "host", "port", "path", "query", "fragment")]
)


@F.pandas_udf(_STRUCT)
def _irregular(urls: pd.Series) -> pd.DataFrame:
    out = []
    for url in urls:
        p = parse(url)
        out.append((p is not None, *([p[k] for k in ("scheme", "user", "host", "port", "path", "query", "fragment")] if p else [None] * 7)))
    frame = pd.DataFrame(out, columns=["ok", "scheme", "user", "host", "port", "path", "query", "fragment"])
    frame["port"] = frame["port"].astype("Int32")
    return frame


def parts(url: Column, *, native: bool = False) -> Column:
    """A struct ``ok, scheme, user, host, port, path, query, fragment``; ``ok`` is false for what isn't a URL.

    ``native`` takes every row as regular: right where all URLs are known to be, and without Python.
    """
    part = lambda k: F.regexp_extract(url, PARTS, k)
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    mark = lambda regex, k: F.when(F.rlike(url, F.lit(regex)), part(k))
    regular = F.struct(
        F.rlike(url, F.lit(PARTS)).alias("ok"), part(1).alias("scheme"), F.lit("").alias("user"), part(2).alias("host"), F.lit(None).cast("int").alias("port"),
        path.alias("path"), mark(r"^[^?#]*[?]", 4).alias("query"), mark("#", 5).alias("fragment"),
    )
    if native:
        return regular
    own = is_regular(url)
    return F.when(own, regular).otherwise(_irregular(F.when(own, F.lit(None)).otherwise(url)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once. Plans repeat an expression wherever it is used: URL parts, used many times, would
    make code that can't be compiled."""
    return F.element_at(F.transform(F.array(value), f), 1)


def origin(p: Column) -> Column:
    """Scheme, host (empty, if there is none) and port."""
    return F.concat(p["scheme"], F.lit("://"), F.coalesce(p["host"], F.lit("")), F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")))


def rebuilt(p: Column, path: Column, query: Column) -> Column:
    """A URL of parts with another path and query (null: none)."""
    bare = p["host"].isNull()
    head = F.when(bare, F.concat(p["scheme"], F.lit(":"))).otherwise(
        F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")))
    )
    return F.concat(head, path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.coalesce(F.concat(F.lit("#"), p["fragment"]), F.lit("")))


def query_tokens(query: Column) -> Column:
    """Raw ``key=value`` tokens in order; empty ones are left out."""
    return F.array_remove(F.split(F.coalesce(query, F.lit("")), "&"), "")


def normalised(url: Column, *, native: bool = False) -> Column:
    """One trailing slash less (but for the root), query tokens in byte order, standard spelling; what isn't a URL stays."""

    def normal(p: Column) -> Column:
        path = F.when((F.length(p["path"]) > 1) & F.endswith(p["path"], F.lit("/")), F.substring(p["path"], F.lit(1), F.length(p["path"]) - 1)).otherwise(p["path"])
        query = F.array_join(F.array_sort(query_tokens(p["query"])), "&")
        return F.when(p["ok"], rebuilt(p, path, F.when(query != "", query))).otherwise(url)

    return bound(parts(url, native=native), normal)


def extension(url: Column, *, native: bool = False) -> Column:
    """The lower-cased text after the last dot of the last path segment; null without one, or for a leading dot only.

    Of strings that aren't URLs: after the last dot of what follows the last slash, up to a question mark.
    """
    name = F.regexp_extract(url, r"([^/]*)$", 1)
    loose = F.when(F.contains(name, F.lit(".")), F.lower(F.regexp_extract(name, r"[.]([^.?]*)(?:[?][^.]*)?$", 1)))

    def own(p: Column) -> Column:
        last = F.regexp_extract(p["path"], r"([^/]*)$", 1)
        return F.when(p["ok"], F.when(F.rlike(last, F.lit(r"^.+[.]")) & (last != ".."), F.lower(F.regexp_extract(last, r"[.]([^.]*)$", 1)))).otherwise(loose)

    return bound(parts(url, native=native), own)


def host_key(host: Column) -> Column:
    """Lower case, without dots at the end."""
    return F.regexp_replace(F.lower(host), r"[.]+$", "")


def is_http(text: Column) -> Column:
    return F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://"))
