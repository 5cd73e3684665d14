"""What each URL source is asked: addresses, endpoints, page sizes and cursors, as texts.

Nothing is sent from here. A transport sends the requests and records the answers, which ``recorded`` reads.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from urllib.parse import quote_plus

from weir.operators.filters import CLASSIC, PYWB, CaptureFilter

#: Rows that a page holds at most.
PAGE_ROWS = {"wayback": 50_000, "otx": 200, "vt": 40, "urlscan": 100, "zoomeye": 100, "github": 100}
SITEMAPS = ("sitemap.xml", "sitemap_index.xml", "sitemap.txt")


def form_encoded(text: str) -> str:
    """As HTML forms do: a space is a plus sign; letters, digits and ``*-._`` stay."""
    return quote_plus(text, safe="*").replace("~", "%7E")


def otx_endpoint(domain: str, subdomains: bool) -> str:
    """Hosts below a domain have an endpoint of their own, unless subdomains are wanted."""
    return "domain" if subdomains or domain.count(".") <= 1 else "hostname"


def site(domain: str, subdomains: bool) -> str:
    return f"{'*.' if subdomains else ''}{domain}"


def request(source: str, domain: str, *, page: int = 0, cursor: str | None = None, subdomains: bool = False, index: str = "latest", archive: CaptureFilter | None = None) -> str:
    """The address of a source's page; pages count from 0 or 1 as the source does, cursors are those of the page before."""
    archive, rows = archive or CaptureFilter(), PAGE_ROWS.get(source)
    if source == "wayback":
        resumed = f"&resumeKey={form_encoded(cursor)}" if cursor else ""
        return f"https://web.archive.org/cdx/search/cdx?url={site(domain, subdomains)}/*&fl=original&collapse=urlkey{archive.query_params(CLASSIC)}&limit={rows}&showResumeKey=true{resumed}"
    if source == "cc":
        query = f"https://index.commoncrawl.org/{index}-index?url={site(domain, subdomains)}/*&output=json{archive.query_params(PYWB)}"
        return query + ("&showNumPages=true" if page < 0 else f"&page={page}")
    if source == "arquivo":
        return f"https://arquivo.pt/wayback/cdx?url={site(domain, subdomains)}/*&output=json&collapse=urlkey{archive.query_params(PYWB)}&page={page}"
    if source == "otx":
        return f"https://otx.alienvault.com/api/v1/indicators/{otx_endpoint(domain, subdomains)}/{domain}/url_list?limit={rows}&page={page}"
    if source == "vt":
        return f"https://www.virustotal.com/api/v3/domains/{domain}/urls?limit={rows}" + (f"&cursor={form_encoded(cursor)}" if cursor else "")
    if source == "urlscan":
        return f"https://urlscan.io/api/v1/search/?q=domain:{form_encoded(domain)}&size={rows}" + (f"&search_after={cursor}" if cursor else "")
    if source == "github":
        quoted = form_encoded(f'"{domain}"')
        return f"https://api.github.com/search/code?q={quoted}&per_page={rows}&page={page}"
    raise ValueError(f"{source!r} isn't asked by pages")


def zoomeye_request(domain: str, *, page: int = 1, subdomains: bool = False) -> dict:
    """The body of a search."""
    dork = base64.b64encode(f"site:{site(domain, subdomains)}".encode()).decode()
    return {"qbase64": dork, "page": page, "pagesize": PAGE_ROWS["zoomeye"], "sub_type": "web"}


def well_known(source: str, domain: str) -> Iterator[str]:
    """Where robots and sitemap files may lie, in the order in which they are tried."""
    for scheme in ("https", "http"):
        for name in ("robots.txt",) if source == "robots" else SITEMAPS:
            yield f"{scheme}://{domain}/{name}"
