"""A run's options, their validation and the order of precedence."""

from __future__ import annotations

import re
import tomllib
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, replace

from weir.functions.text import cdx_time, fingerprint
from weir.operators.filters import PYWB, CaptureFilter, UrlFilter, preset
from weir.sources.recorded import PROVIDERS
from weir.sources.transport import Client, rotation

DEFAULT_PROVIDERS = ("wayback", "cc", "otx")
#: Where caches lie by kind; ``redis`` names a shared store of JSON entries here.
CACHE_TYPES = ("sqlite", "redis", "none")
#: Environment variables that may hold keys, separated by commas.
KEY_VARIABLE = "WEIR_{}_API_KEY"


@dataclass(frozen=True)
class ScanOptions:
    """What a run does. Network options are accepted and inert: recorded responses need none."""

    providers: tuple[str, ...] = ()
    exclude_providers: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()  # providers that a key is known for
    api_keys: tuple[tuple[str, str], ...] = ()  # provider and key; several keys of one provider take turns
    all_providers: bool = False
    exclude_robots: bool = False
    exclude_sitemap: bool = False
    cc_index: tuple[str, ...] = ("latest",)
    subdomains: bool = False
    strict: bool = True
    stdin_only: bool = False
    files: tuple[str, ...] = ()
    presets: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    archive: CaptureFilter = CaptureFilter()
    normalize: bool = False
    merge: bool = False
    show_host: bool = False
    show_path: bool = False
    show_param: bool = False
    check_status: bool = False
    include_status: tuple[str, ...] = ()
    exclude_status: tuple[str, ...] = ()
    extract_links: bool = False
    show_sources: bool = False
    output: str | None = None
    format: str = "plain"
    silent: bool = False
    incremental: bool = False
    no_cache: bool = False
    cache_type: str = "sqlite"
    cache_path: str | None = None
    redis_url: str | None = None
    cache_ttl: int = 86_400
    output_dir: str | None = None
    stream: bool = False
    max_time: int = 0
    parallel: int = 5
    timeout: int = 120
    retries: int = 2
    network_scope: str = "all"
    proxy: str | None = None
    proxy_auth: str | None = None
    insecure: bool = False
    random_agent: bool = False
    rate_limit: float | None = None
    rate_limits: tuple[str, ...] = ()

    def url_filter(self) -> UrlFilter:
        base = UrlFilter(self.extensions, self.exclude_extensions, self.patterns, self.exclude_patterns, self.min_length, self.max_length)
        return base.with_presets(*self.presets)

    def view(self) -> str | None:
        return "host" if self.show_host else "path" if self.show_path else "param" if self.show_param else None

    def client(self, source: str | None = None) -> Client:
        """Settings of a sender, with a source's own rate where one is set."""
        rate = dict(map(parse_rate, self.rate_limits)).get(source, self.rate_limit)
        return Client(self.timeout, self.retries, self.insecure, self.random_agent, self.proxy, self.proxy_auth, rate)

    def known_keys(self) -> set[str]:
        return {*self.keys, *(name for name, _ in self.api_keys)}

    def rotated(self, source: str):
        """A source's keys in turn."""
        return rotation([key for name, key in self.api_keys if name == source])

    def validated(self) -> ScanOptions:
        for name in (*self.providers, *self.exclude_providers):
            if name not in PROVIDERS:
                raise ValueError(f"unknown provider {name!r}; known: {', '.join(PROVIDERS)}")
        for name in self.presets:
            preset(name)
        self.client()
        if self.network_scope not in ("all", "providers", "testers", "providers,testers", "testers,providers"):
            raise ValueError(f"unknown network scope {self.network_scope!r}; known: all, providers, testers")
        if self.cache_type not in CACHE_TYPES:
            raise ValueError(f"unknown cache type {self.cache_type!r}; known: {', '.join(CACHE_TYPES)}")
        for index in self.cc_index:
            if index.lower() != "latest" and not re.fullmatch(r"CC-MAIN-[0-9]{4}-[0-9]{2}", index):
                raise ValueError(f"not an index: {index!r}")
        return self

    def merged(self, config: dict) -> ScanOptions:
        """Options still at their defaults are taken from a configuration; unknown keys and sections are ignored."""
        blank, out = ScanOptions(), {}
        archive = {}
        for section, keys in CONFIG.items():
            own = config.get(section)
            for key, field in keys.items():
                value = own.get(key) if isinstance(own, dict) else None
                if value is None:
                    continue
                if field.startswith("archive."):
                    name = field.partition(".")[2]
                    if getattr(self.archive, name) == getattr(blank.archive, name):
                        archive[name] = _moment(key, value) if name in ("start", "end") else _listed(value)
                elif field.startswith("key."):
                    name = field.partition(".")[2]
                    if name not in self.known_keys():
                        out["api_keys"] = (*out.get("api_keys", self.api_keys), *((name, k) for k in _listed(value, split=True)))
                elif getattr(self, field) != getattr(blank, field):
                    continue
                elif key in ("include_robots", "include_sitemap"):
                    out[field] = out.get(field, False) or value is False
                elif key == "format" and value.strip().lower() not in ("plain", "json", "jsonl", "csv"):
                    warnings.warn(f"format {value!r} in the configuration is ignored; known: plain, json, jsonl, csv", stacklevel=2)
                elif isinstance(getattr(blank, field), tuple):
                    out[field] = _listed(value, split=key == "cc_index") or getattr(blank, field)
                elif isinstance(value, bool):
                    out[field] = out.get(field, False) or value
                else:
                    out[field] = value.strip().lower() if key in ("format", "network_scope") else value
        if archive:
            out["archive"] = replace(self.archive, **archive)
        return replace(self, **out)

    def with_keys(self, environment: Mapping[str, str], provider_config: dict | None = None, config: dict | None = None) -> ScanOptions:
        """Everything in its order: options as given, keys of the environment, a file of keys alone, the configuration."""
        o = self
        for name, p in PROVIDERS.items():
            if p.key != "no" and name not in o.known_keys():
                found = _listed(environment.get(KEY_VARIABLE.format(name.upper()), ""), split=True)
                o = replace(o, api_keys=(*o.api_keys, *((name, k) for k in found)))
        if provider_config:
            o = o.merged({"provider": {k: v for k, v in provider_config.items() if k.endswith("_api_key")}})
        return o.merged(config) if config else o

    def cache_key(self, domain: str) -> str:
        """Changes with everything that changes a domain's cached result."""
        a = self.archive
        return fingerprint([
            domain, sorted(select_sources(self)), list(self.cc_index), self.subdomains, self.strict, list(self.presets), list(self.extensions), list(self.exclude_extensions),
            list(self.patterns), list(self.exclude_patterns), self.min_length, self.max_length, self.normalize, self.merge, a.start, a.end, list(a.status), list(a.exclude_status), list(a.mime), list(a.exclude_mime),
        ])


#: The configuration's sections and keys, and the options that they set.
CONFIG = {
    "output": {"output": "output", "format": "format", "merge_endpoint": "merge", "stream": "stream"},
    "provider": {
        "providers": "providers", "subs": "subdomains", "cc_index": "cc_index", "from": "archive.start", "to": "archive.end",
        "archive_status": "archive.status", "archive_exclude_status": "archive.exclude_status", "archive_mime": "archive.mime", "archive_exclude_mime": "archive.exclude_mime",
        "vt_api_key": "key.vt", "urlscan_api_key": "key.urlscan", "zoomeye_api_key": "key.zoomeye", "github_api_key": "key.github",
        "exclude_robots": "exclude_robots", "exclude_sitemap": "exclude_sitemap", "include_robots": "exclude_robots", "include_sitemap": "exclude_sitemap",
    },
    "filter": {
        "preset": "presets", "extensions": "extensions", "exclude_extensions": "exclude_extensions", "patterns": "patterns", "exclude_patterns": "exclude_patterns",
        "show_only_host": "show_host", "show_only_path": "show_path", "show_only_param": "show_param", "min_length": "min_length", "max_length": "max_length",
    },
    "network": {
        "network_scope": "network_scope", "proxy": "proxy", "proxy_auth": "proxy_auth", "insecure": "insecure", "random_agent": "random_agent",
        "timeout": "timeout", "retries": "retries", "parallel": "parallel", "rate_limit": "rate_limit",
    },
    "testing": {"check_status": "check_status", "include_status": "include_status", "exclude_status": "exclude_status", "extract_links": "extract_links"},
    "cache": {"incremental": "incremental", "cache_type": "cache_type", "cache_path": "cache_path", "redis_url": "redis_url", "cache_ttl": "cache_ttl", "no_cache": "no_cache"},
}


def _listed(value, split: bool = False) -> tuple[str, ...]:
    """A list of a configuration, or one text of it; with ``split`` a text's parts between commas."""
    if isinstance(value, str):
        value = value.split(",") if split else [value]
    return tuple(v for v in (str(x).strip() for x in value) if v)


def _moment(key: str, value) -> str:
    found = cdx_time(str(value), end=key == "to")
    if found is None:
        raise ValueError(f"not a date: {value!r}")
    return found


def load_config(text: str) -> dict:
    return tomllib.loads(text)


def parse_rate(entry: str) -> tuple[str, float]:
    """``id=rate`` with a positive finite rate."""
    name, mark, rate = entry.partition("=")
    try:
        value = float(rate)
    except ValueError:
        value = 0.0
    if not mark or name.strip() not in PROVIDERS or not 0 < value < float("inf"):
        raise ValueError(f"not a rate limit: {entry!r}")
    return name.strip(), value


def select_sources(o: ScanOptions) -> list[str]:
    """Provider ids of a run: chosen or default ones, those with a key, robots and sitemap; exclusion wins."""
    chosen = list(PROVIDERS) if o.all_providers else list(o.providers or DEFAULT_PROVIDERS)
    if not o.providers:
        chosen += [p for p in PROVIDERS if p in o.known_keys()]
    if not o.exclude_robots:
        chosen.append("robots")
    if not o.exclude_sitemap:
        chosen.append("sitemap")
    chosen = [p for p in dict.fromkeys(chosen) if p not in o.exclude_providers]
    return [p for p in PROVIDERS if p in chosen]


def build_sources(o: ScanOptions) -> list[str]:
    """Those that can run: sources whose required key is missing are left out, with a warning; an error if none is left."""
    out = []
    for name in select_sources(o):
        if PROVIDERS[name].key == "required" and name not in o.known_keys():
            warnings.warn(f"{PROVIDERS[name].label} needs a key and is left out", stacklevel=2)
        else:
            out.append(name)
    if not out:
        raise ValueError(f"no provider left; known: {', '.join(PROVIDERS)}")
    return out


def inert_archive(o: ScanOptions) -> list[str]:
    """Why parts of the capture filter have no effect: no index among the sources, or values that one can't take."""
    if o.archive == CaptureFilter():
        return []
    dialects = {PROVIDERS[p].dialect: PROVIDERS[p].label for p in select_sources(o) if PROVIDERS[p].dialect}
    if not dialects:
        return ["no source is a capture index"]
    return [f"{dialects[PYWB]} takes one value of {name}" for name in o.archive.inert(PYWB)] if PYWB in dialects else []


def validates_hosts(o: ScanOptions) -> bool:
    """Hosts are tested unless turned off, for files, or if all targets came by standard input."""
    return o.strict and not o.files and not o.stdin_only


def streaming_conflicts(o: ScanOptions) -> list[tuple[str, str]]:
    """Options that a stream can't honour, with the reason."""
    checks = (
        ("merge-endpoint", o.merge, "merging needs all URLs"), ("check-status", o.check_status, "statuses are looked up after collection"),
        ("include-status", bool(o.include_status), "statuses are looked up after collection"), ("exclude-status", bool(o.exclude_status), "statuses are looked up after collection"),
        ("extract-links", o.extract_links, "links are extracted after collection"), ("incremental", o.incremental, "the comparison needs all URLs"),
        ("show-sources", o.show_sources, "later sources may still report a URL"), ("output-dir", o.output_dir is not None, "files by host are written at the end"),
        ("files", bool(o.files), "files are read as a whole"), ("format", o.format.lower() == "json", "an array ends with the run; use jsonl"),
    )
    return [(name, why) for name, on, why in checks if on]
