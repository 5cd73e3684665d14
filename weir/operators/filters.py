"""Row predicates: extensions, patterns, lengths, presets, capture filters, status filters."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.text import status_text
from weir.functions.urls import extension

#: Extensions by family.
FAMILIES = {
    "images": (
        "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico", "tiff", "tif", "heic", "heif", "raw", "psd", "ai", "eps", "avif", "jfif", "jp2", "jpx", "apng",
        "cr2", "nef", "orf", "arw", "dng", "webm", "pgm", "pbm", "ppm", "pnm", "exr", "xcf", "pcx", "tga", "emf", "wmf", "jxr", "hdp", "wdp", "cur", "dcm", "wbmp",
        "j2k", "art", "jng", "3fr", "ari", "srf", "sr2", "bay", "crw", "kdc", "erf", "mrw", "rw2", "pef", "dicom", "djvu", "fpx", "hdr", "mng", "ora", "pic", "rgb",
        "rgba", "xbm", "xpm", "dpx", "fits", "flif", "img", "mpo", "psb",
    ),
    "fonts": (
        "ttf", "otf", "woff", "woff2", "eot", "fon", "fnt", "svg", "ttc", "dfont", "pfa", "pfb",
    ),
    "documents": (
        "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "rtf", "odt", "ods", "odp", "epub", "mobi", "azw3", "fb2", "djvu", "epub3", "xps",
    ),
    "audio": (
        "mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus", "aiff", "alac", "dsd", "dff", "dsf", "pcm", "aifc", "au", "snd", "caf", "ra", "ram",
    ),
    "videos": (
        "mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "mpeg", "mpg", "3gp", "3g2", "m4v", "f4v", "f4p", "f4a", "f4b", "asf", "rmvb", "rm", "dat", "ts", "vob",
    ),
    "js": (
        "js", "ts", "jsx", "tsx", "mjs", "cjs", "vue", "json", "coffee", "es6", "es", "svelte", "astro", "njk", "map",
    ),
    "style": (
        "css", "scss", "sass", "less", "stylus", "postcss", "pcss", "cssm", "cssx", "cssb",
    ),
}
_EXCLUDING = ("images", "fonts", "documents", "videos", "audio")
_INCLUDING = ("js", "style", "fonts", "documents", "videos", "audio", "images")
PRESETS = {"no-resources": ((), tuple(FAMILIES))} | {f"no-{f}": ((), (f,)) for f in _EXCLUDING} | {f"only-{f}": ((f,), ()) for f in _INCLUDING}
#: Other spellings: the singular of plurals, the plural of ``audio`` and ``style``.
ALIASES = {name[:-1]: name for name in PRESETS if name.endswith("s") and name != "only-js"} | {"no-audios": "no-audio", "only-audios": "only-audio", "only-styles": "only-style"}


@dataclass(frozen=True)
class UrlFilter:
    """Which URLs stay. Lengths are in bytes; patterns are substrings of the whole URL in lower case; exclusion wins."""

    extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None

    def with_presets(self, *names: str) -> UrlFilter:
        """Presets add to what is set already."""
        include, exclude = list(self.extensions), list(self.exclude_extensions)
        for name in names:
            known = preset(name)
            include += [e for f in PRESETS[known][0] for e in FAMILIES[f]]
            exclude += [e for f in PRESETS[known][1] for e in FAMILIES[f]]
        return replace(self, extensions=tuple(include), exclude_extensions=tuple(exclude))

    def column(self, url: Column, *, native: bool = False) -> Column:
        """The decision as one expression, never null."""
        keep = F.lit(True)
        if self.min_length is not None:
            keep &= F.octet_length(url) >= self.min_length
        if self.max_length is not None:
            keep &= F.octet_length(url) <= self.max_length
        low = F.lower(url)
        ext = extension(url, native=native)
        if self.exclude_extensions:
            keep &= ~F.coalesce(ext.isin([e.lower() for e in self.exclude_extensions]), F.lit(False))
        if self.exclude_patterns:
            keep &= ~_any_of(low, self.exclude_patterns)
        if self.extensions:
            keep &= F.coalesce(ext.isin([e.lower() for e in self.extensions]), F.lit(False))
        if self.patterns:
            keep &= _any_of(low, self.patterns)
        return F.coalesce(keep, F.lit(False))


def _any_of(low: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= F.contains(low, F.lit(p.lower()))
    return out


def preset(name: str) -> str:
    """A preset's own name for any accepted spelling; ``ValueError`` names all of them."""
    low = name.strip().lower()
    low = ALIASES.get(low, low)
    if low not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(sorted(PRESETS))}")
    return low


#: How a capture index reads its filters: as regular expressions, or exactly with one value.
CLASSIC, PYWB = "classic", "pywb"


@dataclass(frozen=True)
class CaptureFilter:
    """Predicates on captures that a capture index takes over: date range, status and type, included or excluded."""

    start: str | None = None  # 14 digits
    end: str | None = None
    status: tuple[str, ...] = ()
    exclude_status: tuple[str, ...] = ()
    mime: tuple[str, ...] = ()
    exclude_mime: tuple[str, ...] = ()
    #: Apply here what an index can't express, instead of leaving it out as the indexes do.
    strict: bool = field(default=False, kw_only=True)

    def inert(self, dialect: str) -> list[str]:
        """Included values that a dialect can't express."""
        return [] if dialect == CLASSIC else [name for name in ("status", "mime") if len(getattr(self, name)) > 1]

    def column(self, ts: Column, status: Column, mime: Column, dialect: str = CLASSIC) -> Column:
        """The decision as one expression that scans take over: null, where a value that it needs is unknown, drops a row like false."""
        keep = F.lit(True)
        if self.start:
            keep &= ts >= self.start
        if self.end:
            keep &= ts <= self.end
        dropped = () if self.strict else self.inert(dialect)
        if dropped:
            warnings.warn(f"the index can't filter by several values of {', '.join(dropped)}; they aren't applied", stacklevel=2)
        for name, col in (("status", status), ("mime", mime)):
            included, excluded = getattr(self, name), getattr(self, f"exclude_{name}")
            if included and name not in dropped:
                keep &= _matches(col, included, dialect)
            if excluded:
                keep &= ~_matches(col, excluded, dialect)
        return keep

    def query_params(self, dialect: str) -> str:
        """The same as an index's URL parameters."""
        from urllib.parse import quote_plus

        # asterisks, dots, hyphens and underscores stay; a space is a plus sign
        encode = lambda s: quote_plus(s, safe="*").replace("~", "%7E")
        out = f"&from={self.start}" * bool(self.start) + f"&to={self.end}" * bool(self.end)
        for name, key in (("status", "status" if dialect == PYWB else "statuscode"), ("mime", "mime" if dialect == PYWB else "mimetype")):
            for values, excluded in ((getattr(self, name), False), (getattr(self, f"exclude_{name}"), True)):
                if not values or not excluded and name in self.inert(dialect):
                    continue
                if dialect == CLASSIC:
                    each = [values[0] if len(values) == 1 else "(" + "|".join(values) + ")"]
                else:
                    each = list(values)
                for value in each:
                    mark = "!" * excluded + ("=" if dialect == PYWB and not excluded else "")
                    out += f"&filter={mark}{key}:{encode(value)}"
        return out


def _matches(col: Column, values, dialect: str) -> Column:
    if dialect == CLASSIC:
        return F.rlike(col, F.lit(f"^(?:{'|'.join(values)})$"))
    return col.isin(list(values))


def status_matches(code: Column, patterns) -> Column:
    """Comma lists of codes, or of patterns of the same length in which x is any digit."""
    out = F.lit(False)
    for p in (q.strip() for entry in patterns for q in entry.split(",")):
        if "x" in p.lower():
            regex = "".join("." if c in "xX" else re.escape(c) for c in p)
            out |= F.rlike(code.cast("string"), F.lit(f"^{regex}$"))
        elif p.isdigit():
            out |= code == int(p)
    return F.coalesce(out, F.lit(False))


def status_filter(code: Column, include=(), exclude=()) -> Column:
    """Included patterns make excluded ones void. An unresolved status (null) stays unless patterns are included."""
    if include:
        return status_matches(code, include)
    return ~status_matches(code, exclude) if exclude else F.lit(True)


def shown_status(code: Column) -> Column:
    return F.when(code.isNull(), F.lit("Status check failed")).otherwise(status_text(code))
