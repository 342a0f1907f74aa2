"""File names, paths and URLs from untrusted sources."""

from __future__ import annotations

import os
import re
import unicodedata
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES, MAX_RATIO, MAX_EXPANDED = 512 << 20, 200, 4 << 30
_RESERVED = set("aux con nul prn".split()) | {p + d for p in ("lpt", "com") for d in "123456789"}
_UNSAFE = r'[\x00-\x1f"*/:<>?|\\]'
_PRIVATE = r"^(0\.|10\.|127\.|172\.(3[01]|2\d|1[6-9])\.|192\.168\.|169\.254\.|localhost|\[?::1|\[?fe80|\[?f[cd])"


class UnsafeInput(ValueError):
    """A limit that protects the engine was exceeded."""


def safe_filename(name: str, fallback: str = "untitled", longest: int = 120) -> str:
    """A plain file name: no folders, reserved marks or names, and not too long."""
    name = unicodedata.normalize("NFC", name or "").replace("\\", "/").rsplit("/", 1)[-1]
    name = re.sub(_UNSAFE, "_", name).strip().strip(".").strip()
    if not name:
        return fallback
    stem, ext = os.path.splitext(name)
    if stem.lower() in _RESERVED:
        stem += "_"
    return stem[: max(longest - len(ext), 1)] + ext


def safe_stem(name: str, fallback: str = "untitled", longest: int = 100) -> str:
    return os.path.splitext(safe_filename(name, fallback))[0][:longest] or fallback


def inside(base: str, path: str) -> str:
    """The canonical path, if it lies inside the canonical base."""
    root, real = os.path.realpath(base), os.path.realpath(path)
    if real != root and not real.startswith(root.rstrip(os.sep) + os.sep):
        raise UnsafeInput(f"{path} leaves {base}")
    return real


def safe_join(base: str, *parts: str) -> str:
    return inside(base, os.path.join(base, *(safe_filename(p) for p in parts)))


def check_archive(packed: int, expanded: int) -> None:
    if expanded > MAX_EXPANDED:
        raise UnsafeInput(f"archive expands to {expanded} bytes, more than {MAX_EXPANDED}")
    if packed > 0 and expanded / packed > MAX_RATIO:
        raise UnsafeInput(f"archive expands {expanded / packed:.0f} times, more than {MAX_RATIO}")


def may_fetch(url: str) -> bool:
    try:
        found = urlsplit(url)
        return found.scheme in ("http", "https") and bool(found.hostname) and not re.match(_PRIVATE, found.hostname.lower())
    except ValueError:
        return False


# ---- the same as Columns


def url_allowed(url: Column) -> Column:
    """http or https, with a host, which is neither private nor local. A host name that begins
    like a private address is refused as well."""
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return F.coalesce(F.lower(scheme).isin("http", "https") & (host != "") & ~host.rlike(_PRIVATE), F.lit(False))


def filename_column(name: Column, fallback: str = "untitled", longest: int = 120) -> Column:
    """safe_filename() for names whose accents are already composed."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), r"^.*/", "")
    clean = F.regexp_replace(F.regexp_replace(base, _UNSAFE, "_"), r"^[\s.]+|[\s.]+$", "")
    ext = F.regexp_extract(clean, r"^.+(\.[^.]*)$", 1)
    stem = F.substring(clean, F.lit(1), F.length(clean) - F.length(ext))
    stem = F.when(F.lower(stem).isin(*sorted(_RESERVED)), F.concat(stem, F.lit("_"))).otherwise(stem)
    return F.when(clean == "", F.lit(fallback)).otherwise(
        F.concat(F.substring(stem, F.lit(1), F.greatest(F.lit(longest) - F.length(ext), F.lit(1))), ext)
    )


def archive_bomb(packed: Column, expanded: Column) -> Column:
    return (expanded > MAX_EXPANDED) | ((packed > 0) & (expanded / packed > MAX_RATIO))
