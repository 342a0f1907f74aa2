"""Readers by format, in order of preference, and the fallback from one to the next."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from quirespark.functions.formats import Text, decode, suffix
from quirespark.schemas import Document, Options


@dataclass(frozen=True)
class Source:
    """One input: its name and bytes. Readers neither write files nor detect again."""

    name: str
    raw: bytes

    @cached_property
    def read(self) -> Text:
        return decode(self.raw)

    @property
    def text(self) -> str:
        return self.read.text

    @property
    def ext(self) -> str:
        return suffix(self.name)


Reader = Callable[[Source, Options], Document]


@dataclass(frozen=True)
class Converter:
    key: str
    name: str
    fn: Reader
    priority: int = 100
    requires: str = ""
    description: str = ""

    # Looked up where the reader would run, without importing anything.
    @property
    def available(self) -> bool:
        return all(importlib.util.find_spec(m) is not None for m in self.requires.split())


@dataclass
class Outcome:
    document: Document
    converter: str = ""


class Registry:
    def __init__(self) -> None:
        self._all: list[Converter] = []

    def register(self, added: Converter, *, replace: bool = False) -> None:
        same = (added.key, added.name)
        kept = [c for c in self._all if not (replace and (c.key, c.name) == same)]
        self._all = sorted([*kept, added], key=lambda c: c.priority)

    def chain(self, key: str) -> list[Converter]:
        """The readers of a format, the preferred one first."""
        return [c for c in self._all if c.key == key]

    def formats(self) -> list[str]:
        return sorted({c.key for c in self._all})

    def describe(self) -> Iterable[dict]:
        for key in self.formats():
            for c in self.chain(key):
                yield {"format": key, "converter": c.name, "priority": c.priority, "available": c.available, "requires": c.requires, "description": c.description}

    def run(self, key: str, source: Source, options: Options) -> Outcome:
        """The first reader that yields text; what was tried before it shows in the warnings."""
        chain = self.chain(key)
        if not chain:
            return Outcome(Document().fail("failed", "no-converter", f"no reader is registered for {key}"))
        usable = [c for c in chain if c.available]
        errors: list[str] = []
        best: Outcome | None = None
        for c in usable:
            try:
                doc = c.fn(source, options)
            except Exception as e:  # noqa: BLE001 - a reader's failure is a row's diagnosis, not the job's
                errors.append(f"{c.name}: {type(e).__name__}: {e}")
                continue
            if doc.status == "failed":
                errors.append(f"{c.name}: " + "; ".join(w["message"] for w in doc.warnings))
                continue
            if doc.blank():
                doc.worsen("empty")
                best = best or Outcome(doc, c.name)
                continue
            if c is not usable[0]:
                doc.flag("fallback-converter", f"read by {c.name} after " + ("; ".join(errors) or "an empty result"))
            better = [x for x in chain if not x.available and x.priority < c.priority]
            if better:
                doc.info("optional-dependency-missing", "better readers need: " + ", ".join(x.requires for x in better))
            return Outcome(doc, c.name)
        if best:
            best.document.error("no-content", "; ".join(["no reader found any text", *errors]))
            return best
        missing = [f"{c.name} needs {c.requires}" for c in chain if not c.available]
        return Outcome(Document().fail("failed", "all-converters-failed", "; ".join(errors + missing) or "no reader succeeded"))


registry = Registry()


def reads(place: str, priority: int, description: str, needs: str = "") -> Callable[[Reader], Reader]:
    """Adds a function to the readers of a format; ``place`` is format/name."""
    key, _, name = place.partition("/")

    def add(fn: Reader) -> Reader:
        registry.register(Converter(key, name, fn, priority, needs, description))
        return fn

    return add


def load() -> Registry:
    """The registry with every built-in reader in it."""
    from quirespark.operators import books, media, office, pdf, structured, textual  # noqa: F401

    return registry
