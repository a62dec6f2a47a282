"""Plug-in points: layout detectors, orders, document parsers, entity recognisers and classifiers.

A backend is registered by kind and name and made when it is asked for, so that its libraries load only where they are used.
What a backend computes is wrapped for Spark by the functions in ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any, Protocol, runtime_checkable

import numpy as np

KINDS = ("layout", "order", "document", "entities", "classifier", "text")
_factories: dict[tuple[str, str], Callable[..., Any]] = {}


@runtime_checkable
class LayoutDetector(Protocol):
    def detect(self, image: bytes) -> list[tuple[str, float, float, float, float, float]]:
        """(label, x1, y1, x2, y2, score) of each region of a page image."""


@runtime_checkable
class Order(Protocol):
    def order(self, boxes: np.ndarray, labels: list[str]) -> list[int]:
        """Permutation of a page's boxes."""


@runtime_checkable
class DocumentParser(Protocol):
    def parse(self, pdf: bytes) -> str:
        """A document as JSON: pages of items with category, text and box."""


@runtime_checkable
class EntityRecogniser(Protocol):
    def entities(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(text, label, score) of each text, aligned with the batch."""


@runtime_checkable
class Classifier(Protocol):
    def classify(self, text: str) -> str:
        """A reply that names one of the classes."""


@runtime_checkable
class TextRecogniser(Protocol):
    def read(self, image: bytes) -> tuple[str, float]:
        """Text of a region's image and its mean confidence."""


def register(kind: str, name: str):
    """Decorator of a factory: register("order", "top-bottom")."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")

    def add(factory):
        _factories[kind, name] = factory
        return factory

    return add


def make(kind: str, name: str, **options) -> Any:
    if (kind, name) not in _factories:
        raise KeyError(f"no {kind} named {name!r}; known: {', '.join(names(kind)) or 'none'}")
    return _factories[kind, name](**options)


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _factories if k == kind)


@dataclass(frozen=True)
class LinkConfig:
    """Bounds of the linking passes."""

    max_document_share: float = 0.25
    min_key_length: int = 4
    fan_out: int = 8
    split_min_headings: int = 3
    split_max_items: float = 10.0
    column_min_headings: int = 2
    column_max_items: float = 12.0
    header_max_words: int = 8
    section_tokens: float = 0.25
    section_characters: float = 0.55
    min_piece_items: int = 3
    classify_max_chars: int = 4000
    classify_min_chars: int = 40
    orphan_distance: float = 0.5

    @classmethod
    def of(cls, settings: dict | None) -> LinkConfig:
        """From a dict of settings; unknown ones are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (settings or {}).items() if k in known})


from . import builtin  # noqa: E402,F401 - registers the backends that need no library
