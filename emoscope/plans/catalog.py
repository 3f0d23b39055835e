"""Imports every query module so that its queries register."""

from __future__ import annotations

import importlib

from emoscope.plans.registry import REGISTRY

MODULES = [
    "emoscope.plans.q_predictions",
    "emoscope.plans.q_corpus",
    "emoscope.plans.q_windows",
    "emoscope.plans.q_text",
    "emoscope.plans.q_arrays",
    "emoscope.plans.q_io",
    "emoscope.plans.q_stream",
    "emoscope.plans.q_more",
]

_loaded = False


def load_all() -> None:
    global _loaded
    if _loaded:
        return
    for m in MODULES:
        importlib.import_module(m)
    _loaded = True


__all__ = ["REGISTRY", "load_all"]
