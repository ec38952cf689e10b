"""Registered queries over the pipeline-shaped views of the given tables."""

import importlib

MODULES = ("curate", "sampling", "learning", "pixel", "ingest")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tilewright.plans.{m}")
