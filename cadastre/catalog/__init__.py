"""Registered queries, grouped as the operators are."""

import importlib

GROUPS = ("scalar", "measures", "joins", "audit", "store", "detect", "infer", "raster", "streams")


def load() -> None:
    for group in GROUPS:
        importlib.import_module(f"cadastre.catalog.{group}")
