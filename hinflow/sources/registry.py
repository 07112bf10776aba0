"""Named loaders, so that a project can add its own."""

from __future__ import annotations

from collections.abc import Callable

from . import hin

LOADERS: dict[str, Callable] = {"native": hin.read_native, "hne": hin.read_hne}


def register_loader(name: str, loader: Callable) -> None:
    LOADERS[name] = loader


def supported() -> list[str]:
    return sorted(LOADERS)


def load(name: str, spark, *args, **options):
    if name not in LOADERS:
        raise KeyError(f"no loader {name!r}; there are {supported()}")
    return LOADERS[name](spark, *args, **options)
