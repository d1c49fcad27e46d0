"""Every registered query; importing the package fills the registry."""

import importlib
import pkgutil

from paperfold.catalog.registry import REGISTRY, runner

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["REGISTRY", "runner"]
