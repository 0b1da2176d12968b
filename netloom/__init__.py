"""Per-observation networks on Spark."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PUBLIC = {
    "RunConfig": "config", "PreprocessConfig": "config", "RunResult": "plans.run", "run_modules": "plans.run",
    "run_directory": "plans.run", "build_modules": "plans.preprocess", "build_scores": "plans.score",
}
__all__ = list(_PUBLIC)


def __getattr__(name):
    if name not in _PUBLIC:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
