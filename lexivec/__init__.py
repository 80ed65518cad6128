"""Word embeddings learned and served as Spark DataFrames."""

_PUBLIC = {"WordVectors": "lexivec.estimator", "WordVectorsModel": "lexivec.estimator",
           "TrainSettings": "lexivec.settings"}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    # On first use: tasks import their own modules without the ML classes.
    if name not in _PUBLIC:
        raise AttributeError(name)
    import importlib

    return getattr(importlib.import_module(_PUBLIC[name]), name)
