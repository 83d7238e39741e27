"""tidemark: a Spark-native engine for declarative, labelled time series."""

__version__ = "0.1.0"
#: Public names and where they are; each is loaded when it is first used.
_PUBLIC = {
    "Engine": "plans.engine", "SPLITS": "plans.engine", "Dataset": "plans.dataset", "generate_dataset": "plans.dataset", "AddOn": "plans.addons", "Metadata": "plans.addons",
    "register_oscillation": "plans.registry", "register_anomaly": "plans.registry", "ConfigError": "sources.config", "api": "functions.api",
}
__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str):
    import importlib

    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module = importlib.import_module(f".{_PUBLIC[name]}", __name__)
    return module if name == "api" else getattr(module, name)
