"""Named parts of a deployment: sources, processors, detectors, scalers and clusterers, found by name or dotted path."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame

from flowmill.operators.windower import Settings

_PARTS: dict[str, dict[str, Callable]] = {}
#: What the library itself offers; imported when it is asked for.
_BUILT_IN = {
    "source": {"files": "flowmill.sources.files.load", "netflow": "flowmill.sources.files.read_netflow", "broker": "flowmill.sources.broker.BrokerSource"},
    "processor": {"ipfix": "flowmill.sources.ingest.explode_ipfix", "netflow9": "flowmill.sources.ingest.explode_netflow9", "windows": "flowmill.operators.windower.window_features"},
    "detector": {"chain": "flowmill.operators.ml.detection_chain", "decision": "flowmill.operators.ml.detect"},
    "scaler": {"config": "flowmill.operators.scaling.scale", "min_max": "flowmill.operators.scaling.apply_min_max", "quantile": "flowmill.operators.ml.quantile_uniform"},
    "clusterer": {"kmeans": "flowmill.operators.ml.kmeans_grid", "dbscan": "flowmill.operators.ml.dbscan", "k_medoids": "flowmill.operators.ml.k_medoids"},
}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Decorator: make a factory known, e.g. register("detector", "ai")."""
    def add(factory: Callable) -> Callable:
        _PARTS.setdefault(kind, {})[name] = factory
        return factory

    return add


def find(kind: str, name: str) -> Callable:
    """A registered factory, or the object at a dotted path such as package.module.Class."""
    if name in _PARTS.get(kind, {}):
        return _PARTS[kind][name]
    module, _, attribute = _BUILT_IN.get(kind, {}).get(name, name).rpartition(".")
    if not module:
        raise KeyError(f"no {kind} named {name}; known: {sorted({*_PARTS.get(kind, {}), *_BUILT_IN.get(kind, {})})}")
    return getattr(importlib.import_module(module), attribute)


class Detector:
    """A detector turns flows into rows of flow_id, detector, event_name and metric."""

    name = "detector"

    def score(self, flows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def run(self, flows: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        return self.score(flows).select("flow_id", F.lit(self.name).alias("detector"), "event_name", "metric")


# Names of the windower's settings in configuration files, by our names.
SETTING_NAMES = {
    "window_ms": "window_size", "min_flows": "win_min_entries", "min_windows": "win_min_cnt", "timeout": "win_timeout", "max_windows": "win_max_cnt",
    "longest_flow_ms": "flow_winspan_max_len", "samples": "samples_cnt",
}


def load_config(path: str) -> dict[str, Any]:
    """A configuration from YAML or JSON; YAML needs its library."""
    with open(path) as text:
        if path.endswith(".json"):
            return json.load(text)
        import yaml

        return yaml.safe_load(text)


def window_settings(config: dict[str, Any]) -> Settings:
    """Settings from a configuration; names that are missing keep their default. window_size is in seconds below 1000, else in ms."""
    found = {f.name: config[SETTING_NAMES[f.name]] for f in fields(Settings) if SETTING_NAMES.get(f.name) in config}
    if "window_ms" in found and found["window_ms"] < 1000:
        found["window_ms"] = int(found["window_ms"] * 1000)
    return Settings(**found)
