"""Experiments and diagrams from config files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import signatures
from graphloom.functions.tables import materialise
from graphloom.model import GraphSet
from graphloom.operators import persistence
from graphloom.operators.gcn_training import Schedule
from graphloom.plans import experiment

try:
    import yaml
except ImportError:  # configs can still be given as dicts
    yaml = None


def read(text: str) -> dict:
    """A config from YAML."""
    if yaml is None:
        raise RuntimeError("reading configs needs PyYAML")
    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a config is a mapping")
    return found


def training(train: dict) -> dict:
    """epochs, batch_size and schedule of a config's ``train``: {num_epochs, batch_size, optimizer: {name, lr,
    weight_decay, momentum}, lr_scheduler: {milestones, gamma}}."""
    step, later = train.get("optimizer") or {}, train.get("lr_scheduler") or {}
    rest = {k: float(step[k]) for k in ("weight_decay", "momentum") if k in step}
    at = {"milestones": tuple(later.get("milestones", ())), "gamma": float(later.get("gamma", 0.1))}
    schedule = Schedule(step.get("name", "sgd"), float(step.get("lr", 0.1)), **rest, **at)
    return {"epochs": train.get("num_epochs", 30), "batch_size": train.get("batch_size", 128), "schedule": schedule}


def plans(config: dict, env: str | None = None) -> tuple[list[dict], dict | None]:
    """(experiments, report) of a config's environment ``env`` (its only one by default): an experiment for each
    combination of the environment's variables, {dataset_name, graph_kernel or graph_vector, classifier,
    folds, chosen}; the report's row and col.

    The classifier is the last part of model.name in lower case; train.cross_validation is the share of a fold.
    ``signature-network`` also takes train's num_epochs, batch_size, optimizer and lr_scheduler.
    """
    envs = config.get("env") or {"": {"variables": config.get("variables", {}), "report": config.get("report")}}
    if env is None and len(envs) > 1:
        raise ValueError(f"name one of the environments {sorted(envs)}")
    name = next(iter(envs)) if env is None else env
    if name not in envs:
        raise ValueError(f"unknown environment {name!r}")
    chosen = envs[name] or {}
    found = []
    for one in experiment.grid({**{k: v for k, v in config.items() if k != "env"}, "variables": chosen.get("variables") or {}}):
        data = one.get("dataset") or {}
        share = (one.get("train") or {}).get("cross_validation", 0.1)
        if not 0 < share <= 0.5:
            raise ValueError("cross_validation is the share of a fold, up to a half")
        made = {k: data[k] for k in ("dataset_name", "graph_kernel", "graph_vector") if data.get(k)}
        classifier = str((one.get("model") or {}).get("name", "svc")).rsplit(".", 1)[-1].lower()
        if classifier == "signature-network":
            made |= training(one.get("train") or {})
        found.append(made | {"classifier": classifier, "folds": round(1 / share), "chosen": one["chosen"]})
    return found, chosen.get("report")


def run(config: dict, datasets: Mapping[str, GraphSet], env: str | None = None) -> DataFrame:
    """The accuracy of each of a config's experiments beside its variables, or its report's table. ``datasets``
    has the collections by dataset_name; one that is missing raises before anything runs."""
    each, report = plans(config, env)
    missing = {p.get("dataset_name") for p in each} - set(datasets)
    if missing:
        raise ValueError(f"unknown datasets {sorted(map(str, missing))}")
    scores = [experiment.run(datasets[p["dataset_name"]], p).select(*[F.lit(v).alias(k) for k, v in p["chosen"].items()], "accuracy") for p in each]
    found = reduce(DataFrame.union, scores)
    return experiment.report(found, report["row"], report["col"], "accuracy") if report else found


def diagrams(graphs: GraphSet, config: dict) -> DataFrame:
    """graph_id, dim, birth, death, creator of a config {graph_filtration, options, normalize, threshold}: the named
    signature's filtration, written once, then scaled to [0, 1] in each graph and cut at a persistence, if asked."""
    graphs = graphs.written()
    weights = signatures.signature(graphs, config.get("graph_filtration", "vertex_degree"), **config.get("options", {}))
    points = materialise(persistence.vertex_diagram(graphs, weights))
    if config.get("normalize"):
        points = persistence.normalise(points)
    return persistence.threshold(points, config["threshold"]) if config.get("threshold") is not None else points


def distances(graphs: GraphSet, pairs: DataFrame, config: dict) -> DataFrame:
    """g1, g2, distance of the pairs (g1, g2) by a config {graph_kernel: bottleneck_distance, ...} of ``diagrams``,
    over the points of dimension ``dim`` (0 by default) that die."""
    if config.get("graph_kernel") != "bottleneck_distance":
        raise ValueError(f"unknown distance {config.get('graph_kernel')!r}")
    return persistence.bottleneck_distances(diagrams(graphs, config).where(F.col("dim") == config.get("dim", 0)), pairs)
