"""Experiments: parameter grids, features by name, cross-validated scores and a report table."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml.feature import Normalizer, StringIndexer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import signatures
from graphloom.functions.tables import dense_ids, materialise
from graphloom.model import GraphSet
from graphloom.operators import evaluate, kernels, packed, persistence, vectorize, wl
from graphloom.operators.gcn_training import Schedule
from graphloom.operators.signature_training import SignatureNetwork, chunks


def grid(config: dict) -> list[dict]:
    """The configs of all combinations of ``variables``; a value ``~name`` elsewhere stands for the variable."""
    variables = config.get("variables", {})

    def filled(x, chosen):
        if isinstance(x, dict):
            return {k: filled(v, chosen) for k, v in x.items()}
        if isinstance(x, list):
            return [filled(v, chosen) for v in x]
        return chosen.get(x[1:], x) if isinstance(x, str) and x.startswith("~") else x

    rest = {k: v for k, v in config.items() if k != "variables"}
    each = [dict(zip(variables, values)) for values in product(*variables.values())]
    return [filled(rest, chosen) | {"chosen": chosen} for chosen in each]


def grid_table(spark: SparkSession, variables: dict[str, list[str]]) -> DataFrame:
    """One row for each combination."""
    return spark.createDataFrame([*product(*variables.values())], [*variables])


def persistent_features(
    graphs: GraphSet, iterations: int = 2, original: bool = True, label: bool = True, cycle: bool = False, total: bool = False,
    infinity: bool = False, p: float = 2.0, smooth: bool = False,
) -> DataFrame:
    """it, graph_id, block, label, value of the asked blocks of the Weisfeiler-Lehman filtration's features: label
    counts, persistence and cycle persistence by label, total persistence and infinity norm (null label)."""
    if graphs.packed is not None:
        return _packed_features(graphs, iterations, {"original": original, "label": label, "cycle": cycle}, {"total": total, "infinity": infinity}, p, smooth)
    labels, rows = persistence.persistent_wl(graphs, iterations, p=p, smooth=smooth)
    rows = materialise(rows)
    none = F.lit(None).cast("long").alias("label")
    blocks = {
        "original": (original, lambda: wl.histogram(labels).select("it", "graph_id", "label", F.col("n").cast("double").alias("value"))),
        "label": (label, lambda: persistence.label_persistence(labels, rows, p)),
        "cycle": (cycle, lambda: persistence.cycle_persistence(labels, rows, p)),
        "total": (total, lambda: persistence.total_persistence(rows, p).select("it", "graph_id", none, "value")),
        "infinity": (infinity, lambda: persistence.infinity_norm(rows, p).select("it", "graph_id", none, "value")),
    }
    found = None
    for name, (asked, make) in blocks.items():
        if asked:
            x = make().select("it", "graph_id", F.lit(name).alias("block"), "label", "value")
            found = x if found is None else found.union(x)
    if found is None:
        raise ValueError("ask for a block")
    return found


def _packed_features(graphs: GraphSet, iterations: int, by_label: dict[str, bool], whole: dict[str, bool], p: float, smooth: bool) -> DataFrame:
    """The same of a packed collection: a label's blocks from one row of sums each, the others from one pass."""
    def blocks(rows, values, asked, label):
        each = F.array(*[F.struct(F.lit(name).alias("block"), F.col(values[name]).cast("double").alias("value")) for name in asked])
        return rows.select("it", "graph_id", label, F.inline(each)).where("value is not null").select("it", "graph_id", "block", "label", "value")

    asked, found = [name for name, wanted in by_label.items() if wanted], []
    rows = graphs.written().packed
    if asked:
        found.append(blocks(packed.label_sums(rows, iterations, p=p, smooth=smooth), {"original": "n", "label": "points", "cycle": "cycles"}, asked, F.col("label")))
    asked = [name for name, wanted in whole.items() if wanted]
    if asked:
        found.append(blocks(packed.norms(rows, iterations, p=p, smooth=smooth), {name: name for name in asked}, asked, F.lit(None).cast("long").alias("label")))
    if not found:
        raise ValueError("ask for a block")
    return reduce(DataFrame.union, found)


def _persistent(cycles: bool):
    def features(graphs: GraphSet) -> DataFrame:
        found = persistent_features(graphs, cycle=cycles)
        named = F.concat_ws(":", "block", F.col("it").cast("string"), F.col("label").cast("string"))
        return found.select("graph_id", named.alias("feature"), F.col("value").alias("n"))

    return features


def _degree_diagram(graphs: GraphSet) -> DataFrame:
    """graph_id, dim, birth, death of the degree filtration, scaled to [0, 1] by the collection's largest degree."""
    graphs = graphs.written()
    if graphs.packed is not None:
        points, degrees = packed.vertex_diagram(graphs.packed, packed.degree), packed.largest(graphs.packed, packed.degree)
    else:
        points, degrees = persistence.vertex_diagram(graphs, signatures.degree(graphs)), signatures.degree(graphs)
    top = F.broadcast(degrees.agg(F.greatest(F.max("weight"), F.lit(1)).cast("double").alias("top")))
    return points.join(top).select("graph_id", "dim", (F.col("birth") / F.col("top")).alias("birth"), (F.col("death") / F.col("top")).alias("death"))


def _named(values: DataFrame, *name: str) -> DataFrame:
    return values.select("graph_id", F.concat_ws(":", *[F.col(c).cast("string") for c in name]).alias("feature"), F.col("value").alias("n"))


def signature_layers(graphs: GraphSet) -> DataFrame:
    """graph_id, feature, n of three layers of fixed structure elements over degree diagrams: 150 for the
    finite points of dimension 0, turned and stretched like the centres, and 50 each for the births of those
    of dimension 0 and 1 that never die."""
    spark, points = graphs.graphs.sparkSession, materialise(_degree_diagram(graphs))
    finite, never = points.where("dim = 0 and death > birth"), points.where("death is null")
    turned = vectorize.upper_diagonal(finite).withColumnsRenamed({"x": "birth", "y": "death"})
    at = vectorize.centres(spark, 150, 1).select("e", F.col("cx").alias("birth"), F.col("cy").alias("death"))
    at = vectorize.upper_diagonal(at).select("e", F.col("x").alias("cx"), F.col("y").alias("cy"))
    layers = [vectorize.slayer(turned, at)]
    for dim in (0, 1):
        births = vectorize.centres(spark, 50, 2 + dim).select("e", "cx")
        layers.append(vectorize.slayer_births(never.where(F.col("dim") == dim), births))
    found = None
    for name, layer in zip(("finite0", "never0", "never1"), layers):
        x = _named(layer.withColumn("layer", F.lit(name)), "layer", "e")
        found = x if found is None else found.union(x)
    return found


def signature_points(graphs: GraphSet) -> DataFrame:
    """graph_id, part, x, y of the degree diagrams: finite0, points of dimension 0 above the diagonal, turned and
    stretched; never0 and never1, births of points that never die, with a null y."""
    parts = vectorize.diagram_groups(materialise(_degree_diagram(graphs)).select("graph_id", "dim", "birth", "death"))
    finite = vectorize.upper_diagonal(parts.where("part = 'finite0' and death > birth").drop("dim"))
    never = parts.where("part <> 'finite0'").select("graph_id", "part", F.col("birth").alias("x"), F.lit(None).cast("double").alias("y"))
    return finite.union(never)


def signature_network(graphs: GraphSet, config: dict) -> DataFrame:
    """accuracy of learned structure elements as ``run`` measures it, of {epochs, schedule, batch_size, folds, seed}.
    The network is fitted anew without each fold."""
    points, n, seed = materialise(chunks(signature_points(graphs))), config.get("folds", 10), config.get("seed", 1)
    y = F.dense_rank().over(Window.orderBy("y")) - 1
    classes = materialise(graphs.graphs.where("y is not null").select("y").distinct()).withColumn("label", y)
    rows = materialise(evaluate.folds(graphs.graphs.join(F.broadcast(classes), "y"), "graph_id", n, seed))
    count = classes.count()
    each = []
    for k in range(n):
        test = rows.where(F.col("fold") == k)
        if not test.limit(1).count():
            continue
        train = rows.where(F.col("fold") != k).select("graph_id", F.col("label").alias("y"))
        size = config.get("batch_size", 128)
        model = SignatureNetwork(count, group=size, batches=max(1, round(train.count() / size)), seed=seed)
        model.fit(points, train, config.get("epochs", 30), config.get("schedule", Schedule("sgd", 0.1)))
        found = model.predict(points, test).join(test, "graph_id").select("label", "prediction")
        each.append((evaluate.accuracy(found).first()["accuracy"],))
    return graphs.graphs.sparkSession.createDataFrame(each, "accuracy double").agg(F.avg("accuracy").alias("accuracy"))


def _image(graphs: GraphSet) -> DataFrame:
    return _named(vectorize.persistence_image(_degree_diagram(graphs).where("dim = 0"), 1.0), "i", "j")


def _landscape(graphs: GraphSet) -> DataFrame:
    return _named(vectorize.persistence_landscape(_degree_diagram(graphs).where("dim = 0"), 1.0), "k", "i")


GRAPH_KERNELS = {
    "shortest_path": kernels.shortest_path_features,
    "graphlet_sampling": kernels.sampled_graphlets,
    "wl-subtree": lambda g: kernels.wl_features(g, 5),
}
GRAPH_VECTORS = {
    "wl-subtree": lambda g: kernels.wl_features(g, 2),
    "persistent-wl": _persistent(False),
    "persistent-wlc": _persistent(True),
    "signature-layers": signature_layers,
    "persistence-image": _image,
    "persistence-landscape": _landscape,
}
#: Inputs of a network, not of a kernel: not scaled to length 1.
RAW_VECTORS = {"signature-layers"}


def features_of(graphs: GraphSet, kernel: str | None = None, vector: str | None = None) -> DataFrame:
    """graph_id, feature, n of the named kernel's or vector's feature map; one of both must be given."""
    if bool(kernel) == bool(vector):
        raise ValueError("give a graph kernel or a graph vector")
    table, name = (GRAPH_KERNELS, kernel) if kernel else (GRAPH_VECTORS, vector)
    if name not in table:
        raise ValueError(f"unknown name {name!r}")
    return table[name](graphs)


def vectors(features: DataFrame, graphs: DataFrame, unit: bool = True) -> DataFrame:
    """graph_id, features of each of ``graphs`` (graph_id): a sparse vector with one slot for each distinct
    feature and the exact sums as values; of length 1 with ``unit``, so that inner products are the cosine
    kernel. A graph without a feature gets zeros."""
    sums = features.groupBy("graph_id", "feature").agg(F.sum(F.col("n").cast("double")).alias("n"))
    number = materialise(dense_ids(sums.select("feature").distinct(), ["feature"], "slot"))
    size = max(1, number.count())
    rows = sums.join(number, "feature").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("slots"))
    sparse = F.udf(lambda at: Vectors.sparse(size, [(x["slot"], x["n"]) for x in at or []]), VectorUDT())
    raw = graphs.select("graph_id").join(rows, "graph_id", "left").select("graph_id", sparse("slots").alias("features"))
    if not unit:
        return raw
    return Normalizer(inputCol="features", outputCol="unit").transform(raw).select("graph_id", F.col("unit").alias("features"))


def run(graphs: GraphSet, config: dict) -> DataFrame:
    """accuracy of one config, {graph_kernel or graph_vector, classifier, folds, seed}: the average over the
    folds, 10 by default, of the accuracy on a fold after training on the others. Folds without a graph
    don't count. The classifier ``signature-network`` has features of its own."""
    if config.get("classifier") == "signature-network":
        return signature_network(graphs, config)
    found = features_of(graphs, config.get("graph_kernel"), config.get("graph_vector"))
    rows = vectors(found, graphs.graphs, config.get("graph_vector") not in RAW_VECTORS).join(graphs.graphs, "graph_id")
    n = config.get("folds", 10)
    rows = materialise(evaluate.folds(rows, "graph_id", n, config.get("seed", 1)))
    rows = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows).cache()
    size, classes = len(rows.first()["features"]), rows.select("label").distinct().count()
    each = []
    for k in range(n):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if not test.limit(1).count():
            continue
        layers = {"layers": (200, 100, 50)} if config.get("graph_vector") == "signature-layers" else {}
        model = evaluate.classifier(config.get("classifier", "svc"), size, classes, **layers).fit(train)
        each.append((evaluate.accuracy(model.transform(test).select("label", "prediction")).first()["accuracy"],))
    rows.unpersist()
    return graphs.graphs.sparkSession.createDataFrame(each, "accuracy double").agg(F.avg("accuracy").alias("accuracy"))


def report(rows: DataFrame, row: str, column: str, metric: str) -> DataFrame:
    """A table of the metric, row by column."""
    return rows.groupBy(row).pivot(column).agg(F.first(metric))
