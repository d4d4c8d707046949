"""Models over feature tables with MLlib: scaling, trees, boosting, clusters and their quality."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortex.sources.trials import TrialStore
from cohortex.staging import release, stage


def _tree(k: dict) -> dict:
    """Controls that all tree models share: depth, rows of a leaf, gain of a split (pruning), bins, seed."""
    return {"maxDepth": k.get("depth", 5), "minInstancesPerNode": k.get("leaf_rows", 1), "minInfoGain": k.get("least_gain", 0.0), "maxBins": k.get("bins", 32), "seed": k.get("seed", 1)}


MODELS = {
    "tree": lambda **k: DecisionTreeClassifier(**_tree(k)),
    "forest": lambda **k: RandomForestClassifier(numTrees=k.get("trees", 20), featureSubsetStrategy=k.get("features", "auto"), subsamplingRate=k.get("rows", 1.0), **_tree({"depth": 6} | k)),
    "boosting": lambda **k: GBTClassifier(maxIter=k.get("trees", 10), stepSize=k.get("rate", 0.1), subsamplingRate=k.get("rows", 1.0), **({"validationIndicatorCol": k["stop_on"]} if k.get("stop_on") else {}), **_tree({"depth": 3} | k)),
}


def impute(df: DataFrame, fields: list[str], how: str = "median", sentinel: float = -999.0) -> DataFrame:
    """Nulls of ``fields`` (as doubles) replaced by the column's median, or by a sentinel."""
    d = df.withColumns({f: F.col(f).cast("double") for f in fields})
    if how == "sentinel":
        return d.fillna(sentinel, subset=fields)
    return Imputer(strategy="median", inputCols=fields, outputCols=fields, relativeError=0.001).fit(d).transform(d)


def impute_modes(df: DataFrame, fields: list[str]) -> DataFrame:
    """Nulls of categorical ``fields`` replaced by the field's commonest value, the first in order of several."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("x")) for f in fields])
    n = df.select(F.explode(parts).alias("v")).select("v.*").where("x is not null").groupBy("field", "x").agg(F.count(F.lit(1)).alias("n"))
    modes = {r["field"]: r["x"] for r in n.groupBy("field").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("x")).collect()}  # one row a field
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(modes.get(f)).cast(dict(df.dtypes)[f])) for f in fields})


def class_weights(df: DataFrame, label: str, weights: dict[str, float]) -> DataFrame:
    """``df`` with ``weight``: by class, 1 where none is given."""
    return df.withColumn("weight", F.coalesce(*[F.when(F.col(label) == c, F.lit(float(w))) for c, w in weights.items()], F.lit(1.0)))


def fit_classifier(train: DataFrame, fields: list[str], positive: Column, kind: str = "forest", weight: str | None = None, **params):
    """A pipeline of assembler and model; rows with null features must be imputed before."""
    model = MODELS[kind](**params).setFeaturesCol("x").setLabelCol("y")
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=fields, outputCol="x"), model]).fit(train.withColumn("y", positive.cast("double")))


def score(model, df: DataFrame, key: list[str], name: str = "prob") -> DataFrame:
    """``key, prob``: the positive class's probability."""
    return model.transform(df).select(*key, vector_to_array("probability")[1].alias(name))


def importance(model, fields: list[str], spark) -> DataFrame:
    """``feature, importance`` of a tree model."""
    v = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(fields, v)], "feature string, importance double")


def kmeans_profiles(df: DataFrame, key: list[str], fields: list[str], k: int, seed: int = 1, components: int | None = None) -> DataFrame:
    """``key, cluster, *fields``: k-means on standardised (optionally PCA-projected) fields, clusters numbered by falling size."""
    stages = [VectorAssembler(inputCols=fields, outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True)]
    if components:
        stages.append(PCA(k=components, inputCol="z", outputCol="p"))
    stages.append(KMeans(k=k, seed=seed, featuresCol="p" if components else "z", predictionCol="__c"))
    d = Pipeline(stages=stages).fit(df).transform(df).select(*key, "__c", *fields)
    sizes = d.groupBy("__c").count().orderBy(F.col("count").desc(), "__c").collect()  # k rows
    number = F.coalesce(*[F.when(F.col("__c") == r["__c"], F.lit(i)) for i, r in enumerate(sizes)])
    return d.select(*key, number.cast("int").alias("cluster"), *fields)


def cluster_quality(df: DataFrame, cluster: str, fields: list[str]) -> DataFrame:
    """``clusters, n, within, between, calinski_harabasz, size_ratio`` from sums and sums of squares per cluster; one aggregate."""
    sq = sum((F.col(f) * F.col(f) for f in fields), F.lit(0.0))
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(sq).alias("q"), *[F.sum(f).alias(f"s_{f}") for f in fields])
    mine = sum((F.col(f"s_{f}") * F.col(f"s_{f}") for f in fields), F.lit(0.0)) / F.col("n")
    s = per.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum(mine).alias("m"), (F.max("n") / F.min("n")).alias("size_ratio"), *[F.sum(f"s_{f}").alias(f"t_{f}") for f in fields])
    grand = sum((F.col(f"t_{f}") * F.col(f"t_{f}") for f in fields), F.lit(0.0)) / F.col("n")
    s = s.withColumns({"within": F.col("q") - F.col("m"), "between": F.col("m") - grand})
    ch = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return s.select(F.col("k").cast("long").alias("clusters"), F.col("n").cast("long").alias("n"), "within", "between", ch.alias("calinski_harabasz"), "size_ratio")


def adversarial_auc(df: DataFrame, group: str, a, b, fields: list[str], key: list[str]) -> DataFrame:
    """AUC with which a boosted model tells two periods apart: near 0.5 if they look alike.  Odd-hashed keys train, the others test."""
    from cohortex.operators.metrics import auc

    d = impute(df.where(F.col(group).isin(a, b)), fields).withColumn("h", F.pmod(F.xxhash64(*key), F.lit(2)))
    m = fit_classifier(d.where("h = 1"), fields, F.col(group) == b, "boosting")
    test = score(m, d.where("h = 0"), [*key, group])
    return auc(test.withColumn("y", F.col(group) == b), [], "prob", "y").select("auc")


def leaf_profiles(model, df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``key`` and per field the share of a forest's trees in which the row's leaf hangs below a split on that field.

    The trees are walked once on the driver (their size is a parameter of the
    model, not of the data); rows look their leaves up in literal arrays.
    """
    forest = model.stages[-1]
    scored = forest.copy().setLeafCol("__leaf").transform(model.stages[0].transform(df)).withColumn("__leaves", vector_to_array("__leaf"))
    hits = {i: F.lit(0) for i in range(len(fields))}
    trees = forest.trees
    for t, tree in enumerate(trees):
        parents: list[int] = []

        def walk(node, parent, parents=parents) -> None:
            if node.subtreeDepth() == 0:
                parents.append(parent)
                return
            f = node.split().featureIndex()
            walk(node.leftChild(), f)
            walk(node.rightChild(), f)

        walk(tree._java_obj.rootNode(), -1)
        below = F.element_at(F.array(*[F.lit(p) for p in parents]), F.element_at("__leaves", t + 1).cast("int") + 1)
        for i in hits:
            hits[i] = hits[i] + (below == i).cast("int")
    return scored.select(*key, *[(hits[i] / float(len(trees))).alias(f) for i, f in enumerate(fields)])


def silhouette(df: DataFrame, cluster: str, fields: list[str]) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    v = VectorAssembler(inputCols=fields, outputCol="v").transform(df.withColumn("prediction", F.col(cluster)))
    return ClusteringEvaluator(featuresCol="v").evaluate(v)


def davies_bouldin(df: DataFrame, cluster: str, fields: list[str]) -> DataFrame:
    """``clusters, davies_bouldin``: mean over clusters of the worst ratio of two clusters' mean distances to their centres and the distance of the centres.

    Two aggregates over the rows; the k rows of centres are sent to the tasks
    and compared with each other.
    """
    centres = df.groupBy(cluster).agg(*[F.avg(f).alias(f"c_{f}") for f in fields])
    far = F.sqrt(sum(((F.col(f) - F.col(f"c_{f}")) * (F.col(f) - F.col(f"c_{f}")) for f in fields), F.lit(0.0)))
    spread = df.join(F.broadcast(centres), cluster).groupBy(cluster, *[f"c_{f}" for f in fields]).agg(F.avg(far).alias("s"))  # one row a cluster
    other = spread.select(F.col(cluster).alias("o"), F.col("s").alias("o_s"), *[F.col(f"c_{f}").alias(f"o_{f}") for f in fields])
    apart = F.sqrt(sum(((F.col(f"c_{f}") - F.col(f"o_{f}")) * (F.col(f"c_{f}") - F.col(f"o_{f}")) for f in fields), F.lit(0.0)))
    worst = spread.join(F.broadcast(other), F.col(cluster) != F.col("o")).groupBy(cluster).agg(F.max(F.try_divide(F.col("s") + F.col("o_s"), apart)).alias("r"))  # k rows each side
    return worst.agg(F.count(F.lit(1)).alias("clusters"), F.avg("r").alias("davies_bouldin"))


def sweep_clusters(df: DataFrame, key: list[str], fields: list[str], ks: list[int], seed: int = 1) -> DataFrame:
    """``k, silhouette, calinski_harabasz, davies_bouldin, size_ratio, score`` for every number of clusters.

    score: mean of the three indices' places among the ks, scaled to [0, 1],
    1 being best (Davies-Bouldin counts from the smallest).
    """
    got = []
    for k in ks:
        c = stage(kmeans_profiles(df, key, fields, k, seed), "sweep")
        q = cluster_quality(c, "cluster", fields).first()
        got.append((k, silhouette(c, "cluster", fields), q["calinski_harabasz"], davies_bouldin(c, "cluster", fields).first()["davies_bouldin"], q["size_ratio"]))
        release(c)
    place = lambda i, up: {r[0]: sum((o[i] < r[i]) if up else (o[i] > r[i]) for o in got) / max(1, len(got) - 1) for r in got}
    places = [place(1, True), place(2, True), place(3, False)]
    rows = [(*r, sum(p[r[0]] for p in places) / 3) for r in got]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, size_ratio double, score double")


def cross_validate(df: DataFrame, fold: str, fields: list[str], positive: Column, kind: str = "forest", **params) -> DataFrame:
    """``fold, auc``: every fold judged by a model of the others."""
    from cohortex.operators.metrics import auc

    out = []
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        m = fit_classifier(df.where(F.col(fold) != f), fields, positive, kind, **params)
        s = score(m, df.where(F.col(fold) == f).withColumn("__y", positive), ["__y"])
        out.append((f, auc(s, [], "prob", "__y").first()["auc"]))
    return df.sparkSession.createDataFrame(out, f"{fold} {dict(df.dtypes)[fold]}, auc double")


def random_search(folds: list[tuple[DataFrame, DataFrame]], fields: list[str], positive: Column, space: dict[str, tuple], trials: int, seed: int, kind: str = "forest", store: TrialStore | None = None, study: str = "study", warm: int = 3) -> DataFrame:
    """``trial, params, value, state``: seeded draws from ``space``, each judged by its mean AUC over ``folds``, pruned and resumable.

    space: per parameter (low, high) of two ints or floats, or a list of
    choices.  After every fold a trial whose mean so far is below the median of
    the finished trials' means at that fold is given up (``pruned``), once
    ``warm`` are finished.  With a ``store`` finished and pruned trials of the
    study are read back and not repeated: the draws of a trial depend on the
    seed and its number alone.
    """
    import json
    import random
    from statistics import median

    from cohortex.operators.metrics import auc

    known = store.load(study) if store else {}
    for no in range(trials):
        if no in known:
            continue
        rng = random.Random(f"{seed}:{no}")
        params = {k: rng.choice(v) if isinstance(v, list) else rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v) for k, v in sorted(space.items())}
        path, state = [], "complete"
        for train, valid in folds:
            m = fit_classifier(train, fields, positive, kind, **params)
            path.append(auc(score(m, valid.withColumn("__y", positive), ["__y"]), [], "prob", "__y").first()["auc"] or 0.0)
            at = len(path)
            others = [sum(t["path"][:at]) / at for t in known.values() if t["state"] == "complete"]
            if at < len(folds) and len(others) >= warm and sum(path) / at < median(others):
                state = "pruned"
                break
        known[no] = {"params": json.dumps(params, sort_keys=True), "path": path, "state": state}
        if store:
            store.add(study, no, known[no]["params"], path, state)
    rows = [(no, t["params"], sum(t["path"]) / len(t["path"]), t["state"]) for no, t in sorted(known.items()) if no < trials]
    return folds[0][0].sparkSession.createDataFrame(rows, "trial int, params string, value double, state string")


def grid_search(train: DataFrame, valid: DataFrame, fields: list[str], positive: Column, grid: list[dict], kind: str = "forest") -> DataFrame:
    """``trial, params, auc`` on ``valid`` for every parameter set, in order; the caller picks."""
    from cohortex.operators.metrics import auc

    out = []
    for i, params in enumerate(grid):
        m = fit_classifier(train, fields, positive, kind, **params)
        s = score(m, valid.withColumn("__y", positive), ["__y"])
        out.append((i, repr(sorted(params.items())), auc(s, [], "prob", "__y").first()["auc"]))
    return train.sparkSession.createDataFrame(out, "trial int, params string, auc double")
