"""Isolation forest (Liu, Ting and Zhou 2008), one per commune.

All trees of all groups grow together, a level at a time: each node's rows give its extremes,
and the split is drawn from them by a hash of (seed, group, tree, node), so the draw depends on
nothing else. Nodes are numbered as in a heap and become rows of a node table. Scoring follows
all trees of a group at once on Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from viario.config import FOREST, FOREST_FEATURES
from viario.functions.numbers import no_nan
from viario.operators.quantiles import quantiles
from viario.operators.small import join_groups
from viario.storage import materialise, path_exists

MIN_ROWS = 10
MIN_FEATURES = 3
BROADCAST_NODES = 2_000_000  # about 80 MB of node arrays per executor
SALT_ROWS = 200_000          # rows of a group scored in one task when nodes are not broadcast

PRIME = (1 << 31) - 1        # ranks of rows for a tree are multiples of their number modulo this
NANO = 1_000_000_000         # path lengths are added as whole numbers of this size, so their order does not matter

NODES = "grp string, tree int, node int, feature int, threshold double, lo int, hi int, path double"
_GROUP, _HASH, _SALT = "__grp", "__hash", "__salt"

# The code of this module travels with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n values."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def pack_trees(nodes: pd.DataFrame, subsample: int) -> dict:
    """All trees of one group as plain arrays."""
    shape = (nodes["tree"].max() + 1, nodes["node"].max() + 1)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    packed = {
        "depth": math.ceil(math.log2(max(subsample, 2))),
        "norm": float(expected_path(subsample)) or 1.0,
    }
    for name, kind in (("feature", np.int32), ("threshold", float), ("lo", np.int32),
                       ("hi", np.int32), ("path", float)):
        packed[name] = np.zeros(shape, dtype=kind)
        packed[name][at] = nodes[name].to_numpy()
    packed["path"] = np.rint(packed["path"] * NANO).astype(np.int64)
    return packed


def tree_scores(packed: dict, x: np.ndarray) -> np.ndarray:
    """The more negative, the easier a row is to isolate. All trees are followed at once."""
    trees = np.arange(len(packed["feature"]))[None, :]
    rows = np.arange(len(x))[:, None]
    at = np.zeros((len(x), trees.shape[1]), dtype=np.int32)
    for _ in range(packed["depth"]):
        feature = packed["feature"][trees, at]
        left = x[rows, np.maximum(feature, 0)] <= packed["threshold"][trees, at]
        step = np.where(left, packed["lo"][trees, at], packed["hi"][trees, at])
        at = np.where(feature < 0, at, step)
    total = packed["path"][trees, at].sum(axis=1)
    return -np.exp2(-(total / NANO / trees.shape[1]) / packed["norm"])


def drawn_number(*parts: Column) -> Column:
    """A number below 2^52 from the text of some values."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(13)), 16, 10).cast("long")


def features_of(df: DataFrame) -> list[str]:
    return [f for f in FOREST_FEATURES if f in df.columns]


def prepare(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Features as numbers f0, f1, .. with the gaps filled by the median of the group."""
    numeric = df.withColumns({f"__f{i}": no_nan(F.col(f)) for i, f in enumerate(features)})
    numeric = numeric.withColumn(_GROUP, F.col(group).cast("string"))
    names = [f"__f{i}" for i in range(len(features))]
    counts = numeric.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    for n in names:
        if counts[n]:
            middle = quantiles(numeric, n, {"__m": 0.5}, [_GROUP]).select(_GROUP, "__m")
            numeric = join_groups(numeric, middle, [_GROUP]).withColumn(n, F.coalesce(n, "__m")).drop("__m")
    return numeric


def _eligible(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Groups with enough complete rows."""
    complete = reduce(lambda a, b: a & b, [no_nan(F.col(f)).isNotNull() for f in features])
    keyed = df.select(F.col(group).cast("string").alias(_GROUP), complete.alias("ok")).dropna()
    counts = keyed.groupBy(_GROUP).agg(F.count_if(F.col("ok")).alias("complete"),
                                       F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("complete") >= MIN_ROWS)


def _draw(prepared: DataFrame, groups: DataFrame, names: list[str], params: dict, row_id: list[str] | None) -> DataFrame:
    """The rows of each tree: those with the smallest ranks, `subsample` at most, with __m, their number.

    A bound on the rank that few groups of this size would miss leaves about as many rows as are
    drawn, so little more than the drawn rows is moved."""
    own = row_id or [c for c in prepared.columns if c not in names]
    source = prepared.withColumn(_HASH, drawn_number(F.lit(params["seed"]), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in own]))
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    rows = join_groups(source.where(complete).select(_GROUP, _HASH, *names), groups.select(
        _GROUP, F.col("n").alias("__n")), [_GROUP], "inner")
    wanted = params["subsample"]
    share = F.least(F.lit(1.0), F.lit(wanted + 8 * math.sqrt(wanted) + 8) / F.col("__n"))
    tree = F.col("__tree").cast("long") + 1
    rank = (F.col(_HASH) % PRIME * (1 + tree * 1103515245 % (PRIME - 1)) + tree * 12345701 % PRIME) % PRIME
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(params["trees"] - 1))).alias("__tree")).select(
        _GROUP, _HASH, *names, "__tree", rank.alias("__rank"), share.alias("__share")).where(
        F.col("__rank") <= F.col("__share") * F.lit(float(PRIME)))
    tree = Window.partitionBy(_GROUP, "__tree")
    place = F.row_number().over(tree.orderBy("__rank", _HASH, *names))
    drawn = dealt.withColumn("__place", place).where(F.col("__place") <= wanted)
    return drawn.select(_GROUP, "__tree", *names, F.count(F.lit(1)).over(tree).alias("__m"))


def _level(rows: DataFrame, names: list[str], depth: int, seed: int) -> DataFrame:
    """Decide the nodes of a depth: each row adds its node to its trail and goes to a child, or stays at a leaf."""
    features = ", ".join(names)
    own = [_GROUP, "__tree", *names, "__m", "__node", "__trail", "__alive"]

    def over(what: str) -> str:
        return f"{what} OVER (PARTITION BY {_GROUP}, __tree, __node)"

    def number(what: str) -> str:
        return f"CAST(conv(substr(md5(concat_ws('|', {seed}, {_GROUP}, __tree, __node, '{what}')), 1, 13), 16, 10) AS BIGINT)"

    seen = rows.selectExpr(
        *own, f"array({', '.join(over(f'min({n})') for n in names)}) AS __low",
        f"array({', '.join(over(f'max({n})') for n in names)}) AS __high", f"{over('count(1)')} AS __size")
    seen = seen.selectExpr("*", f"filter(sequence(0, {len(names) - 1}), i -> get(__high, i) > get(__low, i)) AS __varying")
    # a tree of m rows goes on to the depth ceil(log2(m)), the binary digits of m - 1
    seen = seen.selectExpr("*", f"""CASE WHEN length(bin(__m - 1)) > {depth} AND size(__varying) > 0
        THEN get(__varying, CAST({number("feature")} % greatest(size(__varying), 1) AS INT)) ELSE -1 END AS __feature""")
    least, most = "get(__low, greatest(__feature, 0))", "get(__high, greatest(__feature, 0))"
    cut = f"({least} + CAST({number('threshold')} AS DOUBLE) / {float(1 << 52)!r}D * ({most} - {least}))"
    seen = seen.selectExpr("*", f"CASE WHEN __feature < 0 THEN 0D WHEN {cut} < {most} THEN {cut} ELSE {least} END AS __threshold")
    return seen.selectExpr(
        _GROUP, "__tree", *names, "__m",
        f"""CASE WHEN NOT __alive OR __feature < 0 THEN __node
            WHEN get(array({features}), __feature) <= __threshold THEN 2 * __node + 1 ELSE 2 * __node + 2 END AS __node""",
        f"""CASE WHEN __alive THEN concat(__trail, array(named_struct('node', __node, 'feature', __feature, 'threshold', __threshold,
            'depth', {depth}, 'size', __size))) ELSE __trail END AS __trail""",
        "__alive AND __feature >= 0 AS __alive")


def train(
    prepared: DataFrame, groups: DataFrame, n_features: int, params: dict, row_id: list[str] | None = None,
) -> DataFrame:
    """Node table of all trees of the given groups (group, n rows).

    The rows of a (group, tree) are drawn to one place and stay there for all levels: every
    level is a window over the nodes, and nothing is moved again but the nodes at the end."""
    names = [f"__f{i}" for i in range(n_features)]
    rows = _draw(prepared, groups, names, params, row_id)
    trail = "array<struct<node:int,feature:int,threshold:double,depth:int,size:bigint>>"
    rows = rows.withColumns({"__node": F.lit(0), "__trail": F.array().cast(trail), "__alive": F.lit(True)})
    for depth in range((params["subsample"] - 1).bit_length() + 1):
        rows = _level(rows, names, depth, params["seed"])
    facts = rows.select(F.col(_GROUP).alias("grp"), F.col("__tree").alias("tree"), F.col("__m").cast("int").alias("subsample"),
                        F.inline("__trail"))
    nodes = facts.groupBy("grp", "tree", "node").agg(*[
        F.any_value(c).alias(c) for c in ("feature", "threshold", "depth", "size", "subsample")])
    n = F.col("size").cast("double")
    rest = F.when(n > 2, 2.0 * (F.ln(n - 1) + F.lit(float(np.euler_gamma))) - 2.0 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)
    leaf = F.col("feature") < 0
    return nodes.select(
        "grp", "tree", "node", "feature", "threshold", (2 * F.col("node") + 1).alias("lo"), (2 * F.col("node") + 2).alias("hi"),
        F.when(leaf, F.col("depth") + rest).otherwise(0.0).alias("path"), "subsample")


def score(prepared: DataFrame, nodes: DataFrame, n_features: int, keep: list[str],
          broadcast_nodes: int = BROADCAST_NODES, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Add __score; null for groups without a model."""
    names = [f"__f{i}" for i in range(n_features)]
    if nodes.count() <= broadcast_nodes:
        return _score_by_broadcast(prepared, nodes, names, keep)
    return _score_by_salt(prepared, nodes, names, keep, salt_rows)


def _score_by_broadcast(prepared, nodes, names, keep) -> DataFrame:
    table = nodes.toPandas()  # at most BROADCAST_NODES rows, counted before
    model = {g: pack_trees(t, int(t["subsample"].iloc[0])) for g, t in table.groupby("grp")}
    shared = prepared.sparkSession.sparkContext.broadcast(model)

    def follow(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for group, *values in batches:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values])
            out = np.full(len(group), np.nan)
            for name, rows in group.groupby(group).indices.items():
                if name in shared.value:
                    out[rows] = tree_scores(shared.value[name], x[rows])
            yield pd.Series(out)

    udf = F.pandas_udf(follow, "double")
    return prepared.withColumn("__score", F.nanvl(udf(_GROUP, *names), F.lit(None).cast("double"))).select(
        *keep, _GROUP, "__score"
    )


def _score_by_salt(prepared, nodes, names, keep, salt_rows) -> DataFrame:
    sizes = materialise(prepared.dropna(subset=[_GROUP]).groupBy(_GROUP).agg(
        F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("__salts")
    ), "forest-sizes")
    rows = join_groups(prepared.select(*keep, _GROUP, *names), sizes, [_GROUP], "inner")
    rows = rows.withColumn(_SALT, F.pmod(F.xxhash64(*keep), "__salts").cast("int")).drop("__salts")
    copies = nodes.join(sizes.withColumnRenamed(_GROUP, "grp"), "grp").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    ).drop("__salts")

    def follow(data: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = data.drop(columns=[*names, _SALT])
        out["__score"] = np.nan
        if len(data) and len(trees):
            packed = pack_trees(trees, int(trees["subsample"].iloc[0]))
            out["__score"] = tree_scores(packed, data[names].to_numpy(dtype=float))
        return out

    kept = rows.drop(*names, _SALT).withColumn("__score", F.lit(None).cast("double"))
    scored = rows.groupBy(_GROUP, _SALT).cogroup(copies.groupBy("grp", _SALT)).applyInPandas(
        follow, kept.schema
    )
    unkeyed = prepared.where(F.col(_GROUP).isNull()).select(
        *keep, _GROUP, F.lit(None).cast("double").alias("__score")
    )
    filled = F.nanvl("__score", F.lit(None).cast("double"))
    return scored.withColumn("__score", filled).unionByName(unkeyed)


def model_key(features: list[str], group: str, params: dict) -> str:
    text = json.dumps([features, group, params], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _saved(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The node table under a path, or nothing when there is none or it cannot be read."""
    if path is None or not path_exists(spark, path):
        return None
    nodes = spark.read.schema(NODES + ", subsample int, cutoff double").parquet(path).drop("part")
    try:
        readable = nodes.agg(F.count("cutoff")).first()[0] > 0
    except (PySparkException, Py4JJavaError):
        return None
    return nodes if readable else None


def detect_forest(
    df: DataFrame, models_path: str | None = None, params: dict | None = None,
    row_id: list[str] | None = None, broadcast_nodes: int = BROADCAST_NODES,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Add isolation_forest_anomaly and isolation_score.

    Saved models under `models_path` are used again; groups without one are trained."""
    params = params or FOREST
    plain = df.withColumns({"isolation_forest_anomaly": F.lit(False), "isolation_score": F.lit(0.0)})
    group = next((c for c in ("nombre_comuna", "corredor") if c in df.columns), None)
    features = features_of(df)
    if group is None or len(features) < MIN_FEATURES:
        return plain
    spark, n = df.sparkSession, len(features)
    prepared = prepare(df, group, features)
    path = models_path and f"{models_path}/forest-{model_key(features, group, params)}"
    model = _saved(spark, path)
    missing = _eligible(df, group, features)
    if model is not None:
        known = model.select(F.col("grp").alias(_GROUP)).distinct()
        missing = missing.join(known, _GROUP, "left_anti")
    missing = materialise(missing, "forest-groups")
    if missing.isEmpty():
        if model is None:
            return plain
        scored, cutoffs = score(prepared, model.drop("cutoff"), n, df.columns, broadcast_nodes, salt_rows), _cutoffs(model)
    else:
        nodes = materialise(train(prepared, missing, n, params, row_id), "forest-nodes")
        every = nodes if model is None else nodes.unionByName(model.select(nodes.columns))
        # Scored once: the cutoffs of new models come from the same scores.
        scored = materialise(score(prepared, every, n, df.columns, broadcast_nodes, salt_rows), "forest-scores")
        own = join_groups(scored.select(_GROUP, "__score"), missing.select(_GROUP), [_GROUP], "left_semi")
        cutoffs = materialise(quantiles(own, "__score", {"cutoff": params["contamination"]}, [_GROUP]).select(_GROUP, "cutoff"), "forest-cutoffs")
        if path:
            trained = join_groups(nodes, cutoffs.withColumnRenamed(_GROUP, "grp"), ["grp"], "inner")
            save_model(trained, path, afresh=model is None)
        cutoffs = cutoffs if model is None else cutoffs.unionByName(_cutoffs(model))
    flag = F.coalesce(F.col("__score") < F.col("cutoff"), F.lit(False))
    return join_groups(scored, cutoffs, [_GROUP]).select(
        *df.columns, flag.alias("isolation_forest_anomaly"),
        F.coalesce("__score", F.lit(0.0)).alias("isolation_score"),
    )


def _cutoffs(model: DataFrame) -> DataFrame:
    return materialise(model.groupBy(F.col("grp").alias(_GROUP)).agg(F.max("cutoff").alias("cutoff")), "forest-cutoffs")


def save_model(nodes: DataFrame, path: str, afresh: bool = False) -> None:
    """Write the node tables of some groups, each in the place of its former one; `afresh` drops all others."""
    nodes.withColumn("part", F.md5("grp")).write.mode("overwrite").option(
        "partitionOverwriteMode", "static" if afresh else "dynamic").partitionBy("part").parquet(path)
