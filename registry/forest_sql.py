"""SQL that grows and follows the isolation forest, level by level."""

from __future__ import annotations

from viario.config import FOREST, FOREST_FEATURES
from viario.operators.detect.forest import MIN_ROWS, NANO, PRIME

_K = range(len(FOREST_FEATURES))
_F = ", ".join(f"f{i}" for i in _K)
_LIST = f"[{_F}]"
_TREES, _WANTED, _SEED = FOREST["trees"], FOREST["subsample"], FOREST["seed"]
_LEVELS = (_WANTED - 1).bit_length() + 1


def _number(what: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {_SEED}, grp, tree, node, '{what}')), 1, 13) AS BIGINT)"


def _levels() -> str:
    out = []
    for d in range(_LEVELS):
        out.append(f"""
s{d} AS (
  SELECT *, [{", ".join(f"min(f{i}) OVER w" for i in _K)}] AS low, [{", ".join(f"max(f{i}) OVER w" for i in _K)}] AS high,
    count(*) OVER w AS size FROM l{d} WHERE alive WINDOW w AS (PARTITION BY grp, tree, node)),
v{d} AS (SELECT *, list_filter(range(0, {len(_K)}), lambda i: high[i + 1] > low[i + 1]) AS varying FROM s{d}),
c{d} AS (
  SELECT *, CASE WHEN length(bin(m - 1)) > {d} AND len(varying) > 0
    THEN varying[1 + {_number("feature")} % len(varying)] ELSE -1 END AS feature FROM v{d}),
u{d} AS (
  SELECT *, low[1 + greatest(feature, 0)] AS least_one, high[1 + greatest(feature, 0)] AS most,
    low[1 + greatest(feature, 0)] + {_number("threshold")}::DOUBLE / {1 << 52}::DOUBLE
      * (high[1 + greatest(feature, 0)] - low[1 + greatest(feature, 0)]) AS cut FROM c{d}),
t{d} AS MATERIALIZED (
  SELECT *, CASE WHEN feature < 0 THEN 0 WHEN cut < most THEN cut ELSE least_one END AS threshold FROM u{d}),
l{d + 1} AS (
  SELECT grp, tree, {_F}, m, 2 * node + CASE WHEN {_LIST}[1 + greatest(feature, 0)] <= threshold THEN 1 ELSE 2 END AS node,
    feature >= 0 AS alive FROM t{d}),""")
    return "".join(out)


def _steps() -> str:
    out = []
    for d in range(_LEVELS - 1):
        out.append(f"""
p{d + 1} AS (
  SELECT event_id, p{d}.grp, p{d}.tree, {_F}, CASE WHEN feature < 0 THEN p{d}.node
    WHEN {_LIST}[1 + feature] <= threshold THEN 2 * p{d}.node + 1 ELSE 2 * p{d}.node + 2 END AS node
  FROM p{d} JOIN nodes ON nodes.grp = p{d}.grp AND nodes.tree = p{d}.tree AND nodes.node = p{d}.node),""")
    return "".join(out)


_PATH = """(CASE WHEN {n} > 2 THEN 2 * (ln({n}::DOUBLE - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n}::DOUBLE - 1) / {n}
  WHEN {n} = 2 THEN 1 ELSE 0 END)"""

# Needs `series`; gives `forest` with event_id, isolation_score and isolation_forest_anomaly.
FOREST_SQL = f"""
middles AS (SELECT nombre_comuna, {", ".join(f"median({f}) AS m{i}" for i, f in enumerate(FOREST_FEATURES))} FROM series GROUP BY ALL),
grown AS (
  SELECT nombre_comuna FROM series WHERE nombre_comuna IS NOT NULL GROUP BY ALL
  HAVING count(*) FILTER ({" AND ".join(f"{f} IS NOT NULL" for f in FOREST_FEATURES)}) >= {MIN_ROWS}),
filled AS (
  SELECT event_id, nombre_comuna AS grp, {", ".join(f"CAST(coalesce({f}, m{i}) AS DOUBLE) AS f{i}" for i, f in enumerate(FOREST_FEATURES))},
    CAST('0x' || substr(md5(concat_ws('|', {_SEED}, event_id)), 1, 13) AS BIGINT) AS h
  FROM series JOIN middles USING (nombre_comuna) SEMI JOIN grown USING (nombre_comuna)),
dealt AS (
  SELECT grp, tree, {_F}, row_number() OVER (PARTITION BY grp, tree ORDER BY
    (h % {PRIME} * (1 + (tree + 1) * 1103515245 % {PRIME - 1}) + (tree + 1) * 12345701 % {PRIME}) % {PRIME}, h, {_F}) AS place
  FROM filled, (SELECT unnest(range({_TREES})) AS tree)),
l0 AS (
  SELECT grp, tree, {_F}, count(*) OVER (PARTITION BY grp, tree) AS m, 0::BIGINT AS node, true AS alive
  FROM dealt WHERE place <= {_WANTED}),{_levels()}
nodes AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT DISTINCT grp, tree, node, feature, threshold, {d} AS depth, size FROM t{d}" for d in range(_LEVELS))}),
p0 AS (SELECT event_id, grp, tree, {_F}, 0::BIGINT AS node FROM filled, (SELECT unnest(range({_TREES})) AS tree)),{_steps()}
sums AS (
  SELECT event_id, p.grp, sum(CAST(round((depth + {_PATH.format(n="size")}) * {NANO}) AS BIGINT)) AS total
  FROM p{_LEVELS - 1} p JOIN nodes ON nodes.grp = p.grp AND nodes.tree = p.tree AND nodes.node = p.node GROUP BY ALL),
sampled AS (SELECT grp, max(m) AS m FROM l0 GROUP BY grp),
isolated AS (
  SELECT event_id, grp, -(2::DOUBLE ** (-(total::DOUBLE / {NANO} / {_TREES}) / {_PATH.format(n="m")})) AS p FROM sums JOIN sampled USING (grp)),
cutoffs AS (SELECT grp, quantile_cont(p, {FOREST["contamination"]}) AS cutoff FROM isolated GROUP BY grp),
forest AS (
  SELECT event_id, coalesce(p, 0::DOUBLE) AS isolation_score, coalesce(p < cutoff, false) AS isolation_forest_anomaly
  FROM series LEFT JOIN isolated USING (event_id) LEFT JOIN cutoffs USING (grp))"""
