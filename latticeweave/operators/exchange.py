"""Exchange: gather the values of each connection's stencil (collect), and put the results at its receivers (disperse)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .masks import IJK

KEY = ["m", "n", "ni", "nj", "nk"]
COLLECTS = ("INTERPOLATE", "NONE", "ANY", "NOT_ALL", "ALL", "MIN", "MAX")


def stencil_rows(connections: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per connection and stencil point: the key, v (order, i fastest), grid_id, i, j, k (wrapped) and weight."""
    small = meta.select(F.col("grid_id").alias("m"), *(F.col(f"{p}{a}").alias(f"_{p}{a}") for p in ("b", "e", "per_", "q") for a in IJK))
    out = connections.select(*KEY, "begin", "wi", "wj", "wk")
    for a in reversed(IJK):
        out = out.select("*", F.posexplode(f"w{a}").alias(f"_p{a}", f"_w{a}"))
    out = out.join(F.broadcast(small), "m")
    for d, a in enumerate(IJK):
        p = F.col("begin")[d] + F.col(f"_p{a}")
        out = out.withColumn(a, F.when(F.col(f"_per_{a}") & (p >= F.col(f"_e{a}")), p - F.col(f"_q{a}")).otherwise(p).cast("int"))
    v = F.col("_pi") + F.size("wi") * (F.col("_pj") + F.size("wj") * F.col("_pk"))
    return out.select(*KEY, v.alias("v"), F.col("m").alias("grid_id"), *IJK, (F.col("_wi") * F.col("_wj") * F.col("_wk")).alias("weight"))


def _values(value: str | list[str]) -> dict[str, str]:
    """Column -> name of the result; a single column's result is called value."""
    return {value: "value"} if isinstance(value, str) else {v: v for v in value}


def collect(connections: DataFrame, fields: DataFrame, meta: DataFrame, op: str = "INTERPOLATE", value: str | list[str] = "value", ordered: bool = False) -> DataFrame:
    """The key and value of each connection, or the values of several columns in one pass. Logical operators give 1 or 0 and take any value but 0 as true. ordered: sum
    in the order of the stencil's points, so that the result is the same to the last bit however the rows are dealt."""
    if op not in COLLECTS:
        raise ValueError(f"unknown collect operator {op}; known: {', '.join(COLLECTS)}")
    kinds, names = dict(fields.dtypes), _values(value)
    if op == "INTERPOLATE" and any(kinds[v] not in ("float", "double") for v in names):
        raise TypeError("INTERPOLATE takes float or double values")
    met = stencil_rows(connections, meta).join(fields.select("grid_id", *IJK, *(F.col(v).alias(f"_v{k}") for k, v in enumerate(names))), ["grid_id", *IJK])

    def how(x: str, kind: str):
        true = F.col(x) != (F.lit(False) if kind == "boolean" else 0)
        if op == "INTERPOLATE" and ordered:
            terms = F.sort_array(F.collect_list(F.struct("v", (F.col("weight") * F.col(x)).alias("t"))))
            return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["t"])
        return {
            "INTERPOLATE": F.sum(F.col("weight") * F.col(x)), "NONE": (~F.bool_or(true)).cast("int"), "ANY": F.bool_or(true).cast("int"),
            "NOT_ALL": (~F.bool_and(true)).cast("int"), "ALL": F.bool_and(true).cast("int"), "MIN": F.min(x), "MAX": F.max(x),
        }[op]

    return met.groupBy(KEY).agg(*(how(f"_v{k}", kinds[v]).alias(name) for k, (v, name) in enumerate(names.items())))


def disperse(fields: DataFrame, collected: DataFrame, op: str = "OVERWRITE", value: str | list[str] = "value") -> DataFrame:
    """The fields with the collected values put in place of (OVERWRITE) or added to (APPEND) those of the receivers. Of several
    values for one receiver OVERWRITE takes that of the highest m, APPEND their sum."""
    if op not in ("OVERWRITE", "APPEND"):
        raise ValueError(f"unknown disperse operator {op}")
    kinds, names = dict(fields.dtypes), _values(value)
    new = [(F.max_by(name, "m") if op == "OVERWRITE" else F.sum(name)).alias(f"_new{k}") for k, name in enumerate(names.values())]
    arrived = collected.groupBy(F.col("n").alias("grid_id"), *(F.col(f"n{a}").alias(a) for a in IJK)).agg(*new)
    out = fields.join(arrived, ["grid_id", *IJK], "left")
    for k, v in enumerate(names):
        put = F.coalesce(f"_new{k}", v) if op == "OVERWRITE" else F.col(v) + F.coalesce(f"_new{k}", F.lit(0))
        out = out.withColumn(v, put.cast(kinds[v]))
    return out.select(fields.columns)


def exchange(connections: DataFrame, fields: DataFrame, meta: DataFrame, collect_op: str = "INTERPOLATE", disperse_op: str = "OVERWRITE", value: str | list[str] = "value", ordered: bool = False) -> DataFrame:
    """Collect, send and disperse in one plan."""
    return disperse(fields, collect(connections, fields, meta, collect_op, value, ordered), disperse_op, value)


def connections_of(overlap: DataFrame, kind: str = "LINEAR", dims: int = 2) -> DataFrame:
    """Connections (schema.CONNECTIONS) from overlap rows, with NEAREST or LINEAR weights on the cell's corners."""
    if kind == "CUBIC":
        raise NotImplementedError("cubic connections are not available")
    if kind not in ("NEAREST", "LINEAR"):
        raise ValueError(f"unknown kind of connection: {kind}")

    def weights(d: int, c: str):
        if d >= dims:
            return F.array(F.lit(1.0))
        u = F.col(c)
        if kind == "LINEAR":
            return F.array(1.0 - u, u)
        return F.array(F.when(u <= 0.5, 1.0).otherwise(0.0), F.when(u <= 0.5, 0.0).otherwise(1.0))

    end = [F.col(f"c{a}") + (2 if d < dims else 1) for d, a in enumerate(IJK)]
    return overlap.select(*KEY, F.array("ci", "cj", "ck").alias("begin"), F.array(*end).alias("end"), "u", "v", "w", *(weights(d, c).alias(f"w{a}") for d, (a, c) in enumerate(zip(IJK, ("u", "v", "w")))))
