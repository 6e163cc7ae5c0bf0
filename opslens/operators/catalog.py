"""Short forms of an architecture catalog: codes of kinds and relations with a legend, and a fingerprint that no order changes.

Nodes are (id, name, kind), edges (source, target, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of kinds and relations, and those of an unnamed one.
KIND_CODES = {
    "Service": "SV", "API": "API", "Component": "CP", "Database": "DB", "Cache": "CA", "Middleware": "MW", "Queue": "MQ", "Cluster": "CL", "Instance": "IN",
    "Host": "HO", "VM": "VM", "Pod": "PD", "NetworkSwitch": "NW", "UIControl": "UI", "UIFunction": "UF", "Function": "FN", "System": "SYS",
}
RELATION_CODES = {
    "CALLS": "C", "DEPENDS_ON": "D", "USES_DB": "U", "READS": "R", "WRITES": "W", "PUBLISHES": "P", "SUBSCRIBES": "S", "CONNECTS_TO": "X",
    "RUNS_ON": "O", "HOSTED_ON": "H", "HAS_MEMBER": "M", "CONTAINS": "N", "BELONGS_TO": "B", "MEMBER_OF": "MO", "ROUTES_TO": "T", "TRIGGERS": "G",
}
NO_KIND, NO_TYPE = "Component", "CALLS"


def _code(value: Column, default: str, codes: dict[str, str], other) -> Column:
    text = F.trim(F.coalesce(F.when(value != "", value), F.lit(default)))
    known = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.coalesce(F.try_element_at(known, text), F.when(other(text) != "", other(text)), F.lit(codes[default]))


def kind_code(kind: Column) -> Column:
    """The code of a kind; of an unknown one its letters and digits, in capitals, eight at most."""
    return _code(kind, NO_KIND, KIND_CODES, lambda x: F.substring(F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", "")), 1, 8))


def relation_code(relation: Column) -> Column:
    """The code of a relation; an unknown one in capitals, with underscores for what is no letter or digit."""
    return _code(relation, NO_TYPE, RELATION_CODES, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "_"))


def _row(*values: Column) -> Column:
    return F.to_json(F.array(*(F.coalesce(v, F.lit("")) for v in values)))


def _rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    coded = nodes.select(F.lit("n").alias("part"), _row(F.col("id"), F.col("name"), kind_code(F.col("kind"))).alias("item"))
    return coded.unionByName(edges.select(F.lit("e").alias("part"), _row(F.col("source"), F.col("target"), relation_code(F.col("type"))).alias("item")))


def encoded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, item (a JSON array): n (id, name, code), e (source, target, code), and the legends t and r (code, name) of used codes.

    Blank names are those of the defaults. Where several names have one code, the legend gives each, and what is read back has the least."""
    legend = lambda rows, part, code, name: rows.select(_row(code, name).alias("item")).distinct().select(F.lit(part).alias("part"), "item")
    named = lambda c, default: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default))
    kinds = legend(nodes.select("kind").distinct(), "t", kind_code(F.col("kind")), named("kind", NO_KIND))
    relations = legend(edges.select("type").distinct(), "r", relation_code(F.col("type")), named("type", NO_TYPE))
    return _rows(nodes, edges).unionByName(kinds).unionByName(relations)


def decoded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from what encoded() gives."""
    cells = rows.select("part", F.from_json("item", "array<string>").alias("x"))
    part = lambda p: cells.filter(F.col("part") == p)
    # A few dozen codes.
    legend = lambda p: F.broadcast(part(p).groupBy(F.col("x")[0].alias("code")).agg(F.min(F.col("x")[1]).alias("named")))
    nodes = part("n").select(F.col("x")[0].alias("id"), F.col("x")[1].alias("name"), F.col("x")[2].alias("code")).join(legend("t"), "code", "left")
    edges = part("e").select(F.col("x")[0].alias("source"), F.col("x")[1].alias("target"), F.col("x")[2].alias("code")).join(legend("r"), "code", "left")
    return nodes.select("id", "name", F.col("named").alias("kind")), edges.select("source", "target", F.col("named").alias("type"))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, `fingerprint`: a digest of all rows that their order doesn't change.

    Every row's digest is cut into four numbers, and these are summed up: sums merge across tasks in any order, and no task
    sees more than its own rows. Repeated rows count."""
    digest = F.sha2(F.concat("part", "item"), 256)
    parts = [F.sum(F.conv(F.substring("digest", i * 15 + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = _rows(nodes, edges).select(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), *parts)
    said = F.concat_ws(":", F.col("n").cast("string"), *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)))
    return sums.select(F.concat(F.lit("sha256:"), F.substring(F.sha2(said, 256), 1, 16)).alias("fingerprint"))
