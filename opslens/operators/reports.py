"""Reports over incident records: id, project, status, severity, root, created."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The domains of severity and status.
SEVERITIES = ("low", "medium", "high", "critical")
STATUSES = ("open", "in_progress", "resolved", "ignored")


def severity_status(incidents: DataFrame) -> DataFrame:
    """severity, status, n over both whole domains; unknown values count as medium and open."""
    known = incidents.select(
        F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("medium").alias("severity"),
        F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("open").alias("status"),
    )
    zeros = incidents.sparkSession.createDataFrame([(s, t, 0) for s in SEVERITIES for t in STATUSES], "severity string, status string, n long")
    counted = known.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))
    return zeros.unionByName(counted).groupBy("severity", "status").agg(F.sum("n").alias("n"))


def batch_severity(incidents: DataFrame) -> DataFrame:
    """Per project: total, one count a severity, resolved."""
    count = lambda c: F.sum(c.cast("long"))
    return incidents.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), *(count(F.col("severity") == s).alias(s) for s in SEVERITIES), count(F.col("status") == "resolved").alias("resolved")
    )


def summary(incidents: DataFrame) -> DataFrame:
    """One row: total, open, resolved, resolved per thousand, projects."""
    count = lambda c: F.sum(c.cast("long"))
    row = incidents.agg(F.count(F.lit(1)).alias("total"), count(F.col("status") == "open").alias("open"), count(F.col("status") == "resolved").alias("resolved"), F.count_distinct("project").alias("projects"))
    return row.withColumn("resolved_per_1000", F.floor(1000 * F.col("resolved") / F.greatest("total", F.lit(1))))


#: Columns of incidents that a search looks into.
SEARCHED = ("title", "root", "mode", "id", "batch")


def page(incidents: DataFrame, number: int, size: int, status: str | None = None, severity: str | None = None, like: str | None = None) -> DataFrame:
    """One page, newest first: place, id, with total and pages; the page number is clamped. The rows are a top-k, never a full sort.

    `like` is looked for in any case in those of the SEARCHED columns that there are, with % and _ for any text and any sign."""
    rows = incidents
    for name, value in (("status", status), ("severity", severity)):
        rows = rows.filter(F.col(name) == value) if value else rows
    if like and like.strip():
        pattern = "%" + like.strip().replace("\\", "\\\\") + "%"
        held = [F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False)) for c in SEARCHED if c in incidents.columns]
        rows = rows.filter(reduce(or_, held, F.lit(False)))
    total = rows.count()
    pages = max(1, -(-total // size))
    first = (min(max(1, number), pages) - 1) * size
    order = [F.col("created").desc(), F.col("id").desc()]
    top = rows.orderBy(*order).limit(first + size).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return top.filter(F.col("place") > first).select("place", "id", "status", "severity", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


def node_frequency(roots: DataFrame, chains: DataFrame) -> DataFrame:
    """node, root_hits, chain_hits (incidents whose chain has it), incidents. roots: (id, node); chains: (id, node)."""
    hits = roots.select("id", "node", F.lit(1).alias("root"), F.lit(0).alias("chain")).unionByName(chains.distinct().select("id", "node", F.lit(0).alias("root"), F.lit(1).alias("chain")))
    return hits.groupBy("node").agg(F.sum("root").alias("root_hits"), F.sum("chain").alias("chain_hits"), F.count_distinct("id").alias("incidents"))


def path_frequency(chains: DataFrame) -> DataFrame:
    """path, n of whole chains. chains: (id, place, node); repeated nodes of a chain count at their first place."""
    first = chains.groupBy("id", "node").agg(F.min("place").alias("place"))
    paths = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("c"))
    return paths.groupBy(F.array_join(F.transform("c", lambda x: x["node"]), "->").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def fault_modes(members: DataFrame, mode: str) -> DataFrame:
    """mode, n, services, and the service that has most of it (the least name of equals)."""
    each = members.groupBy(F.col(mode).alias("mode"), "service").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), F.col("service")))["service"]
    return each.groupBy("mode").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("services"), best.alias("top_service"))


def upsert(stored: DataFrame, new: DataFrame, key: str, keep=("status",)) -> DataFrame:
    """The stored rows with those of `new` put in by key; of rows in both, the columns in `keep` stay as stored."""
    names = [c for c in stored.columns if c != key]
    s = stored.select(key, *(F.col(c).alias(f"_s_{c}") for c in names), F.lit(True).alias("_old"))
    n = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in names), F.lit(True).alias("_new"))
    both = s.join(n, key, "full")
    value = lambda c: F.when(F.col("_new") & ~(F.col("_old").isNotNull() & F.lit(c in keep)), F.col(f"_n_{c}")).otherwise(F.col(f"_s_{c}"))
    return both.select(key, *(value(c).alias(c) for c in names))


def node_report(roots: DataFrame, chains: DataFrame, total: int) -> DataFrame:
    """Of each node: hits as root and in chains, incidents, their share, its three most frequent modes, its latest incident, and its place.

    roots: (id, node, mode, created), one row an incident; chains: (id, node, created)."""
    hits = roots.select("id", "node", "mode", "created", F.lit(1).alias("root"), F.lit(0).alias("chain")).unionByName(
        chains.select("id", "node", F.lit(None).cast("string").alias("mode"), "created").distinct().withColumns({"root": F.lit(0), "chain": F.lit(1)})
    )
    counted = hits.groupBy("node").agg(F.sum("root").alias("root_hits"), F.sum("chain").alias("chain_hits"), F.count_distinct("id").alias("incidents"), F.max("created").alias("latest"))
    modes = roots.groupBy("node", "mode").agg(F.count(F.lit(1)).alias("n"))
    top = modes.groupBy("node").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "mode"))), 1, 3), lambda x: x["mode"]), ",").alias("modes"))
    ratio = lambda c: F.round(F.col(c) / max(1, total), 4)
    return counted.join(top, "node", "left").select("node", "root_hits", "chain_hits", "incidents", ratio("root_hits").alias("root_ratio"), ratio("incidents").alias("incident_ratio"), F.coalesce("modes", F.lit("")).alias("modes"), "latest")


def top_nodes(report: DataFrame, most: int) -> DataFrame:
    """The first nodes of a report with their place: by root hits, incidents, chain hits, name."""
    order = [F.col("root_hits").desc(), F.col("incidents").desc(), F.col("chain_hits").desc(), F.lower("node"), "node"]
    return report.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def affected_nodes(roots: DataFrame, chains: DataFrame, most_roots: int = 5, most: int = 5) -> DataFrame:
    """node, affected, n, place: of the most frequent roots the nodes that most often stand in the chains of their incidents."""
    top = roots.groupBy("node").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.col("hits").desc(), "node").limit(most_roots)
    related = roots.join(F.broadcast(top.select("node")), "node", "left_semi").select("id", "node").distinct()
    with_ = chains.select("id", F.col("node").alias("affected")).distinct()
    counted = related.join(with_, "id").filter("affected <> node").groupBy("node", "affected").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "affected")).cast("long")
    return counted.withColumn("place", place).filter(F.col("place") <= most)


def mode_report(roots: DataFrame, label, total: int) -> DataFrame:
    """label, n, ratio, raw_modes, top_root of fault modes by their label. roots: (id, node, mode)."""
    labelled = roots.withColumn("label", label)
    each = labelled.groupBy("label", "node").agg(F.count(F.lit(1)).alias("n"), F.collect_set("mode").alias("modes"))
    return each.groupBy("label").agg(
        F.sum("n").alias("n"), F.round(F.sum("n") / max(1, total), 4).alias("ratio"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("modes")))), ",").alias("raw_modes"),
        F.min_by("node", F.struct(-F.col("n"), "node")).alias("top_root"),
    )


def path_report(chains: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """path, length, n, ratio of whole chains, each node at its first place; an incident without a chain counts with its root alone."""
    first = chains.groupBy("id", "node").agg(F.min("place").alias("place"))
    paths = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("path"))
    alone = roots.join(paths, "id", "left_anti").select("id", F.array("node").alias("path"))
    counted = paths.unionByName(alone).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.array_join("path", " → ").alias("path"), F.size("path").cast("long").alias("length"), "n", F.round(F.col("n") / max(1, total), 4).alias("ratio"))


def dashboard(incidents: DataFrame) -> DataFrame:
    """Per project: counts of incidents, of open and critical ones, the share that is resolved, and the latest one."""
    count = lambda c: F.sum(c.cast("long"))
    return incidents.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "open").alias("open"), count((F.col("severity") == "critical") & (F.col("status") != "resolved")).alias("open_critical"),
        F.round(count(F.col("status") == "resolved") / F.count(F.lit(1)), 4).alias("resolution"), F.max_by("id", F.struct("created", "id")).alias("latest"),
    )


def with_batches(incidents: DataFrame, batches: DataFrame) -> DataFrame:
    """The batches (batch, name) with their incidents' counts, 0 where they have none; incidents of no batch count under a name of their own."""
    counted = incidents.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("created").alias("latest"))
    known = batches.join(counted, "batch", "full")
    return known.select("batch", F.coalesce("name", F.concat(F.lit("I"), F.lpad(F.col("batch").cast("string"), 5, "0"))).alias("name"), F.coalesce("n", F.lit(0)).alias("n"), "latest")


def step_frequency(rows: DataFrame, steps) -> DataFrame:
    """step, n, place: how often each troubleshooting step is named. There are as many rows as different steps."""
    counted = rows.select(F.explode(steps).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "step")).cast("long"))


def batch_summary(incidents: DataFrame, roots: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: incidents, root_nodes, nodes, resolved, open, resolution. incidents: (id, status); roots, chains: (id, node)."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    rows = incidents.agg(F.count(F.lit(1)).alias("incidents"), count(F.col("status") == "resolved").alias("resolved"))
    named = roots.agg(F.count_distinct("node").alias("root_nodes")).crossJoin(roots.select("node").union(chains.select("node")).agg(F.count_distinct("node").alias("nodes")))
    return rows.crossJoin(named).select(
        "incidents", "root_nodes", "nodes", "resolved", (F.col("incidents") - F.col("resolved")).alias("open"), F.round(F.col("resolved") / F.greatest("incidents", F.lit(1)), 4).alias("resolution")
    )


def _percent(ratio):
    return F.concat(F.bround(100 * ratio, 0).cast("long").cast("string"), F.lit("%"))


def _first(rows: DataFrame, order: list, row: str) -> DataFrame:
    """The first row as one struct column; null where there is none, so that it can be put beside other single rows."""
    return rows.orderBy(*order).limit(1).agg(F.first(F.struct(*rows.columns)).alias(row))


def _leading(nodes: DataFrame, modes: DataFrame) -> DataFrame:
    node = _first(nodes.filter("root_hits > 0"), [F.col("root_hits").desc(), F.col("incidents").desc(), F.col("chain_hits").desc(), F.lower("node"), "node"], "top")
    return node.crossJoin(_first(modes, [F.col("n").desc(), "label"], "mode"))


def _said(row: DataFrame, items: list) -> DataFrame:
    """Of one row the structs of `items` that are not null, each with its place from 1."""
    listed = F.filter(F.array(*items), lambda x: x.isNotNull())
    return row.select(F.posexplode(listed).alias("place", "x")).select((F.col("place") + 1).cast("long").alias("place"), "x.*")


def conclusions(summary: DataFrame, nodes: DataFrame, modes: DataFrame, paths: DataFrame) -> DataFrame:
    """place, text: at most five sentences on a batch, from batch_summary(), node_report(), mode_report() and path_report().

    All inputs are reduced to one row before they meet. A batch without incidents gets the one sentence that says so."""
    row = summary.crossJoin(_leading(nodes, modes)).crossJoin(_first(paths, [F.col("n").desc(), "path"], "way"))
    text = lambda pattern, *values: F.struct(F.format_string(pattern, *values).alias("text"))
    # The sentences.
    some = F.col("incidents") > 0
    return _said(row, [
        F.when(~some, F.struct(F.lit("本批次未形成可汇总的 RCA 故障记录。").alias("text"))),
        F.when(some, text("本批次共形成 %d 个 RCA 故障结论，涉及 %d 个根因节点和 %d 个传播节点。", F.col("incidents"), F.col("root_nodes"), F.col("nodes"))),
        F.when(some & F.col("top").isNotNull(), text("故障最集中于“%s”：%d 次被判定为根因，出现在 %d 个故障和 %d 条传播链中。", F.col("top.node"), F.col("top.root_hits"), F.col("top.incidents"), F.col("top.chain_hits"))),
        F.when(some & F.col("mode").isNotNull(), text("最主要的故障模式是“%s”，共 %d 次，占本批次故障的 %s。", F.col("mode.label"), F.col("mode.n"), _percent(F.col("mode.ratio")))),
        F.when(some & F.col("way").isNotNull(), text("最高频传播路径为“%s”，关联 %d 个故障。", F.col("way.path"), F.col("way.n"))),
        F.when(some, text("当前已解决 %d 个，仍有 %d 个未完成闭环，批次治理完成率为 %s。", F.col("resolved"), F.col("open"), _percent(F.col("resolution")))),
    ])


def recommendations(summary: DataFrame, nodes: DataFrame, modes: DataFrame, steps: DataFrame) -> DataFrame:
    """place, priority, title, description, node, n: what to do about a batch. steps: step_frequency(); no incidents, no rows."""
    row = summary.crossJoin(_leading(nodes, modes)).crossJoin(_first(steps.filter("step <> ''"), [F.col("n").desc(), "step"], "step"))
    some, none = F.col("incidents") > 0, F.lit("")
    item = lambda priority, title, description, node, n: F.struct(priority.alias("priority"), title.alias("title"), description.alias("description"), node.alias("node"), n.alias("n"))
    # Titles and descriptions.
    return _said(row, [
        F.when(some & F.col("top").isNotNull(), item(
            F.when(F.col("top.root_ratio") >= 0.5, "P0").otherwise("P1"), F.format_string("优先治理高频根因节点：%s", F.col("top.node")),
            F.format_string("该节点关联 %d 个故障、%d 次作为根因，应优先核查其健康状态、容量和高可用机制。", F.col("top.incidents"), F.col("top.root_hits")), F.col("top.node"), F.col("top.incidents"))),
        F.when(some & F.col("mode").isNotNull(), item(
            F.lit("P1"), F.format_string("建立“%s”专项检测与告警", F.col("mode.label")), F.format_string("该模式出现 %d 次，建议统一监控指标、告警阈值和标准处置手册。", F.col("mode.n")),
            F.coalesce("mode.top_root", none), F.col("mode.n"))),
        F.when(some & (F.col("open") > 0), item(
            F.lit("P1"), F.lit("完成未闭环故障的验证与复盘"), F.format_string("仍有 %d 个故障未标记为已解决，应补充恢复验证、解决说明和复发防护措施。", F.col("open")), none, F.col("open"))),
        F.when(some & F.col("step").isNotNull(), item(F.lit("P2"), F.lit("固化批次共性排查动作"), F.col("step.step"), none, F.col("step.n"))),
    ])
