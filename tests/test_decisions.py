"""Labels of chains, promoted facts and what a decision is told, for nulls, blanks, repeats and empty tables."""

from opslens.operators import decisions, reports


def test_chains(spark):
    chains = spark.createDataFrame([(1, ["db", " ", "api", "web"]), (2, None), (3, ["one"])], "decision int, chain array<string>")
    labels = spark.createDataFrame([(1, 1, "api", "first", None, None), (1, 2, " api ", " ", "why", "own"), (1, 3, "off", "x", "x", "x"), (1, 4, None, "x", "x", "x"), (9, 1, "db", "x", "x", "x")], "decision int, place int, node string, label string, explanation string, stage string")
    got = {(r.decision, r.place): (r.node, r.label, r.explanation, r.stage) for r in decisions.display_chains(chains, labels).collect()}
    assert got == {(1, 0): ("db", "db", "", "根因"), (1, 1): ("api", "api", "why", "own"), (1, 2): ("web", "web", "", "受影响入口"), (3, 0): ("one", "one", "", "根因")}
    assert decisions.display_chains(chains.limit(0), labels.limit(0)).count() == 0


def test_promotion(spark):
    incidents = spark.createDataFrame([(1, "svc", "boom" * 40), (2, None, None), (3, "svc", "x")], "incident int, service string, cause string")
    guesses = spark.createDataFrame([(1, 2, "later", "A", 0.95, ["z"]), (1, 1, "first", "B", 0.8, ["first", "svc"]), (3, 1, "", None, None, None)], "incident int, rank int, candidate string, mode string, score double, chain array<string>")
    made = spark.createDataFrame([(1, "id", "chosen", "C", None, ["a", " b "]), (2, " ", "no", "no", 0.9, ["a"]), (3, "id", "no", "no", 0.9, [" "])], "incident int, node string, candidate string, mode string, confidence double, path array<string>")
    got = {r.incident: r for r in decisions.promoted(incidents, guesses, made).collect()}
    assert (got[1].candidate, got[1].mode, got[1].confidence, got[1].severity, got[1].chain, got[1].decided) == ("chosen", "C", 0.8, "high", ["a", "b"], True)
    assert got[1].title == "svc：" + ("boom" * 40)[:100]
    assert (got[2].title, got[2].candidate, got[2].severity, got[2].chain) == ("未知服务：未提取到明确异常", "未知服务", "low", [])
    assert (got[3].candidate, got[3].mode, got[3].decided) == ("svc", "", False)
    assert decisions.compacted(guesses).filter("incident = 1").first().hypotheses[0].candidate == "first"


def test_focus(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "first"), ("b", "Beta", None), ("c", "Gamma", "third"), ("d", "Delta", "far")], "id string, name string, description string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("c", "a", "CALLS"), ("b", "d", "CALLS"), ("a", "a", "CALLS"), ("a", "gone", "CALLS")], "source string, target string, type string")
    named = spark.createDataFrame([(1, "alpha"), (1, "a"), (1, None), (2, "nobody")], "incident int, name string")
    got = [tuple(r) for r in decisions.focus(named, nodes, edges).orderBy("place").collect()]
    assert got == [(1, 1, "a", "first"), (1, 2, "c", "third")]
    assert decisions.focus(named, nodes, edges, most=1).count() == 1


def test_projects(spark):
    nodes = spark.createDataFrame([("a", "Service", "p"), ("b", "Incident", "p"), ("c", "Service", ""), ("d", "Service", None)], "id string, kind string, project string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "gone")], "source string, target string")
    got = {r.project: tuple(r)[1:] for r in decisions.project_overview(nodes, edges, spark.createDataFrame([("p",), ("q",)], "project string")).collect()}
    assert got == {"p": (2, 1, 1, 1, 0, 0), "q": (0, 0, 0, 0, 0, 0), None: (4, 3, 3, 1, 2, 1)}


def test_search(spark):
    rows = spark.createDataFrame([(1, "open", "high", 1, "Redis late", None), (2, "open", "high", 2, None, "REDIS-1"), (3, "open", "low", 3, "disk", "a\\b"), (30, "open", "low", 4, None, None)], "id int, status string, severity string, created int, title string, root string")
    ids = lambda like: [r.id for r in reports.page(rows, 1, 10, like=like).orderBy("place").collect()]
    assert ids("redis") == [2, 1] and ids("3") == [30, 3] and ids("r_dis%1") == [2] and ids("a\\b") == [3] and ids("none") == [] and len(ids("  ")) == 4
