"""Nodes and relations that an architecture text names, found by rules; texts are (doc, text).

Each text gives the finds of its whole and of each of its sentences in one pass of expressions; finds are rows with the rank
of the rule that made them, and what a name is becomes an aggregate over its finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import architecture
from .grounding import LEAST_IDENTIFIER, mentions
from .lineage import cut, spread

# What names look like in texts.
WORD = "[一-龥A-Za-z0-9_-]"
# A match begins where its run of letters does; where that gives none, no later letter of the run does.
RUN = f"(?<!{WORD}){WORD}+"
SERVICE, DATABASE, PLATFORM = RUN + "服务(?!名)", RUN + "(?:数据库|DB|db)", RUN + "平台"
API = r"(?i)(?:API\s*Gateway|API网关|网关|[A-Za-z0-9_\-/]+API)"
CACHE = "(?iU)(?:Redis|Memcached)" + WORD + r"{0,12}?(?:集群|Cluster|缓存)|\b(?:Redis|Memcached)\b(?![-_](?:node[-_]?)?\d)"
INSTANCE = r"(?i)redis(?:[-_](?:node[-_]?)?|节点[-_]?)\d+"
TITLE, NO_TITLE, NO_QUEUE = WORD + "{2,40}系统", "系统", "消息队列"
LAYER = "网关层|接入层|应用层|业务服务层|服务层|数据层|消息层|中间件层|功能层|存储层|展示层|前端层|后端层"
COMPOSED = "由(.{1,100}?)(?:组成|构成)"
HOLDS = r"(.{1,30}?(?:系统|层|服务|集群|缓存|数据库|中间件))\s*(?:包含|包括|由)\s*(.+?)(?:组成|构成)?$"
PROVIDES = "([^，。；;\n]+服务).*?(?:提供|负责)(.+?)(?:功能|能力|服务)?$"
NO_FUNCTION = "，?(?:读写|读取|写入|会调用|并调用|调用|通过|订阅|发布|依赖).*$"
DEPENDS, CALLS = "依赖|连接|访问|使用|查询|读写|读取|写入|缓存到|存储到", "调用|请求|访问|依赖|对接|连接|校验"
CALLER = f"({SERVICE}).*?(?:{CALLS})([^。；;\n]+)"
ALIAS = r"(?i)([一-龥A-Za-z0-9_-]+服务)[^。；;\n]{0,60}?(?:日志服务名|serviceName|别名|alias)(?:（serviceName）)?\s*(?:为|是|[=:：])?\s*`?([A-Za-z][A-Za-z0-9_.-]+)"
FIELDS = {"host": r"(?i)\bhost(?:name)?\s*[=:：]\s*([A-Za-z0-9_.-]+)", "ip": r"(?i)\bip\s*[=:：]\s*((?:\d{1,3}\.){3}\d{1,3})", "port": r"(?i)\bport\s*[=:：]\s*(\d{2,5})"}
# Words that a name leaves behind, at its ends or as what stands before it, and the endings of kinds.
NAME_CUTS = (r"^\s+|\s+$", r"^(?:[-*+>#]+\s*)+", r"^[的和及与并、,，\s]+", r"[的和及与并、,，\s]+$", "^(?:包含|包括|由|负责|提供)", "(?:组成|构成)$", r"\s*[一二三四五六七八九十\d]+个实例$", "^[ ：:。；;\t\r\n]+|[ ：:。；;\t\r\n]+$")
# A name that neither begins nor ends with one of these is left as it is by all of them.
CUT_ENDS = " \t\n\x0b\f\r\x85\u2028\u2029-*+>#的和及与并、,，包由负提成例：:。；;"
BEFORE_NAME = ("包含", "包括", "调用", "请求", "访问", "依赖", "读写", "读取", "写入", "使用", "通过", "订阅", "发布", "会", "并")
BEFORE_ITEM = "^(?:包含|包括|由|负责|提供|统一|会|并会|并调用|调用)"
ENDINGS = {"Service": "服务", "Database": "数据库"}
SENTENCE_ENDS = "[。；;\n]+"
# Kinds that have addresses, and what is left out where no relation holds it.
ADDRESSED, ABSTRACT = ("Instance", "Host", "Pod", "Cluster", "Cache", "Database"), ("系统", "API Layer", "UI Layer", "网关与微服务")
MOST_NAME, MOST_FUNCTIONS, MOST_SEGMENT = 80, 8, 160
#: Addressed names of a text that its sentences are searched for one by one; more are searched for at once.
FEW_NAMES = 64

_FIND = "array<struct<name: string, kind: string, layer: string>>"
_EDGE = "array<struct<source: string, target: string, type: string>>"


# What a pattern needs somewhere, looked for before the pattern itself, which is slower.
NEEDS = {
    SERVICE: "服务", DATABASE: "数据库|DB|db", PLATFORM: "平台", CACHE: "(?iU)Redis|Memcached", INSTANCE: "(?i)redis", API: "(?i)API|网关", TITLE: "系统", COMPOSED: "由", HOLDS: "包含|包括|由", PROVIDES: "提供|负责",
    CALLER: CALLS, ALIAS: "(?i)日志服务名|serviceName|别名|alias",
}


def _extract(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(NEEDS[pattern]), F.regexp_extract(text, pattern, group)).otherwise("")


def _extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.rlike(NEEDS[pattern]), found).otherwise(F.array().cast("array<string>")) if pattern in NEEDS else found


def _once(value: Column, f) -> Column:
    """f of a value that it reads several times, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean_name(text: Column) -> Column:
    """A name without bullets, joining words at its ends and counts of instances."""
    return _once(text, _clean)


def _clean(text: Column) -> Column:
    """The same of a column or a lambda's variable."""
    bare = text
    for pattern in NAME_CUTS:
        bare = F.regexp_replace(bare, pattern, "")
    return F.substring(F.when(F.btrim(text, F.lit(CUT_ENDS)) != text, bare).otherwise(text), 1, MOST_NAME)


def entity(text: Column, kind: str) -> Column:
    """The name in what a pattern has found: after the last verb and the last item of a list, up to its kind's ending."""
    return F.get(_entities(F.array(text), kind), F.lit(0))


def _entities(texts: Column, kind: str) -> Column:
    """The same of each of an array. Each step is a pass over the array, as an expression computes what it names twice twice."""

    def last(text):
        text = _clean(text)
        for word in BEFORE_NAME:
            text = F.substring_index(text, word, -1)
        return F.replace(text, F.lit("和"), F.lit("、"))

    def ended(text):
        whole = F.regexp_extract_all(text, F.lit(f"{RUN}{ending}"), F.lit(0))
        return F.when(F.contains(text, F.lit(ending)) & ~text.endswith(ending), F.coalesce(F.try_element_at(whole, F.lit(-1)), text)).otherwise(text)

    texts = F.transform(texts, last)
    texts = F.transform(texts, lambda x: F.coalesce(F.try_element_at(F.filter(F.split(x, "、"), lambda y: y != ""), F.lit(-1)), x))
    if ending := ENDINGS.get(kind):
        texts = F.transform(texts, ended)
    return F.transform(texts, _clean)


def items(text: Column) -> Column:
    """The names of a list in words."""
    text = F.regexp_replace(F.regexp_replace(text, "等(?:信息|组件|服务|功能)?", ""), "以及|和|并", "、")
    return _named(F.transform(F.split(text, "[、,，/]+"), lambda x: F.regexp_replace(_clean(x), BEFORE_ITEM, "")))


def _named(names: Column) -> Column:
    return F.filter(names, lambda x: x != "")


def _found(text: Column, pattern: str, kind: str) -> Column:
    return _named(_entities(_extract_all(text, pattern), kind))


def _edges(sources: Column, targets: Column, kind: Column) -> Column:
    sources, targets = (_named(F.transform(x, _clean)) for x in (sources, targets))
    pairs = F.transform(sources, lambda s: F.transform(F.filter(targets, lambda t: t != s), lambda t: F.struct(s.alias("source"), t.alias("target"), kind.alias("type"))))
    return F.flatten(pairs)


def _only(holds: Column, edges: Column) -> Column:
    return F.when(holds, edges).otherwise(F.array().cast(_EDGE))


def _finds(names: Column, kind=None, layer=None) -> Column:
    """Finds of names; their kinds and layers are inferred unless given."""
    kind, layer = kind or architecture.inferred_kind, layer or (lambda _: F.lit(None).cast("string"))
    found = F.transform(_named(F.transform(names, _clean)), lambda x: F.struct(x.alias("name"), kind(x).alias("kind"), layer(x).alias("layer")))
    return F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), F.coalesce(x["layer"], architecture.default_layer(x["kind"])).alias("layer"))).cast(_FIND)


def _first_of(names: Column) -> Column:
    return F.slice(names, 1, 1)


def _titles(texts: DataFrame) -> DataFrame:
    """The texts with their title and layers, in columns of their own, as several rules read them."""
    text = F.col("text")
    title = F.array(clean_name(F.coalesce(F.nullif(_extract(text, TITLE, 0), F.lit("")), F.lit(NO_TITLE))))
    composed = F.flatten(F.transform(_extract_all(text, COMPOSED, 1), items))
    layers = F.array_distinct(F.concat(F.filter(composed, lambda x: x.endswith("层")), F.regexp_extract_all(text, F.lit(LAYER), F.lit(0))))
    return texts.withColumns({"title": title, "layers": layers})


def _of_text() -> tuple[list[Column], Column]:
    """Finds of a whole text of _titles() in the order of their rules, and its edges."""
    of = lambda kind: lambda _: F.lit(kind)
    text, title, layers = map(F.col, ("text", "title", "layers"))
    services = F.filter(_found(text, SERVICE, "Service"), lambda x: ~F.contains(text, F.concat(x, F.lit("层"))))
    gates = F.filter(_found(text, API, "API"), lambda x: F.lower(x) != "api")
    finds = [
        _finds(title, of("System"), of("系统层")), _finds(layers, of("Layer"), lambda x: x), _finds(services, of("Service"), of("业务服务层")), _finds(_found(text, DATABASE, "Database"), of("Database"), of("数据层")),
        _finds(_found(text, architecture.QUEUE, "Queue"), of("Queue"), of("中间件层")), _finds(_found(text, CACHE, "Cache"), None, of("数据层")), _finds(_found(text, INSTANCE, "Instance"), of("Instance"), of("基础设施层")),
        _finds(_found(text, architecture.MIDDLEWARE, "Middleware"), of("Middleware"), of("中间件层")), _finds(gates, lambda x: F.when(F.lower(x).rlike("api|网关"), F.lit("API")).otherwise(F.lit("Component")), of("网关层")),
    ]
    return finds, _edges(title, layers, F.lit("CONTAINS"))


def _spans(sentences: DataFrame) -> DataFrame:
    """The sentences with the names in them, in columns of their own, as several rules read them."""
    said = F.col("said")
    done = F.transform(items(F.regexp_replace(_extract(said, PROVIDES, 2), NO_FUNCTION, "")), lambda x: _once(F.regexp_replace(x, "功能$", ""), _clean))
    done = F.filter(done, lambda x: F.length(x).between(2, 30) & ~x.endswith("服务") & ~x.endswith("数据库"))
    return sentences.withColumns({
        "services": _found(said, SERVICE, "Service"), "queues": _found(said, architecture.QUEUE, "Queue"), "stores": _found(said, DATABASE, "Database"), "caches": _found(said, CACHE, "Cache"), "middleware": _found(said, architecture.MIDDLEWARE, "Middleware"),
        "parent": clean_name(_extract(said, HOLDS, 1)), "held": F.filter(F.transform(items(_extract(said, HOLDS, 2)), _clean), lambda x: ~x.isin("", "以及")),
        "caller": entity(_extract(said, CALLER, 1), "Service"), "called": _extract(said, CALLER, 2),
        "offering": clean_name(_extract(said, PROVIDES, 1)), "functions": F.slice(F.transform(done, lambda x: F.concat(x, F.lit("功能"))), 1, MOST_FUNCTIONS),
    })


def _of_sentence() -> tuple[list[Column], Column]:
    """Finds of a sentence of _spans() and its edges; `queue` is the text's first queue."""
    said, queue, services, queues, parent, held, functions = map(F.col, ("said", "queue", "services", "queues", "parent", "held", "functions"))
    says = lambda *words: said.rlike("|".join(words))
    machine = lambda x: (architecture.inferred_kind(parent) == "Cluster") & architecture.inferred_kind(x).isin("Instance", "Host", "Pod")
    holding = F.concat(_edges(F.array(parent), F.filter(held, lambda x: ~machine(x)), F.lit("CONTAINS")), _edges(F.array(parent), F.filter(held, machine), F.lit("HAS_MEMBER")))
    access = F.when(says("读写"), "USES_DB").when(says("写入", "保存"), "WRITES").when(says("读取", "查询"), "READS").otherwise("USES_DB")
    stores = _edges(_first_of(services), F.col("stores"), access)
    backing = F.array_except(F.array_distinct(F.concat("caches", queues, "middleware")), services)
    backing = F.when((F.size(services) > 0) & says(DEPENDS), backing).otherwise(F.array().cast("array<string>"))
    needs = _edges(_first_of(services), backing, F.when(says("读取", "查询"), "READS").when(says("写入", "存储"), "WRITES").otherwise("DEPENDS_ON"))
    together = _only((F.size(services) > 1) & says(CALLS), _edges(_first_of(services), F.slice(services, 2, 1 << 20), F.lit("CALLS")))
    called = F.concat(_found(F.col("called"), SERVICE, "Service"), _found(F.col("called"), PLATFORM, "Component"))
    calls = _edges(F.array("caller"), called, F.lit("CALLS"))
    topic = F.when(F.size(queues) > 0, _first_of(queues)).when((F.size(services) > 0) & says("发布", "订阅"), F.array(queue)).otherwise(F.array().cast("array<string>"))
    queued = F.concat(_only((F.size(topic) > 0) & says("发布", "发送", "生产"), _edges(_first_of(services), topic, F.lit("PUBLISHES"))), _only((F.size(topic) > 0) & says("订阅", "消费"), _edges(_first_of(services), topic, F.lit("SUBSCRIBES"))))
    offers = _edges(F.array("offering"), functions, F.lit("PROVIDES"))
    finds = [_finds(F.when(parent != "", F.concat(F.array(parent), held)).otherwise(F.array().cast("array<string>"))), _finds(backing), _finds(functions, lambda _: F.lit("Function"), lambda _: F.lit("功能层"))]
    return finds, F.concat(holding, stores, needs, together, calls, queued, offers)


def _ranked(finds: list[Column], begin: int) -> Column:
    """The finds of rules with their places: ranks from `begin`."""

    def ranked(names: Column, rank: int) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(rank).alias("rank"), x["name"].alias("name"), x["kind"].alias("kind"), x["layer"].alias("layer")))

    return F.flatten(F.array(*(ranked(names, begin + i) for i, names in enumerate(finds))))


def _addresses(sentences: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc, name, host, ip, port: what follows the names of addressed nodes in their text; the last one said counts."""
    told = sentences.filter(F.lower("said").rlike(r"\b(?:host(?:name)?|ip|port)\s*[=:：]"))
    told = cut(told.select("doc", "place", "said", F.to_json(F.struct("doc", "place")).alias("row")))
    named = nodes.filter(F.col("kind").isin(*ADDRESSED) & (F.length("name") >= LEAST_IDENTIFIER)).select("doc", "name", F.lower("name").alias("key"))
    named = cut(named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc"))))
    few, many = named.filter(F.col("n") <= FEW_NAMES).drop("n"), named.filter(F.col("n") > FEW_NAMES).drop("n")
    held = told.join(few, "doc").filter(F.contains(F.lower("said"), F.col("key"))).select("doc", "name", "place", "said")
    if many.limit(1).count():
        long = told.join(many.select("doc").distinct(), "doc", "left_semi")
        found = mentions(long.select("row", F.col("said").alias("text")), many).join(long, "row").join(many, ["doc", "key"])
        held = held.unionByName(found.select("doc", "name", "place", "said"))
    pattern = F.concat(F.lit(r"(?i)\Q"), "name", F.lit(rf"\E(?![A-Za-z0-9_-])([^。；;\n]{{0,{MOST_SEGMENT}}})"))
    segments = F.regexp_extract_all("said", pattern, F.lit(1))
    last = lambda p: F.try_element_at(F.filter(F.transform(segments, lambda s: F.regexp_extract(s, p, 1)), lambda x: x != ""), F.lit(-1))
    rows = held.select("doc", "name", "place", *(last(p).alias(n) for n, p in FIELDS.items()))
    return rows.groupBy("doc", "name").agg(*(F.expr(f"max_by({n}, place) FILTER (WHERE {n} IS NOT NULL)").alias(n) for n in FIELDS))


def _texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that say anything, with title and layers, and their sentences (doc, queue, place, said)."""
    rows = spread(texts.filter("trim(text) <> ''").select("doc", "text"))
    queue = F.coalesce(F.nullif(F.regexp_extract("text", architecture.QUEUE, 0), F.lit("")), F.lit(NO_QUEUE))
    said = F.filter(F.transform(F.split("text", SENTENCE_ENDS), lambda x: F.trim(x)), lambda x: x != "")
    return _titles(rows), rows.select("doc", queue.alias("queue"), F.posexplode(said).alias("place", "said"))


def _relations(made: DataFrame) -> DataFrame:
    # With explode() Spark would look for empty arrays first, and compute what isn't written yet twice.
    return made.select("doc", F.explode_outer("edges").alias("e")).filter("e is not null").select("doc", "e.*").distinct()


def relations(texts: DataFrame) -> DataFrame:
    """The edges of extracted() alone, in one pass without tables on the way."""
    rows, sentences = _texts(texts)
    whole, each = rows.select("doc", _of_text()[1].cast(_EDGE).alias("edges")), _spans(sentences).select("doc", _of_sentence()[1].cast(_EDGE).alias("edges"))
    return _relations(whole.unionByName(each))


def extracted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, name, kind, layer, aliases, host, ip, port) and edges (doc, source, target, type) of texts.

    Of several finds of a name the first rule that tells more than a component counts. Ends of edges become nodes. Systems,
    layers and abstract words that no edge holds go. Aliases and addresses are only what the text says, the latter of names
    of LEAST_IDENTIFIER characters or more. A null or empty text gives nothing; texts that repeat a doc count as one text
    in pieces, and the nodes of a null doc have neither aliases nor addresses; other columns are not looked at. Both tables are cut, as several steps read them."""
    rows, sentences = _texts(texts)
    sentences = cut(sentences)
    finds, layers = _of_text()
    whole = rows.select("doc", _ranked(finds, 0).alias("finds"), layers.cast(_EDGE).alias("edges"))
    more, edges = _of_sentence()
    each = _spans(spread(sentences)).select("doc", _ranked(more, len(finds)).alias("finds"), edges.cast(_EDGE).alias("edges"))
    made = cut(whole.unionByName(each))
    edges = cut(_relations(made))
    ends = edges.select("doc", F.explode(F.array("source", "target")).alias("name")).distinct()
    implied = ends.select("doc", F.lit(99).alias("rank"), "name", architecture.inferred_kind(F.col("name")).alias("kind"), F.lit(architecture.DEFAULT_LAYER).alias("layer"))
    every = made.select("doc", F.explode("finds").alias("f")).select("doc", "f.*").unionByName(implied).withColumn("linked", F.col("rank") == 99)
    first = lambda c, default: F.coalesce(F.expr(f"min_by({c}, rank) FILTER (WHERE {c} <> '{default}')"), F.lit(default)).alias(c)
    nodes = every.groupBy("doc", "name").agg(first("kind", architecture.DEFAULT_KIND), first("layer", architecture.DEFAULT_LAYER), F.bool_or("linked").alias("linked"))
    nodes = cut(nodes.filter(F.col("linked") | ~(F.col("kind").isin("System", "Layer") | F.col("name").isin(*ABSTRACT))).drop("linked"))
    pairs = F.arrays_zip(_extract_all(F.col("said"), ALIAS, 1).alias("name"), _extract_all(F.col("said"), ALIAS, 2).alias("alias"))
    aliases = sentences.select("doc", "place", F.posexplode(pairs).alias("at", "x")).select("doc", entity(F.col("x.name"), "Service").alias("name"), F.struct("place", "at", F.col("x.alias").alias("alias")).alias("x"))
    aliases = aliases.groupBy("doc", "name").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["alias"])).alias("aliases"))
    nodes = nodes.join(aliases, ["doc", "name"], "left").join(_addresses(sentences, nodes), ["doc", "name"], "left")
    return nodes.select("doc", "name", "kind", "layer", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "host", "ip", F.col("port").cast("int").alias("port")), edges
