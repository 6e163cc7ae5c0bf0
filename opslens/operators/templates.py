"""Message templates mined from masked messages: by a prefix tree of fixed depth, or by similarity alone.

Only distinct masked messages are mined, in the order of their first events, and each finds its template once; counts come
from how often a message stands in the log, so a message that fills the log is one row a task. The leaf of the tree that a
message belongs to is told by its first words and by which words have a branch of their own, which are ranked by Spark.
A leaf's messages are clustered in chunks of their order, each in one task; the templates of a leaf's chunks are then
clustered as messages are, level by level, until a leaf is one chunk. A leaf of one chunk has exactly the clusters of one
pass; over more chunks, messages that one pass puts together may stay apart where the templates of their chunks differ in
more words than the threshold allows, and none is put together that its chunk kept with a template it is not like."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_text
from .compression import best, numbered
from .lineage import cut

MASK = "<*>"
#: Depth of the tree with root and leaf, branches of a node, share of equal words.
DEPTH, MAX_CHILDREN, THRESHOLD = 4, 100, 0.4
#: Messages that are clustered by one task at once.
CHUNK = 10_000


def message_kinds(events: DataFrame) -> DataFrame:
    """message (masked), tokens, size, n, at (event_s, event_id of the first): one row a distinct masked message of events."""
    kinds = events.groupBy(log_text.mask(F.col("message")).alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("event_s", "event_id")).alias("at"))
    tokens = F.filter(F.split("message", " "), lambda x: x != "")
    return kinds.select("message", tokens.alias("tokens"), F.size(tokens).alias("size"), "n", "at")


def tree_leaves(kinds: DataFrame, depth: int = DEPTH, max_children: int = MAX_CHILDREN) -> DataFrame:
    """The messages with `leaf`: number of words, then the first words, as far as the depth goes. A word with a digit, and one
    that comes after a node's other branches are given out, takes the branch of masked words."""
    kinds = kinds.withColumn("leaf", F.col("size").cast("string"))
    for level in range(1, depth - 2):
        word = F.get("tokens", F.lit(level - 1))
        kinds = kinds.withColumn("_word", F.when((F.col("size") > level) & ~word.rlike("[0-9]") & (word != MASK), word))
        branches = kinds.filter("_word is not null").groupBy("leaf", "_word").agg(F.min("at").alias("at"))
        own = best(branches, ["leaf"], ["at"], max_children - 1).select("leaf", "_word", F.col("_word").alias("_own"))
        last = F.col("size") <= level  # a message that ends here stays at this node
        kinds = kinds.join(own, ["leaf", "_word"], "left").withColumn("leaf", F.when(last, F.col("leaf")).otherwise(F.concat_ws(" ", "leaf", F.coalesce("_own", F.lit(MASK))))).drop("_word", "_own")
    return kinds


def likeness(template: list[str], tokens: list[str], masked: bool) -> tuple[float, int]:
    """The share of a template's words that a message of as many words has, and its masked words. masked: these count as equal."""
    hidden = template.count(MASK)
    if not template:
        return 1.0, 0
    same = sum(a == b or masked and MASK in (a, b) for a, b in zip(template, tokens))
    return same / len(template), hidden


def merge(template: list[str], tokens: list[str]) -> list[str]:
    return [a if a == b else MASK for a, b in zip(template, tokens)]


class Leaf:
    """The clusters of a leaf, in the order in which they were founded."""

    def __init__(self, threshold: float, masked: bool):
        self.threshold, self.masked, self.templates, self.founders = threshold, masked, [], []

    def add(self, name, tokens: list[str]):
        """The founder of the cluster that a message goes to: the most alike, of equals the one with more masked words where
        these don't count as equal, then the oldest; else a new one."""
        rank = lambda i: (s := likeness(self.templates[i], tokens, self.masked), (s[0], 0 if self.masked else s[1], -i))[1]
        at = max(range(len(self.templates)), key=rank, default=-1)
        if at < 0 or likeness(self.templates[at], tokens, self.masked)[0] < self.threshold:
            self.templates.append(tokens)
            self.founders.append(name)
            return name
        self.templates[at] = merge(self.templates[at], tokens)
        return self.founders[at]


def _clustered(rows: DataFrame, threshold: float, masked: bool, chunk: int) -> DataFrame:
    """(id, founder, chunked): rows (leaf, at, tokens, id) clustered by chunks of each leaf's order; chunked: whether the leaf has more than one."""
    placed = numbered(rows.select("leaf", "at", "id", "tokens"), "leaf", ["at", "id"]).withColumn("_chunk", F.floor(F.col("place") / chunk))
    # No leaf has more chunks than a chunk's share of all messages.
    chunks = placed.groupBy("leaf").agg(F.max("_chunk").alias("_last"))
    dealt = placed.join(chunks, "leaf").repartition("leaf", "_chunk").sortWithinPartitions("leaf", "_chunk", "place")

    def run(batches):
        group, leaf = None, None
        for pdf in batches:
            out = []
            for name, last, number, of, tokens in zip(pdf["id"], pdf["_last"], pdf["_chunk"], pdf["leaf"], pdf["tokens"]):
                if (of, number) != group:
                    group, leaf = (of, number), Leaf(threshold, masked)
                out.append((name, leaf.add(name, list(tokens)), last > 0))
            yield pd.DataFrame(out, columns=["id", "founder", "chunked"])

    return cut(dealt.mapInPandas(run, "id string, founder string, chunked boolean"))


def shown(tokens: DataFrame) -> DataFrame:
    """founder, tokens: rows (founder, tokens) of one length a founder, with a mask wherever they differ."""
    places = tokens.select("founder", F.posexplode("tokens").alias("place", "token")).groupBy("founder", "place").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    word = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(MASK))
    return places.groupBy("founder").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", word.alias("word")))), lambda x: x["word"]).alias("tokens"))


def clusters(kinds: DataFrame, threshold: float = THRESHOLD, masked: bool = False, chunk: int = CHUNK) -> DataFrame:
    """message, founder: messages (leaf, message, tokens, at) with the message that founded their cluster."""
    rows = kinds.select("leaf", "at", F.col("message").alias("id"), "tokens")
    found = _clustered(rows, threshold, masked, chunk)
    homes, held = found.select(F.col("id").alias("message"), "founder"), found.count()
    while found.filter("chunked").limit(1).count():
        # The templates of leaves with several chunks are clustered once more; each stands where its founder stood.
        some = found.filter("chunked").select("id", "founder")
        founders = rows.select("leaf", "at", F.col("id").alias("founder"))
        rows = cut(shown(some.join(rows.select("id", "tokens"), "id").select("founder", "tokens")).join(founders, "founder").select("leaf", "at", F.col("founder").alias("id"), "tokens"))
        found = _clustered(rows, threshold, True, chunk)
        n = rows.count()
        moved = found.select(F.col("id").alias("founder"), F.col("founder").alias("_to"))
        homes = cut(homes.join(moved, "founder", "left").select("message", F.coalesce("_to", "founder").alias("founder")))
        if n >= held:  # nothing came together any more
            break
        held = n
    return homes


def mined(events: DataFrame, tree: bool = True, threshold: float = THRESHOLD, depth: int = DEPTH, max_children: int = MAX_CHILDREN, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Templates (template_id, template, n, first_id), and (message, template_id) of each distinct masked message.

    tree: by the prefix tree, where masked words count as different; else by number of words alone, where they count as
    equal. Null messages count as empty; empty messages are one template. Templates are numbered in the order of their first events."""
    kinds = cut(message_kinds(events.withColumn("message", F.coalesce("message", F.lit("")))))
    leaves = tree_leaves(kinds, depth, max_children) if tree else kinds.withColumn("leaf", F.col("size").cast("string"))
    homes = cut(clusters(cut(leaves), threshold, not tree, chunk))
    held = homes.join(kinds, "message")
    text = shown(held.select("founder", "tokens")).select("founder", F.array_join("tokens", " ").alias("template"))
    facts = held.groupBy("founder").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    # One row a template.
    number = F.format_string("E%05d", F.row_number().over(Window.orderBy("at")))
    named = cut(facts.join(text, "founder", "left").withColumn("template_id", number))
    found = named.select("template_id", F.coalesce("template", F.lit("")).alias("template"), "n", F.col("at.event_id").alias("first_id"))
    return found, homes.join(named.select("founder", "template_id"), "founder").select("message", "template_id")


def event_templates(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """The events with the template_id of their masked message. A frequent message's rows are split where Spark finds them skewed."""
    masked: Column = log_text.mask(F.coalesce("message", F.lit("")))
    return events.withColumn("_masked", masked).join(mapping.withColumnRenamed("message", "_masked"), "_masked", "left").drop("_masked")
