"""Repair of conversations whose turns were damaged, by dynamic programming over turns and grammar state.

A good conversation is empty, or an optional system turn and then pairs of user and assistant turns. Every turn is kept,
given another role or deleted, and empty turns may be inserted; the cheapest edits win. Cost-to-go is computed backward
over turn and grammar state; a forward walk takes, of the edits that are tight with it, the one whose letter is least in
ASCII (Delete, Insert, Keep, Rerole), which gives the least audit of all cheapest ones. The edits then go back to the turns.

Spark puts all turns in order (by ranges, so that a long conversation spans several tasks), finds faults and writes a turn
as one letter: role and fault. Letters are gathered by segments of SEGMENT turns at most. A segment's backward pass is a
4 x 4 matrix of costs from state to state, and these matrices, a few numbers a segment, are all that comes together of a
conversation before its segments are walked, each on its own, from the state in which the one before ends. Texts never
leave Spark's expressions.

Defined results: null role, text, conv_id or turn count as one space where damage is drawn; a null role or text is one
space from there on, a null conv_id is a conversation of its own and returned as null; null turns come first; turns of one
number are ordered by role and text; a role's initial is its first character, and a role that starts with none of s, u, a
is no turn of the grammar and can only be given another role or deleted; repeated rows are turns like others; extra columns
are ignored; an empty table gives an empty result."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Faults in their order, and the initials of the grammar; any other role is "o".
FAULTS = ("", "truncated", "blank", "duplicate")
INITIALS = "suao"
#: A turn that the damage dropped; all others are letters from "A", by initial and fault.
GONE = "-"
LETTERS = "".join(chr(ord("A") + i) for i in range(16))
#: Turns of a segment, a power of two.
SEGMENT_BITS = 12
STATES = range(4)
#: The initial that leads to a state, and the states after an initial: 0 start, 1 after system, 2 after user, 3 after assistant.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: The initial of what is inserted or given in a state: user after all but a user.
NEXT = ("u", "u", "a", "u")
ENDS = (0, 2 * INSERT, INSERT, 0)
NO_WAY = 1 << 40


def _insert(state: int) -> int:
    return AFTER[NEXT[state]][state]


def _edits(letter: str, state: int) -> list[tuple[str, int, int, str]]:
    """(letter, cost, state after, new initial) of the edits of one turn, in ASCII order."""
    initial, fault = INITIALS[(ord(letter) - 65) // 4], FAULTS[(ord(letter) - 65) % 4]
    found = [("D", DELETE, state, "")]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED * (fault == "truncated")
        if state in AFTER[initial]:
            found.append(("K", more, AFTER[initial][state], ""))
        found.append(("R", REROLE + more, _insert(state), NEXT[state]))
    return found


def cost_to_go(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a turn, by state, from the costs after it. Before a turn at most two are inserted, as a third leads nowhere new."""
    if letter == GONE:
        return after
    now = [min(cost + after[to] for _, cost, to, _ in _edits(letter, state)) for state in STATES]
    return tuple(min(now[s], INSERT + now[a := _insert(s)], 2 * INSERT + now[_insert(a)]) for s in STATES)


@lru_cache(20_000)
def costs(codes: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a segment, from the costs after it."""
    for letter in reversed(codes):
        after = cost_to_go(letter, after)
    return after


@lru_cache(20_000)
def matrix(codes: str) -> tuple[int, ...]:
    """Costs from each state before a segment to each state after it, row by row."""
    columns = [costs(codes, tuple(0 if s == to else NO_WAY for s in STATES)) for to in STATES]
    return tuple(columns[to][s] for s in STATES for to in STATES)


@lru_cache(20_000)
def walk(codes: str, after: tuple[int, ...], state: int) -> tuple[int, str, tuple[str, ...]]:
    """State after a segment, its audit, and a step for each turn: initials inserted before it, edit, new initial."""
    togo = [after]
    for letter in reversed(codes):
        togo.append(cost_to_go(letter, togo[-1]))
    togo.reverse()
    audit, steps = [], []
    for i, letter in enumerate(codes):
        before = ""
        while letter != GONE:
            left, tight = togo[i][state], [e for e in _edits(letter, state) if e[1] + togo[i + 1][e[2]] == togo[i][state]]
            inserts = left == INSERT + togo[i][_insert(state)]
            if inserts and not (tight and tight[0][0] == "D"):
                before, state = before + NEXT[state], _insert(state)
                audit.append("I")
                continue
            edit, _, state, initial = tight[0]
            audit.append(edit)
            steps.append(before + edit + initial)
            break
        else:
            steps.append(GONE)
    return state, "".join(audit), tuple(steps)


@lru_cache(20_000)
def illegal(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def initials_of(codes: str) -> str:
    return "".join(INITIALS[(ord(c) - 65) // 4] for c in codes if c != GONE)


def _summary(codes: pd.Series) -> pd.DataFrame:
    said = [initials_of(c) for c in codes]
    return pd.DataFrame({"costs": [matrix(c) for c in codes], "head": [x[:1] for x in said], "tail": [x[-1:] for x in said], "illegal": [illegal(x) for x in said]})


def _ends(matrices: pd.Series) -> pd.Series:
    """Costs after each segment of a conversation; before them, those before the first segment."""

    def back(found):
        out = [tuple(ENDS)]
        for m in reversed(found):
            out.append(tuple(min(int(m[4 * s + to]) + out[-1][to] for to in STATES) for s in STATES))
        return out[::-1]

    return matrices.map(back)


def _exits(codes: pd.Series, after: pd.Series) -> pd.Series:
    """The state after a segment, for each state before it."""
    return pd.Series([[walk(c, tuple(map(int, a)), s)[0] for s in STATES] for c, a in zip(codes, after)])


def _walks(codes: pd.Series, after: pd.Series, state: pd.Series) -> pd.DataFrame:
    found = [walk(c, tuple(map(int, a)), int(s)) for c, a, s in zip(codes, after, state)]
    return pd.DataFrame({"audit": [f[1] for f in found], "steps": [f[2] for f in found]})


_TYPES = {
    "_summary": "struct<costs:array<bigint>,head:string,tail:string,illegal:bigint>",
    "_ends": "array<array<bigint>>",
    "_exits": "array<int>",
    "_walks": "struct<audit:string,steps:array<string>>",
}


def _vectorised(function):
    """The function on pandas series as a column function; made where a session is, as workers import this module without one."""
    return F.pandas_udf(function, _TYPES[function.__name__])


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, copy: the turns after damage drawn by conversation and number; gone ones stay as rows."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return (
        turns.select("conv_id", "turn", "role", "text", draw.alias("draw"))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("draw") == 4, "user").otherwise(said("role")).alias("role"),
            text.alias("text"),
            (F.col("draw") == 0).alias("gone"),
            F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )


def whole(turns: DataFrame) -> DataFrame:
    """The turns as damage() gives them, without damage."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", "turn", said("role"), said("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def _initial(role) -> F.Column:
    return F.greatest(F.locate("s", F.substring(role, 1, 1)), 2 * F.locate("u", F.substring(role, 1, 1)), 3 * F.locate("a", F.substring(role, 1, 1)))


def in_order(turns: DataFrame, store: Scratch) -> DataFrame:
    """The turns with conv (a key of the conversation, never null), id in order and segment; saved as `turns`."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    sorted_ = turns.withColumn("conv", key).repartitionByRange(*order).sortWithinPartitions(*order)
    return store.save(sorted_.withColumn("id", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("id", SEGMENT_BITS)), "turns")


def coded(rows: DataFrame, store: Scratch) -> DataFrame:
    """conv, segment, id, code (initial and fault as a letter) of each ordered turn, and what is counted of it."""
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    narrow = rows.select(
        "conv", "segment", "id", "turn", "gone",
        F.when(~F.col("gone"), F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))).alias("digest"),
        F.pmod(_initial(F.col("role")) + 3, F.lit(4)).alias("initial"),
        F.when(F.btrim("text", F.lit(WHITE)) == "", 2).when(~end.isin(".", "!", "?"), 1).otherwise(0).alias("fault"),
    )
    # Written, as Spark splits a frequent turn's rows only where both sides of the join come from a shuffle of their own.
    first = narrow.filter("digest is not null and fault != 2").groupBy("conv", "digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = store.save(first, "first")
    fault = F.when((F.col("fault") != 2) & (F.col("id") > F.col("first")), 3).otherwise(F.col("fault"))
    return (
        narrow.join(first, ["conv", "digest"], "left")
        .withColumn("fault", F.when(~F.col("gone"), fault))
        .select("conv", "segment", "id", "turn", "gone", "fault", F.when(F.col("gone"), GONE).otherwise(F.substring(F.lit(LETTERS), F.col("initial") * 4 + F.col("fault") + 1, F.lit(1))).alias("code"))
    )


def repair(turns: DataFrame, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """Repaired turns (conv, conv_id, id, edit, role, text; an inserted turn has the id of the turn it stands before and no text,
    one at the end a null id), and for each conversation conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    turns: as damage() or whole() gives them."""
    rows = in_order(turns, store)
    codes = store.save(coded(rows, store), "codes")
    n = lambda fault: F.count(F.when(F.col("fault") == FAULTS.index(fault), 1)).alias(fault)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), "")
    segments = codes.groupBy("conv", "segment").agg(F.min("id").alias("first"), joined.alias("codes"), n("blank"), n("duplicate"), n("truncated"))
    segments = store.save(segments.withColumn("found", _vectorised(_summary)("codes")), "segments")

    parts = F.sort_array(F.collect_list(F.struct("segment", "found.costs", "found.head", "found.tail")))
    sums = [F.sum(x).alias(x.split(".")[-1]) for x in ("blank", "duplicate", "truncated", "found.illegal")]
    talks = segments.groupBy("conv").agg(parts.alias("parts"), *sums).withColumn("ends", _vectorised(_ends)(F.transform("parts", lambda p: p["costs"])))
    # Pairs across segments: each part that holds turns beside the last one before it that does.
    full = F.filter("parts", lambda p: p["head"] != "")
    seams = F.zip_with(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), lambda a, b: (~F.concat(a["tail"], b["head"]).isin("su", "ua", "au")).cast("int"))
    talks = talks.withColumn("illegal", F.col("illegal") + F.aggregate(seams, F.lit(0), lambda a, x: a + x))
    talks = store.save(talks.withColumn("cost", F.element_at(F.element_at("ends", 1), 1)), "talks")

    after = talks.select("conv", F.posexplode(F.slice("ends", 2, F.size("ends"))).alias("at", "after"), "parts").select("conv", F.element_at("parts", F.col("at") + 1)["segment"].alias("segment"), "after")
    walked = segments.select("conv", "segment", "first", "codes").join(after, ["conv", "segment"]).withColumn("exits", _vectorised(_exits)("codes", "after"))
    walked = store.save(walked, "walked")
    exits = walked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("segment", "exits"))).alias("parts"))
    # The state before each segment, and after the last one: a fold over the exits.
    states = F.aggregate("parts", F.array(F.lit(0)), lambda found, p: F.concat(found, F.array(F.element_at(p["exits"], F.element_at(found, -1) + 1))))
    states = exits.select("conv", "parts", states.alias("states"))
    entries = states.select("conv", F.posexplode(F.transform("parts", lambda p: p["segment"])).alias("at", "segment"), "states").select("conv", "segment", F.element_at("states", F.col("at") + 1).alias("state"))
    done = walked.drop("exits").join(entries, ["conv", "segment"]).withColumn("walk", _vectorised(_walks)("codes", "after", "state"))
    done = store.save(done.select("conv", "segment", "first", "walk.audit", "walk.steps"), "done")

    last = states.select("conv", F.element_at("states", -1).alias("state")).withColumn("ends", F.element_at(F.array(*map(F.lit, ("", "ua", "a", ""))), F.col("state") + 1))
    audit = done.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("segment", "audit"))).alias("audits")).select("conv", F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit"))
    shown = codes.filter("not gone").groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("n"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long")
    names = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    summary = (
        names.join(talks.drop("parts", "ends"), "conv").join(audit, "conv").join(last.select("conv", "ends"), "conv").join(shown, "conv", "left")
        .select("conv", "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", F.translate("ends", "ua", "II")).alias("audit"), "ends")
    )
    summary = store.save(summary, "summary")

    role = lambda x: F.when(x == "u", "user").otherwise("assistant")
    added = lambda x: F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.struct(F.lit("I").alias("edit"), role(c).alias("role"), F.lit("").alias("text")))
    step = F.element_at("steps", (F.col("id") - F.col("first") + 1).cast("int"))
    own = F.struct(F.regexp_extract("step", "[DKR]", 0).alias("edit"), F.when(F.col("step").rlike("R"), role(F.right("step", F.lit(1)))).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))
    kept = F.when(F.col("step").rlike("[KR]"), F.array(own)).otherwise(F.array().cast("array<struct<edit:string,role:string,text:string>>"))
    repaired = (
        rows.filter("not gone").join(done, ["conv", "segment"])
        .select("conv", "conv_id", "id", "role", "text", step.alias("step"))
        .select("conv", "conv_id", "id", F.posexplode(F.concat(added(F.regexp_extract("step", "^[ua]*", 0)), kept)).alias("at", "x"))
        .unionByName(summary.filter("ends != ''").select("conv", "conv_id", F.lit(None).cast("long").alias("id"), F.posexplode(added(F.col("ends"))).alias("at", "x")))
    )
    return repaired.select("conv", "conv_id", "id", "at", "x.edit", "x.role", "x.text"), summary.drop("ends")


def repair_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    store = Scratch(turns.sparkSession, "turn-repair")
    repaired, summary = repair(turns, store)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "at", F.concat("role", F.lit(":"), "text").alias("said"))
    said = repaired.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda p: p["said"]), "\n").alias("said"))
    out = summary.join(said, "conv", "left").withColumn("repaired_sha256", F.sha2(F.coalesce("said", F.lit("")).cast("binary"), 256))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
