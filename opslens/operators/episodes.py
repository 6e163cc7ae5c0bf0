"""Fault episodes, which depend on the order of events: rows that Spark has dealt out and sorted are gone through once, and only
episodes that later rows can still meet are held."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Seconds in which an error may join an episode: by trace, target, passed-on or root errors, class, and family.
TRACE_GAP, TARGET_GAP, SHORT_GAP, CLASS_GAP, FAMILY_GAP = 600, 45, 20, 480, 300
LONGEST = max(TRACE_GAP, TARGET_GAP, SHORT_GAP, CLASS_GAP, FAMILY_GAP)


def join_score(error: dict, episode: dict) -> int:
    """How well an error fits an episode by what it has seen; -1 if not at all."""
    gap = error["event_s"] - episode["last"]
    at_home = not error["service"] or not episode["services"] or error["service"] in episode["services"]
    if error["trace_id"] and error["trace_id"] in episode["traces"] and gap <= TRACE_GAP:
        return 100
    if error["downstream"] and error["downstream"] in episode["services"] | episode["targets"] and gap <= TARGET_GAP:
        return 95
    if gap <= SHORT_GAP and (error["is_wrapper"] or error["is_atomic"] or episode["atomic"]):
        return 85
    if at_home and error["exception_key"] in episode["classes"] and gap <= CLASS_GAP:
        return 90
    return 80 if at_home and error["family"] in episode["families"] and gap <= FAMILY_GAP else -1


def fault_episodes(errors: DataFrame) -> DataFrame:
    """event_id, episode (the id of its first error) of errors (event_id, event_s, trace_id, service, downstream, family,
    exception_key, is_wrapper, is_atomic): each joins the open episode that it fits best, the newest of equals, or opens one.

    Stretches of time that lie further apart than any gap don't meet, so each is a task's work of its own; within one, only
    episodes whose last error can still be followed are held."""
    slots = errors.select(F.floor(F.col("event_s") / LONGEST).alias("_slot")).distinct()
    before = F.lag("_slot").over(Window.orderBy("_slot"))  # one row a slot of time, whatever the number of errors
    slots = slots.withColumn("_opens", F.when(F.col("_slot") - before <= 1, 0).otherwise(1)).withColumn("_stretch", F.sum("_opens").over(Window.orderBy("_slot")))
    dealt = errors.withColumn("_slot", F.floor(F.col("event_s") / LONGEST)).join(slots.select("_slot", "_stretch"), "_slot")

    def run(batches):
        stretch, held = None, []
        for pdf in batches:
            out = []
            for error in pdf.to_dict("records"):
                if error["_stretch"] != stretch:
                    stretch, held = error["_stretch"], []
                held = [e for e in held if error["event_s"] - e["last"] <= LONGEST]
                score, _, home = max(((join_score(error, e), n, e) for n, e in enumerate(held)), key=lambda x: x[:2], default=(-1, 0, None))
                if score < 0:
                    home = {"id": error["event_id"], "traces": set(), "services": set(), "targets": set(), "families": set(), "classes": set(), "atomic": False}
                    held.append(home)
                home["last"], home["atomic"] = error["event_s"], home["atomic"] or error["is_atomic"]
                for name, c in (("traces", "trace_id"), ("services", "service"), ("targets", "downstream"), ("families", "family"), ("classes", "exception_key")):
                    if error[c]:
                        home[name].add(error[c])
                out.append((error["event_id"], home["id"]))
            yield pd.DataFrame(out, columns=["event_id", "episode"])

    kind = dict(errors.dtypes)["event_id"]
    return dealt.repartition("_stretch").sortWithinPartitions("_stretch", "event_s", "event_id").mapInPandas(run, f"event_id {kind}, episode {kind}")
