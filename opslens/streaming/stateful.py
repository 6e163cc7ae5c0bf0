"""Streams with state of their own: fault episodes and message templates, as the batch operators find them.

Both take rows with a column `key` (a system or project), whose state is one worker's work, and tell event time by themselves:
a key's watermark is its latest event less `late` seconds. Rows wait until the watermark has passed them and are then taken
in the order of time, so that rows that come out of order change nothing; a row that comes after the watermark has passed its
time is late, and is told as such, with no episode or template. A timer of processing time takes what waits when a key has
been idle, and closes it. State is bounded by what fits into `late` seconds, the longest gap, and a number of templates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators import episodes, templates

EPISODES = "key string, event_id string, episode string, late boolean"
TEMPLATES = "key string, event_id string, template_id long, template string, late boolean"
_TIMES = "seen long, passed long, next long"


class _InOrder(StatefulProcessor):
    """Rows of a key in the order of event time; subclasses say what is made of them (take) and what is held (load, store)."""

    def __init__(self, late: int, idle_ms: int):
        self.late, self.idle_ms = late, idle_ms

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_s long, event_id string, row string")
        self.held = handle.getListState("held", "item string")
        self.times = handle.getValueState("times", _TIMES)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        seen, passed, number = self.times.get() if self.times.exists() else (None, None, 0)
        waiting, out = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], []
        for pdf in rows:
            for row in pdf.drop(columns="key").to_dict("records"):
                at = int(row["event_s"])
                if passed is not None and at < passed:
                    out.append(self.told(key[0], row, None))
                else:
                    waiting.append((at, str(row["event_id"]), json.dumps({k: v if v == v else None for k, v in row.items()}, default=str)))
                seen = at if seen is None else max(seen, at)
        passed = seen - self.late if passed is None else max(passed, seen - self.late)
        out += self._taken(key[0], waiting, seen, passed, number)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """An idle key: what waits is taken, and what is open closes."""
        seen, _, number = self.times.get()
        out = self._taken(key[0], [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], seen, seen + 1, number)
        self.closed()
        self.timer.clear()
        yield pd.DataFrame(out, columns=self.columns)

    def _taken(self, key, waiting, seen, passed, number):
        ready = sorted(r for r in waiting if r[0] < passed)
        left = [r for r in waiting if r[0] >= passed]
        held = [json.loads(r[0]) for r in self.held.get()] if self.held.exists() else []
        out = []
        for _, _, text in ready:
            row = json.loads(text)
            found, number = self.take(row, held, number)
            out.append(self.told(key, row, found))
        held = self.kept(held, passed)
        self.held.put([(json.dumps(x),) for x in held]) if held else self.held.clear()
        self.waiting.put(left) if left else self.waiting.clear()
        self.times.update((seen, passed, number))
        return out

    def kept(self, held, passed):
        return held

    def closed(self):
        pass

    def close(self):
        pass


class Episodes(_InOrder):
    """Errors join the open episode that they fit best, as episodes.join_score() says, or open one."""

    columns = ["key", "event_id", "episode", "late"]
    _sets = (("traces", "trace_id"), ("services", "service"), ("targets", "downstream"), ("families", "family"), ("classes", "exception_key"))

    def told(self, key, row, found):
        return key, str(row["event_id"]), found, found is None

    def take(self, row, held, number):
        held[:] = [e for e in held if row["event_s"] - e["last"] <= episodes.LONGEST]
        best = (-1, 0, None)
        for n, e in enumerate(held):
            score = episodes.join_score(row, {**e, **{name: set(e[name]) for name, _ in self._sets}})
            best = max(best, (score, n, e), key=lambda x: x[:2])
        home = best[2]
        if best[0] < 0:
            home = {"id": str(row["event_id"]), "atomic": False, **{name: [] for name, _ in self._sets}}
            held.append(home)
        home["last"], home["atomic"] = row["event_s"], home["atomic"] or bool(row["is_atomic"])
        for name, column in self._sets:
            if row[column] and row[column] not in home[name]:
                home[name].append(row[column])
        return home["id"], number

    def kept(self, held, passed):
        return [e for e in held if passed - e["last"] <= episodes.LONGEST]

    def closed(self):
        self.held.clear()


class Templates(_InOrder):
    """Masked messages find their cluster among the key's templates; of more than `most` the one that was used last longest ago goes."""

    columns = ["key", "event_id", "template_id", "template", "late"]

    def __init__(self, late: int, idle_ms: int, threshold: float, most: int):
        super().__init__(late, idle_ms)
        self.threshold, self.most = threshold, most

    def told(self, key, row, found):
        return key, str(row["event_id"]), *(found or (None, None)), found is None

    def take(self, row, held, number):
        tokens = [x for x in (row["message"] or "").split(" ") if x]
        fits = [(templates.likeness(t["tokens"], tokens, False), -t["id"], t) for t in held if len(t["tokens"]) == len(tokens)]
        score, _, home = max(fits, key=lambda x: x[:2], default=((-1.0, 0), 0, None))
        if home is None or score[0] < self.threshold:
            number += 1
            home = {"id": number, "tokens": tokens}
        else:
            home = {"id": home["id"], "tokens": templates.merge(home["tokens"], tokens)}
            held[:] = [t for t in held if t["id"] != home["id"]]
        held.append(home)
        del held[: max(0, len(held) - self.most)]
        return (home["id"], " ".join(home["tokens"])), number


def stream_episodes(errors: DataFrame, late: int = 600, idle_ms: int = 60_000) -> DataFrame:
    """key, event_id, episode (the id of its first error), late. errors: key, and the columns of episodes.fault_episodes()."""
    columns = ("key", "event_id", "event_s", "trace_id", "service", "downstream", "family", "exception_key", "is_wrapper", "is_atomic")
    return errors.select(*columns).groupBy("key").transformWithStateInPandas(Episodes(late, idle_ms), EPISODES, "append", "processingTime")


def stream_templates(events: DataFrame, late: int = 600, idle_ms: int = 60_000, threshold: float = templates.THRESHOLD, most: int = 10_000) -> DataFrame:
    """key, event_id, template_id (by key), template as it is then, late. events: key (as the leaf of a tree), event_id, event_s, message (masked)."""
    return events.select("key", "event_id", "event_s", "message").groupBy("key").transformWithStateInPandas(Templates(late, idle_ms, threshold, most), TEMPLATES, "append", "processingTime")
