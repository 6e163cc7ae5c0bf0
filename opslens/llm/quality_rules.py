"""Quality rules: text statistics and a learned decision list over them.

Sequential covering learns the list: a rule for low quality grows by the threshold condition with the best FOIL gain on
one part of the labelled rows until it covers no good one there, is pruned from its end on the other part, and is kept if
it is precise enough on that part; the rows it covers go and the next rule is learned. The list is emitted as one ordered
Spark conditional expression, so that applying it costs no Python and can be read.

Only a bounded number of labels is used for learning (max_labels, those with the least hash of their doc_id), each with one
document; of labels or documents that repeat a doc_id the least counts. Statistics and verdicts cover all rows.

Defined results: null text counts as empty and has no words, which fails the base rule; rows without a label are judged
like all others; without labels of both kinds the list is empty and only the base rule rejects; repeated rows are judged
once each; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, strings

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
MAX_LABELS = 20_000
MIN_PRECISION = 0.95
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits")
SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in STATS)
_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", *STATS)])
#: What conditions are about: each is a number that a reader can check, as SQL over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "digits_per_word": "n_digits / greatest(n_words, 1)",
}


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(codes) < 4:
        return 0
    n = np.int64(codes.max() + 1)
    pair = codes[:-1] * n + codes[1:]
    if n > 2_000_000:  # three codes no longer fit into one number
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * n + codes[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : len(codes) - 2 + k] |= twice
    return int(covered.sum())


def text_stats(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # splits at the six characters of WHITE and no others
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(codes),
        len(lines),
        len(seen),
        sum(map(text.count, "0123456789")),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document."""

    def run(batches):
        for batch in batches:
            rows = [(doc_id, *text_stats(text)) for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * len(_ARROW))], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) > most:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, most), method="nearest"))
    return distinct


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    rule, left = (), np.ones(len(bad), bool)
    while len(rule) < most and (left & ~bad).any():
        p0, n0 = (left & bad).sum(), (left & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            for cut in _cuts(values[left]):
                for above in (True, False):
                    condition = Condition(name, above, float(cut))
                    now = left & condition.holds(x)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = condition, g
        if best is None:
            break
        rule, left = (*rule, best), left & best.holds(x)
    return rule


def worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    now = covered(rule, x, len(bad))
    p, n = (now & bad).sum(), (now & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on; the longest of equals."""
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, x, bad), default=rule)


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = MIN_PRECISION, most_rules: int = 12) -> list[Rule]:
    """Rules for low quality, in order. Rows alternate between growing and pruning: two of three grow."""
    rules: list[Rule] = []
    grows = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    part = lambda rows: {k: v[rows] for k, v in x.items()}
    while len(rules) < most_rules:
        g, p = left & grows, left & ~grows
        if not bad[g].any() or not bad[p].any():
            break
        rule = prune(grow(part(g), bad[g]), part(p), bad[p])
        if not rule:
            break
        hit = covered(rule, x, len(bad))
        held = hit & p
        if not held.any() or bad[held].mean() < min_precision or bad[hit & left].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """The list learned from the labels (doc_id, quality 0 or 1); at most max_labels rows reach the driver."""
    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    # Two longs a row and max_labels rows at most: small enough to broadcast by its bound.
    rows = document_stats(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    # One row of each label, whatever the number of documents that have its id.
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "s.*")
    known = one.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *(F.expr(f).alias(n) for n, f in FEATURES.items()))
    found = known.toPandas().sort_values("doc_id")
    if not len(found):
        return []
    order = np.random.default_rng(7).permutation(len(found))
    x = {n: found[n].to_numpy(np.float64)[order] for n in FEATURES}
    return learn_list(x, found["quality"].to_numpy()[order] == 0)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def rule_number(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that holds, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        out = out.when(F.expr(" and ".join(c.sql() for c in rule)), F.lit(number))
    return out.otherwise(F.lit(None).cast("int"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, rule, kept."""
    judged = document_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
