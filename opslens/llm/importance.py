"""Importance resampling towards a target distribution, over hashed n-grams.

Each task feeds its Arrow batches to a DuckDB of its own: SQL splits texts into words, unnests them, makes n-grams with
window functions, and counts them by bucket, the unsigned CRC-32 (a registered function on zlib's) of their UTF-8 bytes;
distinct n-grams of a piece are hashed once. Texts go in pieces of PIECE_BYTES, so that a task holds a bounded number of
words beside its longest text. Bucket counts, one row a document and one sum a piece, are spilled to Parquet in the shared
folder by Spark's writer, so a lost executor's tasks are run again. Spark then merges the sums, turns them into gains, a
bounded array that is broadcast, and scores documents from their spilled counts: texts are read once.

Documents are drawn by score plus a Gumbel noise of their own, so that drawing is one sort: ranges of the score are dealt
out and sorted, and a document's rank is its place plus the sizes of the ranges before.

Defined results: null text has no words; a document without features has weight 0; a null doc_id is written as empty text
where noise is drawn, and comes last among equal scores; rows that repeat a doc_id are scored and drawn each for itself, and
have the same noise; extra columns are ignored; an empty table gives an empty result, an empty target has counts of 0."""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A word, of lowered text: ASCII letters and digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that one SQL statement takes, unless a single text is longer.
PIECE_BYTES = 2_000_000
SPILL = "doc_id long, total boolean, n_words long, n_features long, buckets array<int>, counts array<bigint>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("total", pa.bool_()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)


def count_sql(most_words: int, buckets: int) -> str:
    """Bucket counts of the texts in `piece` (i, text), by i; the row with a null i has the sums."""
    lengths = (
        "SELECT i, word AS feature FROM words"
        if n == 0
        else f"SELECT i, word || ' ' || {' || chr(32) || '.join(f'lead(word, {k}) OVER run' for k in range(1, n + 1))} FROM words WINDOW run AS (PARTITION BY i ORDER BY place)"
        for n in range(most_words)
    )
    return f"""
WITH split AS (SELECT i, regexp_extract_all(text, '{WORD}') AS found FROM piece),
words AS (SELECT i, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM split),
features AS ({" UNION ALL ".join(lengths)}),
seen AS (SELECT i, feature, count(*) AS n FROM features WHERE feature IS NOT NULL GROUP BY i, feature),
hashed AS (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM seen)),
counted AS (SELECT i, bucket, sum(n) AS n FROM seen JOIN hashed USING (feature) GROUP BY GROUPING SETS ((i, bucket), (bucket)))
SELECT c.i, max(len(found)) AS n_words, sum(n)::BIGINT AS n_features, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n::BIGINT ORDER BY bucket) AS counts
FROM counted c LEFT JOIN split USING (i) GROUP BY c.i"""


def _crcs(features: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(x.encode()) for x in features.to_pylist()], pa.int64())


def _database():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.create_function("crc", _crcs, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _pieces(texts: pa.Array):
    """Stretches (first, number) of the texts, each of PIECE_BYTES at most or one text."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > first and size + n > PIECE_BYTES:
            yield first, i - first
            first, size = i, 0
        size += n
    if len(texts):
        yield first, len(texts) - first


def bucket_counts(rows: DataFrame, most_words: int, buckets: int) -> DataFrame:
    """The spill: bucket counts of each row of (doc_id, text), and as rows with total their sums by piece."""
    sql = count_sql(most_words, buckets)

    def run(batches):
        con = _database()
        for batch in batches:
            texts, ids = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")), batch.column("doc_id")
            for first, n in _pieces(texts):
                piece = pa.table({"i": pa.array(range(n), pa.int64()), "text": texts.slice(first, n)})
                con.register("piece", piece)
                found = con.sql(sql).to_arrow_table()
                con.unregister("piece")
                place = pc.index_in(pa.array([*range(n), None], pa.int64()), value_set=found["i"].combine_chunks())
                out = found.take(place)
                total = pa.array([False] * n + [True])
                owner = pa.concat_arrays([ids.slice(first, n).cast(pa.int64()), pa.nulls(1, pa.int64())])
                numbers = [pc.fill_null(out[x].combine_chunks().cast(pa.int64()), 0) for x in ("n_words", "n_features")]
                lists = [pc.coalesce(out[x].combine_chunks().cast(t), pa.scalar([], t)) for x, t in (("buckets", _ARROW.field("buckets").type), ("counts", _ARROW.field("counts").type))]
                yield pa.RecordBatch.from_arrays([owner, total, *numbers, *lists], schema=_ARROW)

    return rows.select("doc_id", "text").mapInArrow(run, SPILL)


def bucket_sums(spill: DataFrame) -> DataFrame:
    """bucket, n over all documents of a spill."""
    return spill.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with `gain`, an array over all buckets, from the sums of both sides."""
    per = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    listed = per.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("at"), F.sum("s").alias("source"), F.sum("t").alias("target"))
    number = lambda x: x.cast("double")
    ratio = lambda a: (number(a["t"] + 1) * number(F.col("source") + buckets)) / (number(a["s"] + 1) * number(F.col("target") + buckets))
    return listed.select(F.transform("at", lambda a: F.floor(1000 * F.ln(ratio(a)))).alias("gain"))


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank among the drawn (null: not drawn). target: has a text column."""
    store = Scratch(docs.sparkSession, "importance")
    counted = bucket_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), most_words, buckets)
    spill = store.save(counted.withColumn("row", F.monotonically_increasing_id()), "spill")
    goal = store.save(bucket_counts(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), most_words, buckets), "goal")
    gain = store.save(gains(bucket_sums(spill), bucket_sums(goal), buckets), "gains")

    # gain has one row with as many numbers as there are buckets.
    gained = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.element_at("gain", b + 1) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(sum - pmod(sum, n_features)) div n_features"))
    scored = (
        spill.filter("not total").crossJoin(F.broadcast(gain))
        .select("doc_id", "row", "n_words", "n_features", gained.alias("sum"))
        .select("doc_id", "row", "n_features", (F.col("n_words") >= least_words).alias("eligible"), weight.cast("long").alias("weight"))
        .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    )
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    ranged = store.save(ranged.withColumn("place", F.monotonically_increasing_id()), "scored")
    store.drop("spill", "goal")
    # A row for each range that was dealt out, however many documents there are.
    part = F.shiftright("place", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("eligible").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.col("eligible") & (rank <= F.expr(f"all * {percent} div 100"))
    return ranged.withColumn("part", part).join(F.broadcast(sizes), "part").select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
