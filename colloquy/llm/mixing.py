"""Mixing sources to target weights: capped water-filling over token sizes, with seeded whole and fractional repetitions."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import cores, cut, spread

#: The split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Hash buckets of one level; two levels place a record to 2^-32 of its source.
BUCKETS = 65536
_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, text: str, vocabulary: str) -> DataFrame:
    """`documents` with `n_tokens`: tokens of the whole text, 0 for NULL and empty texts."""

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    # as one that may change, so that no filter on the count is moved below and counts anew
    return documents.withColumn("n_tokens", F.pandas_udf(counts, T.LongType()).asNondeterministic()(text))


def water_fill(sizes: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source so that the shares come as near to their targets as the caps allow.

    `targets`: share and most repetitions. `total` defaults to the tokens there are. A source that can't fill its share
    gives all it may; what it lacks is spread over the others in proportion to their shares, until all fit. Sources
    without tokens, share or repetitions give 0; if all are clamped the total shrinks.
    """
    cap = {s: sizes.get(s, 0.0) * max(0, n) for s, (w, n) in targets.items()}
    left = float(sum(sizes.get(s, 0.0) for s in targets) if total is None else total)
    open_, out = {s for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}, dict.fromkeys(targets, 0.0)
    while open_ and left > 0:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / weight >= cap[s]}
        if not full:
            for s in open_:
                out[s] = left * targets[s][0] / weight
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return out


def normal_source(source: str = "source"):
    """Spellings of a source: case, outer blanks, and blanks or hyphens for underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(source))), r"[\s\-]+", "_")


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 7, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(records, shares). records: `key`, source, n_tokens, copies >= 1; shares: one row per target.

    Each record of a source is used floor(r) times, and once more if its seeded hash falls below the point where the
    running size reaches the rest of r, with r the repetitions that the source needs. Records without text, source or a
    target aren't used; repeated keys count once; an empty table gives no records and shares of 0. `total_tokens`
    (default: all tokens of the targeted sources) is the size aimed at.
    """
    t = [r for r in targets.select(normal_source().alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"]).collect()]
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in t}
    d = documents.select(F.col(key).alias("_key"), normal_source().alias("source"), F.col("text").alias("_text")).where("_key IS NOT NULL AND source IS NOT NULL").where(F.col("source").isin(list(goal)))
    if d.rdd.getNumPartitions() < cores(documents.sparkSession):  # few splits: else the text needs no shuffle
        d = spread(d)
    d = token_counts(d, "_text", vocabulary).select("_key", "source", "n_tokens").where("n_tokens > 0").dropDuplicates(["_key"])
    h = F.xxhash64(F.lit(seed), "_key")
    d = cut(d.select("*", F.pmod(F.shiftright(h, 16), F.lit(BUCKETS)).alias("_h1"), F.pmod(h, F.lit(BUCKETS)).alias("_h2")))
    sizes = {r["source"]: float(r["n"]) for r in d.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    take = water_fill(sizes, goal, total_tokens)
    plan = []
    for s, n in take.items():
        r = n / sizes[s] if sizes.get(s) else 0.0
        whole = int(r + 1e-9)
        plan.append((s, whole, max(0.0, n - whole * sizes.get(s, 0.0))))
    spark = documents.sparkSession
    p = F.broadcast(spark.createDataFrame(plan or [("", 0, 0.0)], "source string, _whole bigint, _rest double"))  # one row per target

    def place(rows: DataFrame, level: str, rest: str) -> DataFrame:
        """Per source the first bucket in which the running size passes `rest`, and what is left of it there."""
        sums = rows.groupBy("source", level).agg(F.sum("n_tokens").alias("_n"), F.first(rest).alias("_want"))
        run = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        cutp = sums.where(F.col("_before") + F.col("_n") > F.col("_want"))
        return cutp.groupBy("source").agg(F.min_by(F.struct(F.col(level).alias("at"), (F.col("_want") - F.col("_before")).alias("left")), level).alias("_c"))

    d = d.join(p, "source")
    one = place(d, "_h1", "_rest").select("source", F.col("_c.at").alias("_at1"), F.col("_c.left").alias("_left1"))
    d = d.join(F.broadcast(one), "source", "left")
    two = place(d.where("_h1 = _at1"), "_h2", "_left1").select("source", F.col("_c.at").alias("_at2"))
    d = d.join(F.broadcast(two), "source", "left")
    extra = (F.col("_rest") > 0) & (F.col("_at1").isNull() | (F.col("_h1") < F.col("_at1")) | ((F.col("_h1") == F.col("_at1")) & (F.col("_at2").isNull() | (F.col("_h2") < F.col("_at2")))))
    d = d.withColumn("copies", F.col("_whole") + F.when(extra, 1).otherwise(0))
    used = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    wanted = spark.createDataFrame([(s, w, n) for s, (w, n) in goal.items()] or [("", 0.0, 0)], "source string, target_share double, max_repeats bigint").where("source <> ''")
    total = Window.partitionBy(F.lit(1))
    shares = wanted.join(used, "source", "left").fillna(0, ["n_records", "available_tokens", "mixed_tokens"])
    shares = shares.withColumn("reached_share", F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(total)), F.lit(0.0)))
    return d.where("copies > 0").select(F.col("_key").alias(key), "source", "n_tokens", "copies"), shares
