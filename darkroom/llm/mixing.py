"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.session import salted_join, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts(docs: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` of every document, by a public tokenizer's vocabulary file, which the driver sends to the executors. Null texts have no tokens."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(SparkFiles.get(name))
        encoder.encode_special_tokens = True
        for batch in batches:
            for small in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                encoded = encoder.encode_batch_fast([t or "" for t in small.column(2).to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([small.column(0), small.column(1), pa.array([len(e.ids) for e in encoded], pa.int64())], names=["doc_id", "source", "tokens"])

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(count, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, source string, tokens bigint")


def mixing_rates(counts: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """How often each source is repeated: the targets with ``documents``, ``tokens``, ``wanted_share`` and ``rate``.

    A source without tokens cannot contribute; the shares of the others are scaled up to one (``wanted_share``). The rate is wanted_share × size ÷
    tokens, at most ``max_repeats``. With ``size`` null the size is the greatest at which no source is over its cap, so every
    share is reached; a greater size leaves the capped sources short, and the report says so.

    Defined cases: rows with a null source and sources without a target are not drawn; targets with a null or non-positive share have rate 0; a null
    max_repeats means no cap, unless all are null (then 1); an empty corpus has rate 0 everywhere.
    """
    have = counts.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    wanted = targets.select("source", F.col("target_share").cast("double").alias("target_share"), "max_repeats").dropDuplicates(["source"])
    joined = wanted.join(have, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    totals = joined.agg(F.sum(F.when(usable, F.col("target_share"))).alias("reachable"), F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("capped"), F.sum(F.when(usable, F.col("tokens"))).alias("all_tokens"))
    reach = totals.select("reachable", (F.lit(float(size)) if size is not None else F.coalesce(F.col("capped") * F.col("reachable"), F.col("all_tokens").cast("double"))).alias("size"))
    both = joined.crossJoin(F.broadcast(reach))  # one row
    share = F.when(usable, F.col("target_share") / F.col("reachable")).otherwise(0.0)
    rate = F.when(usable, F.least(share * F.col("size") / F.col("tokens"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))))).otherwise(0.0)
    return both.select("source", "target_share", "max_repeats", "documents", "tokens", share.alias("wanted_share"), rate.alias("rate"))


def draw(counts: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """The mixture: ``doc_id``, ``source``, ``tokens``, ``copy`` (1, 2, …).

    Each document comes floor(rate) times, and once more with probability rate − floor(rate), decided by a hash of seed and id: the
    same documents are drawn whatever the partitioning, also when a task is run again. The rates are a row a source and stored, so their size is measured before they
    are broadcast, and a source with a third of all rows is not gathered.
    """
    joined = salted_join(counts, rates.select("source", "rate"), ["source"])
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    times = (whole + (chance < F.col("rate") - whole).cast("bigint")).cast("int")
    return joined.withColumn("copies", times).filter("copies > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def mixture_records(docs: DataFrame, doc_id: str, drawn: DataFrame) -> DataFrame:
    """The drawn documents themselves, every column, one row a copy, with ``copy``. An id that stands in several rows brings each of them. Null ids are not drawn."""
    copies = drawn.groupBy("doc_id").agg(F.max("copy").alias("__copies"))
    joined = docs.join(copies, docs[doc_id] == copies["doc_id"]).select(*[docs[c] for c in docs.columns], "__copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def mix(docs: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, size: float | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). Tokens are counted once, over whole texts of all documents, and stored. The report has per target the rate and the drawn
    documents, copies, tokens and ``actual_share``."""
    counts = stored(token_counts(docs, doc_id, source, text, tokenizer))
    rates = stored(mixing_rates(counts, targets, size))
    drawn = draw(counts, rates, seed)
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("drawn_copies"), F.max("copy").alias("most_copies"), F.sum("tokens").alias("drawn_tokens"))
    total = got.agg(F.sum("drawn_tokens").alias("all_drawn"))
    report = rates.join(got, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return drawn, report.select(
        "source", "target_share", "wanted_share", "max_repeats", "documents", "tokens", "rate", zero("drawn_copies"), zero("most_copies"), zero("drawn_tokens"),
        F.coalesce(F.col("drawn_tokens") / F.col("all_drawn"), F.lit(0.0)).alias("actual_share"),
    )
