"""Occurrence and record counts of every term or n-gram by a distributed suffix array with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.session import stored


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays; 0 if one is null."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(a.isNull() | b.isNull(), 0).when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def suffixes(df: DataFrame, record: str, tokens: str) -> DataFrame:
    """Every distinct suffix of the token lists, whole: ``suffix``, ``shared``, ``occurrences``, ``records``.

    Null tokens and empty tokens are removed first. Within a record suffixes are put in order and each is compared with the one before it: ``shared`` is the length of
    their common prefix, so up to that depth it is a within-record duplicate of its neighbour. Equal suffixes with equal ``shared`` are one row: ``occurrences`` counts them all,
    ``records`` once a record. Rows are added up before they are moved, so neither a term nor a record that makes up a third of all rows is a large group anywhere but in
    its distinct suffixes.
    """
    kept = F.filter(F.col(tokens), lambda t: t.isNotNull() & (t != ""))
    listed = df.select(F.col(record).alias("record"), kept.alias("tokens"))
    every = listed.select("record", "tokens", F.posexplode("tokens").alias("at", "token")).select("record", F.slice("tokens", F.col("at") + 1, F.size("tokens")).alias("suffix"))
    once = every.groupBy("record", "suffix").agg(F.count(F.lit(1)).alias("times"))
    in_record = Window.partitionBy("record").orderBy("suffix")
    known = once.filter(F.col("record").isNotNull()).withColumn("shared", common_prefix(F.col("suffix"), F.lag("suffix").over(in_record)))
    both = known.select("suffix", "shared", "times", F.lit(1).alias("one")).unionByName(once.filter(F.col("record").isNull()).select("suffix", F.lit(0).alias("shared"), "times", F.lit(0).alias("one")))
    return both.groupBy("suffix", "shared").agg(F.sum("times").alias("occurrences"), F.sum("one").alias("records"))


def ngram_counts(df: DataFrame, record: str, tokens: str, max_n: int | None = 1) -> DataFrame:
    """Occurrences and records of every n-gram of length 1 … ``max_n`` (null: of every length) over token lists.

    Method: the distinct suffixes of all lists, whole, with their multiplicities (``suffixes``) are range-partitioned and sorted — a suffix array laid over the partitions. One pass over
    it takes the length of the common prefix with the suffix before; the suffixes between two places where that length falls below n form the interval of one n-gram. The
    interval's occurrences are its number of occurrences; its records are those less the within-record duplicates, the suffixes that share n tokens or more with their neighbour in
    the same record. Intervals that cross a partition border are added up at the end.

    Result: ``ngram`` (array of its tokens), ``n``, ``occurrences``, ``records``.

    Defined cases: null lists, null and empty tokens do not count; tokens are compared character by character; rows of the same record
    are one record, however many rows it has; rows with a null record count as occurrences but as no record; an empty table gives an
    empty result; other columns are ignored.
    """
    array = stored(suffixes(df, record, tokens)).repartitionByRange("suffix", "shared").sortWithinPartitions("suffix", "shared")

    def intervals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now: list[list[int]] = []  # occurrences and records of the interval of each depth
        last: list[str] = []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def close(depth: int) -> None:
            while len(open_now) > depth:
                occurrences, records = open_now.pop()
                for column, value in zip(out, (last[: len(open_now) + 1], len(open_now) + 1, occurrences, records), strict=True):
                    column.append(value)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, _PARTIAL.types, strict=True)], schema=_PARTIAL)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for suffix, shared, occurrences, records in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                depth = len(suffix) if max_n is None else min(len(suffix), max_n)
                prefix = next((i for i, (x, y) in enumerate(zip(last, suffix, strict=False)) if x != y), min(len(last), len(suffix)))
                close(prefix)
                open_now += [[0, 0] for _ in range(depth - len(open_now))]
                for n in range(depth):
                    open_now[n][0] += occurrences
                    open_now[n][1] += records if shared <= n else 0
                last = suffix
            yield flush()
        close(0)
        yield flush()

    partial = array.select("suffix", "shared", "occurrences", "records").mapInArrow(intervals, "ngram array<string>, n int, occurrences bigint, records bigint")
    return partial.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


_PARTIAL = pa.schema([("ngram", pa.list_(pa.string())), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])


def mark_by_records(counts: DataFrame, total: Column, rare_below: int, common_above: float) -> Column:
    """``rare`` in fewer than ``rare_below`` records, else ``common`` in more than the share ``common_above`` of all records, else null."""
    return F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total * F.lit(common_above), "common")


def term_marks(df: DataFrame, record: str, tokens: str, rare_below: int, common_above: float) -> DataFrame:
    """Every term with occurrences, records and its mark. The total counts distinct records, those without terms included."""
    counts = ngram_counts(df, record, tokens, 1).select(F.element_at("ngram", 1).alias("term"), "occurrences", "records")
    total = df.agg(F.countDistinct(record).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark_by_records(counts, F.col("total"), rare_below, common_above)).drop("total")
