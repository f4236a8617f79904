"""Held-out passages inside a corpus, found through a positional inverted index of the corpus."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.session import stored

STRETCH = 5
SHARE = 0.5
#: Tokens after which a task closes a block of the index. It bounds a task's memory and the length of a stored list, and changes no result.
BLOCK_TOKENS = 1_000_000
#: Phrases looked up at a time in one block; more are split over several tasks. It changes no result either.
CHUNK_PHRASES = 200_000

_MARKUP = regex.compile(r"</?[A-Za-z][^<>]*>|\[/?[A-Za-z]+(?:=[^\[\]]*)?\]|&(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);")
_INVISIBLE = regex.compile(r"\p{Cf}")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Words without regard to letter case, punctuation, line breaks, quote marks and markup."""
    if "<" in text or "[" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return _PLAIN_WORD.findall(text.lower())
    return _WORD.findall(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold())


def inverted_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The stored index of a corpus: ``term``, ``block``, and ``docs`` and ``at``, the document and the position of each of its occurrences within one block of documents.

    Each task turns its documents around block by block, so a term comes once a block and only lists are shuffled. The table is partitioned by term and block: the
    commonest terms are spread by document ranges. It is written to the shared folder and may be looked up any number of times.
    """

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            codes: list[int] = []
            sizes: list[int] = []
            first = 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = words(t)
                sizes.append(len(found))
                codes += [known.setdefault(w, len(known)) for w in found]
                if len(codes) >= BLOCK_TOKENS or i == batch.num_rows - 1:
                    yield block(batch.column(0).slice(first, len(sizes)), known, codes, sizes)
                    known, codes, sizes, first = {}, [], [], i + 1

    def block(ids: pa.Array, known: dict[str, int], codes: list[int], sizes: list[int]) -> pa.RecordBatch:
        term, size = np.array(codes, np.int64), np.array(sizes, np.int64)
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(known)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), values) for values in (ids.take(pa.array(doc[order])), pa.array(at[order].astype(np.int32)))]
        name = zlib.crc32(repr((ids[0].as_py(), ids[-1].as_py())).encode())  # two blocks of one name are looked up as one
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([name] * len(known), pa.int64()), *lists], names=["term", "block", "docs", "at"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    blocks = kept.mapInArrow(invert, f"term string, block bigint, docs array<{kept.schema['doc_id'].dataType.simpleString()}>, at array<int>")
    return stored(blocks.repartition("term", "block"))


def phrase_plans(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Each phrase (``phrase``, its words between single blanks) with ``plan``, its words as (occurrences in the corpus, offset, term), the rarest first. A phrase with a
    word that the corpus lacks has none."""
    terms = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    frequency = index.select("term", F.size("at").alias("n")).groupBy("term").agg(F.sum("n").alias("n"))
    plans = terms.join(frequency, "term").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("plan"))
    return plans.filter(F.size("plan") == F.size(F.split("phrase", " ")))


def find_phrases(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Where phrases stand: ``phrase``, ``doc_id``, ``at`` (the place of its first word), distinct.

    Every phrase is sent to the lists of its rarest term, one a block, and so to the blocks in which that term occurs; the lists of the other terms in question come to the same
    blocks. There the rarest term's list, moved back by the term's offset, is intersected with those of the next rarest terms, each moved likewise, one after the other
    down to the commonest. With ``slop`` each word may stand up to so many places before or after its own: proximity instead of exact matches.

    Lists of terms that stand in no phrase are not moved. A task holds one block's lists and at most about ``CHUNK_PHRASES`` phrases.

    ``phrases`` has a column ``phrase``; null and empty phrases give no row; repeated ones one row a place.
    """
    plans = stored(phrase_plans(index, phrases.select("phrase").filter("phrase <> ''").distinct()))
    chunks = plans.count() // CHUNK_PHRASES + 1
    plans = plans.select("phrase", "plan", F.pmod(F.xxhash64("phrase"), F.lit(chunks)).cast("int").alias("chunk"))
    anchored = plans.groupBy(F.col("plan")[0]["term"].alias("term"), "chunk").agg(
        F.collect_list(F.struct("phrase", F.col("plan.offset").alias("order"))).alias("anchored")
    )
    asked = plans.select(F.explode("plan.term").alias("term"), "chunk").distinct().join(anchored, ["term", "chunk"], "left")
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = index.join(asked, "term").repartition(tasks, "block", "chunk")

    def search(group: pa.Table) -> pa.Table:
        lists, ats = group["docs"].combine_chunks(), group["at"].combine_chunks()
        encoded = lists.flatten().dictionary_encode()
        doc = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = ats.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        reach = np.zeros(len(encoded.dictionary), np.int64)
        np.maximum.at(reach, doc, at)
        asked_here = group["anchored"].combine_chunks().flatten()
        phrases, orders = [p.split(" ") for p in asked_here.field("phrase").to_pylist()], asked_here.field("order").to_pylist()
        room = 2 * slop + 1 + max(map(len, phrases), default=0)
        begin = np.cumsum(reach + room) - (reach + room) + room  # documents one after the other, so far apart that no phrase reaches into the next
        names = group["term"].to_pylist()
        code: dict[str, int] = {}
        row = np.array([code.setdefault(t, len(code)) for t in names], np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        keys = np.sort((np.repeat(row, sizes) << 40) | (begin[doc] + at))
        present = [all(t in code for t in p) for p in phrases]
        phrases, offsets = [p for p, ok in zip(phrases, present, strict=True) if ok], [o for o, ok in zip(orders, present, strict=True) if ok]
        terms = [[code[p[k]] for k in o] for p, o in zip(phrases, offsets, strict=True)]
        ranks = max(map(len, terms), default=0)
        size = np.array([len(t) for t in terms], np.int64)
        term = np.array([t + [-1] * (ranks - len(t)) for t in terms], np.int64).reshape(len(terms), ranks)
        offset = np.array([o + [0] * (ranks - len(o)) for o in offsets], np.int64).reshape(len(terms), ranks)
        w, place = np.empty(0, np.int64), np.empty(0, np.int64)
        if ranks:
            low, high = np.searchsorted(keys, term[:, 0] << 40), np.searchsorted(keys, (term[:, 0] + 1) << 40)
            n = high - low
            w = np.repeat(np.arange(len(n)), n)
            place = (keys[np.repeat(low, n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)] & ((1 << 40) - 1)) - offset[w, 0]
        for rank in range(1, ranks):
            wanted = (term[w, rank] << 40) | (place + offset[w, rank])
            found = np.minimum(np.searchsorted(keys, wanted - slop), len(keys) - 1)
            kept = (size[w] <= rank) | ((keys[found] >= wanted - slop) & (keys[found] <= wanted + slop))
            w, place = w[kept], place[kept]
        at_doc = np.searchsorted(begin, place + slop, side="right") - 1
        return pa.table(
            {"phrase": pa.array([" ".join(p) for p in phrases], pa.string()).take(pa.array(w)), "doc_id": encoded.dictionary.take(pa.array(at_doc)), "at": pa.array((place - begin[at_doc]).astype(np.int32))}
        )

    doc_type = index.schema["docs"].dataType.elementType.simpleString()
    found = together.groupBy("block", "chunk").applyInArrow(search, f"phrase string, doc_id {doc_type}, at int")
    return found.distinct()


def stretches_of(hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Windows found (passage start, document start) joined to stretches (passage start, document start, length)."""
    out: list[tuple[int, int, int]] = []
    first = last = (-9, -9)
    for s, p in [*sorted(set(hits), key=lambda h: (h[1] - h[0], h[0])), (-9, -9)]:
        if (s, p) != (last[0] + 1, last[1] + 1):
            if first[0] >= 0:
                out.append((first[0], first[1], last[0] - first[0] + STRETCH))
            first = (s, p)
        last = (s, p)
    return out


def longest_in_order(stretches: list[tuple[int, int, int]]) -> int:
    """Most passage words covered by stretches (passage start, document start, length) that follow each other in both; where two overlap, either or both may be cut,
    if five words are left of each.

    One sweep over the document's places. ``best[e]`` is the most covered so far by words before the passage's e-th; a stretch may begin its counted part at any of its
    words and end it five or more words later. Costs a step per word of the stretches, however many there are.
    """
    if not stretches:
        return 0
    best = [0] * (max(s + n for s, _, n in stretches) + 1)
    begun: list[list[int]] = [[] for _ in stretches]  # most covered before a counted part that begins at each word, less the words before it
    gain = [-len(best)] * len(stretches)
    events = [(p + k, part, i, k) for i, (_, p, n) in enumerate(stretches) for part, span in ((0, range(STRETCH, n + 1)), (1, range(n - STRETCH + 1))) for k in span]
    for _, part, i, k in sorted(events):
        s = stretches[i][0]
        if part:
            begun[i].append(best[s + k] - k)
            continue
        gain[i] = max(gain[i], begun[i][k - STRETCH])
        covered, e = gain[i] + k, s + k
        while e < len(best) and best[e] < covered:
            best[e] = covered
            e += 1
    return best[-1]


def find_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, share: float = SHARE) -> DataFrame:
    """Documents that carry a passage, wholly or partly: ``doc_id``, ``item_id``, ``covered`` (passage words), ``words`` (of the passage).

    The corpus is inverted once (``inverted_index``). Every five-word window of a passage is looked up as an exact phrase, from its rarest term on (``find_phrases``);
    neighbouring windows join to stretches, and a document carries a passage if stretches in the passage's order cover at least ``share`` of its words.
    The corpus is read once whatever the test set, and nothing of either is gathered: windows, lists and hits are tables.

    Defined cases: null texts, passages and ids give no row; a passage shorter than five words is never found; repeated document rows give one row, and rows of one id
    with different texts are one document; an item with several passages has the best of them; quoted parts count; whole texts are searched; empty
    tables give no row; other columns are ignored.
    """
    index = inverted_index(docs, doc_id, text)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = words(t)
                for s in range(len(w) - STRETCH + 1):
                    for column, value in zip(rows, (i, s, len(w), " ".join(w[s : s + STRETCH])), strict=True):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string())], names=["item_id", "passage", "s", "words", "phrase"])

    asked = items.select(F.col(item_id).alias("item_id"), F.col(passage).cast("string").alias("passage")).filter(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct()
    item_type = asked.schema["item_id"].dataType.simpleString()
    windows = stored(asked.mapInArrow(cut, f"item_id {item_type}, passage string, s int, words int, phrase string").withColumn("passage", F.xxhash64("passage")))
    hits = find_phrases(index, windows).join(windows, "phrase")
    grouped = hits.groupBy("doc_id", "item_id", "passage", "words").agg(F.collect_list(F.struct("s", "at")).alias("hits"))  # as many as one document and one passage have in common

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list] = ([], [])
            for i, (size, found) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                stretches = stretches_of([(h["s"], h["at"]) for h in found])
                if len({w for s, _, n in stretches for w in range(s, s + n)}) < share * size:  # no chain covers more than all stretches together
                    continue
                covered = longest_in_order(stretches) if len(stretches) > 1 else stretches[0][2]
                if covered >= share * size:
                    rows[0].append(i), rows[1].append(covered)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.int32()), batch.column(2).take(at)], names=["doc_id", "item_id", "covered", "words"])

    doc_type = grouped.schema["doc_id"].dataType.simpleString()
    measured = grouped.select("doc_id", "item_id", "words", "hits").mapInArrow(measure, f"doc_id {doc_type}, item_id {item_type}, covered int, words int")
    return measured.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("words").alias("words"))


def leaked_items(found: DataFrame) -> DataFrame:
    """Per test item that leaked: documents carrying it and the most words found in one."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("covered").alias("covered"), F.max("words").alias("words"))
