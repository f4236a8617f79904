"""Choosing one interpretation per record by Viterbi over each source's record order, in parallel and exactly.

A source may hold any share of all rows, so its sequence is never gathered. The rows are range-partitioned by (source, order) and
checkpointed; each partition reduces the piece of a source that crosses its border to a small matrix of best costs (first
candidate × last candidate), the driver joins these matrices (their number is that of the partitions, whatever the data) and a
second pass solves every piece between the fixed ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions.instants import instants_of_wall_clock, staged, with_readings, zone_or_null
from darkroom.session import broadcast_if_small, materialise, stored

FORMAT_SWITCH = 1.0
BACKWARD_JUMP = 0.5
CANDIDATES = "array<struct<prior:double,fmt:string,instant_us:bigint>>"

Candidate = tuple[float, str, int]


def _step(a: Candidate, b: Candidate) -> float:
    return (FORMAT_SWITCH if a[1] != b[1] else 0.0) + (BACKWARD_JUMP if b[2] < a[2] else 0.0)


def _forward(costs: list[float], before: list[Candidate], now: list[Candidate]) -> tuple[list[float], list[int]]:
    """One step: the best cost of each candidate and the candidate before it (the first of equals)."""
    out, back = [], []
    for b in now:
        options = [c + _step(a, b) for c, a in zip(costs, before, strict=True)]
        best = min(options)
        out.append(best + b[0])
        back.append(options.index(best))
    return out, back


def best_path(rows: list[list[Candidate]], first: int | None = None, last: int | None = None) -> list[int]:
    """The cheapest path through rows of candidates; its ends can be fixed. Ties go to the earlier candidate."""
    if not rows:
        return []
    inf = float("inf")
    costs = [c[0] if first is None or i == first else inf for i, c in enumerate(rows[0])]
    backs: list[list[int]] = []
    for before, now in zip(rows, rows[1:], strict=False):
        costs, back = _forward(costs, before, now)
        backs.append(back)
    at = last if last is not None else costs.index(min(costs))
    path = [at]
    for back in reversed(backs):
        path.append(back[path[-1]])
    return path[::-1]


class _Sequence:
    """Rows in order, as arrays; the candidates of a row are made into Python values only where they are looked at."""

    def __init__(self, rows: pa.Table):
        lists = rows["__viterbi_candidates"].combine_chunks()
        self.offsets = lists.offsets.to_numpy()
        flat = lists.values
        self.prior, self.instant = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("prior", "instant_us"))
        self.formats, self.flat = flat.field("fmt"), flat
        self.sources = rows["__viterbi_source"].combine_chunks()
        codes = self.sources.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.single = np.diff(self.offsets) == 1
        self.begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
        self.ends = np.append(self.begins[1:], len(codes)) if len(codes) else np.empty(0, np.int64)

    def row(self, i: int) -> list[Candidate]:
        return [(float(self.prior[k]), self.formats[k].as_py(), int(self.instant[k])) for k in range(self.offsets[i], self.offsets[i + 1])]


def _border_matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each source's piece in this partition that touches its begin or end: the first row, the last row and the matrix. Beyond a row with a single candidate costs no longer
    depend on the first row, so only what stands before the first and after the last such row is walked; what lies between adds the same to every entry."""
    pieces: list[dict] = []
    part = None

    def walk(piece: dict, rows: _Sequence, begin: int, end: int) -> None:
        for i in range(begin, end):
            row = rows.row(i)
            piece["m"] = [_forward(costs, piece["tail"], row)[0] for costs in piece["m"]]
            piece["tail"] = row

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("__viterbi_part")[0].as_py()
        rows = _Sequence(pa.Table.from_batches([batch]))
        for begin, end in zip(rows.begins.tolist(), rows.ends.tolist(), strict=True):
            source = rows.sources[begin].as_py()
            at = begin
            if not pieces or pieces[-1]["source"] != source:
                head = rows.row(begin)
                pieces = [*pieces[:1], {"source": source, "head": head, "tail": head, "into": None, "m": [[c[0] if i == j else float("inf") for j in range(len(head))] for i, c in enumerate(head)]}]
                at += 1
            now = pieces[-1]
            alone = at + np.flatnonzero(rows.single[at:end])
            if len(alone):
                if now["into"] is None:
                    walk(now, rows, at, int(alone[0]) + 1)
                    now["into"] = [costs[0] for costs in now["m"]]
                now["tail"], now["m"] = rows.row(int(alone[-1])), [[0.0]]
                at = int(alone[-1]) + 1
            walk(now, rows, at, end)
    for place, p in enumerate(pieces):
        matrix = p["m"] if p["into"] is None else [[a + b for b in p["m"][0]] for a in p["into"]]
        ends = [[[{"prior": a, "fmt": b, "instant_us": c} for a, b, c in p[k]]] for k in ("head", "tail")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([p["source"]], pa.string()), *[pa.array(e, pa.list_(_CANDIDATE)) for e in ends], pa.array([[x for r in matrix for x in r]], pa.list_(pa.float64()))],
            names=["part", "place", "source", "head", "tail", "matrix"],
        )


_CANDIDATE = pa.struct([("prior", pa.float64()), ("fmt", pa.string()), ("instant_us", pa.int64())])


def _join_borders(pieces: list) -> dict[tuple[int, str], tuple[int, int]]:
    """Fixes the end states of every piece that belongs to a source with pieces in several partitions."""
    fixed: dict[tuple[int, str], tuple[int, int]] = {}
    chains: dict[str, list] = {}
    for p in sorted(pieces, key=lambda p: (p["part"], p["place"])):
        chains.setdefault(p["source"], []).append(p)
    for source, chain in chains.items():
        if len(chain) < 2:
            continue
        tuples = lambda cs: [(c["prior"], c["fmt"], c["instant_us"]) for c in cs]
        entry: list[list[int]] = []
        leave: list[list[int]] = []
        costs: list[float] = []
        before: list[Candidate] = []
        for n, p in enumerate(chain):
            head, tail = tuples(p["head"]), tuples(p["tail"])
            width = len(tail)
            into = [0.0] * len(head)
            if n:
                arrive = [[c + _step(a, b) for c, a in zip(costs, before, strict=True)] for b in head]
                into = [min(options) for options in arrive]
                leave.append([options.index(min(options)) for options in arrive])
            total = [[into[i] + p["matrix"][i * width + j] for i in range(len(head))] for j in range(width)]
            costs = [min(options) for options in total]
            entry.append([options.index(min(options)) for options in total])
            before = tail
        at = costs.index(min(costs))
        for n in range(len(chain) - 1, -1, -1):
            first = entry[n][at]
            fixed[(chain[n]["part"], source)] = (first, at)
            if n:
                at = leave[n - 1][first]
    return fixed


def choose_by_viterbi(df: DataFrame, source: list[str], order: list[str], candidates: str, into: str = "chosen", keep_unread: bool = True) -> DataFrame:
    """Adds the candidate on the cheapest path of each source, as ``struct<prior, fmt, instant_us>``. Rows with a single candidate cut a sequence into stretches that are
    settled apart; a task holds the rows of one stretch, at most those of its partition.

    ``candidates`` is ``array<struct<prior double, fmt string, instant_us bigint>>``. The cost of a path is the sum of the priors, of
    ``FORMAT_SWITCH`` for every change of ``fmt`` between neighbours and of ``BACKWARD_JUMP`` for every instant before its predecessor's.

    Defined cases: rows with no candidate (null or empty array) take no part in the sequence and get null (they are left
    out if ``keep_unread`` is false); a null source is a source of
    its own; equal order values are taken in the order of all order columns, then of the candidates; ties between paths go to the
    earlier candidate; an empty table gives an empty table. Other columns pass through; one named like
    ``into`` is replaced.
    """
    df = df.drop(into) if into in df.columns and into not in (candidates, *source, *order) else df
    some = F.size(F.coalesce(F.col(candidates), F.array().cast(CANDIDATES))) > 0
    kind = "struct<prior:double,fmt:string,instant_us:bigint>"
    keyed = df.filter(some).select("*", F.to_json(F.struct(*source), {"ignoreNullFields": "false"}).alias("__viterbi_source"), F.col(candidates).cast(CANDIDATES).alias("__viterbi_candidates"))
    keyed = stored(keyed)  # the range partitioning reads it twice
    ranged = keyed.repartitionByRange("__viterbi_source", *order, F.to_json("__viterbi_candidates")).sortWithinPartitions("__viterbi_source", *order, F.to_json("__viterbi_candidates"))
    fixed_rows = materialise(ranged.withColumn("__viterbi_part", F.spark_partition_id()))
    borders = fixed_rows.select("__viterbi_part", "__viterbi_source", "__viterbi_candidates").mapInArrow(
        _border_matrices, f"part int, place int, source string, head {CANDIDATES}, tail {CANDIDATES}, matrix array<double>"
    )
    fixed = _join_borders(borders.collect())  # at most two rows a partition
    names = df.columns

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows since the last row with a single candidate, which is the first of them
        begun: set[str] = set()

        def settle(rows: _Sequence, upto: int, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            part = held["__viterbi_part"][0].as_py()
            index = rows.offsets[:upto].astype(np.int64)
            for begin, end in zip(rows.begins.tolist(), rows.ends.tolist(), strict=True):
                source = rows.sources[begin].as_py()
                first, last = fixed.get((part, source), (None, None))
                edges = np.append(np.append(begin - 1, begin + np.flatnonzero(rows.single[begin:end])), end)
                for before, after in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if before + 1 == after or before + 1 >= upto:
                        continue
                    a, b = max(before, begin), min(after + 1, end)  # with the single-candidate rows on either side
                    path = best_path(
                        [rows.row(i) for i in range(a, b)],
                        first if a == begin and source not in begun else None,
                        last if after == end and (end < len(rows.single) or ended) else None,
                    )
                    for i, k in zip(range(a, min(b, upto)), path, strict=False):
                        index[i] = rows.offsets[i] + k
                if begin < upto:
                    begun.add(source)
            ready, held = held.slice(0, upto), held.slice(upto)
            yield from ready.select(names).append_column(into, rows.flat.take(pa.array(index)).cast(_CANDIDATE)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = (new if held is None else pa.concat_tables([held, new])).combine_chunks()
            rows = _Sequence(held)
            cut = np.flatnonzero(rows.single[1:])  # what stands before the last single-candidate row is settled
            if len(cut):
                yield from settle(rows, int(cut[-1]) + 1, False)
        if held is not None and held.num_rows:
            yield from settle(_Sequence(held.combine_chunks()), held.num_rows, True)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed_rows.schema if f.name in names), f"`{into}` {kind}"])
    solved = fixed_rows.mapInArrow(solve, schema)
    if not keep_unread:
        return solved
    return solved.unionByName(df.filter(~some).withColumn(into, F.lit(None).cast(kind)))


DATE_FIELDS = ("detected_date", "video_metadata_date", "filename_date")


def reading_candidates(readings: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per reading and date field with every valid interpretation of its text.

    ``readings`` has reading_id, device_id, read_at, date_source and the three date texts; ``devices`` has device_id, zone_name, date_order and
    video_clock. Result: reading_id, device_id, read_at, field_name, value, ``candidates`` and ``determinate`` (the value denotes exactly one
    instant by the device's settings). A value that states its zone or offset, or counts from 1970, needs no device, nor does the time of a file system, which is UTC. A slash
    date without a known order keeps both orders as candidates but is never determinate. A wall-clock reading in an overlap has two
    candidates, in a gap none. Rows repeated exactly give one row. Null and empty texts give no candidate.
    """
    c = F.col
    settings = devices.select(
        devices["device_id"].alias("__device"),
        zone_or_null(devices["zone_name"]).alias("__zone_name"),
        F.lower(F.trim(devices["date_order"])).alias("__order"),
        F.lower(F.trim(devices["video_clock"])).alias("__video_clock"),
    ).dropDuplicates(["__device"])
    rows = readings.select("reading_id", "device_id", "read_at", F.regexp_replace(F.lower(c("date_source")), "[^a-z]", "").alias("__means"), *DATE_FIELDS).distinct()
    joined = rows.join(broadcast_if_small(settings), rows["device_id"] == c("__device"), "left")
    video = F.when(c("__video_clock") == "utc", F.lit("UTC")).when(c("__video_clock") == "local", c("__zone_name"))
    detected = (
        F.when(c("__means") == "filesystemmodified", F.lit("UTC"))
        .when(c("__means") == "videometadata", video)
        .otherwise(c("__zone_name"))
    )
    zones = {"detected_date": detected, "video_metadata_date": video, "filename_date": c("__zone_name")}
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), c(f).alias("value"), z.alias("zone")) for f, z in zones.items()])
    long = joined.select("reading_id", "device_id", "read_at", "__order", F.explode(fields).alias("f")).select(
        "reading_id", "device_id", "read_at", "__order", "f.field_name", "f.value", c("f.zone").alias("__zone")
    ).filter(c("value").isNotNull())
    read = with_readings(long, "value", "__readings")
    is_slash = lambda r: r["fmt"].isin("dmy", "mdy")
    agreed = F.filter("__readings", lambda r: ~is_slash(r) | c("__order").isNull() | (r["fmt"] == c("__order")))
    read = staged(read, {"__agreed": agreed})

    def of(i: int) -> Column:
        r = F.get("__agreed", F.lit(i))
        instants = F.when(r["epoch_us"].isNotNull(), F.array(r["epoch_us"])).otherwise(instants_of_wall_clock(r["wall_us"], F.coalesce(r["zone"], c("__zone"))))
        named = F.transform(instants, lambda u: F.struct(F.lit(0.0).alias("prior"), r["fmt"].alias("fmt"), u.alias("instant_us")))
        return F.coalesce(F.when(r.isNotNull(), named), F.array()).cast(CANDIDATES)

    unordered = F.exists("__readings", is_slash) & c("__order").isNull()
    read = staged(read, {"candidates": F.concat(of(0), of(1))})
    return read.select("reading_id", "device_id", "read_at", "field_name", "value", "candidates", ((F.size("candidates") == 1) & ~unordered).alias("determinate"))


def resolve_readings(readings: DataFrame, devices: DataFrame, keep_unread: bool = True) -> DataFrame:
    """Every date value of the readings as one instant: the interpretations of ``reading_candidates``, chosen by Viterbi over the reading
    order of each (device, field). Adds ``chosen`` (null where a value has no interpretation)."""
    return choose_by_viterbi(reading_candidates(readings, devices), ["device_id", "field_name"], ["read_at", "reading_id"], "candidates", keep_unread=keep_unread)
