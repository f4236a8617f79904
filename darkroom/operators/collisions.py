"""Several files for one destination: who holds it, who is a copy, who is renamed to what."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import paths
from darkroom.operators.ranking import ranked
from darkroom.session import salted_join, stored

#: Up to so many files a group has counters of three or four digits only.
MOST = 9999
_NUMBERED = r"_\d{3,4}$"
_NUMBERS = r"(?:_\d{3,4})+$"
_LONG_NUMBERED = r"_[1-9]\d{4,}$"
_ANY_NUMBERS = r"(?:_(?:\d{3,4}|[1-9]\d{4,}))+$"


def first_holders(plan: DataFrame) -> DataFrame:
    """Per destination the first source (by path) with its hash; partial aggregation, no window."""
    return plan.groupBy("destination").agg(F.min(F.struct("source", "file_hash")).alias("holder"), F.count(F.lit(1)).alias("wanted"))


def conflicts(plan: DataFrame) -> DataFrame:
    """Every source after the first for the same destination, with that first source: ``source``, ``destination``, ``first_source``."""
    contested = first_holders(plan).filter("wanted > 1").select("destination", F.col("holder.source").alias("first_source"))
    return salted_join(plan.select("source", "destination"), contested, ["destination"]).filter(F.col("source") != F.col("first_source")).select("source", "destination", "first_source")


def collision_key(destination: Column) -> Column:
    """Folder, stem without a closing run of counters, and suffix: every name a file could take has the same key, up to ``MOST`` files."""
    folder = F.substring_index(destination, "/", -1)
    parent = F.substring(destination, F.lit(1), F.length(destination) - F.length(folder))
    return F.concat(parent, F.regexp_replace(paths.stem(destination), _NUMBERS, ""), F.lit("\x00"), paths.suffix(destination))


def keyed(plan: DataFrame, disk: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``plan`` and ``disk`` with ``key``, the same for all names that a file could take, and ``numbered``: the name ends in a counter. Groups of over
    ``MOST`` files reach counters of five digits, so names with longer numbers belong to them as well."""
    frames = [None if f is None else f.withColumns({"key": collision_key(F.col("destination")), "numbered": paths.stem(F.col("destination")).rlike(_NUMBERED)}) for f in (plan, disk)]
    keys = frames[0].select("key") if disk is None else frames[0].select("key").unionAll(frames[1].select("key"))
    wide = F.concat(F.regexp_replace(F.substring_index("key", "\x00", 1), _ANY_NUMBERS, ""), F.lit("\x00"), F.substring_index("key", "\x00", -1))
    crowded = keys.groupBy("key").count().filter(F.col("count") > MOST).select(wide.alias("wide")).distinct().collect()  # one in ten thousand files at most
    if crowded:
        listed = plan.sparkSession.createDataFrame(crowded, "wide string").withColumn("crowded", F.lit(True))
        long = F.coalesce("crowded", F.lit(False)) & paths.stem(F.col("destination")).rlike(_LONG_NUMBERED)
        widened = {"key": F.when(F.col("crowded"), F.col("wide")).otherwise(F.col("key")), "numbered": F.col("numbered") | long}
        frames = [None if f is None else salted_join(f.withColumn("wide", wide), listed, ["wide"], "left").withColumns(widened).drop("wide", "crowded") for f in frames]
    return frames[0], frames[1]


def _numbered(path: str, counter: int) -> str:
    head, slash, name = path.rpartition("/")
    dot = name.rfind(".")
    stem, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    return f"{head}{slash}{stem}_{counter:03d}{ext}"


def resolve_in_order(sources: list[str], destinations: list[str], hashes: list[str | None], on_disk: dict[str, str | None], policy: str = "check_hash") -> list[tuple[str | None, str]]:
    """The sequential rule over one group in source order: (final destination or null, outcome)."""
    reserved: dict[str, str | None] = {}
    out: list[tuple[str | None, str]] = []
    next_free: dict[str, int] = {}
    for _, wanted, content in zip(sources, destinations, hashes, strict=True):
        final, outcome = wanted, "copy"
        if wanted in on_disk or wanted in reserved:
            holder = on_disk[wanted] if wanted in on_disk else reserved[wanted]
            if policy == "skip":
                final, outcome = None, "collision skipped"
            elif policy == "check_hash" and content is not None and holder == content:
                final, outcome = None, "duplicate of existing file" if wanted in on_disk else "duplicate in batch"
            else:
                counter = next_free.get(wanted, 1)
                while (name := _numbered(wanted, counter)) in on_disk or name in reserved:
                    counter += 1
                next_free[wanted] = counter + 1
                final, outcome = name, "renamed"
        if final is not None:
            reserved[final] = content
        out.append((final, outcome))
    return out


def resolve_collisions(plan: DataFrame, existing: DataFrame | None = None, policy: str = "check_hash") -> DataFrame:
    """Final destination of every planned file: ``source``, ``destination``, ``final_destination`` (null: skipped), ``outcome``.

    ``plan`` has source, destination and file_hash; ``existing`` has destination and file_hash of what is on disk. A file whose destination is
    taken is a duplicate if its hash equals that of the file on disk, else of the first source that reserved it; otherwise it gets
    the lowest free counter. ``policy`` is check_hash, rename, skip or fail.

    Groups in which no name ends in a counter are resolved by aggregates and distributed row numbers, whatever their size. Only contested groups
    with such names need the rule in sequence, one group at a time. Counters have no end: after _9999 comes _10000, either way.

    Defined cases: the order is the source path; null hashes equal nothing; rows with a null source or destination are left out; repeated sources count as one;
    ``fail`` raises if anything collides; empty tables give an empty result.
    """
    if policy not in ("check_hash", "rename", "skip", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    rows = plan.select("source", "destination", "file_hash").filter("source is not null and destination is not null")
    rows = rows.groupBy("source", "destination").agg(F.min("file_hash").alias("file_hash"))
    disk = None if existing is None else existing.filter("destination is not null").groupBy("destination").agg(F.min("file_hash").alias("disk_hash"))
    planned, on_disk = keyed(rows, disk)
    groups = planned.groupBy("key").agg(F.count(F.lit(1)).alias("files"), F.max("numbered").alias("numbered"))
    if disk is not None:
        seen = on_disk.groupBy("key").agg(F.count(F.lit(1)).alias("disk_files"), F.max("numbered").alias("disk_numbered"))
        groups = groups.join(seen, "key", "left")
    else:
        groups = groups.withColumns({"disk_files": F.lit(0), "disk_numbered": F.lit(False)})
    groups = groups.select("key", ((F.col("files") > 1) | (F.coalesce("disk_files", F.lit(0)) > 0)).alias("contested"), (F.col("numbered") | F.coalesce("disk_numbered", F.lit(False))).alias("in_sequence"))
    sorted_out = stored(salted_join(planned.drop("numbered"), groups, ["key"]))  # read by three branches
    if policy == "fail":
        if rows.groupBy("destination").count().filter("count > 1").limit(1).count() or (disk is not None and rows.join(disk, "destination", "left_semi").limit(1).count()):
            raise ValueError("a destination exists or is reserved")
    free = sorted_out.filter(~F.col("contested")).select("source", "destination", F.col("destination").alias("final_destination"), F.lit("copy").alias("outcome"))

    plain = sorted_out.filter("contested and not in_sequence").select("source", "destination", "file_hash")
    holders = first_holders(plain).select("destination", F.col("holder.source").alias("first_source"), F.col("holder.file_hash").alias("first_hash"))
    held = salted_join(plain, holders, ["destination"])
    held = held.join(disk, "destination", "left") if disk is not None else held.withColumn("disk_hash", F.lit(None).cast("string"))
    exists = F.lit(False)
    if disk is not None:
        held = held.join(disk.select("destination").withColumn("on_disk", F.lit(True)), "destination", "left")
        exists = F.coalesce("on_disk", F.lit(False))
    is_first = ~exists & (F.col("source") == F.col("first_source"))
    same = F.coalesce(F.when(exists, F.col("file_hash") == F.col("disk_hash")).otherwise(F.col("file_hash") == F.col("first_hash")), F.lit(False))
    outcome = F.when(is_first, "copy").when(F.lit(policy == "skip"), "collision skipped")
    if policy == "check_hash":
        outcome = outcome.when(same, F.when(exists, "duplicate of existing file").otherwise("duplicate in batch"))
    judged = held.select("source", "destination", outcome.otherwise("renamed").alias("outcome"))
    renamed = ranked(judged.filter("outcome = 'renamed'"), ["destination"], ["source"])
    number = F.when(F.col("seq") > 999, F.col("seq").cast("string")).otherwise(F.lpad(F.col("seq").cast("string"), 3, "0"))
    name = F.concat(F.regexp_replace(F.col("destination"), r"(\.[^./]+)?$", ""), F.lit("_"), number, paths.suffix(F.col("destination")))
    settled = judged.filter("outcome <> 'renamed'").select("source", "destination", F.when(F.col("outcome") == "copy", F.col("destination")).alias("final_destination"), "outcome")
    settled = settled.unionByName(renamed.select("source", "destination", name.alias("final_destination"), "outcome"))

    hard = sorted_out.filter("contested and in_sequence").select("key", "source", "destination", "file_hash", F.lit(False).alias("disk"))
    if disk is not None:
        wanted = hard.select("key").distinct()
        hard = hard.unionByName(on_disk.join(wanted, "key", "left_semi").select("key", F.lit("").alias("source"), "destination", F.col("disk_hash").alias("file_hash"), F.lit(True).alias("disk")))

    def in_sequence(group: pd.DataFrame) -> pd.DataFrame:
        kept = {r.destination: r.file_hash for r in group[group.disk].itertuples()}
        todo = group[~group.disk].copy()
        todo = todo.iloc[todo["source"].map(lambda s: s.encode()).argsort(kind="stable")]
        done = resolve_in_order(todo["source"].tolist(), todo["destination"].tolist(), [h if isinstance(h, str) else None for h in todo["file_hash"]], kept, policy)
        return pd.DataFrame({"source": todo["source"].tolist(), "destination": todo["destination"].tolist(), "final_destination": [f for f, _ in done], "outcome": [o for _, o in done]})

    exact = hard.groupBy("key").applyInPandas(in_sequence, "source string, destination string, final_destination string, outcome string")
    return free.unionByName(settled).unionByName(exact)


def unique_names(names: DataFrame) -> DataFrame:
    """Names given to files, made unique without regard to letter case: ``source``, ``name``, ``unique_name``. The first file by source keeps its name, a later one gets the lowest
    counter whose name no file before it has, names that end in a counter themselves included.

    Defined cases: null sources and names are left out; a source with several names has the least; repeated rows count once; empty tables give an empty result.
    """
    one = names.filter("source is not null and name is not null").groupBy("source").agg(F.min("name").alias("name"))
    wanted = one.select("source", F.concat(F.lit("/"), F.lower("name")).alias("destination"), F.lit(None).cast("string").alias("file_hash"))
    settled = resolve_collisions(wanted, None, "rename").filter("outcome = 'renamed'").select("source", "final_destination")
    stem, suffix = paths.stem(F.col("name")), paths.suffix(F.col("name"))
    counted = F.regexp_extract(paths.stem(F.col("final_destination")), r"(_\d+)$", 1)
    return one.join(settled, "source", "left").select("source", "name", F.when(F.col("final_destination").isNull(), F.col("name")).otherwise(F.concat(stem, counted, suffix)).alias("unique_name"))


def name_counters(names: DataFrame) -> DataFrame:
    """Files that want the same name, letter case aside: ``source``, ``name``, ``counter`` (null for the first, then 1, 2, …) by source order."""
    low = names.filter("source is not null and name is not null").select("source", "name", F.lower("name").alias("key")).distinct()
    contested = low.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    several = ranked(salted_join(low, contested, ["key"], "left_semi"), ["key"], ["source", "name"])
    single = low.join(contested, "key", "left_anti").select("source", "name", F.lit(None).cast("bigint").alias("counter"))
    return single.unionByName(several.select("source", "name", F.when(F.col("seq") > 1, F.col("seq") - 1).cast("bigint").alias("counter")))


