"""Configuration: nested frozen sections with defaults, read from YAML; values become literals in expressions."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from darkroom.functions.dates import DEFAULT_PRIORITY, FOLDER_STRUCTURES


class ConfigError(Exception):
    """A configuration file is missing, unreadable or not valid YAML."""


# Sections, keys and defaults of a configuration file.
@dataclass(frozen=True)
class General:
    recursive: bool = True
    include_videos: bool = True
    ignore_hidden_files: bool = True
    dry_run_default: bool = True
    output_folder: str = ".darkroom"
    timezone: str = "local"


@dataclass(frozen=True)
class Paths:
    source: str | None = None
    destination: str | None = None
    temp_folder: str | None = None


@dataclass(frozen=True)
class Scan:
    # Extensions of the three kinds of media.
    image_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".heic", ".heif", ".webp", ".bmp", ".gif")
    video_extensions: tuple[str, ...] = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".3gp", ".wmv", ".webm")
    raw_extensions: tuple[str, ...] = (".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2")
    skip_exif_errors: bool = True
    limit: int | None = None


@dataclass(frozen=True)
class VideoMetadata:
    enabled: bool = True
    provider: str = "ffprobe"
    ffprobe_path: str = "ffprobe"
    fallback_to_hachoir: bool = True
    skip_errors: bool = True


@dataclass(frozen=True)
class Sorting:
    folder_structure: str = "YYYY/MM"
    fallback_date_priority: tuple[str, ...] = tuple(DEFAULT_PRIORITY)
    include_day: bool = False


@dataclass(frozen=True)
class Heuristic:
    enabled: bool = False
    max_days_from_cluster: int = 2
    min_cluster_size: int = 3


@dataclass(frozen=True)
class FolderTags:
    enabled: bool = False
    tag_format: str = "{tag}"
    min_length: int = 3
    max_length: int = 40
    # Folder names that are no tags by default.
    ignore_list: tuple[str, ...] = (
        "tosort", "unsorted", "misc", "backup", "temp", "tmp", "download", "downloads", "dcim", "camera", "pictures", "photos", "images", "100apple", "100andro", "camera roll",
    )
    force_list: tuple[str, ...] = ()
    auto_detect: bool = True
    distance_check: bool = True
    distance_threshold: float = 0.75


@dataclass(frozen=True)
class Renaming:
    enabled: bool = False
    pattern: str = "{date}_{time}"
    date_format: str = "%Y%m%d"
    time_format: str = "%H%M%S"
    tag_part_format: str = "_{tag}"
    lowercase_extensions: bool = True
    keep_original_if_conflict: bool = True


@dataclass(frozen=True)
class Duplicates:
    enabled: bool = True
    policy: str = "safe"
    hashing_algorithm: str = "sha256"
    on_collision: str = "check_hash"
    cache_hashes: bool = True


@dataclass(frozen=True)
class FilenameDate:
    enabled: bool = True
    patterns: tuple[str, ...] = ("YYYYMMDD_HHMMSS", "YYYYMMDD", "YYMMDD", "YYYY-MM-DD", "YYYY_MM_DD")
    year_cutoff: int = 30
    priority: str = "after_exif"


@dataclass(frozen=True)
class DateMismatch:
    enabled: bool = True
    threshold_days: int = 1
    warn_on_scan: bool = True
    include_in_export: bool = True


@dataclass(frozen=True)
class Export:
    default_format: str = "json"
    include_statistics: bool = True
    include_folder_tags: bool = True
    pretty_print: bool = True
    output_path: str = ".darkroom/export"


@dataclass(frozen=True)
class Verify:
    enabled: bool = False
    algorithm: str = "sha256"
    state_dir: str = ".darkroom"
    run_record_dir: str = "runs"
    verification_dir: str = "verifications"
    allow_cleanup_on_quick: bool = False
    content_search_on_reconstruct: bool = False
    write_run_record: bool = True


@dataclass(frozen=True)
class DryRun:
    show_moves: bool = True
    show_renames: bool = True
    show_tags: bool = True
    show_duplicates: bool = True
    summary_only: bool = False


@dataclass(frozen=True)
class Logging:
    level: str = "info"
    color_output: bool = True
    log_to_file: bool = True
    file_path: str = ".darkroom/darkroom.log"


@dataclass(frozen=True)
class Performance:
    multiprocessing: bool = True
    max_workers: int = 0
    chunk_size: int = 500
    enable_cache: bool = True
    cache_location: str = ".darkroom/cache.db"


@dataclass(frozen=True)
class Synology:
    safe_fs_mode: bool = True
    use_long_paths: bool = False
    min_free_space_mb: int = 500


@dataclass(frozen=True)
class Config:
    version: str = "1.0"
    general: General = field(default_factory=General)
    paths: Paths = field(default_factory=Paths)
    scan: Scan = field(default_factory=Scan)
    sorting: Sorting = field(default_factory=Sorting)
    heuristic: Heuristic = field(default_factory=Heuristic)
    folder_tags: FolderTags = field(default_factory=FolderTags)
    renaming: Renaming = field(default_factory=Renaming)
    duplicates: Duplicates = field(default_factory=Duplicates)
    filename_date: FilenameDate = field(default_factory=FilenameDate)
    date_mismatch: DateMismatch = field(default_factory=DateMismatch)
    export: Export = field(default_factory=Export)
    video_metadata: VideoMetadata = field(default_factory=VideoMetadata)
    verify: Verify = field(default_factory=Verify)
    dry_run: DryRun = field(default_factory=DryRun)
    logging: Logging = field(default_factory=Logging)
    performance: Performance = field(default_factory=Performance)
    synology: Synology = field(default_factory=Synology)

    @property
    def extensions(self) -> list[str]:
        raw, video = self.scan.raw_extensions, self.scan.video_extensions if self.general.include_videos else ()
        return sorted({e.lower() for e in (*self.scan.image_extensions, *video, *raw)})

    @property
    def date_priority(self) -> list[str]:
        """Date sources in order: disabled ones left out, the file name put in where its own setting says."""
        order = [s for s in self.sorting.fallback_date_priority if s != "heuristic" and (s != "video_metadata" or self.video_metadata.enabled)]
        if not self.filename_date.enabled:
            return [s for s in order if s != "filename"]
        if "filename" in order:
            return order
        wanted = {"before_exif": [], "after_filesystem": ["filesystem", "exif"]}.get(self.filename_date.priority, ["exif"])
        at = next((order.index(s) + 1 for s in wanted if s in order), len(order) if self.filename_date.priority == "after_filesystem" else 0)
        return [*order[:at], "filename", *order[at:]]

    def errors(self) -> list[str]:
        """What is wrong with the values; empty if nothing is."""
        found = []
        if self.sorting.folder_structure not in FOLDER_STRUCTURES:
            found.append(f"sorting.folder_structure: {self.sorting.folder_structure!r} is none of {sorted(FOLDER_STRUCTURES)}")
        found += [f"sorting.fallback_date_priority: unknown source {s!r}" for s in self.sorting.fallback_date_priority if s not in (*DEFAULT_PRIORITY, "heuristic")]
        if self.logging.level.lower() not in ("debug", "info", "warning", "error", "critical"):
            found.append(f"logging.level: {self.logging.level!r}")
        if self.duplicates.policy not in ("safe", "skip", "overwrite"):
            found.append(f"duplicates.policy: {self.duplicates.policy!r}")
        tags = self.folder_tags
        if not 0 <= tags.distance_threshold <= 1:
            found.append("folder_tags.distance_threshold: not between 0 and 1")
        if tags.min_length < 1:
            found.append("folder_tags.min_length: below 1")
        if tags.max_length < tags.min_length:
            found.append("folder_tags.max_length: below min_length")
        return found


DEFAULT_FILES = ("darkroom.yaml", "darkroom.yml", ".darkroom/config.yaml", ".darkroom/config.yml")


def _converted(default: Any, value: Any) -> Any:
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(str(v) for v in (value or ()))
    if isinstance(default, (int, float)) and value is not None:
        return type(default)(value)
    return value


def from_dict(data: dict[str, Any]) -> Config:
    """Known keys override defaults, unknown ones are ignored."""
    changes: dict[str, Any] = {}
    base = Config()
    for section in dataclasses.fields(base):
        if section.name not in data:
            continue
        current, given = getattr(base, section.name), data[section.name]
        if dataclasses.is_dataclass(current):
            known = {f.name: _converted(getattr(current, f.name), given[f.name]) for f in dataclasses.fields(current) if isinstance(given, dict) and f.name in given}
            changes[section.name] = dataclasses.replace(current, **known)
        else:
            changes[section.name] = str(given)
    return dataclasses.replace(base, **changes)


def load(path: str | Path | None = None) -> Config:
    """An explicit file, else the first default file that exists, else the defaults."""
    import yaml

    file = Path(path) if path else next((Path(p) for p in DEFAULT_FILES if Path(p).is_file()), None)
    if file is None:
        return Config()
    if not file.is_file():
        raise ConfigError(f"no configuration file {file}")
    try:
        data = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as error:
        raise ConfigError(f"cannot read {file}: {error}") from error
    if not isinstance(data, dict):
        raise ConfigError(f"{file} holds no mapping")
    return from_dict(data)


def template(full: bool = False) -> str:
    """A configuration file with the defaults: the common sections, or all of them."""
    import yaml

    whole = dataclasses.asdict(Config())
    plain = {k: {a: list(b) if isinstance(b, tuple) else b for a, b in v.items()} if isinstance(v, dict) else v for k, v in whole.items()}
    wanted = plain if full else {k: plain[k] for k in ("version", "general", "sorting", "folder_tags", "renaming", "duplicates")}
    return "# darkroom configuration\n" + yaml.safe_dump(wanted, sort_keys=False, allow_unicode=True)
