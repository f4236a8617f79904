"""Embedded metadata: a TIFF directory reader for still images, an atom reader for videos, optional external readers."""

from __future__ import annotations

import json
import os
import shutil
import struct
import subprocess
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions import dates, paths

# Extensions whose embedded data is read, tag numbers and the fields of a video probe in order.
EXIF_EXTENSIONS = [".jpg", ".jpeg", ".tiff", ".tif", ".heic", ".heif", ".png", ".webp", ".cr2", ".nef", ".arw", ".dng"]
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "date_taken", 0x9003: "date_original", 0x9004: "date_digitised", 0xA002: "width", 0xA003: "height"}
PROBE_FIELDS = ["creation_time", "com.apple.quicktime.creationdate", "date", "datetimeoriginal"]
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
EXIF_SCHEMA = "path string, make string, model string, orientation int, width int, height int, date_taken_text string, date_original_text string, date_digitised_text string, raw map<string,string>, exif_error string"
BLOCK = 1 << 16
LARGEST_TAG = 4096


class Part:
    """A stretch of an open file that is read by slices, wherever they lie."""

    def __init__(self, file: BinaryIO, start: int = 0):
        self.file, self.start = file, start
        self.size = max(0, file.seek(0, 2) - start)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, wanted: slice) -> bytes:
        begin, end, _ = wanted.indices(self.size)
        self.file.seek(self.start + begin)
        return self.file.read(max(0, end - begin))

    def after(self, at: int) -> Part:
        return Part(self.file, self.start + at)


def _numbers(form: str, data: bytes | Part, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def _up_to_zero(data: bytes | Part, at: int, end: int) -> bytes:
    out = b""
    while at < end and b"\0" not in out:
        out += data[at : min(end, at + BLOCK)]
        at += BLOCK
    return out.split(b"\0")[0]


def tiff_tags(data: bytes | Part) -> dict[str, str]:
    """The tags of a TIFF block, those of the EXIF directory included: the wanted ones by name, others by number as ``0x9286``, values of over ``LARGEST_TAG`` bytes (previews,
    maker notes) left out. Broken offsets end the reading quietly."""
    if data[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if data[:2] == b"II" else ">"
    out: dict[str, str] = {}
    todo = [_numbers(order + "I", data, 4)[0]]
    seen: set[int] = set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for i in range(_numbers(order + "H", data, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                break
            tag, kind, n = _numbers(order + "HHI", data, entry)
            size = _SIZES.get(kind, 0) * n
            where = entry + 8 if size <= 4 else _numbers(order + "I", data, entry + 8)[0]
            if tag == 0x8769:
                todo.append(_numbers(order + "I", data, entry + 8)[0])
            elif size and where + size <= len(data) and (tag in TAGS or size <= LARGEST_TAG):
                if kind == 2:
                    value = _up_to_zero(data, where, where + n).decode("latin-1").strip()
                else:
                    value = str(_numbers(order + {3: "H", 4: "I"}.get(kind, "B"), data, where)[0])
                out.setdefault(TAGS.get(tag, f"0x{tag:04x}"), value)
    return out


def _boxes(data: bytes | Part, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of the content of every box."""
    while at + 8 <= end:
        size, name = _numbers(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = _numbers(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head:
            return
        yield name, at + head, min(end, at + size)
        at += size


def _exif_item(data: bytes | Part) -> bytes:
    """The TIFF block of the Exif item of a HEIF file, by its item table."""
    meta = next(((a, e) for name, a, e in _boxes(data, 0, len(data)) if name == b"meta"), None)
    if meta is None:
        return b""
    inner = {name: (a, e) for name, a, e in _boxes(data, meta[0] + 4, meta[1])}
    if b"iinf" not in inner or b"iloc" not in inner:
        return b""
    at, end = inner[b"iinf"]
    wanted = set()
    for name, a, _ in _boxes(data, at + (8 if _numbers(">B", data, at)[0] else 6), end):
        version = _numbers(">B", data, a)[0]
        if name == b"infe" and version >= 2:
            item, _, kind = _numbers(">HH4s" if version == 2 else ">IH4s", data, a + 4)
            if kind == b"Exif":
                wanted.add(item)
    at, _ = inner[b"iloc"]
    version, sizes = _numbers(">B3xH", data, at)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    at += 6

    def take(size: int) -> int:
        nonlocal at
        at += size
        return int.from_bytes(data[at - size : at], "big")

    for _ in range(take(2 if version < 2 else 4)):
        item, method = take(2 if version < 2 else 4), take(2) & 15 if version else 0
        take(2)
        base, content = take(base_size), b""
        for _ in range(take(2)):
            take(index_size)
            begin, length = base + take(offset_size), take(length_size)
            if item in wanted and method in (0, 1):
                first, stop = inner.get(b"idat", (0, 0)) if method else (0, len(data))
                content += data[first + begin : min(stop, first + begin + length) if length else stop]
        if len(content) > 4:
            return content[4 + _numbers(">I", content, 0)[0] :].removeprefix(b"Exif\0\0")
        if at > len(data):
            break
    return b""


def _marked(data: bytes | Part) -> int:
    """Where the first Exif mark ends, or -1."""
    for at in range(0, len(data), BLOCK):
        mark = data[at : at + BLOCK + 5].find(b"Exif\0\0")
        if mark >= 0:
            return at + mark + 6
    return -1


def embedded_tiff(data: bytes | Part) -> bytes | Part:
    """The TIFF block of an image file, wherever it lies: the file itself, a JPEG segment, a PNG or WebP chunk, a HEIF item, or what follows an Exif mark."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at : at + 1] == b"\xff":
            marker, size = _numbers(">BH", data, at + 1)
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if marker == 0xDA:
                break
            at += 2 + size
        return b""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, name = _numbers(">I4s", data, at)
            if name == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return b""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            name, size = _numbers("<4sI", data, at)
            if name == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
        return b""
    try:
        if data[4:8] == b"ftyp" and (item := _exif_item(data)):
            return item
    except struct.error:  # a broken item table: the mark is looked for
        pass
    mark = _marked(data)
    if mark >= 0:
        return data.after(mark) if isinstance(data, Part) else data[mark:]
    return b""


def mvhd_date(path: str) -> str | None:
    """Creation time of an MP4/QuickTime file from its movie header (seconds from 1904), as text; zero times are none."""
    with open(path, "rb") as f:
        f.seek(0, 2)
        end, at, stop = f.tell(), 0, None
        while at + 8 <= end:
            f.seek(at)
            size, name = struct.unpack(">I4s", f.read(8))
            head = 8
            if size == 1:
                size, head = struct.unpack(">Q", f.read(8))[0], 16
            size = size or end - at
            if size < head:
                return None
            if name == b"moov":
                at, stop = at + head, at + size
                continue
            if name == b"mvhd" and stop:
                f.seek(at + head)
                body = f.read(20)
                seconds = struct.unpack_from(">Q" if body[0] == 1 else ">I", body, 4)[0]
                return (datetime(1904, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S") if seconds else None
            at += size
    return None


def probe_json_date(text: str) -> str | None:
    """The first date field of a probe's JSON: those of the container before those of the streams, in the order of the fields."""
    data = json.loads(text)
    for tags in [data.get("format", {}).get("tags", {}), *(s.get("tags", {}) for s in data.get("streams", []))]:
        low = {k.lower(): v for k, v in tags.items()}
        for name in PROBE_FIELDS:
            if low.get(name):
                return str(low[name])
    return None


def probe(path: str, command: str = "ffprobe") -> str | None:
    done = subprocess.run([command, "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, text=True, timeout=30, check=False)
    return done.stdout if done.returncode == 0 else None


#: Folders in which ffprobe is looked for besides the search path.
PROBE_FOLDERS = ("/usr/bin", "/usr/local/bin", "/opt/bin", "/opt/ffmpeg/bin", "/usr/local/ffmpeg/bin", "/var/packages/ffmpeg/target/bin")


def find_probe(command: str = "ffprobe") -> str | None:
    """The probe as given, from the search path or from one of the usual folders."""
    return shutil.which(command) or next((p for folder in PROBE_FOLDERS if os.access(p := os.path.join(folder, os.path.basename(command)), os.X_OK)), None)


def probe_version(command: str = "ffprobe") -> str | None:
    """The first line that the probe says about itself."""
    found = find_probe(command)
    if found is None:
        return None
    try:
        done = subprocess.run([found, "-version"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.splitlines()[0] if done.returncode == 0 and done.stdout else None


def providers(command: str = "ffprobe") -> dict[str, bool]:
    """Which external readers are there."""
    from importlib.util import find_spec

    return {"ffprobe": find_probe(command) is not None, "hachoir": find_spec("hachoir") is not None, "builtin": True}


def probe_tags(text: str) -> dict[str, str]:
    """Every tag of a probe's JSON: those of the container by their names, those of the streams with the stream's number before them."""
    data = json.loads(text)
    out = {k: str(v) for k, v in (data.get("format", {}).get("tags") or {}).items()}
    for i, stream in enumerate(data.get("streams", [])):
        out |= {f"stream_{i}_{k}": str(v) for k, v in (stream.get("tags") or {}).items()}
    return out


def _plain_text_tags(path: str) -> dict[str, str]:
    pairs = (line.lstrip("- ").split(":", 1) for line in _plain_text(path) if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs if v.strip()}


def all_video_metadata(files: DataFrame, provider: str = "ffprobe", command: str = "ffprobe", fallback: bool = True) -> DataFrame:
    """``path``, ``reader``, ``tags``: everything a reader says about each video file. Readers as in ``read_video_dates``; a file that none understands has an empty map."""

    def one(path: str) -> tuple[str | None, dict[str, str]]:
        for reader in _readers(provider, command, fallback):
            try:
                if reader == "ffprobe":
                    text = probe(path, find_probe(command))
                    found = probe_tags(text) if text else {}
                elif reader == "hachoir":
                    found = _plain_text_tags(path)
                else:
                    date = mvhd_date(path)
                    found = {"creation_time": date} if date else {}
            except Exception:  # noqa: BLE001 - a broken file has no metadata
                continue
            if found:
                return reader, found
        return None, {}

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [one(p) for p in frame["path"]]
            yield pd.DataFrame({"path": frame["path"], "reader": pd.Series([r for r, _ in made], dtype=object), "tags": [t for _, t in made]})

    return files.select("path").mapInPandas(read, "path string, reader string, tags map<string,string>")


def _readers(provider: str, command: str, fallback: bool) -> list[str]:
    """The readers to try, in order: the one asked for, then, with ``fallback``, hachoir and the built-in one; those that are missing left out."""
    there = providers(command)
    order = [provider, *(["hachoir", "builtin"] if fallback else [])]
    return [r for r in dict.fromkeys(order) if there.get(r)]


def _plain_text(path: str) -> list[str]:
    from hachoir.metadata import extractMetadata
    from hachoir.parser import createParser

    parser = createParser(path)
    with parser:
        return extractMetadata(parser).exportPlaintext()


def _plain_text_date(path: str) -> str | None:
    lines = _plain_text(path)
    return next((line.split(":", 1)[1].strip() for line in lines if "date" in line.lower() and ":" in line), None)


def read_exif(files: DataFrame) -> DataFrame:
    """Embedded still-image data of the files of ``files`` (column ``path``) whose extension has any, read by seeking, so that it may lie anywhere in a file. The date
    texts are parsed by expressions; a file that cannot be read gives a row with ``exif_error``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                row: dict = dict.fromkeys(["make", "model", "orientation", "width", "height", "date_taken_text", "date_original_text", "date_digitised_text", "exif_error"])
                row["path"], row["raw"] = path, {}
                try:
                    with open(path, "rb") as f:
                        found = tiff_tags(embedded_tiff(Part(f)))
                    row |= {"make": found.get("make"), "model": found.get("model"), "raw": found}
                    row |= {f"{k}_text": found.get(k) for k in ("date_taken", "date_original", "date_digitised")}
                    row |= {k: int(found[k]) for k in ("orientation", "width", "height") if found.get(k, "").isdigit()}
                except (OSError, struct.error, ValueError) as error:
                    row["exif_error"] = str(error)
                rows.append(row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in EXIF_SCHEMA.split(", ")])
            for c in ("orientation", "width", "height"):
                out[c] = out[c].astype("Int32")
            yield out

    wanted = files.filter(paths.extension(F.col("path")).isin(*EXIF_EXTENSIONS)).select("path")
    found = wanted.mapInPandas(read, EXIF_SCHEMA)
    parsed = {c: dates.exif_date(F.col(f"{c}_text")) for c in ("date_taken", "date_original", "date_digitised")}
    return found.withColumns(parsed).withColumn("best_date", dates.best_exif(F.col("date_original"), F.col("date_taken"), F.col("date_digitised"))).drop(*[f"{c}_text" for c in parsed])


def read_video_dates(files: DataFrame, provider: str = "builtin", command: str = "ffprobe", fallback: bool = True) -> DataFrame:
    """``path``, ``video_date`` of video files; the caller keeps other files out. A reader that is missing, fails or finds nothing gives way to hachoir, and that to the
    built-in one, if ``fallback`` is set."""

    def one(path: str) -> str | None:
        for reader in _readers(provider, command, fallback):
            text = None
            try:
                if reader == "ffprobe":
                    found = probe(path, find_probe(command))
                    text = probe_json_date(found) if found else None
                else:
                    text = _plain_text_date(path) if reader == "hachoir" else mvhd_date(path)
            except Exception:  # noqa: BLE001 - a broken file has no date in this reader
                continue
            if text is not None:
                return text
        return None

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [one(p) for p in frame["path"]]}, dtype=object)

    return files.select("path").mapInPandas(read, "path string, text string").select("path", dates.video_date(F.col("text")).alias("video_date"))


def read_listing(files: DataFrame, algorithm: str = "sha256", contents: bool = True) -> DataFrame:
    """``path``, ``size_bytes``, ``file_hash`` of those paths that are files. A file that is there but cannot be read has a null hash; without ``contents`` no file is
    opened and every hash is null. Null paths and paths that are no files give no row."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, os.path.getsize(p), _digest(p, algorithm) if contents else None) for p in frame["path"] if p and os.path.isfile(p)]
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "file_hash"])

    return files.select("path").filter("path is not null").mapInPandas(read, "path string, size_bytes bigint, file_hash string")


def _digest(path: str, algorithm: str, chunk: int = 1 << 22) -> str | None:
    import hashlib

    digest = hashlib.new(algorithm if algorithm in ("sha256", "md5") else "sha256")
    try:
        with open(path, "rb") as f:
            while block := f.read(chunk):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def read_hashes(files: DataFrame, algorithm: str = "sha256", chunk: int = 1 << 22) -> DataFrame:
    """``path``, ``file_hash`` of files read in chunks; null where a file cannot be read. Unknown algorithms mean sha256."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "file_hash": [_digest(p, algorithm, chunk) for p in frame["path"]]}, dtype=object)

    return files.select("path").mapInPandas(read, "path string, file_hash string")
