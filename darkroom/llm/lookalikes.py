"""One form for text that looks the same but is stored in other characters: script-aware repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.session import salted_join, stored

#: Letters that look the same, in the order of ``SCRIPTS`` ('' where a script has none). Letters with accents follow their base letter, as tokens are decomposed.
TWINS = [
    ("A", "Α", "А", "", "Ꭺ"), ("B", "Β", "В", "", "Ᏼ"), ("C", "Ϲ", "С", "", "Ꮯ"), ("D", "", "", "", "Ꭰ"), ("E", "Ε", "Е", "", "Ꭼ"), ("F", "Ϝ", "", "", ""), ("G", "", "Ԍ", "", "Ꮐ"), ("H", "Η", "Н", "", "Ꮋ"),
    ("I", "Ι", "І", "", ""), ("J", "Ϳ", "Ј", "", "Ꭻ"), ("K", "Κ", "К", "", "Ꮶ"), ("L", "", "", "Լ", "Ꮮ"), ("M", "Μ", "М", "", "Ꮇ"), ("N", "Ν", "", "", ""), ("O", "Ο", "О", "Օ", ""), ("P", "Ρ", "Р", "", "Ꮲ"),
    ("Q", "", "Ԛ", "", ""), ("R", "", "", "", "Ꭱ"), ("S", "", "Ѕ", "Տ", "Ꮪ"), ("T", "Τ", "Т", "", "Ꭲ"), ("U", "", "", "Ս", ""), ("V", "", "Ѵ", "", "Ꮩ"), ("W", "", "Ԝ", "", "Ꮃ"), ("X", "Χ", "Х", "", ""),
    ("Y", "Υ", "У", "", ""), ("Y", "", "Ү", "", ""), ("Z", "Ζ", "", "", "Ꮓ"),
    ("a", "α", "а", "", ""), ("c", "ϲ", "с", "", ""), ("d", "", "ԁ", "", ""), ("e", "", "е", "", ""), ("g", "", "", "ց", ""), ("h", "", "һ", "հ", ""), ("i", "ι", "і", "", ""), ("j", "ϳ", "ј", "յ", ""), ("k", "κ", "к", "", ""),
    ("l", "", "ӏ", "", ""), ("n", "η", "", "ո", ""), ("o", "ο", "о", "օ", ""), ("p", "ρ", "р", "", ""), ("q", "", "ԛ", "զ", ""), ("s", "", "ѕ", "", ""), ("u", "υ", "", "ս", ""), ("v", "ν", "ѵ", "", ""), ("w", "ω", "ԝ", "", ""),
    ("x", "χ", "х", "", ""), ("y", "γ", "у", "", ""), ("ß", "β", "", "", ""), ("ı", "ι", "", "", ""),
]
#: Look-alikes within one script, or of no script; always replaced.
ALWAYS = {
    "ɑ": "a", "ɡ": "g", "ɩ": "ı", "ʏ": "y", "ɢ": "G", "ꞵ": "ß", "ş": "ș", "Ş": "Ș", "ţ": "ț", "Ţ": "Ț",
    "‐": "-", "‑": "-", "­": "", "−": "-", "﹣": "-", "’": "'", "‘": "'", "ʼ": "'", "‛": "'",
    "⁄": "/", "․": ".", "ꞌ": "'", "“": '"', "”": '"',
}
_KEEP_BEFORE_NFKC = {"ϲ": "c", "Ϲ": "C"}  # compatibility forms of a sigma, but they look like c
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}᠎︀-️ᅟᅠㅤ]|[\p{Cc}--[\t\n\v\f\r\x85]]", regex.V1)
_BLANK = regex.compile(r"[\s\p{Z}]+")
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}


@cache
def _tables() -> dict[str, dict[int, str]]:
    """For each script: every look-alike of one of its letters, by code point. The first row of a letter wins."""
    out: dict[str, dict[int, str]] = {s: {} for s in SCRIPTS}
    for row in TWINS:
        for target, letter in zip(SCRIPTS, row, strict=True):
            for other in row:
                if letter and other and other != letter:
                    out[target].setdefault(ord(other), letter)
    return out


def base_form(text: str) -> str:
    """Compatibility forms composed, invisible characters removed, blanks of every kind as one space, none at the ends."""
    text = "".join(_KEEP_BEFORE_NFKC.get(ch, ch) for ch in text)
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    text = "".join(ALWAYS.get(ch, ch) for ch in text)
    return unicodedata.normalize("NFC", _BLANK.sub(" ", text).strip())


def scripts_of(token: str) -> dict[str, int]:
    return {s: n for s in SCRIPTS if (n := len(_SCRIPT[s].findall(token)))}


def repairs(token: str, around: tuple[str, ...] = ()) -> list[str]:
    """Readings of a token in one script, best first: of a mixed-script token, its dominant script's first; of a token wholly of look-alikes in a text
    that has letters of other scripts (``around``), the token as it stands, then its readings in those. Others have none."""
    found = scripts_of(token)
    mixed = len(found) > 1
    if not found or (not mixed and not set(around) - set(found)):
        return []
    order = sorted(SCRIPTS, key=lambda s: (-found.get(s, 0), SCRIPTS.index(s))) if mixed else [s for s in around if s not in found]
    plain = unicodedata.normalize("NFD", token)
    out: list[str] = []
    for script in order:
        reading = unicodedata.normalize("NFC", plain.translate(_tables()[script]))
        if set(scripts_of(reading)) <= {script} and reading != token and reading not in out:
            out.append(reading)
    return out if mixed or not out else [token, *out]


def _parts(text: str) -> list[tuple[str, list[str]]]:
    """The text cut into tokens and what stands between them; tokens with their possible repairs."""
    around = tuple(scripts_of(text))
    out, end = [], 0
    for m in _TOKEN.finditer(text):
        out += [(text[end : m.start()], []), (m.group(), repairs(m.group(), around) if len(around) > 1 else [])]
        end = m.end()
    return [*out, (text[end:], [])]


def one_form(values: DataFrame, value: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """The consistent form of every distinct value: ``value``, ``form``.

    Invisible characters go, compatibility characters (full-width forms, ligatures, composed accents) and all blanks are unified. In tokens
    that mix scripts, look-alike letters are replaced by those of the token's dominant script if the result occurs in the vocabulary;
    else by those of the next script whose result does; otherwise the token stays. The vocabulary is every token of the values themselves
    that needs no repair, and of ``vocabulary`` (a DataFrame with one string column ``text``). Letter case and accents are kept.

    Values are made distinct before any Python runs, split once and stored, and only tokens in need of repair are looked up, so a value that makes up a
    third of all rows costs as much as any other. Null values give no row; an empty text keeps the empty form; whole texts are
    processed; other columns are ignored.
    """
    distinct = values.select(F.col(value).alias("value")).filter(F.col("value").isNotNull()).distinct()

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [_parts(base_form(v)) for v in frame["value"]]
            needy = [any(r for _, r in p) for p in parts]
            yield pd.DataFrame(
                {
                    "value": frame["value"],
                    "form": ["".join(t for t, _ in p) for p in parts],
                    "parts": [[{"text": t, "repairs": r} for t, r in p] if n else None for p, n in zip(parts, needy, strict=True)],
                }
            )

    split_values = stored(distinct.mapInPandas(split, "value string, form string, parts array<struct<text:string,repairs:array<string>>>"))
    tokens = F.filter(F.split("form", r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")
    words = split_values.filter(F.col("parts").isNull()).select(F.explode(tokens).alias("word"))
    if vocabulary is not None:
        words = words.unionByName(vocabulary.select(F.explode(F.filter(F.split("text", r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")).alias("word")))
    asked = (
        split_values.filter(F.col("parts").isNotNull())
        .select("value", F.posexplode("parts").alias("at", "part"))
        .select("value", "at", "part.text", F.posexplode_outer("part.repairs").alias("rank", "word"))
    )
    known = words.join(asked.filter(F.col("word").isNotNull()).select("word").distinct(), "word", "left_semi").distinct().withColumn("known", F.lit(True))
    best = (
        asked.join(known, "word", "left")
        .groupBy("value", "at")
        .agg(F.first("text").alias("text"), F.min_by("word", F.when(F.col("known"), F.col("rank"))).alias("repaired"))
    )
    pieces = best.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("repaired", "text").alias("text")))).alias("pieces"))
    rebuilt = pieces.select("value", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("form"))
    return split_values.filter(F.col("parts").isNull()).select("value", "form").unionByName(rebuilt)


def find_disguised(rows: DataFrame, record: str, value: str, targets: DataFrame) -> DataFrame:
    """Values that look like a target text but are stored in other characters: ``record``, ``target_id``, distinct. As ``find_disguised_by_field``, of one field."""
    field = F.lit("").alias("field")
    asked = rows.select(field, F.col(record).alias("record"), F.col(value).alias("value"))
    return find_disguised_by_field(asked, targets.select(field, "target_id", "text")).select("record", "target_id")


def find_disguised_by_field(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Values (``field``, ``record``, ``value``) that look like a target text of their field (``field``, ``target_id``, ``text``) but are stored in other
    characters: ``field``, ``record``, ``target_id``, distinct. Values and texts of all fields are brought to one form together.

    A value equal to the text as stored is no case. Null records, values and texts give no row; a table without rows gives none.
    """
    texts = targets.select("field", "target_id", "text").filter(F.col("text").isNotNull())
    forms = one_form(rows.select("value").union(texts.select("text")), "value")
    wanted = texts.join(forms.withColumnRenamed("value", "text"), "text").select("field", "target_id", F.col("text").alias("stored"), "form")
    asked = rows.select("field", "value").filter("value is not null").distinct().join(forms, "value")
    hits = asked.join(wanted, ["field", "form"]).filter(F.col("value") != F.col("stored")).select("field", "value", "target_id")
    gathered = stored(hits.groupBy("field", "value").agg(F.collect_set("target_id").alias("targets")))  # as many as there are targets of one form
    found = salted_join(rows.select("field", "record", "value").filter(F.col("record").isNotNull()), gathered, ["field", "value"])
    return found.select("field", "record", F.explode("targets").alias("target_id")).distinct()
