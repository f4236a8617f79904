"""Mapping free-typed names to a reference list of events (place, occasion, year), with unmatched values reported."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.lookalikes import one_form
from darkroom.session import salted_join, spread, stored

#: A name stands for an entry only from this cosine on, and only if it is so far ahead of every other entry that the name agrees with.
COSINE_THRESHOLD = 0.2
MARGIN = 0.02
#: Entries below this share of a name's best cosine are no candidates: they can neither be what the name stands for nor nearer to a part of it.
NEAR = 1 / 3
#: Lengths of the character n-grams.
GRAMS = (2, 3)
UNREAD_WORD = 0.7

#: Usual English short forms whose letters do not follow those of the word; replaced wherever they stand as words.
ABBREVIATIONS = {"xing": "crossing", "x-ing": "crossing", "x ing": "crossing", "ste": "sainte", "bros": "brothers", "xmas": "christmas"}
_LETTER_FOLDS = {"ø": "o", "ß": "ss", "ı": "i", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ς": "σ"}
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_CAMEL = regex.compile(r"(?<=[\p{Ll}\p{Lo}\p{N}])(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_DATE = regex.compile(r"(?<!\p{N})((?:19|20)\d\d)(?:([-_. ]?)(0[1-9]|1[0-2])(?:\2([0-2]\d|3[01]))?)?(?!\p{N})")
_SHORT = regex.compile(r"(?i)(?<!\p{L})(?:" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r")(?!\p{L})")
_SHORT_YEAR = regex.compile(r"['’](\d\d)(?!\p{N})|(?<=\p{L})(\d\d)(?=$|[^\p{L}\p{N}])")


def folded(text: str) -> str:
    """Case, accents and special letters folded."""
    plain = "".join(ch for ch in unicodedata.normalize("NFD", text.casefold().replace("̇", "")) if not unicodedata.combining(ch))
    return "".join(_LETTER_FOLDS.get(ch, ch) for ch in plain)


def year_of(text: str) -> tuple[int | None, str]:
    """The year a name states — a bare year before that of a date, then a shortened one — and the name without dates."""
    bare = [int(m.group(1)) for m in _DATE.finditer(text) if not m.group(3)]
    dated = [int(m.group(1)) for m in _DATE.finditer(text) if m.group(3)]
    rest = _DATE.sub(" ", text)
    if not bare and not dated:  # joined to letters, as in ParkFair2018
        joined = regex.search(r"(?<=\p{L})((?:19|20)\d\d)(?!\p{N})", rest) or regex.search(r"^((?:19|20)\d\d)(?:0[1-9]|1[0-2])?(?:[0-2]\d|3[01])?(?=\p{L})", rest)
        if joined:
            return int(joined.group(1)), rest[: joined.start()] + " " + rest[joined.end() :]
    short = [int(a or b) for a, b in (m.groups() for m in _SHORT_YEAR.finditer(rest))]
    rest = _SHORT_YEAR.sub(" ", rest)
    if bare or dated:
        return (bare or dated)[-1], rest
    return (2000 + short[-1] if short[-1] < 70 else 1900 + short[-1]) if short else None, rest


@lru_cache(200_000)
def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words, ``most + 1`` if there are more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or len(set(a) - set(b)) > most or len(set(b) - set(a)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2 if len(word) < 14 else 3


@lru_cache(200_000)
def shortens(short: str, word: str) -> bool:
    """Whether a word is written short: same first letter, its letters in order, two at least."""
    if not (2 <= len(short) < len(word)) or short[0] != word[0]:
        return False
    left = iter(word)
    if all(ch in left for ch in short):
        return True
    stem = lambda w: regex.sub(r"(ing|es|e|s)$", "", w)
    return len(stem(word)) >= 3 and stem(short) == stem(word)


@lru_cache(400_000)
def phrase_cost(window: tuple[str, ...], phrase: tuple[str, ...]) -> float | None:
    """Cost of reading a run of words as a phrase: edits, and 0.4 for each shortened word; null if it can't be read so."""
    best = None
    if len(window) == len(phrase):
        total = 0.0
        for a, b in zip(window, phrase, strict=True):
            most = _allowed(b)
            d = distance(a, b, most)
            if d and (shortens(a, b) or (len(a) == 1 and len(phrase) > 1 and b[0] == a)):
                d = 0.4 if len(a) > 1 else 0.5
            elif d > most:
                total = None
                break
            total += d
        best = total
    joined, target = "".join(window), "".join(phrase)
    most = _allowed(target)
    if abs(len(joined) - len(target)) <= most and (d := distance(joined, target, most)) <= most and (best is None or d < best):
        best = float(d)
    if best is None and len(window) > 1 and len(phrase) == 1 and joined[:1] == target[:1] and shortens(joined, target):
        best = 0.4
    return best


def place_cost(window: tuple[str, ...], phrase: tuple[str, ...], written: str, raw: str) -> float | None:
    """As ``phrase_cost``, or by the letters as written where folding them makes one letter two."""
    cost = phrase_cost(window, phrase)
    if len(raw) != len(" ".join(phrase)):
        edits = distance(written, raw, _allowed(raw))
        if edits <= _allowed(raw) and (cost is None or edits < cost):
            return float(edits)
    return cost


def tokenisations(name: str) -> list[tuple[list[str], list[str]]]:
    """Ways to cut a name into words: at separators, and at changes of case; each folded and as written."""
    name = _SHORT.sub(lambda m: ABBREVIATIONS[m.group().lower()].capitalize() if m.group()[0].isupper() else ABBREVIATIONS[m.group().lower()], name)
    cuts = [name, _CAMEL.sub(" ", name)]
    if regex.search(r"(?<!\p{L})\p{Ll}\p{Lu}{2}", name):  # typed with the shift lock on
        cuts.append(_CAMEL.sub(" ", name.swapcase()))
    out: list[tuple[list[str], list[str]]] = []
    for cut in cuts:
        words = [w.lower() for w in _WORD.findall(cut)]
        pair = ([folded(w) for w in words], words)
        if words and pair not in out:
            out.append(pair)
    return out


def fold_words(words: list[str]) -> list[str]:
    return [w for word in words for w in _WORD.findall(folded(word))]


def agreeing(name: str, candidates: list[dict]) -> list[tuple[float, int, int]]:
    """The candidates that a name agrees with in place, occasion and year: (cosine, entry, rule), the best first.

    The name is read against the places and occasions of the candidates and of nothing else. Only the cheapest readings count, so a name whose place or occasion is
    nearer to that of another candidate does not agree with one by its remaining words. Of an entry's rules one whose year is stated goes before one without.
    """
    year, rest = year_of(name)
    places = sorted({(tuple(c["place"]), c["written"], c["alias"]) for c in candidates})
    occasions = sorted({(tuple(c["occasion"]), c["alias"]) for c in candidates})
    pairs = {(tuple(c["place"]), c["written"], tuple(c["occasion"])) for c in candidates if c["alias"]}
    longest = 2 + max((len(p) for p, *_ in [*places, *occasions]), default=0)
    readings: dict[tuple, float] = {}
    for words, raw_words in tokenisations(rest):
        found_places, found_occasions = [], []
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + longest) + 1):
                window = tuple(words[i:j])
                written = " ".join(raw_words[i:j])
                for p, raw, alias in places:
                    if abs(len(p) - len(window)) <= 2 and (cost := place_cost(window, p, written, raw)) is not None:
                        found_places.append((cost + 0.01 * distance(written, raw, 9), i, j, p, raw, alias))
                for o, alias in occasions:
                    if abs(len(o) - len(window)) <= 2 and (cost := phrase_cost(window, o)) is not None:
                        found_occasions.append((cost, i, j, o, alias))
        for c1, i1, j1, p, raw, alias1 in found_places:
            for c2, i2, j2, o, alias2 in found_occasions:
                if alias1 == alias2 and (j1 <= i2 or j2 <= i1) and (not alias1 or (p, raw, o) in pairs):
                    left_over = sum(1 for k in range(len(words)) if not (i1 <= k < j1 or i2 <= k < j2))
                    cost = c1 + c2 + UNREAD_WORD * left_over
                    readings[p, raw, o] = min(cost, readings.get((p, raw, o), 99.0))
    if not readings:  # written without separators
        for words, raw_words in tokenisations(rest):
            for word in {"".join(words), *words}:
                letters = set(word)
                for p, raw, alias in places:
                    target = "".join(p)
                    if len(word) < len(target) + 1 or len(set(target) - letters) > _allowed(target):
                        continue
                    for size in range(max(3, len(target) - 2), len(target) + 3):
                        for head, tail in ((word[:size], word[size:]), (word[len(word) - size :], word[: len(word) - size])):
                            if not tail or (d := distance(head, target, _allowed(target))) > _allowed(target):
                                continue
                            for o, alias2 in occasions:
                                if alias == alias2 and (not alias or (p, raw, o) in pairs) and (c := phrase_cost((tail,), o)) is not None:
                                    cost = d + c + 0.01 * distance("".join(raw_words), raw + "".join(o), 9)
                                    readings[p, raw, o] = min(cost, readings.get((p, raw, o), 99.0))
    if not readings:
        return []
    best = min(readings.values())
    out = []
    for c in candidates:
        if readings.get((tuple(c["place"]), c["written"], tuple(c["occasion"])), 99.0) > best + 1e-9:
            continue
        agreed = []
        for r in c["rules"]:
            wanted = None if c["alias"] and r["stated"] is None and year is None else r["year"] or r["stated"]
            if wanted is None or wanted == year:
                agreed.append((wanted is None, r["rule_id"]))
        if agreed:
            out.append((c["cosine"], c["entry"], min(agreed)[1]))
    return sorted(out, key=lambda x: (-x[0], x[2]))


def chosen(name: str, candidates: list[dict]) -> tuple[int, float]:
    """The rule that a name stands for, 0 if there is none, and the best cosine."""
    found = agreeing(name, candidates)
    score = max((c["cosine"] for c in candidates), default=0.0)
    if not found or any(cosine > found[0][0] - MARGIN and entry != found[0][1] and rule != found[0][2] for cosine, entry, rule in found[1:]):
        return 0, score
    return found[0][2], score


def grams(folded_text: str, written: str) -> list[str]:
    """Character n-grams of the letters, folded and as written: what differs by accents only has most of them in common, but not all."""
    return sorted({t[i : i + n] for t in (folded_text, written) if t for n in GRAMS for i in range(max(1, len(t) - n + 1))})


def reference_entries(rules: DataFrame) -> DataFrame:
    """The reference list taken apart, one stored row an entry: ``entry``, ``place``, ``occasion`` (folded words), ``written`` (the place in lower case), ``alias`` and
    ``rules`` (rule_id, year, and the year that the alias states); with its ``grams``.

    A rule's name falls into place and occasion at the cut at which both halves recur in the list; words that always stand together stay together. An alias that is not
    the name written together is an entry of its own. All by joins and aggregates; the list is not gathered.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for rule, name, alias in zip(frame["rule_id"], frame["folder_name"], frame["alias"], strict=True):
                year, rest = year_of(name)
                words, other, stated = rest.split(), None, None
                if isinstance(alias, str) and alias:
                    stated, left = year_of(alias)
                    if folded("".join(_WORD.findall(left))) != "".join(fold_words(words)):
                        other = _CAMEL.sub(" ", left).split() or None
                rows.append((rule, words, year, other, stated))
            out = pd.DataFrame(rows, columns=["rule_id", "words", "year", "other", "stated"])
            yield out.astype({"year": "Int32", "stated": "Int32"})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            written = [" ".join(p).lower() for p in frame["head"]]
            place, occasion = ([fold_words(w) for w in frame[c]] for c in ("head", "tail"))
            joined = ["".join(_WORD.findall(w + " " + " ".join(o).lower())) for w, o in zip(written, frame["tail"], strict=True)]
            yield pd.DataFrame(
                {
                    "place": place, "occasion": occasion, "written": written, "alias": frame["alias"], "rules": frame["rules"],
                    "grams": [grams("".join([*p, *o]), j) for p, o, j in zip(place, occasion, joined, strict=True)],
                }
            )

    columns = rules.select(F.col("rule_id").cast("bigint").alias("rule_id"), "folder_name", "alias").filter("rule_id is not null and folder_name is not null")
    parsed = stored(columns.mapInPandas(parse, "rule_id bigint, words array<string>, year int, other array<string>, stated int"))
    names = parsed.select("words").distinct()
    cuts = names.filter(F.size("words") > 1).select("words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "k", F.slice("words", 1, F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words")).alias("tail"))
    seen = lambda half, into: cuts.groupBy(half).agg(F.count(F.lit(1)).alias(into))
    ranked = cuts.join(seen("head", "begins"), "head").join(seen("tail", "ends"), "tail")
    rank = F.struct(F.least("begins", "ends"), F.greatest("begins", "ends"), F.when(F.col("begins") > 1, F.col("k")).otherwise(-F.col("k")))
    best = ranked.groupBy("words").agg(F.max_by(F.struct("head", "tail"), rank).alias("cut"))
    whole = parsed.join(best, "words", "left").select(
        F.coalesce("cut.head", "words").alias("head"), F.coalesce("cut.tail", F.array().cast("array<string>")).alias("tail"), F.lit(False).alias("alias"), "rule_id", "year", F.lit(None).cast("int").alias("stated")
    )
    other = parsed.filter("other is not null").select(F.slice("other", 1, 1).alias("head"), F.slice("other", 2, F.size("other")).alias("tail"), F.lit(True).alias("alias"), "rule_id", "year", "stated")
    grouped = whole.unionByName(other).groupBy("head", "tail", "alias").agg(F.array_sort(F.collect_list(F.struct("rule_id", "year", "stated"))).alias("rules"))
    folded_entries = grouped.mapInPandas(fold, "place array<string>, occasion array<string>, written string, alias boolean, rules array<struct<rule_id:bigint,year:int,stated:int>>, grams array<string>")
    return stored(folded_entries.select(F.monotonically_increasing_id().alias("entry"), "*"))


def map_to_events(values: DataFrame, value: str, rules: DataFrame) -> DataFrame:
    """The rule each distinct value stands for: ``value``, ``rule_id`` (0 if there is none), ``score`` (the best cosine).

    ``rules`` has rule_id, folder_name and alias. Values are made distinct, brought to one form and stripped of dates. Candidates come from an inverted index of character
    n-grams over the list's entries; their score is the cosine of the n-gram sets, weighted by rarity in the list. An entry is accepted if its score is over
    the threshold and by a margin over that of every other candidate that the name agrees with; place, occasion and, if the rule has a year, year are checked
    against the candidates. What a name costs depends on its candidates, not on the length of the list, and neither is gathered.

    Defined cases: null and blank values give no row; different entries within the margin give 0; rules whose names repeat are won
    by the smaller id; an empty rule table maps everything to 0; other columns are ignored.
    """
    entries = reference_entries(rules)
    vocabulary = rules.select(F.col("folder_name").alias("text")).filter("text is not null")
    forms = one_form(values, value, vocabulary).filter("form <> ''")
    total = float(max(1, entries.count()))
    in_entries = entries.select("entry", F.explode("grams").alias("gram"))
    rarity = F.log1p(F.lit(total) / F.count(F.lit(1)))
    weights = in_entries.groupBy("gram").agg((rarity * rarity).alias("w2"))
    norms = in_entries.join(weights, "gram").groupBy("entry").agg(F.sum("w2").alias("norm2"))
    lists = in_entries.join(norms, "entry").groupBy("gram").agg(F.collect_list(F.struct("entry", "norm2")).alias("entries"))
    index = stored(weights.join(lists, "gram"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            letters = ["".join(_WORD.findall(year_of(f)[1])) for f in frame["form"]]
            yield pd.DataFrame({"form": frame["form"], "grams": [grams(folded(t), t.lower()) for t in letters]})

    distinct = spread(forms.select("form").distinct(), "form")
    asked = distinct.mapInPandas(cut, "form string, grams array<string>").select("form", F.explode("grams").alias("gram"))
    unknown = F.log1p(F.lit(total)) * F.log1p(F.lit(total))
    sized = asked.join(index.select("gram", "w2"), "gram", "left").groupBy("form").agg(F.sum(F.coalesce("w2", unknown)).alias("size2"), F.collect_list("gram").alias("grams"))
    met = sized.select("form", "size2", F.explode("grams").alias("gram")).join(index, "gram").select("form", "size2", "w2", F.explode("entries").alias("e"))
    common = met.groupBy("form", "size2", "e.entry", "e.norm2").agg(F.sum("w2").alias("dot"))  # lies together by form already
    scored = common.select("form", "entry", (F.col("dot") / F.sqrt(F.col("size2") * F.col("norm2"))).alias("cosine")).filter(F.col("cosine") >= COSINE_THRESHOLD)
    ranked = scored.groupBy("form").agg(F.max("cosine").alias("best"), F.collect_list(F.struct("cosine", "entry")).alias("all"))
    near = ranked.select("form", F.explode(F.filter("all", lambda c: c["cosine"] >= F.col("best") * NEAR)).alias("c")).select("form", "c.cosine", "c.entry")
    described = near.join(entries.drop("grams"), "entry")
    candidates = described.groupBy("form").agg(F.collect_list(F.struct("cosine", "entry", "place", "occasion", "written", "alias", "rules")).alias("candidates"))

    def accept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [chosen(form, list(c)) for form, c in zip(frame["form"], frame["candidates"], strict=True)]
            yield pd.DataFrame({"form": frame["form"], "rule_id": [r for r, _ in made], "score": [s for _, s in made]})

    accepted = spread(candidates, "form").mapInPandas(accept, "form string, rule_id bigint, score double")
    return forms.join(accepted, "form", "left").select("value", F.coalesce("rule_id", F.lit(0)).cast("bigint").alias("rule_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_rows(rows: DataFrame, record: str, value: str, all_names: DataFrame, rules: DataFrame) -> DataFrame:
    """``record``, ``rule_id`` of every row whose value is neither null, blank nor one of ``all_names`` as it stands; one row per record and rule."""
    kept = rows.select(F.col(record).alias("record"), F.col(value).alias("value")).filter(F.col("value").isNotNull()).filter(F.col("record").isNotNull())
    names = all_names.select(F.col(all_names.columns[0]).alias("value")).filter("value is not null").distinct()
    free = kept.join(names, "value", "left_anti")
    mapped = map_to_events(free, "value", rules)
    return salted_join(free, mapped.select("value", "rule_id"), ["value"]).select("record", "rule_id").distinct()
