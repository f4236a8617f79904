"""Subject areas of posts by weighted terms, and the composition of a corpus by subject."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.posts import sentences
from darkroom.session import stored

#: At most so many labelled examples are fitted on (the first by id); a documented bound of the fit, not of the corpus.
MAX_EXAMPLES = 20_000
SHARE_OF_SENTENCES = 0.25
SEED_PURITY, SEED_COUNT = 0.7, 2
#: Thresholds to choose from by ``calibrated``: the least score of a sentence, and the share of the best score that a further subject needs.
SENTENCE_THRESHOLDS, SENTENCE_MARGINS = (1.0, 1.2, 1.5, 1.8, 2.1, 2.5), (0.5, 0.6, 0.7, 0.8)
TERM_WEIGHT = 1.1
PURE_TERM, COMMON = 2.6, 50
#: A term of an example about no subject counts only if this share of its sentences is of one subject.
IDLE_PURITY = 0.9
STRONG_WEIGHT, LABEL_WEIGHT = 2.3, 2.0
#: Shorter words are often function words (scatters *off*, 20 % *off*) and are no evidence on their own.
STRONG_LENGTH = 4
PASSES = 2
#: A term counts from so many own sentences on, whatever the size of the corpus.
LEAST_COUNT = 5
#: Sentences whose judgement a task keeps, since small talk recurs.
KEPT_LINES = 50_000

Weights = dict[str, dict[str, float]]
_WORD = regex.compile(r"[\p{L}\p{M}]{3,}")
_PLAIN_WORD = re.compile(r"[a-z]{3,}")


def terms_of(sentence: str) -> list[str]:
    return _PLAIN_WORD.findall(sentence.lower()) if sentence.isascii() else _WORD.findall(sentence.casefold())


def padded(sentence: str) -> str:
    """The terms of a sentence as the automaton reads them: each between single blanks of its own."""
    return " " + "  ".join(terms_of(sentence)) + " "


def _weigh(counts: dict[str, Counter], subjects: list[str], total: float, least: float, idle: set[str], purity: float = 0.0) -> Weights:
    """Weight of a term for a subject: log of its share there over an even share, scaled so that a term of one subject only has ``PURE_TERM`` however many
    subjects there are, times its rarity (1 up to one sentence in ``COMMON``); only weights above ``TERM_WEIGHT``."""
    out: Weights = {}
    classes = len(subjects) + 1
    for term, by in counts.items():
        n = sum(by.values())
        if n < least or max((by[s] for s in subjects), default=0) < purity * n:
            continue
        if term in idle and max((by[s] for s in subjects), default=0) < IDLE_PURITY * n:
            continue
        rarity = min(1.0, max(0.6, math.log((total + 1) / n) / math.log(COMMON)))
        found = {}
        for s in subjects:
            if by[s]:
                w = PURE_TERM * math.log((by[s] + 0.1) / (n + 0.1 * classes) * classes) / math.log(classes)
                if w >= TERM_WEIGHT:
                    found[s] = round(w * rarity, 4)
        if found:
            out[term] = found
    return out


class Matcher:
    """A multi-pattern automaton over the weighted terms."""

    def __init__(self, weights: Weights, strong: set[str], thresholds: tuple[float, float]):
        import ahocorasick

        self.strong = strong
        self.threshold, self.margin = thresholds
        self.known: dict[str, tuple[list[str], bool]] = {}
        self.automaton = ahocorasick.Automaton()
        for term, by in weights.items():
            self.automaton.add_word(f" {term} ", (term, by))
        if weights:
            self.automaton.make_automaton()
        self.empty = not weights

    def hits(self, line: str) -> dict[str, dict[str, float]]:
        """The weighted terms in one padded sentence."""
        return {} if self.empty else {term: by for _, (term, by) in self.automaton.iter(line)}

    def scores(self, line: str, found: dict[str, dict[str, float]]) -> dict[str, float]:
        """Sum of the weights of the distinct terms found, by subject, reduced for very long sentences."""
        out: dict[str, float] = {}
        for by in found.values():
            for s, w in by.items():
                out[s] = out.get(s, 0.0) + w
        norm = max(1.0, math.sqrt((line.count("  ") + 1) / 20))
        return {s: v / norm for s, v in out.items()} if norm > 1 else out

    def judged(self, line: str) -> tuple[list[str], bool]:
        """The subjects of a sentence, and whether two different terms or a strong one speak for the first."""
        known = self.known.get(line)
        if known is None:
            if len(self.known) >= KEPT_LINES:
                self.known.clear()
            known = self.known[line] = self._judged(line)
        return known

    def _judged(self, line: str) -> tuple[list[str], bool]:
        found = self.hits(line)
        subjects = self.subjects(line, found) if found else []
        if not subjects:
            return subjects, False
        terms = {t for t, by in found.items() if subjects[0] in by}
        return subjects, len(terms) > 1 or bool(terms & self.strong)

    def sure(self, line: str) -> str:
        """The one subject of a sentence if it is beyond doubt, else the empty text."""
        subjects, firm = self.judged(line)
        return subjects[0] if firm and len(subjects) == 1 else ""

    def subjects(self, line: str, found: dict[str, dict[str, float]] | None = None) -> list[str]:
        """Subjects whose score is over the threshold and near the best."""
        scores = self.scores(line, self.hits(line) if found is None else found)
        if not scores:
            return []
        best = max(scores.values())
        return sorted(s for s, v in scores.items() if v >= self.threshold and v >= self.margin * best)


def idle_terms(examples: list[tuple[str, str | None]]) -> set[str]:
    """Terms of the examples that are about no subject."""
    return {t for text, subject in examples if subject is None for t in terms_of(text)}


def seed_weights(examples: list[tuple[str, str | None]], subjects: list[str]) -> Weights:
    """Terms of the labelled examples (and of nothing else) that stand mostly in one subject's examples."""
    counts: dict[str, Counter] = {}
    for text, subject in examples:
        for term in set(terms_of(text)):
            counts.setdefault(term, Counter())[subject or ""] += 1
    return _weigh(counts, subjects, len(examples), SEED_COUNT, idle_terms(examples), SEED_PURITY)


def strong_seeds(examples: list[tuple[str, str | None]], seeds: Weights) -> set[str]:
    """Seeds that stand in three examples at least, all of one subject."""
    labels: dict[str, list] = {}
    for text, subject in examples:
        for term in set(terms_of(text)) & set(seeds):
            labels.setdefault(term, []).append(subject)
    return {t for t, found in labels.items() if len(found) >= 3 and len(set(found)) == 1 and len(t) >= STRONG_LENGTH}


def own_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and the padded terms of every own sentence. Null texts and ids give no row."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[padded(x) for x in sentences(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.string()))], names=["doc_id", "lines"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return kept.mapInArrow(split, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lines array<string>")


def calibrated(examples: list[tuple[str, str | None]], subjects: list[str], share: float = SHARE_OF_SENTENCES) -> tuple[float, float]:
    """The thresholds at which the labelled examples come out best (F1): each half is judged by terms of the other half. Ties go to the pair nearest the middle of both lists."""
    halves = [[x for i, x in enumerate(examples) if i % 2 == h] for h in (0, 1)]
    lines = [[([padded(x) for x in sentences(text)], subject) for text, subject in half] for half in halves]
    seeds = [seed_weights(half, subjects) for half in halves]
    matchers = [Matcher(s, strong_seeds(half, s), (0.0, 0.0)) for half, s in zip(halves, seeds, strict=True)]
    middle = lambda values, v: abs(values.index(v) - (len(values) - 1) / 2)
    best: tuple | None = None
    for threshold in SENTENCE_THRESHOLDS:
        for margin in SENTENCE_MARGINS:
            right = wrong = 0
            for h in (0, 1):
                matcher = matchers[1 - h]
                matcher.threshold, matcher.margin = threshold, margin
                matcher.known.clear()
                for own, subject in lines[h]:
                    got = {s for s, (n, total) in post_subjects(matcher, own).items() if n >= share * total}
                    right += 2 * (subject in got)
                    wrong += len(got) + (subject is not None)
            rank = (right / max(1, wrong), -middle(SENTENCE_THRESHOLDS, threshold) - middle(SENTENCE_MARGINS, margin))
            if best is None or rank > best[0]:
                best = (rank, (threshold, margin))
    return best[1]


def corpus_weights(posts: DataFrame, seeds: Weights, strong: set[str], subjects: list[str], thresholds: tuple[float, float], idle: set[str] = frozenset()) -> Weights:
    """Term weights over the whole corpus (``own_lines``): sentences are labelled by the seeds, each term's sentences counted by label. Each batch
    sends one partial count per term and label."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(seeds, strong, thresholds)
        for batch in batches:
            seen: dict[str, Counter] = {}
            for line, times in Counter(batch.column(0).flatten().to_pylist()).items():
                by = seen.setdefault(matcher.sure(line), Counter())
                if times == 1:
                    by.update(set(line.split()))
                else:  # small talk recurs
                    for term in set(line.split()):
                        by[term] += times
                by[""] += times
            keys = [(t, label, n) for label, by in seen.items() for t, n in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64())], names=["term", "label", "n"])

    partial = posts.select("lines").mapInArrow(count, "term string, label string, n bigint")
    by_term = partial.groupBy("term", "label").agg(F.sum("n").alias("n")).groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"), F.sum("n").alias("n"))
    counted = stored(by_term)
    total = (counted.filter("term = ''").select("n").first() or [0])[0]
    most = F.array_max(F.transform(F.map_entries(F.map_filter("by", lambda label, _: label != "")), lambda e: e["value"]))
    even = F.lit(1.0 / (len(subjects) + 1))  # a term that is no more frequent in any subject than evenly has no weight
    telling = counted.filter((F.col("n") >= LEAST_COUNT) & (F.col("term") != "") & (most > even * F.col("n")))
    counts = {r["term"]: Counter(r["by"]) for r in telling.toLocalIterator()}
    return _weigh(counts, subjects, total, LEAST_COUNT, idle)


def strong_terms(weights: Weights, least: float = STRONG_WEIGHT) -> set[str]:
    return {t for t, by in weights.items() if max(by.values()) >= least and len(t) >= STRONG_LENGTH}


def post_subjects(matcher: Matcher, lines: list[str]) -> dict[str, tuple[int, int]]:
    """Own sentences about each subject, and all own sentences."""
    own = [matcher.judged(line) for line in lines]
    if not any(found for found, _ in own):
        return {}
    clear = Counter(found[0] for found, firm in own if firm and len(found) == 1)
    about: Counter = Counter()
    for found, firm in own:
        most = max((clear[s] for s in found), default=0)
        if firm or most:  # a doubtful sentence, and one of several subjects, follows the rest of the post
            about.update(s for s in found if clear[s] == most)
    return {s: (n, len(own)) for s, n in about.items()}


def assign_subjects(docs: DataFrame, doc_id: str, text: str, examples: DataFrame, subjects: DataFrame, share: float = SHARE_OF_SENTENCES) -> DataFrame:
    """Every post with the subjects that at least ``share`` of its own sentences are about: ``doc_id``, ``subject``, ``about``, ``sentences``.

    ``examples`` has example_id, text and subject (null: about none), ``subjects`` has subject. The terms are curated from the examples: those that stand mostly in one subject's.
    Their weights and further terms (other languages, rarer words) come from all own sentences of the corpus, counted in ``PASSES`` rounds: labelled by the
    examples' terms, then by the weights of the round before. The thresholds are calibrated on the examples (``calibrated``). Sentences are matched by one automaton of all
    weighted terms; every subject over the thresholds is assigned.

    Defined cases: null texts and ids give no row; texts without own sentences have no subject; repeated rows give one row; without examples no post
    has a subject; whole texts are read; other columns are ignored.
    """
    names = sorted(r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect())
    labelled = [(r["text"] or "", r["subject"]) for r in examples.select("example_id", "text", "subject").orderBy("example_id").limit(MAX_EXAMPLES).collect()]
    seeds = seed_weights(labelled, names)
    thresholds = calibrated(labelled, names)
    idle = idle_terms(labelled)
    posts = stored(own_lines(docs, doc_id, text))  # read by every pass
    weights = corpus_weights(posts, seeds, strong_seeds(labelled, seeds), names, thresholds, idle)
    for _ in range(PASSES - 1):
        weights = corpus_weights(posts, seeds | weights, strong_terms(weights, LABEL_WEIGHT), names, thresholds, idle)
    for term, by in seeds.items():
        weights.setdefault(term, by)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, strong_terms(weights), thresholds)
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for i, value in enumerate(batch.column(1).to_pylist()):
                for s, (n, total) in post_subjects(matcher, value).items():
                    if n >= share * total:
                        for column, v in zip(rows, (i, s, n, total), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())], names=["doc_id", "subject", "about", "sentences"])

    found = posts.mapInArrow(assign, f"doc_id {posts.schema['doc_id'].dataType.simpleString()}, subject string, about int, sentences int")
    return found.groupBy("doc_id", "subject").agg(F.max("about").alias("about"), F.max("sentences").alias("sentences"))


def composition(docs: DataFrame, doc_id: str, text: str, assigned: DataFrame) -> DataFrame:
    """The corpus by subject: posts, characters and their shares; posts of several subjects count in each, those of none under null."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"))
    total = sizes.agg(F.count(F.lit(1)).alias("all_posts"), F.sum("chars").alias("all_chars"))
    by = sizes.join(assigned.select("doc_id", "subject"), "doc_id", "left").groupBy("subject").agg(F.count(F.lit(1)).alias("posts"), F.sum("chars").alias("chars"))
    return by.crossJoin(F.broadcast(total)).select("subject", "posts", "chars", (F.col("posts") / F.col("all_posts")).alias("share_of_posts"), (F.col("chars") / F.col("all_chars")).alias("share_of_chars"))
