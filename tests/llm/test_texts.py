import random
import time
from collections import Counter

import pytest

from darkroom.llm.leakage import STRETCH, find_passages, find_phrases, inverted_index, leaked_items, longest_in_order, words
from darkroom.llm.mixing import TOKENIZER, mix, mixing_rates, mixture_records, token_counts
from darkroom.llm.posts import own_text, sentences
from darkroom.llm.subjects import assign_subjects, composition

DOCS = "doc_id bigint, text string, source string, item_id string, terms string"


def covered(doc: str, passage: str) -> int:
    """Brute force: the most passage words in stretches of five or more, in order, over all ways to align them."""
    d, p = words(doc), words(passage)
    run = {}
    for i in range(len(p)):
        for j in range(len(d)):
            if p[i] == d[j]:
                n = 0
                while i + n < len(p) and j + n < len(d) and p[i + n] == d[j + n]:
                    n += 1
                run[i, j] = n
    best: dict[tuple[int, int], int] = {}

    def most(i, j):
        if i >= len(p) or j >= len(d):
            return 0
        if (i, j) not in best:
            out = max(most(i + 1, j), most(i, j + 1))
            for n in range(STRETCH, run.get((i, j), 0) + 1):
                out = max(out, n + most(i + n, j + n))
            best[i, j] = out
        return best[i, j]

    return most(0, 0)


def test_passages_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 24)))) for i in range(8)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)[1].split()
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randint(1, 20)] if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(5)]
        docs.append((i, " ".join(parts), "s", "x", "y"))
    got = {(r.doc_id, r.item_id) for r in find_passages(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(passages, "item_id bigint, passage string"), "item_id", "passage").collect()}
    want = {(d[0], i) for d in docs for i, p in passages if len(words(p)) >= STRETCH and covered(d[1], p) >= 0.5 * len(words(p))}
    assert got == want and want


def test_longest_in_order():
    assert longest_in_order([(0, 0, 6), (6, 20, 5)]) == 11
    assert longest_in_order([(6, 0, 5), (0, 20, 6)]) == 6  # not in the passage's order
    assert longest_in_order([(0, 0, 8), (5, 30, 8)]) == 13  # the overlap counts once
    assert longest_in_order([]) == 0


def test_longest_in_order_cuts_either_stretch():
    assert longest_in_order([(0, 0, 7), (6, 30, 5)]) == 11
    assert longest_in_order([(0, 0, 6), (5, 20, 7), (11, 40, 5)]) == 16
    rng = random.Random(4)
    for _ in range(300):
        passage = [rng.choice("abc") for _ in range(rng.randint(5, 18))]
        doc = [rng.choice("abc") for _ in range(3)]
        for _ in range(rng.randint(1, 3)):
            a = rng.randrange(len(passage))
            doc += passage[a : a + rng.randint(5, 9)] + [rng.choice("abc")]
        stretches = []
        for d in range(-len(passage), len(doc)):
            n = 0
            for s in range(len(passage) + 1):
                if s < len(passage) and 0 <= s + d < len(doc) and passage[s] == doc[s + d]:
                    n += 1
                    continue
                if n >= STRETCH:
                    stretches.append((s - n, s - n + d, n))
                n = 0
        assert longest_in_order(stretches) == covered(" ".join(doc), " ".join(passage))


def test_passages_in_disguise(spark):
    passage = "Under Vank the tiny statute was filed against 2 hearings a day, which Nolt called rewoven notary work."
    docs = [
        (1, "> under vank THE tiny\n> statute <b>was</b> filed against 2 hearings&nbsp;a day: which [i]Nolt[/i] called", "s", "", ""),
        (2, "Under Vank the tiny statute (sic!) was filed against 2 hearings", "s", "", ""), (3, "statute tiny the Vank under", "s", "", ""), (4, None, "s", "", ""), (5, "", "s", "", ""), (None, passage, "s", "", ""),
        (6, "x " * 30_000 + passage, "s", "", ""), (6, "x " * 30_000 + passage, "s", "", ""),
    ]
    items = spark.createDataFrame([(7, passage, "q"), (7, passage, "q"), (8, None, "q"), (9, "too short", "q"), (None, passage, "q")], "item_id bigint, passage string, text string")
    found = find_passages(spark.createDataFrame(docs, DOCS), "doc_id", "text", items, "item_id", "passage")
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 7), (2, 7), (6, 7)]
    assert [(r.item_id, r.documents) for r in leaked_items(found).collect()] == [(7, 3)]
    assert find_passages(spark.createDataFrame([], DOCS), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert find_passages(spark.createDataFrame(docs, DOCS), "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_passages_with_replaced_words(spark):
    passage = [f"w{i}" for i in range(40)]
    texts = [" ".join("other" if i % 6 == 5 else w for i, w in enumerate(passage)), " ".join("other" if i % 5 == 4 else w for i, w in enumerate(passage))]
    docs = spark.createDataFrame([(i, t, "s", "", "") for i, t in enumerate(texts)], DOCS)
    found = find_passages(docs, "doc_id", "text", spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, passage string"), "item_id", "passage").collect()
    assert [(r.doc_id, r.covered) for r in found] == [(0, covered(texts[0], " ".join(passage)))] == [(0, 30)]


def test_passages_in_blocks(spark, monkeypatch):
    import darkroom.llm.leakage as leakage

    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 10)
    monkeypatch.setattr(leakage, "CHUNK_PHRASES", 3)
    items = [(i, " ".join(f"p{i}w{k}" for k in range(8))) for i in range(4)]
    docs = spark.createDataFrame([(i, p, "", "", "") for i, p in items], DOCS)
    found = find_passages(docs, "doc_id", "text", spark.createDataFrame(items, "item_id bigint, passage string"), "item_id", "passage")
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(4)]


@pytest.mark.parametrize("slop", [0, 1])
def test_phrases_equal_brute_force(spark, slop, monkeypatch):
    import darkroom.llm.leakage as leakage

    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 40)
    rng = random.Random(8)
    docs = [(f"d{i}", " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 14)))) for i in range(80)] + [(None, "a b c"), ("null", None), ("empty", "")]
    phrases = {" ".join(rng.choice("abcdefgz") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    index = inverted_index(spark.createDataFrame(docs, "id string, body string"), "id", "body")
    asked = spark.createDataFrame([(p,) for p in phrases] + [(None,), ("",), (min(phrases),)], "phrase string")
    got = {(r.phrase, r.doc_id, r.at) for r in find_phrases(index, asked, slop).collect()}
    frequency = Counter(w for i, t in docs if i and t for w in t.split())
    want = set()
    for p in phrases:
        w = p.split()
        anchor = min(range(len(w)), key=lambda k: (frequency[w[k]], k))  # the rarest word stands exactly, the others near their places
        for i, t in docs:
            d = (t or "").split()
            for at in range(-slop, len(d)):
                near = lambda k: any(0 <= q < len(d) and d[q] == w[k] for q in range(at + k - slop, at + k + slop + 1))  # noqa: E731, B023
                if i and 0 <= at + anchor < len(d) and d[at + anchor] == w[anchor] and all(near(k) for k in range(len(w))):
                    want.add((p, i, at))
    assert {g for g in got if g[2] >= -slop} == {w for w in want if w[2] >= -slop} and want
    assert find_phrases(index, asked.limit(0)).count() == 0


def test_many_repeats_of_a_passage_take_a_moment():
    begun = time.monotonic()
    assert longest_in_order([(i % 3, 60 * i, 40) for i in range(4000)]) == 42
    assert time.monotonic() - begun < 5


def test_token_counts_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(TOKENIZER)
    encoder.encode_special_tokens = True
    texts = ["Hello world", "", "naïve café 写真", "<|endoftext|>", "a" * 5000, None]
    got = {r.doc_id: r.tokens for r in token_counts(spark.createDataFrame([(i, t, "s", "", "") for i, t in enumerate(texts)], DOCS), "doc_id", "source", "text").collect()}
    assert got == {i: len(encoder.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def _corpus(spark, sizes):
    rows = [(n * 100_000 + i, "word " * 10, s, "", "") for n, (s, count) in enumerate(sizes) for i in range(count)]
    return spark.createDataFrame(rows, DOCS)


def test_mixture_reaches_its_shares(spark):
    docs = _corpus(spark, [("big", 3000), ("mid", 700), ("small", 150), (None, 50), ("untargeted", 40)])
    targets = spark.createDataFrame([("big", 0.4, 1, "x"), ("mid", 0.3, 2, "x"), ("small", 0.2, 4, "x"), ("absent", 0.1, 3, "x")], "source string, target_share double, max_repeats int, tokens string")
    drawn, report = mix(docs, "doc_id", "source", "text", targets)
    by = {r.source: r for r in report.collect()}
    copies = Counter((r.source, r.doc_id) for r in drawn.collect())
    assert {s for s, _ in copies} == {"big", "mid", "small"}
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(n <= caps[s] for (s, _), n in copies.items())
    for s, want in (("big", 0.4 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.2 / 0.9)):
        assert abs(by[s].actual_share - want) < 0.03 and by[s].rate <= caps[s] + 1e-9
        assert by[s].drawn_copies == sum(n for (x, _), n in copies.items() if x == s)
    assert by["absent"].actual_share == 0 and by["absent"].rate == 0
    records = mixture_records(docs, "doc_id", drawn).collect()
    assert Counter((r.source, r.doc_id) for r in records) == copies and {r.text for r in records} == {"word " * 10}
    again, _ = mix(docs.repartition(7), "doc_id", "source", "text", targets)
    assert Counter((r.source, r.doc_id) for r in again.collect()) == copies


def test_mixture_over_its_caps(spark):
    docs = _corpus(spark, [("a", 10), ("b", 10)])
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 5), ("c", None, None)], "source string, target_share double, max_repeats int")
    counts = token_counts(docs, "doc_id", "source", "text")
    rates = {r.source: r.rate for r in mixing_rates(counts, targets, size=1e9).collect()}
    assert rates == {"a": 2.0, "b": 5.0, "c": 0.0}
    empty = token_counts(docs.limit(0), "doc_id", "source", "text")
    assert {r.rate for r in mixing_rates(empty, targets).collect()} == {0.0}
    drawn, report = mix(docs.limit(0), "doc_id", "source", "text", targets)
    assert drawn.count() == 0 and report.count() == 3


QUOTED = "bob wrote:\n> Never trust a goal.\n> > Older.\n\n[quote=ann][quote]Deep.[/quote] Outer.[/quote]\n<blockquote>Block <blockquote>inner</blockquote> end.</blockquote>\nMy own line. Is it mine? It is so.<br>Second &amp; last!\n-- \nSent from my potato"


def test_own_sentences():
    assert sentences(QUOTED) == ["My own line.", "Is it mine? It is so.", "Second & last!"]
    assert "potato" not in own_text("Text one.\n____\nSent from my potato") and "potato" not in own_text("Text one.<hr>my potato") and "potato" not in own_text("Text one.\n\nmy potato here")
    assert sentences("") == [] and sentences("> all quoted") == [] and sentences("one\nwrapped line.") == ["one wrapped line."]
    assert sentences("[quote]never closed. Text.") != []


def _subject_tables(spark):
    nouns = {"sport": ["goal", "referee", "league", "stadium", "sprint"], "music": ["violin", "chord", "encore", "tempo", "snare"]}
    rng = random.Random(1)
    say = lambda s: " ".join(rng.choice(["Never trust the {} with a {}.", "I swear the {} beats every {}.", "First the {}, then the {}."]).format(*rng.sample(nouns[s], 2)) for _ in range(3))
    examples = [(i, say(s), s) for i, s in enumerate(["sport", "music"] * 15)] + [(100 + i, "Thanks, that helped. No need to shout.", None) for i in range(5)]
    subjects = spark.createDataFrame([("sport", ""), ("music", ""), (None, "")], "subject string, description string")
    return spark.createDataFrame(examples, "example_id bigint, text string, subject string"), subjects, say


def test_subjects(spark):
    examples, subjects, say = _subject_tables(spark)
    rng = random.Random(6)
    docs = [(i, say(s) + " Thanks, that helped.", s, "", "") for i, s in ((i, rng.choice(["sport", "music"])) for i in range(60))]
    small = [(200, "Thanks, that helped. No need to shout.", None, "", ""), (201, None, None, "", ""), (202, "", None, "", ""), (203, "> " + say("sport").replace("\n", " "), None, "", ""), (None, say("sport"), None, "", "")]
    both = [(300, say("sport") + " " + say("music"), "both", "", ""), (300, "x", None, "", "")]
    long = [(400, "No need to shout. " * 2000 + say("music"), None, "", "")]
    frame = spark.createDataFrame(docs + small + both + long, DOCS)
    got = {}
    for r in assign_subjects(frame, "doc_id", "text", examples, subjects).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got.get(i) == {s} for i, _, s, *_ in docs)
    assert not {200, 201, 202, 203, 400} & set(got) and got[300] == {"sport", "music"}


def test_subjects_of_nothing(spark):
    examples, subjects, say = _subject_tables(spark)
    empty = spark.createDataFrame([], DOCS)
    assert assign_subjects(empty, "doc_id", "text", examples, subjects).count() == 0
    one = spark.createDataFrame([(1, say("sport"), "", "", "")], DOCS)
    assert assign_subjects(one, "doc_id", "text", examples.limit(0), subjects).count() == 0
    report = composition(one, "doc_id", "text", assign_subjects(one, "doc_id", "text", examples, subjects)).collect()
    assert [(r.subject, r.posts, r.share_of_posts) for r in report] == [("sport", 1, 1.0)]


def test_held_out_examples(spark, data):
    """Precision and recall on the fifth of the labelled examples that took no part in fit and calibration, their terms being weighed on the corpus."""
    rows = spark.read.parquet(f"{data}/subject_examples.parquet").collect()
    fit = spark.createDataFrame([r for r in rows if r.example_id % 5])
    held = [r for r in rows if r.example_id % 5 == 0]
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.1/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-r.example_id - 1, r.text) for r in held], "doc_id bigint, text string"))
    found = {(-r.doc_id - 1, r.subject) for r in assign_subjects(docs, "doc_id", "text", fit, spark.read.parquet(f"{data}/subjects.parquet")).filter("doc_id < 0").collect()}
    want = {(r.example_id, r.subject) for r in held if r.subject}
    print("held-out precision", len(found & want) / len(found), "recall", len(found & want) / len(want))
    assert len(found & want) / len(found) >= 0.9 and len(found & want) / len(want) >= 0.9


def test_interjections_are_sentences():
    assert sentences("lol Any news on this? +1 :-) Fair enough.") == ["lol", "Any news on this?", "+1", ":-)", "Fair enough."]
    assert sentences("I agree.\n\nEdit: lol") == ["I agree.", "Edit: lol"] and sentences("Lollipops are fine. Plus +12 more.") == ["Lollipops are fine.", "Plus +12 more."]
    assert len(sentences("I agree.\n\nan unfinished sentence of more words than any signature has stays here")) == 2
    assert sentences("Is it new? That answer helped.") == ["Is it new?", "That answer helped."]


def test_sentences_before_a_closing_line_stay():
    assert sentences("I agree.\n\nGracias, me sirvió. Sent from my awkward potato") == ["I agree.", "Gracias, me sirvió."]
    assert sentences("I agree.\n\nNot what I meant, but fine.<br>Sent from my potato") == ["I agree.", "Not what I meant, but fine."]
    assert sentences("I agree.\n\nSent from my awkward potato") == sentences("I agree.\n\n<p>Sent from my potato</p>") == ["I agree."]
