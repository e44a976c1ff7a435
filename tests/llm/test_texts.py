"""Rules, language, winnowing and the network against slow versions of themselves."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import awkward_rows, prose, rows, texts

from tidewater.llm import convnet, language, rules, winnow
from tidewater.llm.common import Powers, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def labels_of(spark, good):
    return spark.createDataFrame([(d, 1) for d in good] + [(999, 0)], "doc_id long, quality int")


def test_rule_measures_and_scores_are_those_of_a_slow_count(spark, awkward):
    good = [0, 1, 2, 3, 4]
    ratios = rules.log_ratios(awkward, labels_of(spark, good))
    grams, trusted = Counter(), Counter()

    def buckets(text):
        return rules.ngram_buckets(words_of(pa.array([text]), Powers()))[0].tolist()

    for doc, text in texts():
        found = Counter(buckets(text))
        grams += found
        if doc in good:
            trusted += found
    size = 1 << rules.BUCKET_BITS
    prior = {b: (grams[b] + 1) / (grams.total() + size) for b in grams}
    slow = {b: np.log((trusted[b] + size * p) / (trusted.total() + size) / p) for b, p in prior.items()}
    got = {}
    for r in rules.apply_rules(awkward, ratios).collect():
        got.setdefault(r["doc_id"], r)
    for doc, text in texts():
        r = got[doc]
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_measures(text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        found = buckets(text)
        want = sum(slow[b] for b in found) / max(len(found), 1)
        assert abs(r["score"] - want) < 1e-9 and r["kept"] == (not r["base_failed"] and r["score"] >= rules.THRESHOLD)


def test_rules_keep_whole_rows(spark, awkward, nothing):
    kept = rules.keep_good(awkward, labels_of(spark, [0, 1, 2]))
    verdicts = rules.apply_rules(awkward, rules.log_ratios(awkward, labels_of(spark, [0, 1, 2])))
    assert kept.columns == awkward.columns
    assert rows(kept, "doc_id") == rows(verdicts.where("kept"), "doc_id")
    assert rules.keep_good(nothing, labels_of(spark, [])).count() == 0
    assert not rules.log_ratios(nothing, labels_of(spark, [])).any()


def slow_phrases(codes, training):
    """Greedy longest matches by plain search; unknown letters are phrases of their own."""
    count = at = 0
    while at < len(codes):
        size = 0
        while at + size < len(codes) and codes[at:at + size + 1] in training:
            size += 1
        at += max(size, 1)
        count += 1
    return count


def test_automata_know_every_substring_and_how_often_it_occurs():
    text = [1, 2, 1, 2, 3, 1, 2, 2, 1, 1, 2, 3, 1]
    automaton = language.Automaton(text)
    step = {(s, c): t for s, c, t in automaton.edges.tolist()}
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            state = 0
            for c in text[a:b]:
                state = step[state, c]
            times = sum(text[i:i + b - a] == text[a:b] for i in range(len(text)))
            assert round(float(np.expm1(automaton.weight[state]))) == times
    assert all((0, c) not in step for c in (4, 5))


def test_fewest_phrases_win():
    samples = {"aa": ["the cat sat on the mat and then the cat ran " * 3], "bb": ["der hund lief und dann lag der hund dort " * 3]}
    model = language.build_model(samples)
    parser, table = language.Parser(model), language.letter_table()
    text_of = {k: "".join(map(chr, language.letters_of(v[0], table))) for k, v in samples.items()}
    for text in ("The cat and the hund!", "dort lag der Hund 77 und lief", "mat", "zzz qqq", "Der cat"):
        codes = "".join(map(chr, language.letters_of(text, table)))
        found = {k: slow_phrases(codes, t) for k, t in text_of.items()}
        (name,), (score,) = parser.predict([text])
        assert found[name] == min(found.values())
        assert abs(score - (1 - min(found.values()) / max(found.values()))) < 1e-9
    assert parser.predict([None, "", "12 !", "\U0001D7D8"]) [0] == ["und"] * 4
    assert language.Parser(language.build_model({})).predict(["text"])[0] == ["und"]


def test_scripts_of_any_number_of_letters_are_told_apart():
    rng = random.Random(11)
    scripts = {"el": (0x3B1, 24), "en": (0x61, 26), "ko": (0xAC00, 900), "ru": (0x430, 32), "zh": (0x4E00, 1200)}
    words = {k: ["".join(chr(first + int(n * rng.random() ** 2)) for _ in range(rng.randint(1, 6)))
                 for _ in range(300)] for k, (first, n) in scripts.items()}
    # A second language of the same wide script has other words of the same letters.
    words["ja"] = ["".join(rng.choice(words["zh"])[0] for _ in range(rng.randint(2, 4))) for _ in range(300)]
    prose = {k: [" ".join(rng.choice(w) for _ in range(400)) for _ in range(2)] for k, w in words.items()}
    model = language.build_model({k: texts[:1] for k, texts in prose.items()})
    parser, table = language.Parser(model), language.letter_table()
    assert len(model["alphabet"]) > 1000 and language.ABSENT not in model["alphabet"].values()
    text_of = {k: "".join(map(chr, language.letters_of(v[0], table))) for k, v in prose.items()}
    for name, (_, fresh) in prose.items():
        mixed = fresh + " " + prose["zh"][1][:100] + " \u05d0\u05d1 \u0e01"
        for text in (fresh, mixed):
            codes = "".join(map(chr, language.letters_of(text, table)))[:language.SEGMENT]
            found = {k: slow_phrases(codes, t) for k, t in text_of.items()}
            (guess,), (score,) = parser.predict([codes[1:-1].replace("\0", " ")])
            inner = language.letters_of(codes[1:-1].replace("\0", " "), table)
            if len(inner) <= language.SEGMENT:
                slow = {k: slow_phrases("".join(map(chr, inner)), t) for k, t in text_of.items()}
                low, next_low = sorted(slow.values())[:2]
                assert slow[guess] == low and abs(score - (1 - low / next_low)) < 1e-9
            assert guess == name == min(found, key=found.get)


def test_every_text_of_a_language_gives_an_equal_share():
    parts = [np.arange(n) for n in (100, 3, 50, 0, 40)]
    cut = language.equal_shares(parts, 93)
    assert [len(c) for c in cut] == [30, 3, 30, 0, 30] and sum(map(len, language.equal_shares(parts, 500))) == 193


def test_languages_of_awkward_rows(spark, awkward, nothing):
    model = language.learn(awkward)
    got = language.identify(awkward, model)
    lettered = {d for d, t in texts() if any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in got.where("lang_pred <> 'und'").collect()} == lettered
    assert set(model["languages"]) == {"de", "en"} and got.where("score < 0 or score > 1").count() == 0
    kept = language.keep_known(awkward, model)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == lettered
    assert language.keep_known(nothing, language.learn(nothing)).count() == 0


def test_winnowing_selects_the_rightmost_minimum_and_guarantees_matches():
    rng = np.random.default_rng(1)
    powers = Powers()
    for codes in (rng.integers(97, 100, 300), np.full(200, 97), rng.integers(0, 1 << 20, 90), np.arange(5), np.arange(0)):
        codes = codes.astype("<u4")
        hashes, positions = winnow.select(codes, powers, 4, 6)
        n = max(len(codes) - 3, 0) if len(codes) >= 4 else min(len(codes), 1)
        every = [int(winnow.select(codes[i:i + 4], powers, 4, 6)[0][0]) for i in range(n)]
        want = []
        for i in range(max(n - 5, 1) if n else 0):
            window = every[i:i + 6]
            at = i + max(k for k, h in enumerate(window) if h == min(window))
            if not want or want[-1] != at:
                want.append(at)
        assert positions.tolist() == want and hashes.tolist() == [every[p] for p in want]
        back = winnow.unpacked(winnow.packed(hashes, positions))
        assert back[0].tolist() == hashes.tolist() and back[1].tolist() == positions.tolist()
    shared = rng.integers(0, 1000, 9)
    one = np.concatenate([rng.integers(0, 1000, 40), shared]).astype("<u4")
    two = np.concatenate([shared, rng.integers(0, 1000, 50)]).astype("<u4")
    assert set(winnow.select(one, powers, 4, 6)[0]) & set(winnow.select(two, powers, 4, 6)[0])


@pytest.mark.parametrize("n", [20, 60, 90, 127, 150, 255, 300, 511, 600, 2000])
def test_texts_of_any_length_meet_their_own_half_and_not_another_text(n):
    rng, powers = random.Random(n), Powers()

    def print_of(text):
        return np.unique(winnow.select_all(winnow._codes(text), powers)[0])

    for _ in range(40):
        one, other = prose(rng, n)[:n], prose(rng, n)[:n]
        half = n // 2
        for edited in (one[:n - half] + other[:half], one[:n - half] + "?"):
            near = winnow.likeness(print_of(one), print_of(edited))
            assert near > 0.02 + winnow.likeness(print_of(one), print_of(other))


def test_edited_pairs_follow_descending_ids(awkward, nothing, spark):
    got = [tuple(r) for r in winnow.edited_pairs(awkward).collect()]
    low = -(1 << 63)
    held = sorted(((low if d is None else d, t) for d, t in texts()), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (doc, text) in enumerate(held):
        after = held[(i + 1) % len(held)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, text, after))

    def print_of(text):
        return winnow.select_all(winnow._codes(text), Powers())

    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (-r[0], r[1], r[2])), sorted(want, key=lambda r: (-r[0], r[1], r[2]))):
        assert g[:3] == w[:3]
        assert g[3] == winnow.packed(*print_of(w[4])) and g[4] == winnow.packed(*print_of(w[3]))
        sets = [set(print_of(t)[0].tolist()) for t in (w[4], w[3], w[5])]
        for value, other in zip(g[5:], sets[1:]):
            union = len(sets[0] | other)
            assert abs(value - (len(sets[0] & other) / union if union else 1.0)) < 1e-12
    assert winnow.edited_pairs(nothing).count() == 0
    single = spark.createDataFrame([(1, "abcd" * 30)], "doc_id long, text string")
    assert winnow.edited_pairs(single).first()["near_next"] == 1.0


def slow_score(model, text):
    raw = np.full(max(-(-len(text) // 256), 2) * 256, convnet.PAD)
    raw[:len(text)] = list(text)
    x = model["embedding"][raw].astype(float)
    features = []
    for at in range(0, len(raw) - 256, 256):
        windows = [x[p:p + 16].reshape(-1) @ model["filters"] for p in range(at, at + 512 - 15, 8)]
        features.append(np.maximum(np.max(windows, axis=0) + model["bias"], 0))
    return 1 / (1 + np.exp(-(np.mean(features, axis=0) @ model["weights"] + model["offset"][0])))


def test_scores_are_those_of_a_plain_convolution():
    model = convnet.start_values(3)
    held = [t for _, t in texts() if len(t) < 5000]
    got = convnet.score_texts(model, held)
    assert np.allclose(got, [slow_score(model, t.encode()) for t in held], atol=1e-5)
    assert np.allclose(convnet.score_texts(model, [None, ""]), convnet.score_texts(model, [""])[0])


def test_gradients_fit_finite_differences():
    rng = np.random.default_rng(0)
    model = {k: v.astype(float) for k, v in convnet.start_values(5).items()}
    chunks = rng.integers(0, 257, (6, convnet.CHUNK))
    doc, counts, labels = np.array([0, 0, 1, 2, 2, 2]), np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        half = convnet.STRIDE * convnet.EMBEDDING
        x = m["embedding"][chunks].reshape(len(chunks), -1, half)
        top = (x[:, :-1] @ m["filters"][:half] + x[:, 1:] @ m["filters"][half:]).max(axis=1) + m["bias"]
        mean = np.stack([np.maximum(top, 0)[doc == d].mean(axis=0) for d in range(3)])
        z = mean @ m["weights"] + m["offset"][0]
        return np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels))

    grads = convnet._gradient(model, chunks, doc, counts, labels)
    for name in convnet.PARTS:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in model[name].shape)
            high, low = ({k: v.copy() for k, v in model.items()} for _ in range(2))
            high[name][at] += 1e-6
            low[name][at] -= 1e-6
            assert abs((loss(high) - loss(low)) / 2e-6 - grads[name][at]) < 1e-5


def test_the_network_learns_held_out_rows(spark):
    import random

    rng = random.Random(1)
    held = [(i, prose(rng, 60) if i % 3 else "*** ".join(prose(rng, 60).split(" "))) for i in range(300)]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    model = convnet.train(*convnet.training_chunks(docs, known), steps=150)
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in convnet.score(docs.where("doc_id >= 200"), model).collect()]
    assert np.mean(right) > 0.95


def test_the_network_scores_awkward_rows(spark, awkward, nothing):
    model = convnet.train(*convnet.training_chunks(awkward, labels_of(spark, [0, 1])), steps=5)
    got = convnet.score(awkward, model)
    assert got.count() == len(awkward_rows()) and got.where("score is null or score < 0 or score > 1").count() == 0
    empty = convnet.training_chunks(nothing, labels_of(spark, []))
    assert convnet.score(nothing, convnet.train(*empty)).count() == 0
