import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import lm
from foliospark.llm.queries import QUERIES


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["\n"]


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in table}
    counts = Counter()
    for r in table:
        if not held[r.doc_id]:
            counts.update(tokens(r.text))
    total, types = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in QUERIES["op7_lm"](spark, SF_DIR).collect()}
    assert len(found) == len(table)
    for doc_id, text in table:
        row, words = found[doc_id], tokens(text)
        assert row.held_out == held[doc_id]
        assert (row.n_tokens, row.train_tokens) == (len(words), total)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        assert row.score < 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    found = QUERIES["op7_lm"](spark, SF_DIR.replace("0.001", "0.01")).filter("held_out")
    known = found.filter("n_known >= 0.97 * n_tokens")
    sums = known.agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert sums[2] > 10 and sums[0] > sums[1]


def small_words():
    names = [b"\n", b"the", b"of", b"sea", b"moon", b"tide"]
    return lm.Words.of(names, [9, 8, 5, 3, 2, 2], 4)


def drawn_counts(seed, slots):
    counts = np.random.RandomState(seed).randint(0, 9, (2, slots))
    return lm.Slots(counts.astype(np.uint16))


def drawn_mixer(seed, inputs, gates):
    mixer = lm.Mixer.fresh(inputs, gates)
    mixer.weights += np.random.RandomState(seed).uniform(-0.1, 0.1, mixer.weights.shape).astype(np.float32)
    return mixer


def test_the_code_is_that_of_huffman():
    weights = [50, 1, 1, 20, 7, 7, 3, 0, 11]
    code = lm.Code.build(weights)
    sizes = np.diff(code.starts)
    assert sum(2.0**-n for n in sizes) == 1
    ways = ["".join(map(str, code.bits[a:b])) for a, b in zip(code.starts, code.starts[1:])]
    assert not any(a != b and b.startswith(a) for a in ways for b in ways)
    total, left = 0, sorted(weights)
    while len(left) > 1:  # the least sum of weight times length
        merged = left.pop(0) + left.pop(0)
        total += merged
        left = sorted([*left, merged])
    assert sum(w * n for w, n in zip(weights, sizes)) == total
    assert lm.Code.build([3]).starts.tolist() == [0, 0]


def test_symbols_after_the_same_words_are_a_distribution():
    words = small_words()
    counts, mixer = drawn_counts(1, lm.WORD_SLOTS), drawn_mixer(2, lm.CONTEXTS, lm.WORD_GATES)
    for beginning in ([], [1], [3, 1], [2, words.escape, 4]):
        total = 0.0
        for symbol in range(words.escape + 1):
            text = np.array([*beginning, symbol])
            cost = lm.word_costs(text, np.array([0]), words, counts, mixer)
            total += 10 ** cost[-1]
        assert math.isclose(total, 1, rel_tol=1e-4)


def test_bits_of_all_words_of_a_length_are_a_distribution():
    counts, mixer = drawn_counts(3, lm.SPELL_SLOTS), drawn_mixer(4, len(lm.SPELL_BITS), lm.SPELL_GATES)
    # After the same beginning, all possible next bytes share the probability 1.
    heads = [b"ab" + bytes([k]) for k in range(256) if k not in (0x20, 0x0A)]
    word, byte, hashes = lm.letters(heads)
    third = np.arange(len(heads)) * 4 + 2
    total = np.zeros(len(heads))
    for place in range(8):
        slots, value = lm.letter_slots(hashes, byte, place)
        logits, sure = counts.predict(slots, value, 0)
        total += mixer.costs(logits, place * lm.STEPS + sure, value)[third]
    assert 0.9 < (10**total).sum() < 1


def plain_cost(logits, gate, bit, mixer):
    """log10 of a bit's probability by scalar arithmetic."""
    summed = float(mixer.weights[-1][gate])
    summed += sum(float(w[gate]) * x for w, x in zip(mixer.weights, logits))
    summed = min(max(summed, -lm.MOST), lm.MOST)
    at = (summed + lm.MOST) / (2 * lm.MOST) * (lm.MAP_STEPS - 1)
    low = min(int(at), lm.MAP_STEPS - 2)
    table = mixer.refined[gate]
    refined = table[low] + (table[low + 1] - table[low]) * (at - low)
    p = (1 / (1 + math.exp(-summed)) + refined) / 2
    p = min(max(p, 2.0**-16), 1 - 2.0**-16)
    return math.log10(p if bit else 1 - p)


def hashed(value, salt):
    return int(lm.mixed(np.array([value], np.uint64), salt)[0])


def slot(context, node, bits):
    spread = (context + node * 0xD6E8FEB86659FD93) % 2**64
    return (spread * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def plain_slots(history, node):
    """The slots of a node after these symbols, in scalar arithmetic."""
    start = lm.FREQUENT + 1
    last = [min(s, lm.FREQUENT) for s in history[-2:]]
    before = last[-1] if last else start
    earlier = last[-2] if len(last) > 1 else start
    found = [node]
    for k, value in enumerate((before, before * (lm.FREQUENT + 2) + earlier)):
        at = slot(hashed(value, 41 + k), node, lm.WORD_BITS)
        found.append(at + lm.TABLE + 1 + (k << lm.WORD_BITS))
    return found


def plain_logits(counts, slots):
    seen = [(int(counts.counts[0][s]), int(counts.counts[1][s])) for s in slots]
    logits = [math.log((n1 + lm.DELTA) / (n0 + lm.DELTA)) for n0, n1 in seen]
    return logits, sum(sum(seen[-1]) > step for step in lm.CONFIDENCE)


def test_costs_against_a_plain_loop(monkeypatch):
    words = small_words()
    counts, mixer = drawn_counts(5, lm.WORD_SLOTS), drawn_mixer(6, lm.CONTEXTS, lm.WORD_GATES)
    texts = [[1, 3, 2, 4, 0], [0], [6, 6, 1, 5, 0]]
    expected = []
    for text in texts:
        for at, symbol in enumerate(text):
            a, b = words.code.starts[symbol], words.code.starts[symbol + 1]
            cost = 0.0
            for depth, (node, bit) in enumerate(zip(words.code.nodes[a:b], words.code.bits[a:b])):
                logits, sure = plain_logits(counts, plain_slots(text[:at], int(node)))
                cost += plain_cost(logits, min(depth, lm.DEEPEST) * lm.STEPS + sure, bit, mixer)
            expected.append(cost)
    whole = np.array([s for text in texts for s in text])
    begins = np.array([0, 5, 6])
    for tokens in (2, 50_000):  # slices do not matter
        monkeypatch.setattr(lm, "TOKENS", tokens)
        found = lm.word_costs(whole, begins, words, counts, mixer)
        assert np.allclose(found, expected, rtol=1e-4, atol=1e-5)


def test_spellings_against_a_plain_loop():
    counts, mixer = drawn_counts(7, lm.SPELL_SLOTS), drawn_mixer(8, len(lm.SPELL_BITS), lm.SPELL_GATES)
    words = [b"tide", b"a", "ünd".encode()]
    expected = []
    for word in words:
        data, cost = b" " + word + b" ", 0.0
        for at in range(1, len(data)):
            hashes, recent = [hashed(0, 0)], 0
            for order in range(1, len(lm.SPELL_BITS)):
                if at - order >= 0:
                    recent = (recent << 8) | data[at - order]
                hashes.append(hashed(recent, order))
            for place in range(8):
                node = (1 << place) | (data[at] >> (8 - place))
                slots = [node]
                for k in range(1, len(lm.SPELL_BITS)):
                    slots.append(lm.SPELL_STARTS[k] + slot(hashes[k], node, lm.SPELL_BITS[k]))
                logits, sure = plain_logits(counts, slots)
                bit = (data[at] >> (7 - place)) & 1
                cost += plain_cost(logits, place * lm.STEPS + sure, bit, mixer)
        expected.append(cost)
    assert np.allclose(lm.spelled(words, counts, mixer), expected, rtol=1e-4, atol=1e-4)


def test_own_occurrences_are_left_out():
    counts = np.array([[3, 0], [1, 5]], np.uint16)
    slots = np.array([[0, 0, 1]])
    logits, sure = lm.Slots(counts).predict(slots, np.array([0, 1, 0]), 1)
    wanted = [math.log(1.4 / 2.4), math.log(0.4 / 3.4), math.log(5.4 / 0.4)]
    assert np.allclose(logits[0], wanted) and sure.tolist() == [2, 2, 2]


def test_huge_counts_are_halved_alike():
    found = lm.fitted(np.array([[4e9, 2.0], [1e9, 0.0]]))
    assert found.dtype == np.uint16 and found.max() <= lm.MOST_SEEN
    assert abs(found[0][0] / found[1][0] - 4) < 0.01 and found[:, 1].tolist() == [2, 0]


def test_online_steps_lower_the_cost():
    words = [b"aba", b"abab", b"cab"] * 50
    counts = np.zeros((2, lm.SPELL_SLOTS))
    word, byte, hashes = lm.letters(words)
    for place in range(8):
        slots, value = lm.letter_slots(hashes, byte, place)
        for row in slots:
            np.add.at(counts, (value, row), 1)
    counts = lm.Slots(lm.fitted(counts))
    mixer = lm.Mixer.fresh(len(lm.SPELL_BITS), lm.SPELL_GATES)
    before = lm.spelled(words, counts, mixer).sum()
    for _ in range(20):
        for place in range(8):
            slots, value = lm.letter_slots(hashes, byte, place)
            logits, sure = counts.predict(slots, value, 1)
            mixer.learn(logits, place * lm.STEPS + sure, value, np.ones(len(value), np.float32))
    assert lm.spelled(words, counts, mixer).sum() > before


def test_the_order_of_words_matters(spark):
    line = "the cat sat on the mat and the dog lay by the door while rain fell on the old stone road"
    words = line.split()
    turned = [words[k * 5 % len(words)] for k in range(len(words))]
    rows = [(n, f"{line} {n % 5} {line}") for n in range(60)]
    rows += [(100, line), (101, " ".join(turned))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(frame, F.col("doc_id") < 60).collect()}
    assert math.isclose(found[100].base_score, found[101].base_score, rel_tol=1e-9)
    assert found[100].score > 0.5 * found[101].score


def test_weights_and_counts_cover_all_training_rows(spark, monkeypatch):
    rows = [(n, f"w{n % 7} w{n % 11} x{n} y{n}") for n in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    for name in ("fit_word_mixer", "fit_letter_mixer", "count_word_contexts", "count_letter_contexts"):

        def run(rows, *more, name=name, fit=getattr(lm, name)):
            seen[name] = rows.collect()
            return fit(rows, *more)

        monkeypatch.setattr(lm, name, run)
    lm.score(frame, F.col("doc_id") < 150).collect()
    for name in ("fit_word_mixer", "count_word_contexts"):
        assert sum(sum(row.training) for row in seen[name]) == 150
    for name in ("fit_letter_mixer", "count_letter_contexts"):
        assert sum(row.c for row in seen[name]) == 300  # the words seen once


def test_odd_rows(odd_documents):
    found = lm.score(odd_documents, F.col("doc_id") < 5).collect()
    assert len(found) == odd_documents.count()
    for row in found:
        assert math.isfinite(row.score) and row.score <= 0
        if row.doc_id in (1, 2, 3):
            assert row.n_tokens == 1
    untrained = lm.score(odd_documents, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in untrained} == {(0, 0, 0.0)}
    texts = {r.doc_id: r.text for r in odd_documents.filter("doc_id IS NOT NULL").collect()}
    for row in untrained:
        if row.doc_id is not None:
            bits = sum(8 * (len(w.encode()) + 1) for w in tokens(texts[row.doc_id]))
            assert math.isclose(row.score, -bits * math.log10(2), rel_tol=1e-4)
    assert lm.score(odd_documents.filter(F.lit(False)), F.lit(True)).isEmpty()


def count_mixed(monkeypatch):
    """The number of bits of every later call of ``Mixer.costs``."""
    mixed, costs = [], lm.Mixer.costs

    def run(self, logits, gate, bit):
        mixed.append(len(bit))
        return costs(self, logits, gate, bit)

    monkeypatch.setattr(lm.Mixer, "costs", run)
    return mixed


def test_equal_tokens_are_predicted_once(monkeypatch):
    words = small_words()
    counts, mixer = drawn_counts(9, lm.WORD_SLOTS), drawn_mixer(10, lm.CONTEXTS, lm.WORD_GATES)
    text = [1, 3, 2, words.escape, 4, 0]
    once = lm.word_costs(np.array(text), np.array([0]), words, counts, mixer)
    mixed = count_mixed(monkeypatch)
    whole, begins = np.array(text * 500), np.arange(0, 3000, 6)
    found = lm.word_costs(whole, begins, words, counts, mixer)
    assert np.allclose(found, np.tile(once, 500), rtol=1e-12)
    assert sum(mixed) == np.diff(words.code.starts)[text].sum()
    monkeypatch.setattr(lm, "PIECE", 7)  # pieces do not matter
    assert np.allclose(lm.word_costs(whole, begins, words, counts, mixer), found, rtol=1e-12)
    assert len(lm.word_costs(np.zeros(0, np.int64), np.zeros(0, np.int64), words, counts, mixer)) == 0


def test_equal_letters_are_predicted_once(monkeypatch):
    counts, mixer = drawn_counts(11, lm.SPELL_SLOTS), drawn_mixer(12, len(lm.SPELL_BITS), lm.SPELL_GATES)
    # A byte of 0 must not be taken for the lack of one.
    words = [b"tide", b"\0", b"\0\0", b"a\0", b"\0a\0\0\0\0", b"", b"tidetide", "ünd".encode()]
    alone = [float(lm.spelled([word], counts, mixer)[0]) for word in words]
    for word, cost in zip(words, alone):  # against all bytes one by one
        _, byte, hashes = lm.letters([word])
        plain = 0.0
        for place in range(8):
            slots, value = lm.letter_slots(hashes, byte, place)
            logits, sure = counts.predict(slots, value, 0)
            plain += mixer.costs(logits, place * lm.STEPS + sure, value).sum()
        assert math.isclose(plain, cost, rel_tol=1e-5)
    mixed = count_mixed(monkeypatch)
    found = lm.spelled(words * 300, counts, mixer)
    assert np.allclose(found, alone * 300, rtol=1e-6)
    assert sum(mixed) <= 8 * sum(len(word) + 1 for word in words)
    monkeypatch.setattr(lm, "PIECE", 5)
    assert np.allclose(lm.spelled(words * 3, counts, mixer), alone * 3, rtol=1e-6)


def test_slots_are_counted_as_by_a_plain_loop(spark):
    context, words = spark.sparkContext, small_words()
    texts = ["the sea the sea the moon", "of", "", "the gull the sea", "the gull the sea"]
    used = [True, True, True, True, False]
    rows = spark.createDataFrame(
        [(k, u, bytearray(t.encode())) for k, (t, u) in enumerate(zip(texts, used))],
        "id long, training boolean, data binary",
    )
    index, expected = {w: k for k, w in enumerate(words.words)}, np.zeros((2, lm.WORD_SLOTS))
    for text, learned in zip(texts, used):
        symbols = [index.get(w, words.escape) for w in lm.tokens_of(text.encode())]
        for at, symbol in enumerate(symbols if learned else []):
            a, b = words.code.starts[symbol], words.code.starts[symbol + 1]
            for node, bit in zip(words.code.nodes[a:b], words.code.bits[a:b]):
                for slot_at in plain_slots(symbols[:at], int(node)):
                    expected[bit, slot_at] += 1
    shared = context.broadcast(words)
    found = lm.count_word_contexts(lm.code_texts(rows, shared), shared)
    assert (found == expected).all()


def test_letters_are_counted_as_by_a_plain_loop(spark):
    rare = [(b"tide", 3), (b"tid", 1), (b"\0", 2), (b"\0\0", 5), (b"etide", 4)] * 2
    expected = np.zeros((2, lm.SPELL_SLOTS))
    for word, c in rare:
        _, byte, hashes = lm.letters([word])
        for place in range(8):
            slots, value = lm.letter_slots(hashes, byte, place)
            for row in slots:
                np.add.at(expected, (value, row), c)
    frame = spark.createDataFrame([(bytearray(w), c) for w, c in rare], "word binary, c long")
    assert (lm.count_letter_contexts(frame) == expected).all()


def test_bits_without_weights_are_alike():
    drawn = np.random.RandomState(13)
    logits = drawn.normal(size=(lm.CONTEXTS, 5000)).astype(np.float32)
    gate, bit = drawn.randint(0, lm.WORD_GATES, 5000), drawn.randint(0, 2, 5000)
    mixers = [drawn_mixer(14, lm.CONTEXTS, lm.WORD_GATES) for _ in range(2)]
    for _ in range(3):
        mixers[0].learn(logits, gate, bit)
        mixers[1].learn(logits, gate, bit, np.ones(5000, np.float32))
    assert (mixers[0].flat() == mixers[1].flat()).all()


def test_texts_are_split_as_one_by_one():
    texts = [b"", b" \t\n\x0b\x0c\r ", b"  Ab\x0bcD ", b"\x1cQ\x85", "ÄB\u00a0c\u2003d É".encode()]
    texts += [b"\0 \0A", b"\xff\xfeZ \xc3", b"x"]
    for part in (texts, texts[::-1], [], [b""]):
        for first in range(min(len(part), 3) + 1):  # also of a slice
            rows = pa.array([b"other text", *part], pa.binary())[first + 1 :]
            found, sizes = lm.split_texts(rows)
            wanted = [lm.tokens_of(text) for text in part[first:]]
            assert found.to_pylist() == [w for words in wanted for w in words]
            assert sizes.tolist() == [len(words) for words in wanted]
