"""The language network and the toxicity score of single texts, byte by byte and sentence by sentence in plain loops."""

import math
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import kernel, langid, toxicity

TEXTS = ["The cat sat on the mat. Der Hund läuft! É un gatto?\nwords and more words", "x", "á" * 150 + " tail of it", "one two three " * 40, "Ünï\ncödé 中文 ok. yes no"]


def sigmoid(v):
    return 1 / (1 + math.exp(-v))


def slow_language(m, text):
    """Mean probabilities over a text's bytes: a gated unit in either direction over stretches, one position at a time."""
    raw, hidden = text.encode(), m.recurrent[0].shape[1]
    total = [0.0] * len(m.langs)
    for first in range(0, len(raw), langid.STRETCH):
        part = raw[first : first + langid.STRETCH]
        states = []
        for d, order in enumerate((part, part[::-1])):
            h, own = [0.0] * hidden, []
            for byte in order:
                a = [float(m.embedded[d][k, byte]) + sum(float(m.recurrent[d][k, j]) * h[j] for j in range(hidden)) for k in range(2 * hidden)]
                h = [(1 - sigmoid(a[k])) * h[k] + sigmoid(a[k]) * math.tanh(a[hidden + k]) for k in range(hidden)]
                own.append(h)
            states.append(own if d == 0 else own[::-1])
        for ahead, back in zip(*states, strict=True):
            out = [float(m.bias[k]) + sum(float(m.out[0][k, j]) * ahead[j] + float(m.out[1][k, j]) * back[j] for j in range(hidden)) for k in range(len(m.langs))]
            top = max(out)
            shares = [math.exp(v - top) for v in out]
            for k, v in enumerate(shares):
                total[k] += v / sum(shares)
    return [v / len(raw) for v in total]


def test_language_is_that_of_a_loop():
    m = langid.fit([("en", b"the cat and the dog " * 5), ("fr", b"le chat et le chien " * 5), ("de", b"der Hund und die Katze " * 5)], rounds=4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["row", "text"])
    (got,) = langid._predict(m)(iter([batch]))
    for k, text in enumerate(TEXTS):
        want = slow_language(m, text)
        best = max(range(len(want)), key=want.__getitem__)
        assert got.column(1)[k].as_py() == m.langs[best] and abs(got.column(2)[k].as_py() - want[best]) < 1e-4


def slow_toxicity(m, text):
    """A noisy-or over sentences of the logistic of the weights of their distinct words and word heads."""
    clean = 1 - m.leak
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    for sentence in re.split(rb"[\n!.?]", low):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence)
        if not words:
            continue
        slots = set()
        for w in words:
            _, _, _, _, h, _ = next(kernel.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), kernel.ALNUM))
            heads = [sum(c << 8 * k for k, c in enumerate(w[:n])) + (tag << 60) for n, tag in ((4, 1), (5, 2))]
            slots |= {int(h[0]) % toxicity.SLOTS, *(int(x) % toxicity.SLOTS for x in kernel.mix(np.array(heads, np.uint64)))}
        clean *= 1 - sigmoid(sum(float(m.weights[s]) for s in sorted(slots)) + m.bias)
    return 1 - clean


def test_toxicity_is_that_of_a_loop():
    rng = np.random.default_rng(8)
    m = toxicity.Model(np.where(rng.random(toxicity.SLOTS) < 0.4, rng.normal(size=toxicity.SLOTS), 0).astype(np.float32), -3.5, 0.02)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS) + 2)), pa.array([*TEXTS, "", None])], ["doc_id", "text"])
    (got,) = toxicity._scores(m, False)(iter([batch]))
    want = [slow_toxicity(m, t) for t in [*TEXTS, "", ""]]
    assert np.allclose(got.column(1).to_numpy(), want, atol=1e-6)
