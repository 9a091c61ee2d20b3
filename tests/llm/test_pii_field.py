"""The field's messages against enumeration, over many repeats, and on planted repeats."""

import itertools
import random

import numpy as np
import pytest

from somatrix.llm import pii


def model():
    token = np.zeros((len(pii.FEATURES), pii.N))
    token[pii.FEATURES.index("luhn"), 3] = 3.0
    return {"token": token, "chain": np.zeros((pii.N, pii.N)), "skip": np.diag([0.0] + [pii.SKIP_PRIOR] * (pii.N - 1))}


def test_label_reaches_late_repeats():
    """One number in full, then repeats of its last digits that only the skip edges tie to it."""
    text = "call +1 (225) 555-3104 or " + "then 2255553104 " * 60
    strong = model() | {"skip": np.diag([0.0] + [9.0] * (pii.N - 1))}
    strong["token"][0, 0] = 1.0
    base = pii.pattern_spans(text)
    field = pii.Field(text, base)
    p = pii.marginals(field, strong)
    last = len(field.spans) - 1
    assert len(base) == 1 and max(map(len, field.keys)) > 50
    assert p[last].argmax() == 4 and p[last, 4] > 0.9


@pytest.mark.parametrize("text", ["see 4111.1111.1111.1111 or 4111.1111.1111.1111", "a12b c3 then a12b", "x@y z 5553104 x@y"])
def test_marginals_by_enumeration(text):
    """Graphs without loops, on which messages are exact."""
    rng = np.random.default_rng(3)
    weights = {"token": rng.normal(size=(len(pii.FEATURES), pii.N)), "chain": rng.normal(size=(pii.N, pii.N)), "skip": rng.normal(size=(pii.N, pii.N))}
    field = pii.Field(text, [])
    n = len(field.spans)
    whole = np.zeros((n + len(field.keys), pii.N))
    for labels in itertools.product(range(pii.N), repeat=len(whole)):
        score = sum(weights["token"][f, labels[i]].sum() - 1e9 * (labels[i] in pii.impossible(f)) for i, f in enumerate(field.features))
        score += sum(weights["chain"][labels[a], labels[b]] for a, b in field.chain)
        score += sum(weights["skip"][labels[i], labels[n + k]] for k, tokens in enumerate(field.keys) for i in tokens)
        for node, label in enumerate(labels):
            whole[node, label] += np.exp(score)
    assert len(field.keys) == 1 and np.allclose(pii.marginals(field, weights), whole / whole.sum(axis=1, keepdims=True), atol=1e-3)


def test_planted_repeats(spark, sf_dir):
    """Repeats that the patterns miss, beside numbers that repeat and aren't personal."""
    weights = pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng, found, planted, wrong = random.Random(5), 0, 0, 0
    for i in range(150):
        card = "4111111111111111" if i % 2 else "5500005555555559"
        full, part = [("+1 (225) 555-3104", "555-3104"), ("ann.b7@mail3.org", "ann.b7@intern"), (card, ".".join(card[k : k + 4] for k in range(0, 16, 4)))][i % 3]
        words = [rng.choice(["the", "report", "at", "10:30", "in", "2021", "room", "12"]) for _ in range(60)]
        words[5], words[20], words[35], words[50], words[12], words[40] = full, part, part, part, "20240917", "20240917"
        words[4] = words[6] = "the"  # a digit beside a card would be read as part of it
        text = " ".join(words)
        got = [text[a:b] for a, _, b in pii.added_spans(text, pii.pattern_spans(text), weights)]
        planted, found, wrong = planted + 3, found + got.count(part), wrong + len(got) - got.count(part)
    assert found >= 0.9 * planted and wrong <= 0.02 * planted
