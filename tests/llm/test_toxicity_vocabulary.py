"""Toxic vocabularies of which each word is rare, and labels that are partly wrong."""

import random

import numpy as np
import pytest

from ledgerloom.llm import toxicity

WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu".split() for b in "x yn zor wel dat fim gos".split()]


def corpus(rude, noise, seed):
    rng = random.Random(seed)
    texts, toxic, labels = [], [], []
    for i in range(3000):
        text = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)]
        bad = i % 2 == 0
        for _ in range(3):  # all texts are equally long
            text.insert(rng.randrange(len(text)), rng.choice(rude) if bad else rng.choice(WORDS) + rng.choice(WORDS))
        texts.append(" ".join(text))
        toxic.append(bad)
        labels.append(bad != (rng.random() < noise))
    return texts, toxic, labels


def accuracy(rude, noise):
    texts, toxic, labels = corpus(rude, noise, 1)
    model = toxicity.train(texts, labels)
    held, y, _ = corpus(rude, 0, 2)
    return ((toxicity.Scorer(model).scores(held) >= 0.5) == np.array(y)).mean()


BROAD = [f"{a}{b}snout" for a in ("grub", "vile", "mud", "rot", "slim", "filth", "dung", "toad", "wart", "pus") for b in "qa we ri ty ou ip ak sj dl fz gy hv jx kc bn".split()]


@pytest.mark.parametrize("rude, noise, least", [(BROAD + [w[::-1] for w in BROAD], 0.0, 0.85), (BROAD[::15], 0.1, 0.9)])
def test_broad_vocabulary_and_noisy_labels(rude, noise, least):
    assert accuracy(rude, noise) > least


def test_no_class_is_left_without_words():
    texts, _, labels = corpus(BROAD[:5], 0.0, 3)
    model = toxicity.train(texts, labels)
    size = len(model.toxic)
    assert len(model.ordinary) == size and model.ordinary.strip(b"\0") != model.toxic.strip(b"\0")
    base = next(n for n in range(size, 0, -1) if model.ordinary[-n:] == model.toxic[-n:])
    assert model.ordinary[: size - base].strip(b"\0") and model.toxic[: size - base].strip(b"\0")
