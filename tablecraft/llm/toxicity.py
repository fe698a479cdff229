"""A toxicity classifier from confirmed toxic texts and unlabelled ones, in numpy.

Features of a text are its words and the beginnings of words. How much more frequent a
feature is among the toxic than among the others gives its evidence; the frequency among
the others is that among the unlabelled less the share that the class prior says is
toxic. The evidence of a word is the largest of its features. A text is described by its
strongest words, the sum of the notable ones and their share, and a linear classifier of these is trained by the non-negative risk of learning from positive
and unlabelled examples: prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np

from tablecraft.llm.decontaminate import words

BEGINNINGS = (5, 6, 7, 8)
STRONGEST = 6
#: Texts that a feature is given before anything is counted; keeps rare ones weak.
PSEUDO = 5.0
#: A feature of fewer toxic texts has no evidence.
LEAST_TEXTS = 3
#: Words below this evidence do not add to the sum.
NOTABLE = 1.0
EPOCHS = 600
STEP = 0.05
DECAY = 1e-3
REMEMBERED = 400_000


def distinct(text: str | None) -> list[bytes]:
    """Distinct words in order; none for NULL and texts without words."""
    return sorted(set(words(text)))


def of_word(word: bytes) -> list[bytes]:
    """The word, marked by a blank after it, and its beginnings in bytes."""
    n = len(word)
    return [word + b" ", *(word[:k] for k in BEGINNINGS if k <= n)]


def described(evidence: Sequence[np.ndarray]) -> np.ndarray:
    """One row per text from the evidence of its words: the strongest, the sum of the notable, their share, 1."""
    rows = np.zeros((len(evidence), STRONGEST + 3))
    for row, values in zip(rows, evidence):
        if len(values):
            top = np.sort(values)[::-1][:STRONGEST]
            row[: len(top)] = top
            notable = values[values > NOTABLE]
            row[STRONGEST] = np.log1p(notable.sum())
            row[STRONGEST + 1] = np.log1p(100 * len(notable) / len(values))
    rows[:, -1] = 1.0
    return rows


class Classifier:
    """Evidence by feature and the weights of the description; their size depends on the training sample only."""

    def __init__(self, evidence: dict[bytes, float], center: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.evidence, self.center, self.scale, self.weights = evidence, center, scale, weights
        self.known: dict[bytes, float] = {}

    def _strengths(self, text: str | None) -> np.ndarray:
        known, evidence = self.known, self.evidence
        found = set(words(text))
        if len(known) > REMEMBERED:
            known.clear()
        for word in found.difference(known):
            known[word] = max([evidence.get(f, 0.0) for f in of_word(word)])
        return np.array([known[word] for word in found])

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """0 to 1, for empty texts too; higher means toxic is likelier."""
        x = (described([self._strengths(t) for t in texts]) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _texts_with(rows: Iterable[Sequence[bytes]]) -> Counter:
    """In how many texts each feature occurs."""
    total: Counter = Counter()
    for row in rows:
        total.update({f for word in row for f in of_word(word)})
    return total


def train(toxic: Sequence[Sequence[bytes]], unlabelled: Sequence[Sequence[bytes]], prior: float) -> Classifier:
    """Learns from the distinct words of texts. ``unlabelled`` is drawn from all texts, toxic or not.

    Without toxic or unlabelled texts every score is the prior.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    size = STRONGEST + 3
    if not len(toxic) or not len(unlabelled):
        weights = np.zeros(size)
        weights[-1] = np.log(prior / (1 - prior))
        return Classifier({}, np.zeros(size), np.ones(size), weights)
    n_toxic, n_mixed = len(toxic), len(unlabelled)
    hits = {f: n for f, n in _texts_with(toxic).items() if n >= LEAST_TEXTS}
    seen = _texts_with(unlabelled)

    def evidence(hit: int, mixed: int) -> float:
        """Log ratio of toxic texts to those expected if they were like the others; 0 if it is below."""
        others = max(0.0, mixed / n_mixed - prior * hit / n_toxic) / (1 - prior)
        return max(0.0, float(np.log((hit + PSEUDO) / (others * n_toxic + PSEUDO))))

    def rows(texts: Sequence[Sequence[bytes]], own: dict[bytes, float]) -> np.ndarray:
        known: dict[bytes, float] = {}
        for word in {word for text in texts for word in text}:
            known[word] = max(own.get(f, 0.0) for f in of_word(word))
        return described([np.array([known[word] for word in text]) for text in texts])

    # A text of the training set does not count as evidence about itself.
    positive = rows(toxic, {f: evidence(n - 1, seen[f]) for f, n in hits.items()})
    mixed = rows(unlabelled, {f: evidence(n, max(0, seen[f] - 1)) for f, n in hits.items()})
    center, scale = mixed.mean(0), mixed.std(0)
    center[-1], scale[-1] = 0, 1
    scale[scale == 0] = 1
    weights = _fit((positive - center) / scale, (mixed - center) / scale, prior)
    return Classifier({f: evidence(n, seen[f]) for f, n in hits.items()}, center, scale, weights)


def _fit(positive: np.ndarray, mixed: np.ndarray, prior: float) -> np.ndarray:
    """Gradient descent with momentum estimates on the non-negative risk of the logistic loss."""

    def slope(rows: np.ndarray, w: np.ndarray, label: int) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        return rows.T @ (p - label) / len(rows)

    def loss_if_other(rows: np.ndarray, w: np.ndarray) -> float:
        return float(np.logaddexp(0, rows @ w).mean())

    w = np.zeros(positive.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        other = loss_if_other(mixed, w) - prior * loss_if_other(positive, w)
        of_others = slope(mixed, w, 0) - prior * slope(positive, w, 0)
        # Below zero the estimate of the others' risk is overfitted: it is raised again.
        gradient = prior * slope(positive, w, 1) + of_others if other >= 0 else -of_others
        gradient = gradient + DECAY * w
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w = w - STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w
