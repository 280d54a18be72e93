"""Weak supervision: a generative model of overlapping voters, and a linear scorer trained on its posteriors."""

from __future__ import annotations

import numpy as np

from tagloom.llm.common import by_value

ABSTAIN = -1


class LabelModel:
    """Voters say 1, 0 or abstain; how they answer under either hidden label is learned by expectation-maximisation.

    ``rate[y, j, v]`` is how often voter j says v when the label is y. An answer shifts the odds of the label by the
    ratio of its rates; to abstain shifts nothing, as many voters only know one kind of case. Voters that still
    agree once the label is known count less: their shift is divided by one plus the sum of their positive residual
    correlations with the others, though all together never count less than the strongest of them alone.
    """

    def __init__(self, prior: float, strength: float = 10.0):
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        self.strength = strength  # of the first guess, in votes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        for_one = np.zeros((2, len(votes)))  # sum of the discounted shifts, and the largest full one
        for_zero = np.zeros((2, len(votes)))
        for j in range(votes.shape[1]):
            for v in (0, 1):
                shift = np.log(self.rate[1, j, v] / self.rate[0, j, v])
                side = for_one if shift > 0 else for_zero
                said = votes[:, j] == v
                side[0, said] += self.share[j] * abs(shift)
                side[1, said] = np.maximum(side[1, said], abs(shift))
        score = np.log(self.prior / (1 - self.prior)) + for_one.max(axis=0) - for_zero.max(axis=0)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def _correlations(self, votes: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
        said = np.where(votes == ABSTAIN, 0.0, 2.0 * votes - 1.0)
        cover = np.zeros((votes.shape[1], votes.shape[1]))
        for label in (0, 1):
            w = weight * (q if label else 1 - q)
            rest = said - (w @ said) / max(w.sum(), 1e-9)
            cover += (rest * w[:, None]).T @ rest
        spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
        out = cover / spread[:, None] / spread[None, :]
        np.fill_diagonal(out, 0.0)
        return out

    def fit(self, votes: np.ndarray, weight: np.ndarray, rounds: int = 60, fixed_prior: bool = False) -> LabelModel:
        """``votes``: rows x voters of 1, 0, ABSTAIN; ``weight``: how many documents voted like the row.

        At first a voter's answer is taken to be eight times likelier under its own label.
        """
        m = votes.shape[1]
        self.share = np.ones(m)
        self.correlations = np.zeros((m, m))
        each = np.stack([weight @ (votes == v) for v in (0, 1)], axis=1) + 1.0  # voters x answers
        each /= weight.sum() + 2.0
        odd = np.sqrt(8.0)
        first = np.clip(np.stack([each * [odd, 1 / odd], each * [1 / odd, odd]]), 1e-6, 0.99)
        self.rate = first
        for step in range(rounds):
            q = self.posterior(votes)
            if step >= 5:
                self.correlations = self._correlations(votes, weight, q)
                self.share = 1 / (1 + np.clip(self.correlations, 0, None).sum(axis=1))
            new = np.empty_like(first)
            for y in (0, 1):
                w = weight * (q if y else 1 - q)
                for v in (0, 1):
                    new[y, :, v] = (w @ (votes == v) + self.strength * first[y, :, v]) / (w.sum() + self.strength)
            self.rate = np.clip(new, 1e-6, 1.0)
            if not fixed_prior:
                self.prior = float(np.clip((weight @ q) / weight.sum(), 0.02, 0.98))
        return self

    def accuracies(self) -> np.ndarray:
        """How often each voter is right when it does not abstain."""
        both = np.stack([(1 - self.prior) * self.rate[0], self.prior * self.rate[1]])
        return (both[0, :, 0] + both[1, :, 1]) / both.sum(axis=(0, 2))


def fit_linear(
    rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int, decay: float = 1e-3, rounds: int = 400
) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of active features, towards probabilities; Adam steps over all rows."""
    each = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), each)
    feature = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    coef, bias = np.zeros(width + 1), 0.0
    mean, square = np.zeros(width + 2), np.zeros(width + 2)
    share = weight / max(weight.sum(), 1e-9)
    for step in range(1, rounds + 1):
        score = np.bincount(at, weights=coef[feature], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) * share
        grad = np.zeros(width + 2)
        grad[: width + 1] = np.bincount(feature, weights=error[at], minlength=width + 1) + decay * coef / max(len(rows), 1)
        grad[-1] = error.sum()
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
        coef, bias = coef - move[: width + 1], bias - move[-1]
    return coef[:width], float(bias)


by_value(__name__)
