"""Linear-chain inference over many sequences at once.

The words of all sequences form one stream of ``n`` positions; ``first`` marks
where a sequence begins. The stream is cut into equal blocks that advance side by
side, so the number of array steps is the length of a block, not of the longest
sequence. A block is first reduced to one K x K matrix (what it does to any state
that enters it); those matrices give the states at all borders, from which the
blocks run independently. The result is exact, whatever the cuts.
"""

from __future__ import annotations

import numpy as np

WIDE = 128  # states from which a stream is one block
COLUMNS = 16  # states whose weights are summed at one time


class Stream:
    """``scores`` (n x K, log) in blocks, with log transitions and start scores."""

    def __init__(self, scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.n, self.k = scores.shape
        # Block matrices cost n x K^3; with many states one block, n x K^2, is cheaper.
        self.steps = max(1, self.n if self.k > WIDE else int(self.n**0.5))
        self.blocks = -(-self.n // self.steps)
        pad = self.blocks * self.steps - self.n
        scores = np.concatenate([scores, np.zeros((pad, self.k), scores.dtype)])
        first = np.concatenate([first, np.ones(pad, bool)])
        first[:1] = True
        # Step-major: [steps, blocks, K].
        self.scores = np.ascontiguousarray(scores.reshape(self.blocks, self.steps, self.k).transpose(1, 0, 2))
        self.first = np.ascontiguousarray(first.reshape(self.blocks, self.steps).T)
        self.trans, self.start = trans.astype(scores.dtype), start.astype(scores.dtype)

    def flat(self, stepped: np.ndarray) -> np.ndarray:
        """Step-major values back in stream order."""
        return np.ascontiguousarray(np.swapaxes(stepped, 0, 1)).reshape(self.blocks * self.steps, *stepped.shape[2:])[: self.n]

    # ---- sums: forward-backward ---------------------------------------------

    def forward_backward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior n x K, and the scaled forward and backward values."""
        emit = np.exp(self.scores - self.scores.max(axis=2, keepdims=True))
        trans, start = np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())
        blocks, steps, k = self.blocks, self.steps, self.k
        whole = np.broadcast_to(np.eye(k, dtype=emit.dtype), (blocks, k, k)).copy()
        for t in range(steps if blocks > 1 else 0):
            at = np.flatnonzero(self.first[t])
            moved = (whole.reshape(-1, k) @ trans).reshape(blocks, k, k)
            if len(at):
                moved[at] = whole[at].sum(axis=2, keepdims=True) * start
            whole = moved * emit[t][:, None, :]
            whole /= whole.max(axis=(1, 2), keepdims=True)
        into = np.empty((blocks, k), emit.dtype)
        back = np.empty((blocks, k), emit.dtype)
        state = np.full(k, 1.0 / k, emit.dtype)
        for b in range(blocks):
            into[b] = state
            state = state @ whole[b]
            state = state / state.sum()
        state = np.full(k, 1.0 / k, emit.dtype)
        for b in range(blocks - 1, -1, -1):
            back[b] = state
            state = whole[b] @ state
            state = state / state.sum()
        alpha, beta = np.empty_like(emit), np.empty_like(emit)
        for t in range(steps):
            at = np.flatnonzero(self.first[t])
            moved = into @ trans
            if len(at):
                moved[at] = start
            into = moved * emit[t]
            into /= into.sum(axis=1, keepdims=True)
            alpha[t] = into
        for t in range(steps - 1, -1, -1):
            beta[t] = back
            seen = emit[t] * back
            back = seen @ trans.T
            at = np.flatnonzero(self.first[t])
            if len(at):
                back[at] = (seen[at] @ start)[:, None]
            back /= back.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        return self.flat(post), self.flat(alpha), self.flat(beta * emit)

    # ---- maxima: Viterbi -----------------------------------------------------

    def viterbi(self) -> np.ndarray:
        """The best state of every position; the lower state wins a tie."""
        blocks, steps, k = self.blocks, self.steps, self.k
        trans, start = self.trans, self.start
        whole = np.where(np.eye(k, dtype=bool), 0, -1e9).astype(self.scores.dtype)
        whole = np.broadcast_to(whole, (blocks, k, k)).copy()
        for t in range(steps):
            moved = whole[:, :, :1] + trans[0]
            for via in range(1, k):
                np.maximum(moved, whole[:, :, via : via + 1] + trans[via], out=moved)
            at = np.flatnonzero(self.first[t])
            if len(at):
                moved[at] = whole[at].max(axis=2, keepdims=True) + start
            whole = moved + self.scores[t][:, None, :]
            whole -= whole.max(axis=(1, 2), keepdims=True)
        into, state = np.empty((blocks, k), whole.dtype), np.zeros(k, whole.dtype)
        for b in range(blocks):
            into[b] = state
            state = (state[:, None] + whole[b]).max(axis=0)
            state = state - state.max()
        came = np.zeros((steps, blocks, k), np.uint8)
        for t in range(steps):
            at = np.flatnonzero(self.first[t])
            best = into[:, :1] + trans[0]
            if len(at):
                best[at] = into[at, :1] + start
            for via in range(1, k):
                other = into[:, via : via + 1] + trans[via]
                if len(at):
                    other[at] = into[at, via : via + 1] + start
                came[t][other > best] = via
                np.maximum(best, other, out=best)
            into = best + self.scores[t]
            into -= into.max(axis=1, keepdims=True)
        # Where each end state of a block entered it, then the end state of each block.
        row = np.arange(blocks)
        entered = np.tile(np.arange(k, dtype=np.uint8), (blocks, 1))
        for t in range(steps - 1, -1, -1):
            entered = came[t][row[:, None], entered]
        ends = np.empty(blocks, np.uint8)
        end = int(into[-1].argmax())
        for b in range(blocks - 1, -1, -1):
            ends[b] = end
            end = int(entered[b, end])
        path, state = np.empty((steps, blocks), np.uint8), ends
        for t in range(steps - 1, -1, -1):
            path[t] = state
            state = came[t][row, state]
        return self.flat(path)


def pair_sums(alpha: np.ndarray, seen: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected K x K transition counts from the values of ``forward_backward``."""
    inner = np.flatnonzero(~first)
    inner = inner[inner > 0]
    weights = np.exp(trans - trans.max())
    left, right = alpha[inner - 1].astype(np.float64), seen[inner].astype(np.float64)
    scale = np.einsum("ni,ij,nj->n", left, weights, right)
    return np.einsum("ni,nj->ij", left / scale[:, None], right) * weights


class Bags:
    """Feature numbers of a list of words, as one array with starts."""

    def __init__(self, features: list[list[int]]):
        self.sizes = np.array([len(f) for f in features], dtype=np.int64)
        self.flat = np.array([x for f in features for x in f], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(features)), self.sizes)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features."""
        out = np.zeros((len(self.sizes), weights.shape[1]), weights.dtype)
        full = np.flatnonzero(self.sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(self.sizes[full])[:-1]])
            for c in range(0, weights.shape[1], COLUMNS):
                out[full, c : c + COLUMNS] = np.add.reduceat(weights[self.flat, c : c + COLUMNS], starts, axis=0)
        return out

    def gather(self, per_word: np.ndarray, features: int) -> np.ndarray:
        """Sums of a value per word over the words that have each feature."""
        return np.stack([np.bincount(self.flat, per_word[self.owner, c], features) for c in range(per_word.shape[1])], axis=1)


class Climber:
    """AdaGrad steps for a set of named arrays, with a quadratic penalty."""

    def __init__(self, rate: float = 0.5, penalty: float = 1e-4):
        self.rate, self.penalty, self.seen = rate, penalty, {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        gradient = gradient - self.penalty * value
        total = self.seen.setdefault(name, np.full(value.shape, 1e-6))
        total += gradient**2
        value += self.rate * gradient / np.sqrt(total)
