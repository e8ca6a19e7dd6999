"""A bidirectional gated recurrent network with attention pooling, in numpy, forward and backward.

Arrays are time first: steps x windows x width. Padded steps have mask 0 and leave the state as it is.
"""

from __future__ import annotations

import numpy as np

Parameters = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(inputs: int, hidden: int, attention: int, rng: np.random.Generator) -> Parameters:
    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    out = {"attend": normal(2 * hidden, attention), "attend_bias": np.zeros(attention, np.float32), "query": normal(attention), "out": normal(2 * hidden), "out_bias": np.zeros(1, np.float32)}
    for side in ("ahead", "back"):
        out |= {f"{side}_in": normal(inputs, 3 * hidden), f"{side}_bias": np.zeros(3 * hidden, np.float32), f"{side}_state": normal(hidden, 3 * hidden)}
    return out


def _run(projected: np.ndarray, mask: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step of one direction, and what the backward pass needs."""
    hidden = state.shape[0]
    h, states, kept = np.zeros((projected.shape[1], hidden), np.float32), np.empty((*projected.shape[:2], hidden), np.float32), []
    gates_of, new_of = state[:, : 2 * hidden], state[:, 2 * hidden :]
    for t in range(len(projected)):
        gates = sigmoid(projected[t, :, : 2 * hidden] + h @ gates_of)
        update, reset = gates[:, :hidden], gates[:, hidden:]
        recalled = h @ new_of
        new = np.tanh(projected[t, :, 2 * hidden :] + reset * recalled)
        step = update * mask[t][:, None]
        kept.append((h, gates, recalled, new, step))
        h = h + step * (new - h)
        states[t] = h
    return states, kept


def _run_back(d_states: np.ndarray, kept: list, mask: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = state.shape[0]
    d_projected, d_state, dh = np.empty((*d_states.shape[:2], 3 * hidden), np.float32), np.zeros_like(state), np.zeros(d_states.shape[1:], np.float32)
    for t in reversed(range(len(d_states))):
        h, gates, recalled, new, step = kept[t]
        update, reset = gates[:, :hidden], gates[:, hidden:]
        dh = dh + d_states[t]
        d_new = dh * step * (1 - new * new)
        d_update = dh * (new - h) * mask[t][:, None] * update * (1 - update)
        d_reset = d_new * recalled * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], axis=1)
        d_recalled = d_new * reset
        d_projected[t] = np.concatenate([d_gates, d_new], axis=1)
        d_state += h.T @ np.concatenate([d_gates, d_recalled], axis=1)
        dh = dh * (1 - step) + np.concatenate([d_gates, d_recalled], axis=1) @ state.T
    return d_projected, d_state


def forward(p: Parameters, ahead: np.ndarray, back: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows whose projected inputs are given for both directions (the second in natural order)."""
    states_ahead, kept_ahead = _run(ahead, mask, p["ahead_state"])
    states_back, kept_back = _run(back[::-1], mask[::-1], p["back_state"])
    states = np.concatenate([states_ahead, states_back[::-1]], axis=2)
    looked = np.tanh(states @ p["attend"] + p["attend_bias"])
    weight = looked @ p["query"] - 1e4 * (1 - mask)
    weight = np.exp(weight - weight.max(axis=0))
    weight = weight * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ p["out"] + p["out_bias"][0], (states, looked, weight, pooled, kept_ahead, kept_back)


def backward(p: Parameters, mask: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[Parameters, np.ndarray, np.ndarray]:
    """Gradients of all but the input projections, and of the projected inputs of both directions."""
    states, looked, weight, pooled, kept_ahead, kept_back = kept
    d_pooled = d_logit[:, None] * p["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_looked = d_weight[:, :, None] * p["query"] * (1 - looked * looked)
    d_states = weight[:, :, None] * d_pooled + d_looked @ p["attend"].T
    hidden = p["ahead_state"].shape[0]
    d_ahead, d_ahead_state = _run_back(d_states[:, :, :hidden], kept_ahead, mask, p["ahead_state"])
    d_back, d_back_state = _run_back(d_states[::-1, :, hidden:], kept_back, mask[::-1], p["back_state"])
    flat = states.reshape(-1, states.shape[2])
    gradients = {
        "out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True), "query": np.einsum("tb,tba->a", d_weight, looked),
        "attend": flat.T @ d_looked.reshape(-1, d_looked.shape[2]), "attend_bias": d_looked.sum(axis=(0, 1)), "ahead_state": d_ahead_state, "back_state": d_back_state,
    }
    return gradients, d_ahead, d_back[::-1]


class Adam:
    def __init__(self, p: Parameters, rate: float) -> None:
        self.rate, self.step, self.first, self.second = rate, 0, {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: Parameters, gradients: Parameters) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            p[k] -= (scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(np.float32)
