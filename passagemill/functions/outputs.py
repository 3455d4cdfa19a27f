"""What a model gives back, as log P(true | {true, false}) for each text."""

from __future__ import annotations

from typing import Any

import numpy as np

#: Keys under which an output holds finished scores, the first present one counts.
SCORE_KEYS = ("quality_score", "quality_scores", "scores", "score", "logprob_true", "true_logprob")


def log_share(pair: np.ndarray) -> np.ndarray:
    """log P of the first of two logits."""
    return -np.logaddexp(0.0, pair[:, 1] - pair[:, 0])


def log_prob_true(output: Any, true_id: int, false_id: int) -> np.ndarray:
    """Finished scores (an array, or one under SCORE_KEYS), two logits, or logits over a vocabulary (of the first decoded token)."""
    if isinstance(output, np.ndarray | list):
        return np.asarray(output, dtype="float64").reshape(-1)
    if isinstance(output, dict):
        for key in SCORE_KEYS:
            if output.get(key) is not None:
                return np.asarray(output[key], dtype="float64").reshape(-1)
        if output.get("logits_true") is not None and output.get("logits_false") is not None:
            return log_share(np.stack([np.asarray(output[k], dtype="float64").reshape(-1) for k in ("logits_true", "logits_false")], axis=-1))
        found = next((output[k] for k in ("pair_logits", "decoder_logits", "logits") if output.get(k) is not None), None)
    else:
        found = output[0] if isinstance(output, tuple) and output else getattr(output, "logits", None)
    if found is None:
        raise ValueError(f"no scores or logits in {sorted(output) if isinstance(output, dict) else type(output).__name__}")
    logits = np.asarray(found, dtype="float64")
    if logits.ndim == 3:
        logits = logits[:, 0, :]
    if logits.ndim == 2 and logits.shape[1] == 2:
        return log_share(logits)
    if logits.ndim == 2 and logits.shape[1] > max(true_id, false_id):
        return log_share(logits[:, [true_id, false_id]])
    raise ValueError(f"logits of shape {logits.shape} can't be read")
