"""Deterministic stand-ins for the models that plug into the engine."""

from __future__ import annotations

import numpy as np
import pandas as pd

ALPHABET = "abcdefghijklmnop"
#: What the stand-in chat model says, by the length of its prompt.
SAYS = ("easy", "It is Medium.", "HARD", "no idea")


def letters():
    """An embedder: counts of some letters, to unit length; texts without any are all zeros."""

    def embed(texts: pd.Series) -> list[list[float]]:
        out = []
        for text in texts:
            counts = np.array([float(text.count(c)) for c in ALPHABET])
            norm = float(np.sqrt((counts * counts).sum()))
            out.append((counts / norm if norm else counts).tolist())
        return out

    return embed


def plain_chat():
    """A chat model that answers by the length of its prompt."""
    return lambda prompts: prompts.map(lambda p: SAYS[len(p) % len(SAYS)])
