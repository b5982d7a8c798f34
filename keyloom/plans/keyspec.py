"""How keys are made of sequences: alphabet, length and strand convention."""

from __future__ import annotations

from dataclasses import dataclass

from keyloom.functions.alphabets import DNA, Alphabet

SINGLE, CANONICAL, BIMOLECULE = "single", "canonical", "bimolecule"


@dataclass(frozen=True)
class KeySpec:
    """``mode``: keys as read, the lesser strand, or either strand as first met."""

    k: int
    alphabet: Alphabet = DNA
    mode: str = SINGLE

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if self.mode not in (SINGLE, CANONICAL, BIMOLECULE):
            raise ValueError(f"unknown mode {self.mode}")
