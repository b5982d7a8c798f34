"""Sequence alphabets and strand conventions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """Symbols and their complements, in the same order."""

    name: str
    symbols: str
    complements: str

    def raised(self, text: Column) -> Column:
        """The text with the alphabet's letters in upper case; no other letter becomes one."""
        return F.translate(text, self.symbols.lower(), self.symbols)

    def clean(self, text: Column) -> Column:
        """The raised text with every other character removed."""
        return F.regexp_replace(self.raised(text), f"[^{self.symbols}]", "")

    def pieces(self, text: Column) -> Column:
        """The runs of symbols of the raised text, so that no window spans another character."""
        return F.filter(F.split(self.raised(text), f"[^{self.symbols}]+"), lambda s: s != "")

    def reverse_complement(self, sequence: Column) -> Column:
        return F.reverse(F.translate(sequence, self.symbols, self.complements))

    def canonical(self, sequence: Column) -> Column:
        """The lesser of a sequence and its reverse complement."""
        return F.least(sequence, self.reverse_complement(sequence))

    def strand_key(self, sequence: Column) -> Column:
        """A placement key that both strands share: the xor of their hashes."""
        return F.xxhash64(sequence).bitwiseXOR(F.xxhash64(self.reverse_complement(sequence)))


# Nucleotide codes and their complements.
DNA = Alphabet("DNA", "ACGT", "TGCA")
DNA5 = Alphabet("DNA5", "ACGTN", "TGCAN")
DNA16 = Alphabet("DNA16", "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN")
RNA = Alphabet("RNA", "ACGU", "UGCA")
ALPHABETS = {a.name: a for a in (DNA, DNA5, DNA16, RNA)}
