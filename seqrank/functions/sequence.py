"""Sequence expressions. All take a STRING column of RNA letters unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqrank.functions.numeric import col

# Base order of k-mer indexes, and the amino-acid alphabet.
BASES = "ACGU"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def rna(c: str | Column) -> Column:
    """Upper case with T written as U."""
    return F.replace(F.upper(col(c)), F.lit("T"), F.lit("U"))


def fingerprint_text(c: str | Column) -> Column:
    """Form used for digests: no spaces or line ends, anything outside ACGUN becomes N."""
    return F.regexp_replace(F.regexp_replace(rna(c), "[ \\r\\n]", ""), "[^ACGUN]", "N")


def clean_protein(c: str | Column) -> Column:
    """Upper case, stop marks dropped, letters outside the alphabet written as X."""
    return F.regexp_replace(F.regexp_replace(F.upper(col(c)), "\\*", ""), f"[^{AMINO_ACIDS}]", "X")


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(F.translate(col(c), "ACGU", "UGCA"))


def letter_count(c: str | Column, letters: str) -> Column:
    text = col(c)
    # one letter is taken out at a time: translate looks every letter of the text up in a map
    taken = [F.length(text) - F.length(F.replace(text, F.lit(b), F.lit(""))) for b in dict.fromkeys(letters)]
    return sum(taken[1:], taken[0])


def letter_fraction(c: str | Column, letters: str) -> Column:
    """Share of positions with one of ``letters``; NULL for the empty string."""
    return F.try_divide(letter_count(c, letters).cast("double"), F.length(col(c)).cast("double"))


def base_codes(c: str | Column, length: int | None = None) -> Column:
    """A0 C1 G2 U3 other4 as an array; cut or padded to ``length`` when given."""
    text = rna(c)
    if length is not None:
        text = F.rpad(text, length, "N")
    digits = F.regexp_replace(F.translate(text, "ACGU", "0123"), "[^0-3]", "4")
    return F.transform(
        F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: d.cast("tinyint")
    )


def decode_codes(codes: str | Column) -> Column:
    """Letters of base codes, N for code 4."""
    return F.array_join(F.transform(col(codes), lambda d: F.substring(F.lit("ACGUN"), d.cast("int") + 1, 1)), "")


def kmers(c: str | Column, k: int) -> Column:
    """All overlapping k-mers in order; empty for shorter strings."""
    text = col(c)
    return F.when(
        F.length(text) >= k,
        F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k))),
    ).otherwise(F.array().cast("array<string>"))


def kmer_index(kmer: str | Column) -> Column:
    """Base-4 number of a k-mer, first base most significant; NULL with other letters."""
    text = col(kmer)
    return F.when(
        text.rlike("^[ACGU]+$"), F.conv(F.translate(text, "ACGU", "0123"), 4, 10).cast("bigint")
    )


def kmer_text(index: str | Column, k: int) -> Column:
    """Inverse of :func:`kmer_index`."""
    digits = F.lpad(F.conv(col(index).cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", "ACGU")


def entropy(c: str | Column) -> Column:
    """Shannon entropy in bits over A, C, G, U as shares of the whole length; NULL when empty."""
    terms = []
    for base in BASES:
        p = letter_fraction(c, base)
        terms.append(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return F.when(F.length(col(c)) > 0, sum(terms[1:], terms[0]))


def low_complexity(c: str | Column) -> Column:
    h = entropy(c)
    return F.when(h.isNotNull(), F.lit(1.0) - F.least(h / 2.0, F.lit(1.0)))


def u_runs(c: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit("(U+)"), F.lit(1)), F.length)


def longest_u_run(c: str | Column) -> Column:
    return F.coalesce(F.array_max(u_runs(c)), F.lit(0))


def u_word_count(c: str | Column, k: int = 7) -> Column:
    """Overlapping occurrences of k letters U."""
    return F.aggregate(u_runs(c), F.lit(0), lambda acc, n: acc + F.greatest(n - (k - 1), F.lit(0)))


def density_in(kmer_array: Column, words: Column | Sequence[str]) -> Column:
    """Share of k-mers that are among ``words``; NULL when either is empty. A list of words is looked up by hash, an array one by one."""
    if not isinstance(words, Column):
        words = list(words)
        hits = F.size(F.filter(kmer_array, lambda x: x.isin(words))) if words else F.lit(None)
        return F.try_divide(hits.cast("double"), F.size(kmer_array).cast("double"))
    hits = F.size(F.filter(kmer_array, lambda x: F.array_contains(words, x)))
    return F.when(F.size(words) > 0, F.try_divide(hits.cast("double"), F.size(kmer_array).cast("double")))


def simple_repeat(c: str | Column) -> Column:
    """Mean of low complexity and the longest U run as a share of the length."""
    run = F.try_divide(longest_u_run(c).cast("double"), F.length(col(c)).cast("double"))
    return (low_complexity(c) + run) / 2.0


def rich_words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")
