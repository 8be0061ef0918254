"""Similarity of two short texts, from 0 to 1, as native Column expressions. A null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import grams

# Punctuation that normalising drops.
PUNCTUATION = ".,!?;:\"'()[]{}。，！？；：“”‘’（）【】、·"


def normalized(text: Column) -> Column:
    """Without punctuation, runs of white space as one space, trimmed, A-Z in lower case; other letters stay."""
    bare = F.translate(text, PUNCTUATION, "")
    spaced = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edit_similarity(one: Column, two: Column) -> Column:
    """1 less the edit distance over the longer length."""
    most = F.greatest(F.length(one), F.length(two))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(one, two) / most)


def phrase_similarity(one: Column, two: Column) -> Column:
    """Mean over both directions of how near each character has an equal one in the other text."""

    def directed(chars: Column, other: Column, turned: Column) -> Column:
        """Mean nearness of each character to an equal one in ``other``, found by search forwards and, in the reversed text, backwards."""
        n = F.length(other)

        def part(c: Column, i: Column) -> Column:
            after, before = F.position(c, other, i + 1), F.position(c, turned, F.greatest(n - i, F.lit(1)))
            away = F.least(F.when(after > 0, after - 1 - i), F.when(before > 0, i - n + before))
            return (n - F.least(F.coalesce(away, n), n)) / n

        return F.aggregate(F.transform(chars, part), F.lit(0.0), lambda t, x: t + x) / F.size(chars)

    # one element binds the texts: an outer expression inside a lambda would be worked out again for each character
    bound = F.array(F.struct(one.alias("a"), two.alias("b"), F.reverse(one).alias("ra"), F.reverse(two).alias("rb"), grams(one, 1).alias("ca"), grams(two, 1).alias("cb")))
    both = F.get(F.transform(bound, lambda x: (directed(x.ca, x.b, x.rb) + directed(x.cb, x.a, x.ra)) / 2), F.lit(0))
    return F.when((one == "") & (two == ""), 1.0).when((one == "") | (two == ""), 0.0).when(one.isNotNull() & two.isNotNull(), both)


def set_similarity(one: Column, two: Column, n: int = 1) -> Column:
    """Jaccard similarity of the sets of n-character runs; two empty sets are equal."""
    a, b = grams(one, n), grams(two, n)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigram_similarity(one: Column, two: Column) -> Column:
    """Of normalised texts: sets of character pairs, or of characters if a text has fewer than two."""
    one, two = normalized(one), normalized(two)
    return F.when((F.length(one) < 2) | (F.length(two) < 2), set_similarity(one, two)).otherwise(set_similarity(one, two, 2))


def contained_similarity(one: Column, two: Column) -> Column:
    """0.8 and more if the normalised text of fewer bytes lies in the other, else 0."""
    one, two = normalized(one), normalized(two)
    swap = F.octet_length(one) > F.octet_length(two)
    short, long = F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)
    score = F.least(F.lit(1.0), 0.8 + 0.2 * F.length(short) / F.length(long))
    return F.when((one == "") | (two == ""), 0.0).when(F.contains(long, short), score).otherwise(F.when(one.isNotNull() & two.isNotNull(), 0.0))


def mixed_similarity(one: Column, two: Column) -> Column:
    """1 for equal normalised texts, else edit, phrase and character similarity weighted 0.4, 0.4 and 0.2."""
    one, two = normalized(one), normalized(two)
    return F.when(one == two, 1.0).otherwise(0.4 * edit_similarity(one, two) + 0.4 * phrase_similarity(one, two) + 0.2 * set_similarity(one, two))


def best_similarity(one: Column, two: Column) -> Column:
    """The greatest of mixed, contained and bigram similarity; null if a text is null."""
    return F.when(one.isNotNull() & two.isNotNull(), F.greatest(mixed_similarity(one, two), contained_similarity(one, two), bigram_similarity(one, two)))
