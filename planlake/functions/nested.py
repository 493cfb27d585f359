"""Expression builders over arrays: similarities, pairs, quantiles and lookups that never leave the row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def arrayed(x: Column) -> Column:
    """A missing array is an empty one."""
    return F.coalesce(x, F.array())


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double; empty where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; two empty sets are alike."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 1.0)


def occurrences(xs: Column, x: Column) -> Column:
    return F.size(F.filter(xs, lambda y: y == x))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, x: s + x)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over sum of the greater; two empty bags are alike."""
    keys = F.array_union(a, b)
    least = _total(F.transform(keys, lambda k: F.least(occurrences(a, k), occurrences(b, k))))
    most = _total(F.transform(keys, lambda k: F.greatest(occurrences(a, k), occurrences(b, k))))
    return ratio(least, most, 1.0)


def ordered_pairs(xs: Column) -> Column:
    """array<struct<a, b>> of the elements at i < j, repeats included."""
    return F.flatten(F.transform(xs, lambda a, i: F.transform(F.slice(xs, i + 2, F.size(xs)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def unordered_pairs(xs: Column) -> Column:
    """array<struct<a, b>> with a < b over the distinct elements."""
    return let(F.array_sort(F.array_distinct(xs)), ordered_pairs)


def first_match(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: Column | None = None) -> Column:
    """The first name of table one of whose keywords text contains."""
    out = None
    for name, words in table:
        hit = contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(None) if default is None else default)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def count_of(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def nearest_rank(values: Column, p: float) -> Column:
    """The element of a sorted array at index round-half-even(p * (n - 1))."""
    return F.element_at(values, F.bround(F.lit(float(p)) * (F.size(values) - 1)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    """The middle element, the upper one of an even number."""
    return let(F.array_sort(values), lambda v: F.try_element_at(v, (F.size(v) / 2).cast("int") + 1))


def all_in(xs: Column, ys: Column) -> Column:
    return F.size(F.array_except(xs, ys)) == 0


def same_set(xs: Column, ys: Column) -> Column:
    return all_in(xs, ys) & all_in(ys, xs)


def repeats(xs: Column) -> Column:
    """Whether an element occurs twice."""
    return F.size(F.array_distinct(xs)) < F.size(xs)
