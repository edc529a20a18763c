"""Column helpers of the native operators: built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def repeated_words(w: Column) -> Column:
    """Number of words in 3-word windows found twice or more in w, first included.

    Windows are sorted as longs of hash bits above and position bits below, so a text of n words
    leaves 64 - log2(n) bits to the hash. Neighbours of equal hash bits are compared word by
    word; if two of them differ, the windows of equal hash bits are sorted by their words.
    """

    def run(w: Column) -> Column:
        n = F.size(w)
        long = lambda k: F.lit(k).cast("long")
        word = lambda i, k: F.get(w, (i + k).cast("int"))

        def same(i: Column, j: Column) -> Column:
            return (word(i, 0) == word(j, 0)) & (word(i, -1) == word(j, -1)) & (word(i, 1) == word(j, 1))

        def covered(at: Column) -> Column:
            """Words under the windows around the sorted middle positions."""
            return let(F.sort_array(at), lambda p: total(F.transform(p, lambda x, i: F.least(long(3), F.coalesce(F.get(p, i + 1) - x, long(3))))))

        def exact(at: Column) -> Column:
            def repeats(s: Column) -> Column:
                equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
                return F.transform(F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1))), lambda x: x["i"])

            return let(F.sort_array(F.transform(at, lambda i: F.struct(word(i, -1).alias("a"), word(i, 0).alias("b"), word(i, 1).alias("c"), i.alias("i")))), repeats)

        def sorted_windows(bits: Column) -> Column:
            low = F.call_function("shiftleft", long(1), bits) - 1
            key = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
            top = lambda x: F.call_function("shiftright", x, bits)
            place = lambda x: x.bitwiseAND(low)
            beside = lambda x, y: F.coalesce(top(x) == top(y), F.lit(False))
            equal = lambda x, y: F.coalesce((top(x) == top(y)) & same(place(x), place(y)), F.lit(False))
            hits = let(F.sort_array(key), lambda s: F.filter(s, lambda x, i: beside(x, F.get(s, i - 1)) | beside(x, F.get(s, i + 1))))

            def counted(h: Column) -> Column:
                at = F.transform(h, place)
                differ = F.exists(F.transform(h, lambda x, i: equal(x, F.get(h, i - 1)) | equal(x, F.get(h, i + 1))), lambda ok: ~ok)
                return F.when(differ, covered(exact(at))).otherwise(covered(at))

            return let(hits, counted)

        return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(n)), sorted_windows))

    return let(w, run)
