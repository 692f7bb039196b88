"""Blocked Bloom filter made and probed by SQL expressions only.

The filter is ``blocks`` blocks of one 64-bit word. A key picks one block and sets BITS
bits in it, so a probe reads one word. Its size follows the number of keys, by
``blocks_for``, up to MOST blocks (8 bytes each, 8 MB in all); for more keys than those
hold, that function says None, and callers go another way. The filter is one row, which
queries use as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, PER_BLOCK = 5, 4
LEAST, MOST = 1 << 10, 1 << 20
#: Words that travel as one row while the filter is put together.
ROW = 1 << 10


def blocks_for(keys: int) -> int | None:
    """Blocks for so many keys, with about one false hit in 500; None if they need more than MOST."""
    blocks = LEAST
    while blocks * PER_BLOCK < keys:
        blocks *= 2
    return blocks if blocks <= MOST else None


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and the word with its bits; key must not be null."""
    h = F.xxhash64(key)
    g = F.xxhash64(h, F.lit(17))
    one, word = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for j in range(BITS):
        word = word.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(g, 6 * j).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h, F.lit(blocks)).cast("int"), word


def build(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """One row, one column ``filter``: the blocks' words by index.

    Null keys are not added; an empty input gives an all-zero filter.
    """
    block, word = _place(key, blocks)
    filled = keys.where(key.isNotNull()).groupBy(block.alias("block")).agg(F.bit_or(word).alias("word"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("bigint").alias("word"))
    full = every.unionByName(filled).groupBy("block").agg(F.bit_or("word").alias("word"))
    in_order = lambda place, what: F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what])
    rows = full.groupBy(F.floor(F.col("block") / ROW).alias("row")).agg(in_order("block", "word").alias("words"))
    return rows.agg(in_order("row", "words").alias("filter"))


def might_contain(filter_: Column, key: Column, blocks: int) -> Column:
    """False only for keys that were not added; null keys give false.

    ``filter_`` stands in the expression once, so a plan holds its subquery once.
    """
    block, word = _place(key, blocks)
    found = F.get(F.get(filter_, F.floor(block / ROW).cast("int")), F.pmod(block, F.lit(ROW)))
    return F.coalesce(key.isNotNull() & (found.bitwiseAND(word) == word), F.lit(False))


class Sieve:
    """Lets through what may be among the keys of a written table; sized by their count.

    With more keys than a filter may hold (MOST * PER_BLOCK) it lets everything through.
    """

    def __init__(self, keys: DataFrame, key: Column):
        self.blocks = blocks_for(keys.count())
        self.made = None if self.blocks is None else build(keys, key, self.blocks)

    def passes(self, key: Column) -> Column:
        """Never null; null keys don't pass, but where everything does."""
        return F.lit(True) if self.made is None else might_contain(self.made.scalar(), key, self.blocks)
