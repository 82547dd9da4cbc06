"""Problem 9: passages of evaluation items inside corpus documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.lookalikes import consistent_form

_WORD = regex.compile(r"[\p{L}\p{N}]+")
HITS = "doc_id bigint, item_id bigint"


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, of the text in consistent form."""
    return _WORD.findall(consistent_form(text).casefold()) if text else []


class Patterns:
    """Wu-Manber tables for all runs of `m` words of a set of items, over words instead of characters.

    `shift`: for a block of three words, how far the search may move on; a block that ends no pattern run moves it to where it
    could first end one, an unknown block by m - 2 words. `ends`: for a block that ends a run, the places where it does."""

    BLOCK = 3

    def __init__(self, items: list[tuple[int, list[str]]], m: int):
        self.m = m
        self.items = [(i, w) for i, w in items if len(w) >= m]
        self.ids: dict[str, int] = {}
        self.coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in self.items]
        self.shift: dict[tuple[int, int, int], int] = {}
        self.ends: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for k, words in enumerate(self.coded):
            for end in range(2, len(words)):
                block = (words[end - 2], words[end - 1], words[end])
                # The nearest run that holds this block ends at word m - 1 at the earliest.
                self.shift[block] = min(self.shift.get(block, m - 2), max(0, m - 1 - end))
                if end >= m - 1:
                    self.ends.setdefault(block, []).append((k, end))

    def search(self, words: list[str]) -> set[int]:
        """The items of which some run of m words occurs in `words`."""
        m, n, shift = self.m, len(words), self.shift
        found: set[int] = set()
        if n < m:
            return found
        get = self.ids.get
        text = [get(w, -1) for w in words]
        at, far = m - 1, m - 2
        while at < n:
            block = (text[at - 2], text[at - 1], text[at])
            move = shift.get(block, far)
            if move:
                at += move
                continue
            first = text[at - m + 1]
            if first >= 0:
                for k, end in self.ends[block]:
                    passage = self.coded[k]
                    if self.items[k][0] not in found and passage[end - m + 1] == first and passage[end - m + 1 : end + 1] == text[at - m + 1 : at + 1]:
                        found.add(self.items[k][0])
            at += 1
        return found


def _scan(passages, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(passages.value, m)
        for batch in batches:
            docs, items = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item in patterns.search(words_of(text)):
                    docs.append(doc)
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, words: int = 16, block_words: int = 2_000_000) -> DataFrame:
    """Pairs (doc_id, item_id): the document (doc_id, text) holds at least `words` consecutive words of the item's passage (item_id, passage).

    The items are the stated query set. They are broadcast in blocks of at most `block_words` words each (tens of megabytes), one scan of
    the corpus per block, so any number of them can be searched; the corpus is never shuffled, only the hits are made distinct.
    Null or shorter passages and texts hold nothing; passages that repeat are items of their own; empty tables give no rows."""
    spark = docs.sparkSession
    scanned: list[DataFrame] = []
    block: list[tuple[int, list[str]]] = []
    size = 0
    corpus = docs.where(F.col("text").isNotNull() & (F.length("text") >= 2 * words - 1)).select(F.col("doc_id").cast("bigint"), F.col("text"))

    def flush() -> None:
        scanned.append(corpus.mapInArrow(_scan(spark.sparkContext.broadcast(list(block)), words), HITS))

    for row in items.where(F.col("passage").isNotNull()).select(F.col("item_id").cast("bigint"), "passage").distinct().toLocalIterator():
        ws = words_of(row[1])
        if block and size + len(ws) > block_words:
            flush()
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    flush()
    out = scanned[0]
    for more in scanned[1:]:
        out = out.unionByName(more)
    return out.distinct()
