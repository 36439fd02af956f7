"""Encoding a whole corpus with a public byte-level BPE by a global distinct-word shuffle.

Every text is cut into pre-tokens once. A position holds the number its word has in a block of
neighbouring texts, so a word occurs at most once a block in what is shuffled, however frequent it
is. Each distinct word of the corpus is encoded once, its ids are joined back to the blocks that
use it, and the ids of every text are put together by position. Decoding joins the ids with the
table of token bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.session import Scratch

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pre-tokens at which a block of texts is closed; a longer text is a block of its own.
BLOCK = 200_000
#: Words up to this many bytes are merged pair by pair in a list, longer ones through a heap.
SHORT = 24


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding of one pre-token: the neighbours of least rank are merged, the left ones first."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merge_short(word, ranks) if len(word) <= SHORT else _merge_long(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    costs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        known = [c for c in costs if c is not None]
        if not known:
            return [ranks[p] for p in parts]
        i = costs.index(min(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A heap of (rank, place) over a linked list of parts; entries whose parts have changed are stale."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the part at i spans word[i:end[i]]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block: its texts' ids, where each text ends, the word number at every position, and the words.

    Columns block, doc_ids, ends, at (int32 bytes), words. A block's id is its partition and its
    number there; the rows are written before anything reads them, so a repeated task leaves one set.
    """
    import regex

    find = regex.compile(PATTERN).findall
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    n = 0
    docs, ends, at, numbers = [], [], [], {}

    def row():
        return pd.DataFrame([(first + n, docs, ends, np.array(at, np.int32).tobytes(), list(numbers))], columns=["block", "doc_ids", "ends", "at", "words"])

    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            if text:
                at.extend([numbers.setdefault(w, len(numbers)) for w in find(text)])
            docs.append(doc)
            ends.append(len(at))
            if len(at) >= BLOCK or len(docs) >= BLOCK:
                yield row()
                n += 1
                docs, ends, at, numbers = [], [], [], {}
    if docs:
        yield row()


def encode_words(distinct: DataFrame, ranks_path: str) -> DataFrame:
    """Ids of each distinct pre-token: word, ids (int32 bytes). The rank file is read once a Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = read_ranks(ranks_path)
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"].to_numpy(), "ids": [np.array(merge_bytes(w.encode(), ranks), np.int32).tobytes() for w in pdf["word"]]})

    return distinct.mapInPandas(run, "word string, ids binary")


def _assemble(blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The texts of one block: ids of the words, by number, put where the positions name them."""
    out_docs, out_ids = [], []
    table = [b""] * len(words)
    for number, ids in zip(words["number"], words["ids"]):
        table[number] = ids
    flat = np.frombuffer(b"".join(table), np.int32)
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for docs, ends, at in zip(blocks["doc_ids"], blocks["ends"], blocks["at"]):
        at = np.frombuffer(at, np.int32)
        n = lengths[at]
        to = np.concatenate(([0], np.cumsum(n)))
        whole = flat[np.repeat(starts[at] - to[:-1], n) + np.arange(to[-1])] if len(at) else flat[:0]
        out_ids += np.split(whole, to[np.asarray(ends)])[:-1]
        out_docs += list(docs)
    return pd.DataFrame({"doc_id": out_docs, "ids": out_ids})


def encode_corpus(documents: DataFrame, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Token ids of every document: doc_id, ids; an empty list for an empty or null text.

    No special tokens; their strings in a text are ordinary text. Rows with a repeated or null
    doc_id come out one for one. Whole texts are encoded; a text of any length is one row in
    memory. Texts are read once and their positions shuffled once, by block; words are shuffled by
    themselves, at most one row a block, so that no word is hot. Nothing that grows is broadcast.
    """
    scratch = Scratch(documents.sparkSession, "tokens")
    cut = scratch.save(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut_blocks, "block long, doc_ids array<string>, ends array<int>, at binary, words array<string>"))
    uses = cut.select("block", F.posexplode("words").alias("number", "word"))
    ids = encode_words(uses.select("word").distinct(), ranks_path)
    back = uses.hint("merge").join(ids.hint("merge"), "word").select("block", "number", "ids")
    texts = cut.select(F.col("block").alias("of"), "doc_ids", "ends", "at")
    encoded = texts.groupBy("of").cogroup(back.groupBy("block")).applyInPandas(lambda t, w: _assemble(t, w), "doc_id string, ids array<int>")
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")


def token_bytes(spark: SparkSession, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The table of the vocabulary: id, bytes. Its size is the vocabulary's, whatever the corpus."""
    return spark.createDataFrame(pd.DataFrame(sorted((i, b) for b, i in read_ranks(ranks_path).items()), columns=["id", "bytes"]), "id int, bytes binary")


def decode_corpus(encoded: DataFrame, ranks_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Text of every row of (doc_id, ids): doc_id, text; an empty list gives an empty text."""
    table = token_bytes(encoded.sparkSession, ranks_path)
    parts = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    per_doc = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = per_doc.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "utf-8").alias("text"))
    return encoded.select("doc_id").hint("merge").join(text, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
