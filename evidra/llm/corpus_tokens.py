"""Encoding of a corpus with a public byte-pair vocabulary, each distinct word encoded once.

Texts are split into words (pre-tokens) on the JVM. Runs of documents become
*blocks*: a dictionary of the block's distinct words and the codes of all its
words in order. Only dictionaries are exploded: their words are shuffled by
word, so that all places of a word meet and it is encoded once; the ids return
to the blocks, where documents are put together from their codes. A block has a
bounded number of words, hence no group grows with the corpus, and a frequent
word takes one row per block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.session import saved

#: Vocabulary by default; the name of a rank file of ``public_tokenizers``, or a path.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A block is closed when it has so many words; one document may exceed it.
BLOCK_WORDS = 1_000_000


def vocabulary_path(name: str) -> str:
    """Where a rank file lies: a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    """The public split pattern, for the JVM: classes are those of Unicode."""
    import public_tokenizers

    return "(?U)" + public_tokenizers.PATTERN


@cache
def ranks(name: str) -> dict[bytes, int]:
    """Token bytes -> id."""
    with open(vocabulary_path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoder(name: str):
    """The public encoder for a vocabulary, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})


def words_of(text: Column | str) -> Column:
    """The words of a text; null and empty texts have none.

    Texts with code points that the JVM doesn't know yet aren't split: they are one
    word each and are encoded as whole texts.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    split = F.regexp_extract_all(text, F.lit(word_pattern()), F.lit(0))
    return F.when(text.rlike(r"\p{Cn}"), F.array(text)).otherwise(split)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_BLOCK = pa.schema(
    [("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("words", pa.list_(pa.string()))]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of one partition."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    words: list[pa.Array] = []
    count = 0

    def block() -> pa.RecordBatch:
        nonlocal number, ids, sizes, words, count
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # frequent words get small codes, which pack better
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        values = [
            pa.array([(part << 32) + number], pa.int64()),
            pa.array([np.concatenate(ids).astype("<i8").tobytes()]),
            pa.array([_pack(np.concatenate(sizes))]),
            pa.array([_pack(rank[codes])]),
            pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order))),
        ]
        number, ids, sizes, words, count = number + 1, [], [], [], 0
        return pa.RecordBatch.from_arrays(values, schema=_BLOCK)

    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            rows = batch.slice(low, 512)
            lists = rows.column(1)
            ids.append(rows.column(0).to_numpy(zero_copy_only=False))
            sizes.append(np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64))
            words.append(lists.flatten().cast(pa.string()))
            count += int(sizes[-1].sum())
            if count >= BLOCK_WORDS:
                yield block()
    if ids:
        yield block()


def _encode_words(vocabulary: str):
    """Ids of the words of one partition: a row per block met, with places and packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        known: dict[str, list[int]] = {}
        blocks: list[np.ndarray] = []
        places: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        flat: list[np.ndarray] = []

        def parts() -> Iterator[pa.RecordBatch]:
            block, place, count = map(np.concatenate, (blocks, places, counts))
            ids = np.concatenate(flat)
            first = np.concatenate([[0], np.cumsum(count)])
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order])) + 1
            for own in np.split(order, edges):
                size = count[own]
                offsets = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(first[own] - offsets[:-1], size) + np.arange(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[own[0]])], pa.int64()), pa.array([_pack(place[own])]), pa.array([_pack(size)]), pa.array([_pack(ids[take])])],
                    ["block", "ids", "sizes", "codes"],
                )

        held = 0
        for batch in batches:
            lists = []
            for word in batch.column(2).to_pylist():
                found = known.get(word)
                if found is None:
                    # a text that wasn't split holds several words; it isn't ASCII, since the JVM knows all of that
                    found = enc._encode_single_piece(word) if len(word) <= 32 and word.isascii() else enc.encode_ordinary(word)
                    if len(known) < 2_000_000:  # a cache only: words beyond it are encoded anew
                        known[word] = found
                lists.append(found)
            blocks.append(batch.column(0).to_numpy(zero_copy_only=False))
            places.append(batch.column(1).to_numpy(zero_copy_only=False))
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter((x for ids in lists for x in ids), np.int64))
            held += len(lists)
            if held > 4_000_000:
                yield from parts()
                blocks, places, counts, flat, held = [], [], [], [], 0
        if held:
            yield from parts()

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """The documents of one block from its codes and the ids of its words."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 0)
    places, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows:
        if r["kind"] == 1:
            places.append(_unpack(r["ids"]).astype(np.int64))
            sizes.append(_unpack(r["sizes"]).astype(np.int64))
            ids.append(_unpack(r["codes"]).astype(np.int64))
    place, size, ids = np.concatenate(places), np.concatenate(sizes), np.concatenate(ids)
    first = np.cumsum(size) - size
    by_place_first, by_place_size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    by_place_first[place], by_place_size[place] = first, size
    codes = _unpack(own["codes"]).astype(np.int64)
    docs, words = np.frombuffer(own["ids"], "<i8"), _unpack(own["sizes"]).astype(np.int64)
    count = by_place_size[codes]
    offsets = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(by_place_first[codes] - offsets[:-1], count) + np.arange(offsets[-1])
    edges = offsets[np.concatenate([[0], np.cumsum(words)])]
    out = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids[take].astype(np.int32)))
    return pa.table([pa.array(docs), out], names=["doc_id", "ids"])


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of each document; null and empty texts give the empty list.

    What looks like a special token is plain text. Rows with a null id are dropped;
    repeated rows give a row each.
    """
    words = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), words_of(text).alias("words"))
    blocks = saved(words.mapInArrow(_blocks, "block long, ids binary, sizes binary, codes binary, words array<string>"))
    places = blocks.select("block", F.posexplode("words").alias("place", "word")).repartition("word")
    coded = places.mapInArrow(_encode_words(vocabulary), "block long, ids binary, sizes binary, codes binary")
    both = blocks.drop("words").withColumn("kind", F.lit(0)).unionByName(coded.withColumn("kind", F.lit(1)))
    return both.groupBy("block").applyInArrow(_assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``text``: each batch of ids is joined with the token-byte table.

    The table has one row per token of the vocabulary (a fixed, small size); bytes that
    aren't UTF-8 give the replacement character. A null list gives a null text.
    """
    schema = encoded.drop("text").withColumn("text", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = sorted((i, b) for b, i in ranks(vocabulary).items())
        table = np.array([b for _, b in by_id], object)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else b"".join(table[x]).decode("utf-8", "replace") for x in lists.to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema.names)

    return encoded.mapInArrow(run, schema)
