"""Long spans that stand verbatim in more than one document.

1. *Anchors*: winnowing picks characters-grams of every document so that two
   documents with a common span of the wanted length have at least one anchor in
   common. Only anchors (a hash, a document, no text) are shuffled.
2. Documents with a rare anchor in common are proposed as pairs; those around a
   common anchor are put in classes by hashes of whole windows, so that a class
   has one row per member, whatever its size.
3. The first document of a pair or class is the reference. Its suffix automaton,
   built over words, goes to the tasks to which its documents come, and they are
   streamed through it: matching statistics give the maximal common runs of
   words, which are extended by characters to both sides and compared as text.
   Hashes only propose and never decide.

A word longer than ``LONG_WORD`` is taken as single characters; thus every span
of the wanted length holds whole words of both texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.session import HOT_SALTS, HOT_SHARE, hot_keys, saved

#: Length of a span that counts, in Unicode characters.
MIN_SPAN = 300
#: Words beyond this length are split into characters.
LONG_WORD = 40

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int, other: int = 0) -> np.ndarray:
    """A hash of each ``gram`` consecutive code points; ``other`` picks one of two independent ones."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    base = _BASES[other]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n), dtype=np.uint64, out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _powers(pow(base, -1, 1 << 64), n - gram + 1)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes | np.uint64(1)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Best of each ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def anchors_of(texts: list[str], span: int = MIN_SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of the texts, the text that each stands in, and its place there.

    With grams of ``span // 2`` characters and windows of ``span - gram + 1`` grams, a
    common span of ``span`` characters holds one whole window in both texts, whose
    least hash is picked in both. Of equal grams that follow each other directly the
    first and the last are kept: what lies around the others lies around these.
    """
    gram = max(span // 2, 1)
    width = span - gram + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    data = _points(texts)
    if len(data) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _gram_hashes(data, gram)
    least = _sliding(hashes, width, np.minimum)
    # windows that lie in one text
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(least))
    least = np.where(start + span <= ends[owner[: len(least)]], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    greatest = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(greatest == hashes)
    follows = np.zeros(len(at), bool)
    follows[1:] = (at[1:] == at[:-1] + 1) & (hashes[at[1:]] == hashes[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    inner = follows.copy()
    inner[:-1] &= follows[1:]
    inner[-1:] = False
    at = at[~inner]
    return hashes[at], owner[at], at - (ends - sizes)[owner[at]]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about two million characters."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (size == 0 or size + len(texts[high]) < 2_000_000):
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


def _anchors(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in _parts(texts):
                found, owner, place = anchors_of(texts[low:high], span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), ids.slice(low).take(pa.array(owner)), pa.array(place.astype(np.int32))], ["anchor", "doc_id", "place"]
                )

    return run


#: Anchors that stand more often than this give classes of documents by whole spans instead of pairs.
COMMON_ANCHOR = 16
#: Members of a class are paired in blocks of about so many.
BLOCK = 512


def _windows(span: int):
    """Hashes (two, independent) and places of all windows of ``span`` characters around the given places of a text."""
    gram = max(span // 2, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hashes, other = _gram_hashes(_points([text]), span), _gram_hashes(_points([text]), span, 1)
                wanted = np.zeros(len(hashes), bool)
                for place in places:
                    wanted[max(0, place + gram - span) : place + 1] = True
                at = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(other[at].view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))],
                    ["window", "other", "doc_id", "place"],
                )

    return run


def _long(documents: DataFrame, span: int) -> DataFrame:
    return documents.where((F.length("text") >= span) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def shared_anchors(documents: DataFrame, span: int = MIN_SPAN) -> DataFrame:
    """``anchor, doc_id, place, n``: the anchors that stand in more than one document, ``n`` times in all.

    Counts are combined before they are shuffled. An anchor that holds a share of all rows is
    looked up in a broadcast table of at most ``1 / HOT_SHARE`` rows and never meets in one task.
    """
    anchors = saved(_long(documents, span).mapInArrow(_anchors(span), "anchor long, doc_id long, place int"))
    reach = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"))
    reach = saved(reach.where("_a < _b").select("anchor", "n"))
    least = F.lit(HOT_SHARE) * anchors.agg(F.count("*").alias("_all")).scalar() + 100
    hot = F.broadcast(reach.where(F.col("n") > least))
    return anchors.join(hot, "anchor").unionByName(anchors.join(reach.where(F.col("n") <= least), "anchor"))


def _around(documents: DataFrame, places: DataFrame, span: int) -> DataFrame:
    """``window, other, doc_id, place``: the windows around the places (``doc_id, place``) of the documents."""
    places = places.groupBy("doc_id").agg(F.collect_set("place").alias("places"))  # at most one per character
    rows = _long(documents, span).join(places, "doc_id").select("doc_id", "text", "places")
    return rows.mapInArrow(_windows(span), "window long, other long, doc_id long, place int")


def _classes(windows: DataFrame) -> DataFrame:
    """``class, ref, doc_id, n``: documents that have a window in common, with the first of them as reference.

    Windows with the same documents are one class. No group is gathered: counts, least ids and
    sums are combined on the map side, and a hot window meets its one row by a broadcast.
    """
    once = saved(windows.select("window", "doc_id").distinct())
    signed = once.groupBy("window").agg(F.min("doc_id").alias("ref"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("sign"))
    kept = saved(signed.where("n > 1").groupBy("ref", "n", "sign").agg(F.min("window").alias("window")).select("window", "ref", "n"))
    least = F.lit(HOT_SHARE) * once.agg(F.count("*").alias("_all")).scalar() + 100
    hot = F.broadcast(kept.where(F.col("n") > least))  # at most 1 / HOT_SHARE rows
    rows = once.join(hot, "window").unionByName(once.join(kept.where(F.col("n") <= least), "window"))
    return rows.select(F.col("window").alias("class"), "ref", "doc_id", "n")


_WORDS = re.compile(r"\w+|\s+|[^\w\s]+")


def words(text: str) -> tuple[list[str], list[int]]:
    """Symbols of a text and where each starts; they join to the text."""
    out: list[str] = []
    starts: list[int] = []
    for m in _WORDS.finditer(text):
        word, at = m[0], m.start()
        if len(word) > LONG_WORD:
            out.extend(word)
            starts.extend(range(at, at + len(word)))
        else:
            out.append(word)
            starts.append(at)
    return out, starts


class SuffixAutomaton:
    """The suffix automaton of a sequence of symbols."""

    def __init__(self, symbols: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.end = [-1]  # place of the last symbol of the first occurrence
        last = 0
        for at, symbol in enumerate(symbols):
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.end.append(at)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(symbol) == q:
                        self.next[p][symbol] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def runs(self, symbols: list[str]) -> Iterator[tuple[int, int, int]]:
        """Maximal matches of the streamed symbols: first and last place, and last place in the reference."""
        state, size = 0, 0
        held: tuple[int, int, int] | None = None
        for at, symbol in enumerate(symbols):
            before = size
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                size += 1
            if size <= before and held is not None:  # the match before couldn't go on
                yield held
            held = (at - size + 1, at, self.end[state]) if size else None
        if held is not None:
            yield held


class Reference:
    """A document against which others are streamed."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.symbols, self.starts = words(text)
        self.starts.append(len(text))
        self.automaton = SuffixAutomaton(self.symbols)

    def common(self, text: str, span: int) -> list[tuple[int, int]]:
        """Maximal spans of ``text`` of at least ``span`` characters that stand in the reference: begin and end."""
        symbols, starts = words(text)
        starts.append(len(text))
        found: list[tuple[int, int]] = []
        ref = self.text
        for first, last, end in self.automaton.runs(symbols):
            low, high = starts[first], starts[last + 1]
            if high - low < span - 2 * LONG_WORD:
                continue
            there_high = self.starts[end + 1]
            there_low = there_high - (high - low)
            while low and there_low and text[low - 1] == ref[there_low - 1]:
                low, there_low = low - 1, there_low - 1
            while high < len(text) and there_high < len(ref) and text[high] == ref[there_high]:
                high, there_high = high + 1, there_high + 1
            if high - low < span:
                # another occurrence of the run may go further: look at all windows around it
                left, right = max(0, low - LONG_WORD), min(len(text), high + LONG_WORD)
                hits = [i for i in range(left, right - span + 1) if text[i : i + span] in ref]
                if not hits:
                    continue
                low, high = hits[0], hits[-1] + span
            found.append((low, high))
        return found


def _stream(span: int):
    """Streams documents through the automaton of the reference before them (rows are sorted so).

    Gives the documents that share a span with their reference and, where classes are
    asked for, the windows of them that stand in both texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reference = None, None
        spots: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple[int, int, int | None]] = []
            for ref, kind, doc, text, classes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    name, reference, spots = ref, Reference(text), {}
                    continue
                assert ref == name  # each reference comes before its documents
                if not reference.common(text, span):
                    continue
                if classes is None:
                    rows.append((ref, doc, None))
                    continue
                if not spots:
                    hashes = _gram_hashes(_points([reference.text]), span).view(np.int64)
                    spots = dict(zip(hashes.tolist(), range(len(hashes)), strict=True))
                for c in classes:
                    at = spots.get(c)
                    if at is not None and reference.text[at : at + span] in text:
                        rows.append((ref, doc, c))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["ref", "doc_id", "class"])

    return run


def _confirmed(documents: DataFrame, rows: DataFrame, span: int) -> DataFrame:
    """``ref, doc_id, class`` of the rows (``ref, doc_id, classes``) whose texts really have spans in common.

    A reference is sent once to each task that streams documents of it; those of a reference
    with a share of all rows spread over salts.
    """
    rows = saved(rows)
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.where(F.length("text") >= span)
    hot = F.broadcast(hot_keys(rows, "ref").withColumn("_hot", F.lit(True)))  # at most 1 / HOT_SHARE rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SALTS))).otherwise(0).cast("int").alias("salt")
    salted = rows.join(hot, "ref", "left").select("ref", salt, "doc_id", "classes")
    refs = salted.select("ref", "salt").distinct()
    both = salted.join(texts, "doc_id").select("ref", "salt", F.lit(1).alias("kind"), "doc_id", "text", "classes").unionByName(
        refs.join(texts.withColumnRenamed("doc_id", "ref"), "ref").select("ref", "salt", F.lit(0).alias("kind"), F.col("ref").alias("doc_id"), "text", F.lit(None).cast("array<long>").alias("classes"))
    )
    ordered = both.repartition("ref", "salt").sortWithinPartitions("ref", "salt", "kind", "doc_id").select("ref", "kind", "doc_id", "text", "classes")
    return ordered.mapInArrow(_stream(span), "ref long, doc_id long, class long")


def sharing_classes(documents: DataFrame, anchors: DataFrame, span: int = MIN_SPAN) -> tuple[DataFrame, DataFrame]:
    """Pairs and classes of documents with a common span: ``ref, doc_id`` and ``class, doc_id, n``.

    Rare anchors give pairs, at most ``COMMON_ANCHOR`` squared a anchor. Common anchors give classes by whole
    windows around them, one row per document and class, whose documents all hold one window. Every pair that
    shares a span stands in one of the two.
    """
    rare = anchors.where(F.col("n") <= COMMON_ANCHOR).select("anchor", "doc_id")
    pairs = rare.withColumnRenamed("doc_id", "ref").join(rare, "anchor").where("ref < doc_id").select("ref", "doc_id").distinct()
    common = anchors.where(F.col("n") > COMMON_ANCHOR)
    classes = saved(_classes(_around(documents, common, span)))
    members = classes.where("doc_id != ref").groupBy("ref", "doc_id").agg(F.collect_set("class").alias("classes"))
    asked = pairs.withColumn("classes", F.lit(None).cast("array<long>")).unionByName(members)
    found = saved(_confirmed(documents, asked, span))
    sizes = classes.where("doc_id = ref").select("class", "ref", "n")
    held = found.where("class is not null").select("class", "doc_id").unionByName(sizes.select("class", F.col("ref").alias("doc_id")))
    return found.where("class is null").select("ref", "doc_id"), held.join(sizes.select("class", "n"), "class")


def _pairs_of(classes: DataFrame) -> DataFrame:
    """All pairs of the members of each class (``class, doc_id, n``), in blocks: no class is one task."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = classes.withColumn("_k", blocks).withColumn("_i", F.pmod(F.xxhash64("doc_id"), F.col("_k")).cast("int"))
    left = rows.select("class", F.col("doc_id").alias("a"), "_i", F.explode(F.sequence(F.col("_i"), F.col("_k") - 1)).alias("_j"))
    right = rows.select("class", F.col("doc_id").alias("b"), F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_i"))
    met = left.join(right, ["class", "_i", "_j"]).where("(_i < _j or a < b) and a != b")
    return met.select(F.least("a", "b").alias("ref"), F.greatest("a", "b").alias("doc_id"))


def sharing_pairs(documents: DataFrame, span: int = MIN_SPAN) -> DataFrame:
    """``doc_id_a < doc_id_b``: documents that share a verbatim span of at least ``span`` characters.

    Null and shorter texts share nothing. The work is linear in documents; only the rows of the
    result are pairs, which a passage in n documents has n(n-1)/2 of by definition.
    """
    pairs, classes = sharing_classes(documents, shared_anchors(documents, span), span)
    both = pairs.unionByName(_pairs_of(classes))
    return both.select(F.col("ref").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b")).distinct()


def _cover(span: int):
    """Length of the union of the spans that begin at the given places of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [int(np.minimum(np.diff(np.sort(np.array(p, np.int64))), span).sum()) + span for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], ["doc_id", "shared_chars", "most_copies"])

    return run


def shared_parts(documents: DataFrame, span: int = MIN_SPAN) -> DataFrame:
    """Per document: its characters, how many lie in spans that also stand elsewhere, and in how many documents the commonest of them stands.

    Windows of ``span`` characters around shared anchors are counted over all documents by two
    independent 64-bit hashes; no pairs are made. Documents without such spans, null and empty
    ones too, have zero.
    """
    windows = saved(_around(documents, shared_anchors(documents, span), span))
    counts = windows.select("window", "other", "doc_id").distinct().groupBy("window", "other").agg(F.count("*").alias("n")).where("n > 1")
    counts = saved(counts)
    least = F.lit(HOT_SHARE) * windows.agg(F.count("*").alias("_all")).scalar() + 100
    hot = F.broadcast(counts.where(F.col("n") > least))  # at most 1 / HOT_SHARE rows
    met = windows.join(hot, ["window", "other"]).unionByName(windows.join(counts.where(F.col("n") <= least), ["window", "other"]))
    own = met.groupBy("doc_id").agg(F.collect_set("place").alias("places"), F.max("n").alias("n"))  # at most one place per character
    sums = own.mapInArrow(_cover(span), "doc_id long, shared_chars long, most_copies long")
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return sizes.join(sums, "doc_id", "left").select("doc_id", "n_chars", zero("shared_chars"), zero("most_copies"))
