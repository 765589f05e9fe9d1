"""Files that nobody wrote by hand: generated, minified, vendored, or data stored as code.

Re-Pair grammars are inferred over every file, twice: over the classes of its
tokens, where high rule reuse (a small grammar for the length) means that few
shapes are repeated again and again, and over the tokens themselves, whose
rules identify copies: a rule that stands in many repositories, or in files of
third-party folders or notices, is a third-party rule, and a file that consists
of such rules is vendored. A third grammar, over the characters of long literals,
finds blobs: random data has next to no rules. Folders, and after all else leading
notices, decide where they are plain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm import repair
from evidra.session import salted_left_join, saved

#: Folders meant for files of third parties, and for files that tools write (fixed values).
VENDOR_FOLDER = r"(?i)(?:^|/)(?:vendor|vendored|node_modules|bower_components|jspm_packages|third[_-]?party|thirdparty|external|externals|pods|carthage|site-packages|deps/[^/]+|[a-z][\w.-]*-\d+\.\d+(?:\.\d+)?)/"
OUTPUT_FOLDER = r"(?i)(?:^|/)(?:dist|build|out|target|generated|__generated__|_generated|autogen|gen|\.next|coverage|__snapshots__)/"
#: Names that tools give.
OUTPUT_NAME = r"(?i)(?:[._-]min\.[cm]?js|[._-]bundle\.[cm]?js|\.g\.[a-z]+|\.pb\.[a-z.]+|_pb2(?:_grpc)?\.py|\.generated\.[a-z]+|_generated\.[a-z]+|\.designer\.[a-z]+|\.d\.ts)$"

#: Notices in leading comments (fixed values, several languages). They count last, for files whose text shows nothing else.
_GENERATED = re.compile(
    r"(?i)code generated by|auto-?\s?generated|@generated\b|<auto-generated|automatically (?:produced|generated|created)|generated (?:on|by|from|with|using|file)\b|machine-made by|machine generated|do not (?:edit|modify):? (?:output|this)|output of \S+ --emit"
    r"|emitted at build time|hand edits are overwritten|changes will be lost|automatisch (?:erzeugt|generiert)|änderungen gehen verloren|fichier (?:produit|généré) par|ne pas modifier|generado automáticamente|no (?:editar|modificar)\b|自動生成|編集しないで"
)
_VENDORED = re.compile(
    r"(?i)upstream copy|bundled release|contributors \| licen[cs]e|fetched for offline builds|report faults to \S+ upstream|\bvendored from\b|^\W*from \S+@\d+\.\d+|\(c\) the \S+ (?:contributors|authors|project)|copyright \(c\) \S+ (?:project|contributors|authors)|@licen[cs]e\b|@preserve\b"
)
_HAND = re.compile(r"(?i)by hand|reviewed copy|hand-?written")
_BANNER = re.compile(r"^/\*! ?[\w.@/-]+ v?\d+\.\d+")

_TOKEN = re.compile(
    r"(?P<com>//[^\n]*|/\*[\s\S]*?\*/|(?:(?<=\n)|^)[ \t]*#[^\n]*)|(?P<str>\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<num>\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<op>[^\w\s])"
)
_LITERAL = re.compile(r"[\"'`]((?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}|[A-Za-z0-9+/=_-]){40,})[\"'`]?|^([A-Za-z0-9+/=]{60,})$", re.M)
_HEX = re.compile(r"(?:\\x|\\u00)?([0-9a-fA-F]{2})")
_KEYWORDS = frozenset(
    "if else for while do switch case return function class def end import from const let var export public private static final new try catch except finally throw raise package func type struct range map interface extends void async await with in not and or lambda".split()
)

#: A file is made of few shapes when its class grammar, per token, is below this, for a file of ``NORM_TOKENS`` tokens.
FEW_SHAPES = 0.2
#: Grammars of longer texts are smaller per token: the ratio is scaled by the length to this power (calibrated on the library code of a Python installation).
NORM_TOKENS, NORM_POWER = 400, 0.25
#: Files with fewer tokens aren't judged by the size of their grammar: too little can repeat.
LEAST_TOKENS = 120
#: Symbols of the literals' grammar per byte from which they are near-incompressible; fewer bytes than the second value say nothing.
INCOMPRESSIBLE, LEAST_LITERAL = 0.8, 256
#: Share of a file's rules that must be third-party rules for it to count as a copy.
COPIED = 0.85
#: A rule that stands in so many repositories is a third-party rule; copies of hand-written files reach fewer.
SHARED_REPOS = 10
#: Rules shorter than this, in tokens, are phrases of the language and identify nothing.
LEAST_RULE = 12
#: Files are taken together until they have so many tokens; one file may exceed it.
GROUP_TOKENS = 400_000


def tokens(text: str) -> tuple[list[str], list[str]]:
    """Tokens without comments, and their classes."""
    raw, classes = [], []
    for m in _TOKEN.finditer(text):
        kind, word = m.lastgroup, m[0]
        if kind == "com":
            continue
        raw.append(word)
        classes.append(word if kind == "op" or word in _KEYWORDS else kind)
    return raw, classes


_LEADING = re.compile(r"\s*(?:(?://|#|--|;;)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|(?P<q>'''|\"\"\")[\s\S]*?(?:(?P=q)|\Z))")


def leading_comment(text: str) -> str:
    """The whole comment at the top of a file: lines, blocks and a text in triple quotes."""
    text, parts, at = text.lstrip("﻿ \t\r\n"), [], 0
    while found := _LEADING.match(text, at):
        parts.append(found[0])
        at = found.end()
    return "\n".join(line.strip() for line in "\n".join(parts).splitlines() if line.strip())


def literal_bytes(text: str) -> bytes:
    """The bytes of the long literals if most of the text is such literals, else nothing.

    Hexadecimal literals stand for bytes, others for their characters packed to six bits
    (base64 and its like), so that random data looks random in either.
    """
    strings = [m[1] or m[2] for m in _LITERAL.finditer(text)]
    size = sum(map(len, strings))
    if size < LEAST_LITERAL or size < 0.5 * len(text):
        return b""
    joined = "".join(strings)
    pairs = _HEX.findall(joined)
    if len(pairs) * 2 > 0.45 * len(joined) and not re.search(r"[g-tv-wyzG-Z+/]", joined):
        return bytes.fromhex("".join(pairs))
    plain = np.frombuffer(joined.encode("ascii", "ignore"), np.uint8)
    code = np.zeros(256, np.int64)
    code[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)] = np.arange(64)
    code[ord("-")], code[ord("_")] = 62, 63
    values = code[plain[: len(plain) // 4 * 4]].reshape(-1, 4)
    words = (values << np.array([18, 12, 6, 0])).sum(1)
    return np.stack([words >> 16, words >> 8 & 255, words & 255], 1).astype(np.uint8).tobytes()


#: Extensions of source code; other files are judged by path, notice and copies alone.
CODE = r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|java|rb)$"
_CODE, _VENDOR, _OUTPUT, _NAME = (re.compile(x) for x in (CODE, VENDOR_FOLDER, OUTPUT_FOLDER, OUTPUT_NAME))


def by_path(path: str) -> str | None:
    """``vendored`` or ``generated`` if the path says so."""
    return "vendored" if _VENDOR.search(path) else "generated" if _OUTPUT.search(path) or _NAME.search(path) else None


def by_notice(text: str) -> str | None:
    """``vendored`` or ``generated`` if the leading comment says so."""
    head = leading_comment(text)
    if not head or _HAND.search(head):
        return None
    return "vendored" if _VENDORED.search(head) or _BANNER.search(head) else "generated" if _GENERATED.search(head) else None


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > GROUP_TOKENS:
            yield low, at
            low, held = at, 0
        held += size
    if len(sizes):
        yield low, len(sizes)


def grammars(sequences: list[list]) -> Iterator[tuple[int, int, repair.Grammars]]:
    """Grammars of sequences of texts or bytes, some at a time: first, behind the last, and their grammars."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    for low, high in _groups(sizes):
        number: dict = {}
        codes = np.fromiter((number.setdefault(x, len(number)) for s in sequences[low:high] for x in s), np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(x if isinstance(x, str) else bytes([x])) for x in number], np.uint64)
        yield low, high, repair.infer(codes, sizes[low:high], hashes)


def grammar_sizes(sequences: list[list]) -> np.ndarray:
    """Rules and final symbols of each sequence."""
    parts = [g.size(high - low) for low, high, g in grammars(sequences)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _identities(g: repair.Grammars, n: int) -> list[np.ndarray]:
    """Hashes that identify the text of each sequence: long rules, pieces of the final sequence, and the whole.

    Pieces are cut where the hash of a symbol says so; each is known by the sum of a mix of the hashes in it, so
    equal pieces have equal hashes.
    """
    owners, values = [], []
    long = g.rule_size >= LEAST_RULE
    owners.append(g.rule_owner[long])
    values.append(g.rule_hash[long])
    if len(g.final_owner):
        mixed = (g.final_hash ^ (g.final_hash >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        cut = np.ones(len(mixed), bool)
        cut[1:] = (mixed[:-1] >> np.uint64(60) == 0) | (g.final_owner[1:] != g.final_owner[:-1])
        first = np.flatnonzero(cut)
        size = np.add.reduceat(g.final_size, first)
        lengths = np.diff(np.append(first, len(mixed)))
        piece = repair.whole_hashes(g.final_hash, lengths)
        keep = size >= LEAST_RULE
        owners.append(g.final_owner[first][keep])
        values.append(piece[keep] ^ np.uint64(0x94D049BB133111EB))
    owners.append(np.arange(n))
    values.append(g.whole_hash ^ np.uint64(0xD6E8FEB86659FD93))
    owner, value = np.concatenate(owners), np.concatenate(values).view(np.int64)
    order = np.argsort(owner, kind="stable")
    return [np.unique(x) for x in np.split(value[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])]


def judge(paths: list[str], texts: list[str]) -> list[tuple[str | None, str | None, list[int]]]:
    """Kind, reason and rules of each file by itself; kind and reason are null if it looks hand-written.

    Reasons in order: ``folder``, ``literals`` (near-incompressible), ``shapes`` (rule
    reuse), ``layout`` (wide lines without blanks), ``notice``. Every file with at least ``LEAST_RULE`` tokens has rules, whatever its kind.
    """
    pairs = [tokens(t) for t in texts]
    counts = np.array([len(raw) for raw, _ in pairs], np.int64)
    code = [bool(_CODE.search(p)) for p in paths]
    shapes = grammar_sizes([classes for _, classes in pairs])
    packed = [literal_bytes(t) if c else b"" for t, c in zip(texts, code, strict=True)]
    literal = grammar_sizes(packed)
    rules: list[list[int]] = []
    for low, high, g in grammars([raw for raw, _ in pairs]):
        rules.extend(x.tolist() for x in _identities(g, high - low))
    out: list[tuple[str | None, str | None, list[int]]] = []
    for i, (path, text) in enumerate(zip(paths, texts, strict=True)):
        n = int(counts[i])
        own = rules[i] if n >= LEAST_RULE else []
        kind, reason = by_path(path), "folder"
        if kind is None and code[i]:
            if len(packed[i]) >= LEAST_LITERAL * 3 // 4 and literal[i] >= INCOMPRESSIBLE * len(packed[i]):
                kind, reason = "data", "literals"
            elif n >= LEAST_TOKENS and shapes[i] * (n / NORM_TOKENS) ** NORM_POWER < FEW_SHAPES * n:
                kind, reason = _shape_kind(text, pairs[i][1]), "shapes"
            elif n >= LEAST_TOKENS and _squeezed(text, n):
                kind, reason = "minified", "layout"
        if kind is None and text:
            kind, reason = by_notice(text), "notice"
        out.append((kind, reason if kind else None, own))
    return out


def _squeezed(text: str, n: int) -> bool:
    """Whether the code of a text stands on wide lines with hardly any blanks, and not in literals."""
    code = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("//", "/*", "#"))]
    width = sum(map(len, code)) / max(1, len(code))
    return width > 90 and n * 6 > len(text) and sum(text.count(c) for c in " \n\t\r") < 0.09 * len(text)


def _shape_kind(text: str, classes: list[str]) -> str:
    """What a file of few shapes is: minified if it has hardly any blanks, data if it is mostly values, else generated."""
    blanks = sum(text.count(c) for c in " \n\t\r")
    values = sum(c in ("str", "num") for c in classes)
    if blanks < 0.09 * len(text) and values * 4 < len(classes):
        return "minified"
    return "data" if values * 4 >= len(classes) else "generated"


#: Files are judged together until their texts have so many characters; one file may exceed it.
GROUP_CHARACTERS = 4_000_000


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [x or "" for x in batch.column("path").to_pylist()]
        texts = [x or "" for x in batch.column("content").to_pylist()]
        low = 0
        while low < len(texts):
            high, held = low, 0
            while high < len(texts) and (high == low or held + len(texts[high]) <= GROUP_CHARACTERS):
                held += len(texts[high])
                high += 1
            kinds, reasons, rules = zip(*judge(paths[low:high], texts[low:high]), strict=True)
            some = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [*(some.column(n) for n in ("id", "repo_root", "path")), pa.array(kinds, pa.string()), pa.array(reasons, pa.string()), pa.array(rules, pa.list_(pa.int64()))],
                ["id", "repo_root", "path", "kind", "reason", "rules"],
            )
            low = high


def path_kind(path: Column) -> Column:
    """``vendored`` or ``generated`` if the path says so, else null."""
    path = F.coalesce(path, F.lit(""))
    return F.when(path.rlike(VENDOR_FOLDER), "vendored").when(path.rlike(OUTPUT_FOLDER) | path.rlike(OUTPUT_NAME), "generated")


def classify(files: DataFrame) -> DataFrame:
    """``id, repo_root, path, kind, reason`` for every file; both are null for hand-written source.

    Kinds: ``vendored``, ``generated``, ``minified``, ``data``. Reasons: those of ``judge``, and ``shared`` for
    files whose rules are mostly third-party rules. Such rules stand in ``SHARED_REPOS`` repositories, or in a file
    that its folder or notice calls vendored; a notice that is borne out by shared rules gives way to them.
    Null and empty contents are judged by their path alone. JSON and other configuration isn't
    code, so only its path, its copies and its notice count. Redelivered rows count once.
    """
    judged = files.select("id", "repo_root", "path", "content").mapInArrow(
        _judged, "id string, repo_root string, path string, kind string, reason string, rules array<long>"
    )
    judged = saved(judged.dropDuplicates(["id"]))  # grammars are inferred once and read several times
    rules = judged.select("id", "repo_root", "kind", "reason", F.explode("rules").alias("rule"))
    # a rule is counted once per repository first, so a hot one is combined before it is shuffled
    reach = rules.groupBy("rule", "repo_root").agg(F.max(F.coalesce(F.col("kind") == "vendored", F.lit(False))).alias("marked"))
    reach = reach.groupBy("rule").agg(F.max("marked").alias("marked"), (F.count("repo_root") >= SHARED_REPOS).alias("many"))
    theirs = reach.where("marked or many").select("rule", "many")
    mine = salted_left_join(rules.where("kind is null or reason = 'notice'").select("id", "reason", "rule"), theirs, "rule")
    share = F.when(F.max("reason").isNull(), F.count("many")).otherwise(F.count_if("many")) / F.count("*")
    copies = mine.groupBy("id").agg(share.alias("share")).where(F.col("share") >= COPIED).select("id", F.lit(True).alias("copied"))
    rows = judged.join(copies, "id", "left")
    return rows.select(
        "id", "repo_root", "path", F.when(F.col("copied"), "vendored").otherwise(F.col("kind")).alias("kind"), F.when(F.col("copied"), "shared").otherwise(F.col("reason")).alias("reason")
    )


def walked(walks: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of directory walks with their kind: that of the file where it is known, else by the path alone."""
    paths = walks.select("repo_root", F.explode("files").alias("path")).where("path is not null").distinct()
    known = classify(files).select("repo_root", "path", "kind", F.lit(True).alias("known"))
    rows = paths.join(known, ["repo_root", "path"], "left")
    return rows.select(
        "repo_root", "path", F.coalesce("known", F.lit(False)).alias("known"),
        F.coalesce(F.when(F.col("known"), F.col("kind")).otherwise(path_kind(F.col("path"))), F.lit("hand-written")).alias("kind"),
    )
