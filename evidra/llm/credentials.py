"""Credentials that stand in clear in source code and configuration.

A string is *unnatural* when a public tokenizer needs many tokens for few of its
characters. Context rules say where a credential may stand (a known format, an
address, a header, a command, a named value, a login call, a comment) and which
values are none (placeholders, masks, references, patterns). Every find needs
both: the clearer the context, the more natural a value may look. Redaction
covers exactly the characters of the value. The rules take time in proportion
to a text, whether it has one line or many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.corpus_tokens import VOCABULARY, encoder

#: Characters per token below which a string isn't language.
UNNATURAL = 2.35
#: The same for values whose place says that a credential stands there: only plain words are above it.
UNNATURAL_IN_PLACE = 5.0
#: Least length of the value of a variable whose name says nothing.
BARE_VALUE = 20

#: Formats that are credentials wherever they stand (fixed values: prefixes that issuers publish, and the like).
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{18,}|npm_[A-Za-z0-9]{30,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w-]{30,}|[a-z]{2,5}-(?=[a-z0-9]*\d)[a-z0-9]{28,}(?![A-Za-z0-9-])"
    r"|eyJ[\w-]{8,}\.[\w-]{12,}\.[\w-]{12,})"
)
_PEM = re.compile(
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----(?=(?:\\n|\\r|[\s\"'+\\#*/])*[A-Za-z0-9+/=]{16,})(?:(?:[A-Za-z0-9+/=:,\s\\\"'#*]|- ?(?!----))*?-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s]*)"
)
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>]*:(?P<v>[^\s@\"'/<>]+)@(?=[\w\[])")
_HEADER = re.compile(r"(?i)\b(?:bearer|basic|token)\s+(?P<v>[A-Za-z0-9+/._~-]{16,}={0,2})")
_OPTION = re.compile(r"(?i)(?<![\w-])--?(?:pass(?:word|wd|phrase)?|pwd|token|secret|api-?key|auth-?token|access-?token)[= ](?P<v>[^\s\"'`,;)]+)")
_USER = re.compile(r"(?<![\w-])(?:-u|--user|--basic-auth|--auth)[= ][\"']?[\w.@-]+:(?P<v>[^\s\"'@/:]+)")
_CALL = re.compile(r"(?i)\b(?P<f>\w+)\((?P<a>[^()\n]*)\)")
_LOGIN = re.compile(r"(?i)(?:authenticate|login|log_in|sign_?in|connect|session|basic_?auth|set_?password|credentials?)$")
_HOST = re.compile(r"^[\w-]+(?:\.[\w-]+)+(?::\d+)?$")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n$]*)`")
_NAMED = re.compile(
    r"(?<![\w$])(?P<q>\\?[\"']|)(?P<n>[A-Za-z_][\w.-]*)(?P=q)(?:\s*:\s*(?:[A-Za-z]+\b)(?=\s*=)|\s+(?:string|String)(?=\s*=))?\s*(?P<op>:=|=>|=(?!=)|:(?!:))"
)
_COMMENT = re.compile(r"(?:^|[\s;])(?://|#|/\*|\*|<!--|--\s)(?P<v>[^\n]*)", re.M)

_SECRET_NAME = re.compile(
    r"secret|passw|passphrase|pwd|(?:smtp|db|user|mail|ftp|ldap|redis|admin|login|service|root)pass|^pass$|token|api_?key|(?:encryption|signing|access|private|master|service|account|secret|hmac|shared|auth|crypt)key|hmac|credential|^cred|authorization$|^auth$|kennwort|contrasena|motdepasse"
)
#: Words that make a name no secret's: whole segments of the name, or written together with words of secrets only.
_PART = r"(?:secret|password|passwd|passphrase|pass|pwd|token|api|key|hmac|credential|cred|authorization|auth|access|private|signing|encryption|user|admin|login|root|client)s?"
_OTHER_PART = re.compile(
    rf"(?:{_PART})*(?:public|primary|partition(?:s|ed)?|cache[ds]?|caching|sort(?:s|ed|ing)?|foreign|(?:hint|label|field|count|placeholder|length|(?:sub|data|content)?type)(?:s|ed|er)?|csrf|polic(?:y|ies)|checksums?|tokeniz\w*|expir\w*)(?:{_PART})*\d*"
)
_OTHER_END = re.compile(rf"(?:{_PART})*(?:ttl|file|path|uuid|guid|id|name|url|hash|digest)+\d*")
_SEGMENT = re.compile(r"[A-Z]+(?![a-z])\d*|[A-Z]?[^\W\d_A-Z]+\d*|\d+")
#: No name of a secret and no option lacks all of these; texts without them need no look at either.
_NAME_HINT = re.compile(r"(?i)secret|pass|pwd|token|key|hmac|cred|auth|kennwort|contrasena")
_DATA_NAME = re.compile(r"sha\d|md5|integrity|commit|revision|digest|fingerprint|etag|pixel|image|icon|data|payload|trace|request|session|build|version|uuid|guid|nonce|salt|seed|cert|pub")
_COMMENT_WORD = re.compile(r"(?i)passw|pwd|kennwort|token|secret|\bkey\b|api.?key|\bauth|cred|geheim|contraseñ|\bclave|mot de passe|login|\bpins?\b|pass ?phrase|パスワード|鍵|トークン|秘密")

#: Values that are none (fixed values).
_NOTHING = re.compile(
    r"(?i)^(?:replace|change|your|insert|enter|dummy|placeholder|redacted|todo|none$|null$|nil$|true$|false$|undefined|vault:|env[:.(\[]|secret[s]?[:/]|ref[:+]|arn:|kms:|ssm:|file:|op://|\$|%|\{\{|<|#\{|@|example|sample|test$|sha\d{3}-|ssh-)"
    r"|[x*•.#?_-]{6,}|\$\{|\{\{|<[a-z][\w -]*>|^[x*•.]+$|(?:process\.env|os\.environ|getenv|env\.fetch|config\[|secrets?\.get)|_?replace_?me|change_?me|_here$|^your[-_]"
)
_PATTERN = re.compile(r"\\[sSwWdDb]|\[\^|\[[A-Za-z0-9_]-|\(\?|\]\{|\][+*]")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_CONFIG_EXT = ("yaml", "yml", "env", "properties", "sh", "json", "toml", "ini", "cfg", "")


@lru_cache(maxsize=50_000)
def characters_per_token(text: str) -> float:
    """How many characters of the text a token covers on average."""
    return len(text) / max(1, len(encoder(VOCABULARY).encode_ordinary(text)))


def _out_of_place(text: str) -> bool:
    """Whether a string is no plain word or words, however short."""
    return characters_per_token(text) < UNNATURAL_IN_PLACE


def unnatural(text: str) -> bool:
    """Whether the string is long enough and costs too many tokens for its characters."""
    return len(text) >= 12 and characters_per_token(text) < UNNATURAL


def _mixed(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def _works(value: str) -> bool:
    """Whether a value can be a credential at all."""
    return len(value) >= 6 and not _NOTHING.search(value) and not _PATTERN.search(value) and not _UUID.match(value)


def _named_value(value: str, name: str) -> bool:
    """Whether the value of a secret's name is a working credential."""
    if not _works(value) or any(c.isspace() for c in value) or len(value) < 8:
        return False
    if not value.isascii() or re.fullmatch(r"[a-z]+(?::[a-z]+)+", value) or "(" in value:
        return False
    telling = any(not c.isalnum() for c in value) or "pass" in name or "pwd" in name
    return unnatural(value) or _mixed(value) and telling and _out_of_place(value)


@lru_cache(maxsize=50_000)
def _other_name(name: str) -> bool:
    """Whether a name, with or without a tag of its own, says that its value is no secret."""
    for x in (name, re.sub(r"_[A-Za-z0-9]{2,6}$", "", name)):
        parts = [p.lower() for p in _SEGMENT.findall(x)]
        if any(map(_OTHER_PART.fullmatch, parts)) or parts and _OTHER_END.fullmatch(parts[-1]):
            return True
    return False


def spans(text: str, extension: str = "") -> list[tuple[int, int, str]]:
    """Begin, end and kind of each credential; overlapping finds are joined to the first."""
    found: list[tuple[int, int, str]] = []
    # names are compared without their separators
    hinted = _NAME_HINT.search(text) or _NAME_HINT.search(text.replace("_", "").replace("-", ""))
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        found.append((m.start(), m.end(), "private_key"))
    for m in _FORMAT.finditer(text):
        if _works(m[0]) and unnatural(m[0]):
            found.append((m.start(), m.end(), "format"))
    for m in _ADDRESS.finditer(text) if "://" in text and "@" in text else ():
        works = _works(m["v"]) or len(m["v"]) >= 4 and _mixed(m["v"]) and not _NOTHING.search(m["v"])
        if works and _out_of_place(m["v"]):
            found.append((*m.span("v"), "address"))
    for m in _HEADER.finditer(text):
        if _works(m["v"]) and unnatural(m["v"]) and _mixed(m["v"]):
            found.append((*m.span("v"), "header"))
    options = _OPTION.finditer(text) if "-" in text and hinted else ()
    users = _USER.finditer(text) if "--" in text or "-u" in text else ()
    for m in (*options, *users):
        if _works(m["v"]) and _mixed(m["v"]) and _out_of_place(m["v"]):
            found.append((*m.span("v"), "command"))
    for m in _CALL.finditer(text):
        strings = list(_STRING.finditer(m["a"]))
        named = _LOGIN.search(m["f"]) and len(strings) >= 2
        if named or len(strings) >= 3 and _HOST.match(strings[0][1] or strings[0][2] or ""):
            last = strings[-1]
            value = last[1] or last[2] or last[3] or ""
            if _named_value(value, "pass"):
                low = m.start("a") + last.start() + 1
                found.append((low, low + len(value), "call"))
    until = 0
    for m in _NAMED.finditer(text) if extension in ("env", "sh") or hinted else ():
        if m.start() < until:  # part of a value without quotes that was looked at
            continue
        name = m["n"].rsplit(".", 1)[-1]
        # a name may end in a tag of its own
        plain, short = (re.sub(r"[_.-]", "", x).lower() for x in (name, re.sub(r"_[A-Za-z0-9]{2,6}$", "", name)))
        other = _other_name(name)
        if other or not (_SECRET_NAME.search(plain) or _SECRET_NAME.search(short)):
            # an environment variable that says nothing about itself, with a value like a key
            if extension in ("env", "sh") and m["op"] == "=" and not other and not _DATA_NAME.search(plain):
                hit = _value_at(text, m.end(), extension, "=")
                until = hit[2] if hit else 0
                if hit and hit[1] and len(hit[1]) >= BARE_VALUE and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", hit[1]) and _works(hit[1]) and _mixed(hit[1]) and unnatural(hit[1]):
                    found.append((hit[0], hit[0] + len(hit[1]), "variable"))
            continue
        hit = _value_at(text, m.end(), extension, m["op"])
        until = hit[2] if hit else 0
        if hit and hit[1] and _named_value(hit[1], plain):
            found.append((hit[0], hit[0] + len(hit[1]), "named"))
    for m in _COMMENT.finditer(text):
        words = _COMMENT_WORD.search(m["v"])
        if not words:
            continue
        for t in re.finditer(r"[^\s\"'`(),;<>|]+", m["v"]):
            value = t[0].rstrip(".:")
            key = re.match(r"[A-Za-z_]\w*[=:](?=\S)", value)
            low = m.start("v") + t.start()
            if key:
                low, value = low + key.end(), value[key.end() :]
            if t.start() >= words.start() and len(value) >= 8 and _works(value) and "/" not in value[:1] and not re.search(r"[a-z]\.[a-z]+(?::\d+)?$|^@|://|^v?\d+\.\d", value):
                if _mixed(value) and (unnatural(value) or any(not c.isalnum() for c in value)) and value.isascii():
                    found.append((low, low + len(value), "comment"))
    found.sort()
    out: list[tuple[int, int, str]] = []
    for low, high, kind in found:
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]), out[-1][2])
        else:
            out.append((low, high, kind))
    return out


_LEAD = re.compile(r"[ \t(]*")
#: Nothing but a sign that the value goes on behind it stands on the rest of a line.
_CONTINUED = re.compile(r"(?P<sign>[|>]-?|\\|\+)?[ \t\r\f\v]*(?:\n[ \t]*|\Z)")
_MEMBER = re.compile(r"[\w\"'.-]+\s*[:=]\s")
_TRIPLE = re.compile(r"[A-Za-z]*(\"\"\"|''')([^\n]*?)(?:\1|\n|\Z)")
_ESCAPED = re.compile(r"\\([\"'])([^\"'\\\n]*)\\\1")
_QUOTED = re.compile(r"[rbfRBF]?(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)")
#: A value without quotes ends the line, but for a comment; in commands other signs end it too.
_BARE = re.compile(r"(?![\"'\[{&*])(\S++)(\s#|[ \t]*(?:[\r\n]|\Z))?")
_BARE_COMMAND = re.compile(r"(?![\"'\[{&*])([^\s;&|]++)(\s#|[ \t]*(?:[\r\n;&|]|\Z))?")


def _value_at(text: str, at: int, extension: str, op: str) -> tuple[int, str | None, int] | None:
    """Begin and text of the value behind a name, and the end of what was read without quotes (or 0).

    A value may begin on the next line. The text is null if what stands there is no value.
    """
    start = _LEAD.match(text, at).end()
    following = _CONTINUED.match(text, start)
    if following:
        if not following["sign"] and "(" not in text[at:start] and op != "=" and extension not in ("yaml", "yml"):
            return None
        start = following.end()
        if start == len(text) or _MEMBER.match(text, start):
            return None
    if triple := _TRIPLE.match(text, start):
        value = triple[2].strip()
        return triple.start(2) + len(triple[2]) - len(triple[2].lstrip()), value, 0
    if escaped := _ESCAPED.match(text, start):
        return (escaped.start(2), escaped[2], 0) if escaped[2] else None
    if quoted := _QUOTED.match(text, start):
        return (quoted.start(quoted.lastindex), quoted[quoted.lastindex], 0) if quoted[quoted.lastindex] else None
    # (a value without quotes in JSON is a number or a constant)
    if extension in _CONFIG_EXT and extension != "json":
        bare = (_BARE_COMMAND if extension in ("sh", "") else _BARE).match(text, start)
        return (start, bare[1] if bare[2] is not None else None, bare.end(1)) if bare else None
    return None


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each credential masked, character for character; line ends stay."""
    parts, at = [], 0
    for low, high, _ in found:
        parts.append(text[at:low])
        parts.append(re.sub(r"[^\r\n]", "*", text[low:high]))
        at = high
    return "".join([*parts, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("kind", pa.string())]))
    for batch in batches:
        hits, masked = [], []
        for ext, text in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist(), strict=True):
            found = spans(text, ext)
            hits.append([(text.count("\n", 0, low) + 1, low, high, k) for low, high, k in found])
            masked.append(redact(text, found) if found else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("record_id"), batch.column("place"), pa.array(hits, kind), pa.array(masked, pa.string())], ["record_id", "place", "hits", "redacted"]
        )


_OUT = "record_id string, place int, hits array<struct<line_no:int,low:int,high:int,kind:string>>, redacted string"


def scan_files(files: DataFrame) -> DataFrame:
    """``record_id, place, hits, redacted`` per file with content (``place`` is null). Null and empty contents give no row."""
    ext = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1)).alias("ext")
    rows = files.where(F.col("content") != "").select(F.col("id").alias("record_id"), F.lit(None).cast("int").alias("place"), ext, "content")
    return rows.mapInArrow(_scan, _OUT)


def scan_configs(configs: DataFrame) -> DataFrame:
    """The same for each pattern of a redaction config; ``place`` is its number from 1."""
    rows = configs.select(F.col("config_id").alias("record_id"), F.posexplode("patterns").alias("place", "content")).where("content != ''")
    rows = rows.select("record_id", (F.col("place") + 1).alias("place"), F.lit("").alias("ext"), "content")
    return rows.mapInArrow(_scan, _OUT)


def located(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``table_name, record_id, line_no, kind`` of every credential; redelivered rows count once."""
    hits = lambda df, name, line: df.select(F.lit(name).alias("table_name"), "record_id", "place", F.explode("hits").alias("h")).select(
        "table_name", "record_id", F.expr(line).alias("line_no"), F.col("h.kind").alias("kind")
    )
    return hits(scan_files(files), "files", "h.line_no").unionByName(hits(scan_configs(configs), "redaction_configs", "place")).distinct()
