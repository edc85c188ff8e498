"""Credentials embedded in source code: finding and redacting them.

Every quoted string and every long token of every line is a candidate. Its Shannon entropy, relative to the most
that its length and alphabet allow, is held against a threshold that falls with the length. What stands around a
candidate only moves that threshold: behind a credential's name, in a header, URL, call or command option it is
lower, for pass phrases have little entropy; a neutral place asks for the most. A provider's token form counts by
itself. Hashes, ids, references, identifiers, masked, encrypted and placeholder values, public keys, certificates and
blobs of data are left out. Private key blocks count line by line.
"""
from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"
MIN_LENGTH = 8
#: Least relative entropy by how much the surroundings say: a credential's name, a general key's name.
NAMED, GENERAL = 0.6, 0.8
#: In a neutral place: lengths that are judged (longer runs are data), and the threshold at either end.
FREE_LENGTHS, FREE_LEAST = (16, 64), (0.86, 0.82)

# fixed values: forms of providers' tokens
TOKEN_FORMS = (
    r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[opsur]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{40,}", r"glpat-[A-Za-z0-9_\-]{18,}",
    r"sk_live_[A-Za-z0-9]{16,}", r"rk_live_[A-Za-z0-9]{16,}", r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", r"AIza[A-Za-z0-9_\-]{30,}",
    r"npm_[A-Za-z0-9]{30,}", r"flt_[0-9a-f]{32,}", r"xox[abpr]-[A-Za-z0-9\-]{16,}", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
)
# fixed values: words of names behind which a credential stands, in English, German, French and Spanish
NAME_WORDS = (
    "password", "passwd", "passphrase", "passwort", "kennwort", "motdepasse", "contrasena", "clave", "pwd", "secret", "token",
    "apikey", "accesskey", "secretkey", "privatekey", "authkey", "signingkey", "credential", "credentials",
)
# fixed values: endings of names that tell about a credential but hold none
NOT_NAMES = ("name", "field", "id", "length", "count", "type", "path", "file", "prefix", "ttl", "header", "label", "hash", "publickey", "placeholder", "parser", "url")
# fixed values: what stands for a value that isn't there
PLACEHOLDERS = re.compile(r"(?i)^(?:changeme|change_me|example|placeholder|dummy|redacted|password|passwd|secret|token|none|null|true|false|todo|test|user|root|admin)$|x{4,}|\*{3,}|\.{3,}|\byour\b|your[_\- ]|<|>|\{\{|\$\{|%\(|^\$|^ENC\[|changeme|^env\.|process\.env|os\.environ|^vault:|^!|^arn:")

_TOKEN = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(TOKEN_FORMS) + ")(?![A-Za-z0-9])")
_HINT = re.compile(r"(?i)pass|pwd|secret|token|key|auth|cred|kennwort|clave|contrase|://|identified|mysql|curl|:\d+:|-----|akia|asia|gh[opsur]_|github_pat|glpat|_live_|SG\.|aiza|npm_|flt_|xox|eyJ|:\*:")
_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`"
_ASSIGN = re.compile(rf"(?P<q>[\"']?)(?P<name>[A-Za-z_][\w.\-]*)(?P=q)\s*(?::\s*[A-Za-z]\w*\s*)?(?:[:=]{{1,4}}|=>)\s*(?P<value>(?:{_QUOTED})(?:\s*\+\s*(?:{_QUOTED}))*)")
_BARE = re.compile(r"^\s*(?:export\s+|//[\w.\-]+/:)?(?P<q>[\"']?)(?P<name>[A-Za-z_][\w.\-]*)(?P=q)\s*[:=]{1,3}\s*(?P<value>[^\s\"'`()<>{}\[\],;]+)\s*(?:\s#.*)?$")
_INLINE = re.compile(r"(?P<name>PGPASSWORD|MYSQL_PWD|(?<=;)\s*(?:Password|Pwd)|_authToken)\s*=\s*(?P<value>'[^']*'|\"[^\"]*\"|[^\s;'\"]+)")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@'\"]+:(?P<value>[^\s@'\"/]+)@(?P<host>[\w.\-]+)")
_HEADER = re.compile(r"(?i)authorization['\"]?\s*[:=,]\s*['\"]?(?P<scheme>token|bearer|basic|apikey|key)\s+(?P<value>[A-Za-z0-9+/=_.\-]{8,})")
_CALL = re.compile(rf"\.(?P<name>[A-Za-z_]\w*)\(\s*(?P<value>{_QUOTED})\s*\)")
_SENT = re.compile(r"-H\s*['\"](?P<name>[\w\-]+):\s*(?P<value>[^\s'\"]+)['\"]")
_COMMAND = (
    re.compile(r"\bcurl\b.*?\s(?:-u|--user)\s*['\"]?[^\s:'\"]+:(?P<value>[^\s'\"]+)"),
    re.compile(r"\bmysql\w*\b.*?\s-p(?P<value>[^\s'\"]+)"),
    re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<value>\S+)"),
    re.compile(r"^\s*[\w.\-*]+:(?:\d+|\*):[\w\-*]+:[\w\-]+:(?P<value>\S+)\s*$"),
)
_PHRASE = (
    re.compile(r"(?i)\b(?:password|passphrase|kennwort|passwort|token|secret|identified by)\b[^`\"'=:()]{0,24}?(?P<value>`[^`\s]+`|'[^'\s]+'|\"[^\"\s]+\")"),
    re.compile(r"Credentials?\(\s*(?:\"[^\"]*\"|'[^']*')\s*,\s*(?P<value>\"[^\"]+\"|'[^']+')"),
    re.compile(r"(?i)<(?:password|passwd|secret|token|apikey)>(?P<value>[^<\s]+)</"),
    re.compile(r"(?i)^\s*(?://|#|--|/?\*).*\b(?:token|password|secret|key)\b[^:=\"'`]{0,24}:\s+(?P<value>\S{12,})\s*$"),
)
_BEGIN, _END = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"), re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"^[\s\"'+#*/\\]*[A-Za-z0-9+/=]{8,}(?:\\n)?[\s\"',;+]*$")
_CHECKSUM = re.compile(r"^[\s\"'+#*/\\]*(?:=[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{1,6}={1,2})(?:\\n)?[\s\"',;+]*$")
_DIGEST = re.compile(r"(?i)^(?:[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|\$2[aby]\$.*|\$argon2.*|\$[156]\$.*|\{ssha\}.*|pbkdf2.*)$")
_PASSWORD = re.compile(r"pass(?!phrase)|pwd|kennwort|contrasena|clave")
# neutral places: what a candidate looks like, what tells of something else, and words in identifiers
_FREE = re.compile(r"(?P<q>[\"'`])(?P<quoted>[A-Za-z0-9+/=_\-]{16,64})(?P=q)|(?<![^\s=:(,\[])(?P<plain>[A-Za-z0-9+/_\-]{16,64}={0,2})(?=[\s,;)\]]|$)")
_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{16}")
_OTHER = re.compile(r"(?i)\bssh-(?:rsa|dss|ed25519)|\becdsa-|ENC\[|;base64,|\bsha\d{1,3}[-:]|\bh1:|sourcemappingurl|signedsource|integrity|checksum|digest|fingerprint|\betag|\bcommit|\bmd5|\bhash|\bsha\d|uuid|guid|public|\btrace|\bspan|-----|\bnonce|://|certificate")
_SYLLABLES = re.compile(r"[A-Z]?[a-z]{4,}|[A-Z]{5,}|[a-z]{3,}(?=[_\-/]|$)|(?<![A-Za-z0-9])[a-z]+(?![A-Za-z0-9])")
_ALONE = re.compile(r"^\s*[\"'`]?[A-Za-z0-9+/_\-]+={0,2}[\"'`]?[\s,;+]*$")
_WORDS = re.compile(r"^(?:[A-Z]?[a-z]{2,}|[A-Z]{3,})(?:[_\-. /]?(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}))*$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")


def relative_entropy(text: str) -> float:
    """Shannon entropy of the characters over the most that a text of this length and alphabet can have (0 to 1)."""
    n = len(text)
    if n < 2:
        return 0.0
    if re.fullmatch(r"[0-9a-fA-F]+", text):
        alphabet = 16
    elif re.fullmatch(r"[A-Za-z0-9+/=_\-]+", text):
        alphabet = 64
    else:
        alphabet = 94
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    return entropy / math.log2(min(n, alphabet))


def _usable(value: str, least: float) -> bool:
    if _TOKEN.fullmatch(value):
        return not PLACEHOLDERS.search(value) and len(set(value)) > 8
    if len(value) < MIN_LENGTH or PLACEHOLDERS.search(value) or re.search(r"\s", value) or _UUID.match(value):
        return False
    varied = re.search(r"\d", value) or not _WORDS.match(value)
    return bool(varied) and len(set(value)) > 4 and relative_entropy(value) >= least


def _attribute(value: str) -> bool:
    """Whether a bare value is a dotted path of identifiers."""
    parts = value.split(".")
    return len(parts) > 1 and all(p.isidentifier() and (p.islower() or _WORDS.match(p)) for p in parts)


def _folded(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _name_level(name: str) -> float | None:
    """The threshold that a name asks for, None where no credential is expected behind it."""
    last = name.split(".")[-1]
    folded = _folded(last)
    if folded == "auth":
        return NAMED
    if folded.endswith(NOT_NAMES):
        return None
    if any(w in folded for w in NAME_WORDS) or re.search(r"(?:^|[_\-])pass$", last.lower()) or re.search(r"Pass$", last) or folded in ("pass", "dbpass"):
        return NAMED
    return GENERAL if folded not in ("publickey", "primarykey", "foreignkey") and re.search(r"(?:[a-z0-9]Key|[_\-]key|^key)$", last) else None


def _literal(value: str) -> str:
    """The text of one or more joined quoted strings."""
    return "".join(p[1:-1] for p in re.findall(_QUOTED, value)) if value[:1] in "\"'`" else value


def _insides(m: re.Match) -> list[tuple[int, int]]:
    """Places of a value: the insides of its quoted strings, or the whole of a bare one."""
    a, b = m.span("value")
    if m["value"][0] not in "\"'`":
        return [(a, b)]
    return [(a + q.start() + 1, a + q.end() - 1) for q in re.finditer(_QUOTED, m["value"])]


def _basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def free_spans(line: str) -> list[tuple[int, int]]:
    """Places of quoted strings and long tokens whose entropy alone tells a credential, wherever they stand."""
    if not _RUN.search(line):
        return []
    found = []
    for m in _FREE.finditer(line):
        value = m["quoted"] or m["plain"]
        n = len(value)
        lower, upper, digit = (sum(map(f, value)) for f in (str.islower, str.isupper, str.isdigit))
        if digit < 2 or lower + upper < 4 or not lower or not (upper or n >= 24) or re.fullmatch(r"[0-9a-fA-F\-]+", value):
            continue
        if value.count("/") + value.count("-") + value.count("_") > n // 6 or PLACEHOLDERS.search(value) or _UUID.match(value):
            continue
        if sum(len(w) for w in _SYLLABLES.findall(value)) > 0.4 * n or (m["plain"] and _ALONE.match(line)):
            continue
        least = FREE_LEAST[0] + (FREE_LEAST[1] - FREE_LEAST[0]) * (n - FREE_LENGTHS[0]) / (FREE_LENGTHS[1] - FREE_LENGTHS[0])
        if relative_entropy(value) >= least:
            found.append(m.span("quoted" if m["quoted"] else "plain"))
    return [] if found and _OTHER.search(line) else found


def spans(line: str) -> list[tuple[int, int]]:
    """Places (from, to) of the credentials in a line."""
    free = free_spans(line)
    return free + named_spans(line) if _HINT.search(line) else free


def named_spans(line: str) -> list[tuple[int, int]]:
    """Places of values whose surroundings or form lower the threshold."""
    found = []
    for m in _TOKEN.finditer(line):
        if not PLACEHOLDERS.search(m.group()) and len(set(m.group())) > 8:
            found.append(m.span())
    if _BEGIN.search(line):
        m = re.search(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[^\"'`]*", line)
        found.append(m.span())
    for form in (_ASSIGN, _INLINE, _CALL, _SENT):
        for m in form.finditer(line):
            level, value = _name_level(m["name"].strip()), _literal(m["value"])
            if _TOKEN.fullmatch(value) and not PLACEHOLDERS.search(value):
                level = NAMED
            if form is _CALL and _folded(m["name"]) in ("authenticate", "login"):
                level = NAMED
            if _folded(m["name"]) == "auth" and not _basic(value):
                continue
            if level is not None and _usable(value, level) and not (_DIGEST.match(value) and _PASSWORD.search(_folded(m["name"]))):
                found += _insides(m)
    if (m := _BARE.match(line)) and _name_level(m["name"]) == NAMED and _usable(m["value"], NAMED) and not _attribute(m["value"]):
        found.append(m.span("value"))
    for m in _URL.finditer(line):
        if _usable(m["value"], NAMED):
            found.append(m.span("value"))
    for m in _HEADER.finditer(line):
        if _basic(m["value"]) if m["scheme"].lower() == "basic" else _usable(m["value"], NAMED):
            found.append(m.span("value"))
    for form in _COMMAND:
        if (m := form.search(line)) and _usable(m["value"], NAMED):
            found.append(m.span("value"))
    for form in _PHRASE:
        for m in form.finditer(line):
            value = _literal(m["value"])
            if _usable(value, NAMED) and re.search(r"\d|[a-z][A-Z]", value):
                found += _insides(m)
    return found


def redact(line: str, places: list[tuple[int, int]]) -> str:
    """``line`` with every place replaced by MASK; quotes, names and all code around them stay."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(places):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [line[at:a], MASK]
        at = b
    return "".join(out) + line[at:]


def _blank(line: str) -> str:
    """A line of a key block with its runs of key text masked; quotes, escapes and code around them stay."""
    return re.sub(r"(\\[nrt])|=?[A-Za-z0-9+/]{4,}={0,2}|[A-Za-z0-9+/]+={1,2}", lambda m: m.group(1) or MASK, line)


def scan_file(hunks: list[list[str | None]]) -> list[tuple[int, int, str, str]]:
    """(hunk_no, line_no, kind, redacted) of every line of a file that holds a credential."""
    found: dict[tuple[int, int], tuple[str, str]] = {}
    flat = [(h, n, text or "") for h, lines in enumerate(hunks) for n, text in enumerate(lines)]
    inside = False
    for k, (h, n, text) in enumerate(flat):
        marks = text.find("-----") >= 0
        if marks and _END.search(text) and not _BEGIN.search(text):
            if not inside:  # the block's head isn't shown
                for at, (hh, nn, body) in enumerate(reversed(flat[:k])):
                    if not (_BODY.match(body) or at == 0 and _CHECKSUM.match(body)):
                        break
                    found[hh, nn] = ("private key", _blank(body))
            found[h, n] = ("private key", re.sub(r"(?:[A-Za-z0-9+/=]{4,}(?:\\n)?)?-----END [A-Z0-9 ]*-----", MASK, text))
            inside = False
            continue
        if marks and _BEGIN.search(text):
            found[h, n] = ("private key", redact(text, spans(text)))
            inside = not _END.search(text)
            continue
        if inside:
            if _BODY.match(text) or _CHECKSUM.match(text):
                found[h, n] = ("private key", _blank(text))
                continue
            if re.match(r"^\s*(?:Proc-Type|DEK-Info|Comment|Version):|^\s*$", text):
                found[h, n] = ("private key", re.sub(r"(:\s*)\S.*", lambda m: m.group(1) + MASK, text))
                continue
            inside = False
        if text and (places := spans(text)):
            if _ALONE.match(text) and any(_ALONE.match(t) and abs(len(t) - len(text)) < 3 for t in (flat[k - 1][2] if k else "", flat[k + 1][2] if k + 1 < len(flat) else "")) and not _HINT.search(text):
                continue  # one of several such lines: a blob
            found[h, n] = ("value", redact(text, places))
    return [(h, n, kind, red) for (h, n), (kind, red) in sorted(found.items())]


def find_secrets(files: DataFrame) -> DataFrame:
    """(file_id, hunk_no, line_no, kind, redacted) of all lines with credentials in ``files`` (file_id, hunks).

    Null hunks, lines and contents hold nothing; repeated files are scanned each; without files there are no rows.
    One row of input is one task's unit, so a hot repository spreads over all tasks.
    """
    texts = files.select("file_id", F.transform("hunks", lambda h: F.coalesce(F.transform(h["lines"], lambda x: x["content"]), F.array().cast("array<string>"))).alias("texts")).where("file_id is not null and texts is not null")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, *hit) for f, hunks in zip(frame["file_id"], frame["texts"]) for hit in scan_file([list(h) if h is not None else [] for h in hunks])]
            yield pd.DataFrame(rows, columns=["file_id", "hunk_no", "line_no", "kind", "redacted"])

    return texts.mapInPandas(scan, "file_id bigint, hunk_no int, line_no int, kind string, redacted string")
