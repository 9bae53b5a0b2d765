"""Credentials in source code and configuration (problem 4).

A literal is explained by segmenting it into dictionary words with Viterbi's algorithm; the characters that no word explains are
its residual. A literal is a credential if its residual is long for where it stands: a few characters after an assignment
to a credential's name, in a sign-in call or in a URL's user part, many where nothing points to one. Digests in known
formats, identifiers, placeholders, look-ups, labels, public keys and images are excluded. Private key blocks are told by
their frame.

The dictionary is the list of whole words in a public tokenizer's vocabulary file, ordered by frequency.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.tokens import VOCABULARY
from loomfield.session import spread

MASK = "REDACTED"
LONGEST_WORD = 16
#: So many unexplained characters tell a random literal without the help of a digit.
LONG_RESIDUAL = 6

# Names under which credentials are kept, in several languages, without separators.
STRONG = (
    "password passwd passwort passphrase pwd kennwort contrasena contraseña motdepasse senha wachtwoord secret apikey accesskey "
    "secretkey privatekey signingkey licensekey encryptionkey masterkey sharedkey authkey serverkey sessionkey accesstoken authtoken refreshtoken "
    "bearertoken privatetoken apitoken sessiontoken credential credentials creds clientsecret webhooksecret connectionstring"
).split()
WEAK = ["token", "key", "auth", "authorization", "bearer", "cookie", "pin", "passe", "pass"]
# Parts of names that tell something about a credential instead of holding it, or hold a digest.
ABOUT = "label hint title prompt placeholder message hash hashed digest sha sha1 sha256 sha512 md5 checksum fingerprint etag integrity commit revision url uri endpoint path file name field header id uuid count length size limit type kind prefix public expires expiry ttl policy regex pattern help text description".split()
# Words that stand for a value still to be filled in.
STANDINS = "changeme changeit placeholder replace replaceme example sample dummy fake your yourkey todo tbd fixme none null nil undefined true false redacted removed hidden masked insert xxx test password passwd secret token user username default empty unset".split()

SHORT = re.compile(r"(?i)k\d+\Z")
SEPARATED = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñ]+|\d+")
HEX = re.compile(r"(?i)(?:0x)?[0-9a-f]+\Z")
HASH_SIZES = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"(?i)[{(]?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}[)}]?\Z")
DIGEST = re.compile(r"(?i)(?:sha(?:1|224|256|384|512)|md5)[-:$]|\$(?:2[aby]|5|6|1|apr1|argon2\w*|pbkdf2\S*)\$")
LOOKUP = re.compile(r"""\$\{|\$\(|\{\{|%\(|<%|\$[A-Z_]+\Z|process\.env|environ|getenv|env::|ENV\[|System\.|config\.|vault:|secretsmanager|ssm:|file:|op://|\A<[^<>]*>\Z|\A\[[^\]]*\]\Z|\A%[A-Z_]+%\Z|\A@@?\w+@@?\Z""")
JWT = re.compile(r"eyJ[\w-]{6,}\.[\w-]{4,}\.[\w-]{6,}\Z")
# How providers mark their tokens.
MARKED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z|gh[pousr]_\w{20,}\Z|github_pat_\w{20,}\Z|xox[abeoprs]-[\w-]{10,}\Z|[sr]k_(?:live|test|prod)_\w{10,}\Z|sk-[\w-]{16,}\Z|glpat-[\w-]{16,}\Z|AIza[\w-]{30,}\Z|SG\.[\w-]{16,}\.[\w-]{16,}\Z|npm_\w{30,}\Z|hf_\w{30,}\Z")

BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
USERINFO = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s/:@"'`<>]*):([^\s/@"'`<>]+)@""")
COMMAND = re.compile(r"(?i)\b(?:log_?in|auth|connect|-u[^\S\n]+\S+)\b")
OPTION = re.compile(r"""(?i)\s(?:-p|--pass|-P)[ =]?(["']?)([^\s"']{4,})\1""")
#: What stands before a value that is told in prose: everything since the last such sign, looked through once.
TOLD = re.compile(r"""(?<![^\n:`"'])([^\n:`"']*)(?::[^\S\n]+|`)(?=([^\s"'`<>,;(){}]{8,}))""")
TELLS = re.compile(r"\b(?:log ?in|sign ?in|token|key|pw|pwd|password|passphrase|secret|credentials?|creds)\b")
BEARER = re.compile(r"""(?:\bbearer|authorization["'\s:,=]+["']?(?:basic|token))[ ]+([a-z0-9._~+/=!#$%@-]{8,})""")
SIGNIN = re.compile(r"""(?:log_?in|sign_?in|connect|auth\w*)\(\s*(["'])[^"'\n]*\1\s*,\s*(["'])([^"'\n]+)\2""")
# These, BEARER and SIGNIN are looked for in small letters.
NAMED = re.compile(r"passw|passphrase|pwd|kennwort|contrase|mot_?de_?passe|senha|wachtwoord|secret|creds?\b|credential|token|auth|key|bearer|cookie|\bpin\b|\bk\d\b")
VALUE = re.compile(r"""[\w.-]*["'`\])}]*(?:\s*(?::=|=>|->|==?|:(?!:)|,(?=\s*["'`])|>|\bis\b|\bto\b|(?<=[\w`]) ?(?=`))\s*|(?=`))(?:[bru]{0,2}("{3}|["'`])([^\n]+?)\1|([^\s"'`<>,;(){}\[\]]{6,}))""")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/=_.~-])[A-Za-z0-9_][A-Za-z0-9+/=_.~-]{17,}")
BODY = re.compile(r"""(\\[nrt]|[\s"'`\\,+]+)|[^\s"'`\\]+""")
FENCED = re.compile(r"-----BEGIN (?:[A-Z0-9 ]+)-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)|data:[\w/+.-]+;base64,[A-Za-z0-9+/=]*|(?i:\bsha(?:1|256|384|512)-[A-Za-z0-9+/=]+)", re.S)
ABOUT_BEFORE = re.compile(r"(?i)(?:commit|checksum|integrity|sha\d*|md5|digest|hash|revision|etag|fingerprint|uuid|id)\Z")
DIGIT = re.compile(r"\d")
JOINING = frozenset(" \t\r\n:=\"'`])")

#: Rows that can hold a credential at all, as a single RE2 automaton: a key block, a user part, a sign-in, a name under which
#: credentials are kept, or a digit beside a letter or sign. Everything that is found has one of these.
GATE = r"""PRIVATE KEY|://[^\s/:@]*:[^\s/@]+@|(?i:log_?in|sign_?in|connect|auth\w*)\(\s*["']|(?i:log_?in|auth|connect|-u\s+\S+)\b[^\n]*\s(?i:-p|--pass)|[A-Za-z+/=_~!$#%@.-][0-9]|[0-9][A-Za-z+/=_~]|(?i:log ?in\b|sign ?in\b|\bpw\b)|(?i:""" + NAMED.pattern + ")"


@lru_cache(maxsize=2)
def dictionary(path: str = VOCABULARY) -> dict[str, float]:
    """Cost of each word: whole words of the vocabulary, cheaper the more frequent."""
    words: dict[str, float] = {}
    with open(path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            raw = base64.b64decode(token)
            if raw[:1] == b" " and len(raw) > 3 and raw[1:].isalpha() and raw.isascii():
                words.setdefault(raw[1:].decode().lower(), 0.6 + 0.08 * math.log2(int(rank) + 2))
    return words


@lru_cache(maxsize=65536)
def residual(literal: str, path: str = VOCABULARY) -> int:
    """Letters and digits of a literal that the cheapest segmentation into words leaves unexplained (Viterbi).

    A word is in small letters, in capitals, or capitalised; it costs about 1 to 2, an unexplained character 1, a
    separator next to nothing.
    """
    words = dictionary(path)
    n = len(literal)
    best = [0.0] * (n + 1)
    left = [0] * (n + 1)
    low = literal.lower()
    for at in range(1, n + 1):
        char = literal[at - 1]
        plain = char.isalnum()
        cost, rest = best[at - 1] + (1.0 if plain else 0.05), left[at - 1] + plain
        if char.isalpha():
            for size in range(3, min(LONGEST_WORD, at) + 1):
                start = at - size
                word = words.get(low[start:at])
                if word is None or best[start] + word >= cost:
                    continue
                part = literal[start:at]
                if part[1:].islower() or part.isupper():
                    cost, rest = best[start] + word, left[start]
        best[at], left[at] = cost, rest
    return left[n]


@lru_cache(maxsize=65536)
def name_kind(name: str) -> str:
    """What a name promises: ``strong``, ``weak``, ``pin``, ``about`` or nothing."""
    parts = [p.lower() for p in SEPARATED.findall(name)]
    if not parts:
        return ""
    if parts[-1] in ABOUT or parts[0] in ("public",):
        return "about"
    flat = "".join(parts)
    if any(flat.endswith(s) or flat.startswith(s) and len(s) > 5 for s in STRONG):
        return "strong"
    if parts[-1] == "pin":
        return "pin"
    return "weak" if parts[-1] in WEAK or SHORT.match(name) else ""


@lru_cache(maxsize=65536)
def stands_in(value: str) -> bool:
    """A look-up, a placeholder, or nothing but one repeated sign."""
    if LOOKUP.search(value) or len(set(value.strip("\"'"))) <= 2:
        return True
    parts = [p.lower() for p in SEPARATED.findall(value)]
    return any(p in STANDINS[:22] for p in parts) or bool(parts) and all(p in STANDINS for p in parts)


def unexplained(value: str, path: str = VOCABULARY, share: float = 0.55) -> bool:
    """Whether the residual is long for a literal without a digit, or one of digits alone."""
    return value.isascii() and residual(value, path) >= max(LONG_RESIDUAL, share * len(value))


def told_apart(text: str, at: int) -> bool:
    """Whether a literal is called a digest or an id by the word before it."""
    end = at
    while end and text[end - 1] in JOINING:
        end -= 1
    return end < at and bool(ABOUT_BEFORE.search(text, max(0, end - 16), end))


@lru_cache(maxsize=65536)
def grants(value: str, where: str, path: str = VOCABULARY) -> bool:
    """Whether a literal is a credential; ``where``: strong, weak, pin, user (a URL or a sign-in), about, or loose.

    Under a name the residual decides; only where it is short, or most of the literal is explained, has there to be a digit.
    """
    if where == "pin":
        if value.isdigit():
            return 4 <= len(value) <= 12 and not stands_in(value)
        where = "weak"
    if len(value) < 4 or stands_in(value) or UUID.match(value) or DIGEST.match(value):
        return False
    if JWT.match(value) or MARKED.match(value):  # a known form, and no words in it
        return residual(value, path) >= 4
    if HEX.match(value) and len(value) in HASH_SIZES:
        return where in ("strong", "user") or where == "weak" and not value.isdigit()
    if " " in value or "://" in value:
        return False
    has_digit, has_letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if where == "user":
        return len(value) >= 4 and residual(value, path) >= 1
    if where == "strong":
        return len(value) >= 6 and (has_digit and residual(value, path) >= 1 and has_letter or unexplained(value, path, 0.4))
    if where == "weak":
        return len(value) >= 8 and (has_digit and has_letter and residual(value, path) >= 2 or has_letter and unexplained(value, path))
    if len(value) < 18 or not has_digit or HEX.match(value.replace("-", "")):
        return False
    mixed = any(c.islower() for c in value) and any(c.isupper() for c in value)
    return mixed and value.count("/") <= 4 and residual(value, path) >= max(12, 0.55 * len(value))


def find(text: str, path: str = VOCABULARY) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each credential in a text, in order, without overlaps. Kinds: block, url, signin, bearer,
    named, told (in prose or a comment), loose."""
    spans: list[tuple[int, int, str]] = []
    fenced: list[tuple[int, int]] = []
    low = text.lower()
    if len(low) != len(text):  # letters whose small form is two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if "-----BEGIN" in text or "base64," in text or "sha" in text:
        fenced = [m.span() for m in FENCED.finditer(text)]
    for m in BLOCK.finditer(text):
        close = text.find(f"-----END {m[1]}-----", m.end())
        end = close if close >= 0 else _block_end(text, m.end())
        if _holds_key(text[m.end() : end], path):
            spans.append((m.start(), end, "block"))
    if "://" in text:
        spans += [(*m.span(2), "url") for m in USERINFO.finditer(text) if grants(m[2], "user", path)]
    for m in SIGNIN.finditer(low):
        if grants(text[slice(*m.span(3))], "user", path):
            spans.append((*m.span(3), "signin"))
    spans += [(*s, "signin") for s in _options(text) if grants(text[slice(*s)], "user", path)]
    if TELLS.search(low):
        for m in TOLD.finditer(text):
            if TELLS.search(low, *m.span(1)) and grants(m[2], "weak", path):
                spans.append((*m.span(2), "told"))
    for m in BEARER.finditer(low):
        if grants(text[slice(*m.span(1))], "strong", path):
            spans.append((*m.span(1), "bearer"))
    for m in NAMED.finditer(low):
        v = VALUE.match(text, m.end())
        if not v:
            continue
        start, end = v.span(2) if v[1] else v.span(3)
        value = text[start:end]
        if not v[1]:
            value = value.rstrip(".,;:")
            end = start + len(value)
            if value.startswith(("http", "--")) or not any(c.isdigit() for c in value) and not unexplained(value, path):
                continue
        first = m.start()
        while first and (text[first - 1].isalnum() or text[first - 1] in "_-."):
            first -= 1
        last = m.end()
        while last < len(text) and (text[last].isalnum() or text[last] in "_-"):
            last += 1
        if text[first - 2 : first] == "//" or text[first - 1 : first] == "@":  # part of a host's name
            continue
        kind = name_kind(text[first:last])
        if value[:7].lower() in ("bearer ", "basic "):
            continue
        if kind in ("strong", "weak", "pin") and grants(value, kind, path):
            spans.append((start, end, "named"))
    for m in LOOSE.finditer(text):
        if not DIGIT.search(m[0]):
            continue
        value = m.group().rstrip(".=") if text[m.end() - 1] == "." else m.group()
        if "=" in value.rstrip("="):  # a setting; its value is named or loose by itself
            cut = value.index("=") + 1
            value, start = value[cut:], m.start() + cut
        else:
            start = m.start()
        if grants(value, "loose", path) and not told_apart(text, start):
            spans.append((start, start + len(value), "loose"))
    order = {"block": 0, "url": 1, "signin": 2, "bearer": 3, "named": 4, "told": 5, "loose": 6}
    kept = _Spans()
    shut = _Spans(fenced)
    for a, b, kind in sorted(spans, key=lambda s: (order[s[2]], s[0])):
        if not kept.meets(a, b) and (kind == "block" or not shut.meets(a, b)):
            kept.add(a, b, kind)
    return kept.found


class _Spans:
    """Spans that do not overlap, in order; whether one meets them is a look-up."""

    def __init__(self, given: list[tuple[int, int]] = ()):
        self.found: list[tuple] = sorted(given)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.found, (a,))
        return k < len(self.found) and self.found[k][0] < b or k > 0 and self.found[k - 1][1] > a

    def add(self, a: int, b: int, kind: str) -> None:
        insort(self.found, (a, b, kind))


def _holds_key(body: str, path: str) -> bool:
    """Whether a private key's frame holds what words do not explain; one of less than a line is that of a window that stops there."""
    bare = BODY.sub(lambda m: "" if m[1] else m[0], body)
    return not bare or not stands_in(bare) and (len(bare) < 40 or residual(bare, path) >= 0.4 * sum(c.isalnum() for c in bare))


def _options(text: str) -> list[tuple[int, int]]:
    """Where the values of password options stand, the first after each command of the same line. Each line is read once."""
    out: list[tuple[int, int]] = []
    line, command, after = (-1, -1), None, 0
    for m in OPTION.finditer(text):
        if not line[0] <= m.start() <= line[1]:
            end = text.find("\n", m.start())
            line = (text.rfind("\n", 0, m.start()) + 1, end if end >= 0 else len(text))
            command = COMMAND.search(text, max(line[0], after), line[1])
        if command and command.end() <= m.start():
            out.append(m.span(2))
            after = m.end()
            command = COMMAND.search(text, after, line[1])
    return out


def _block_end(text: str, at: int) -> int:
    """Where the body of a key block ends that has no end mark (a window that stops in the middle)."""
    m = re.compile(r"(?:[A-Za-z0-9+/=]{16,}|\\n|\s|[A-Z][\w-]+: [^\n]*)*").match(text, at)
    return m.end() if m else at


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each credential replaced by a plain word, which is well formed wherever a literal was.

    Of a key block the frame, the line breaks and the indentation stay, so that quotes and block scalars still end where they did.
    """
    out, at = [], 0
    for start, end, kind in spans:
        out.append(text[at:start])
        if kind == "block":
            frame = BLOCK.match(text, start).end()
            out.append(text[start:frame] + BODY.sub(lambda m: m[1] or MASK, text[frame:end]))
        else:
            out.append(MASK)
        at = end
    return "".join([*out, text[at:]])


def scan(items: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(keys, lines, kinds, masked_text) of the rows with a credential: the lines, from 1, on which one starts, each once.

    Rows of null or empty text hold none. Nulls in the keys are kept. Texts are read whole. One pass without a shuffle; an RE2
    gate on whole batches leaves the rows that need a closer look.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch["_text"], GATE), False))
            at, lines, kinds, texts = [], [], [], []
            for k, body in enumerate(batch["_text"].to_pylist()):
                if spans := find(body, path):
                    at.append(k)
                    by_line: dict[int, str] = {}
                    line, seen = 1, 0
                    for start, _, kind in spans:
                        line, seen = line + body.count("\n", seen, start), start
                        by_line.setdefault(line, kind)
                    lines.append(list(by_line))
                    kinds.append(list(by_line.values()))
                    texts.append(masked(body, spans))
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lines, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*keys, "lines", "kinds", "masked_text"])

    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    given = items.select(*keys, F.col(text).alias("_text")).where("length(_text) > 0")
    return spread(given).mapInArrow(run, f"{schema}, lines array<int>, kinds array<string>, masked_text string")
