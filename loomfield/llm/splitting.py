"""Splitting oversized texts at natural boundaries (problem 2) by agglomerative merging.

A text starts as atomic segments, and every place between two of them has a strength: how natural a boundary it is. A heap
holds the adjacent pairs; the weakest boundary is merged away first, and among equal ones the pair that makes the smallest
piece, as long as the merged piece and the overlap it will repeat fit the limit. What is left are pieces that end at the
strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import spread

# Strengths of boundaries, weakest first.
CHARACTER, WORD, CLAUSE, SENTENCE, LINE, STATEMENT, PARAGRAPH, SECTION = range(8)

# How finer segments end.
SENTENCES = re.compile(r"(?<=[.!?。！？…])[\"'”’)\]]*\s+|(?<=[。！？])")
CLAUSES = re.compile(r"(?<=[,;:，、；：])\s*|\s+(?=[-–—(])")
WORDS = re.compile(r"(?<=\s)(?=\S)")
HEADING = re.compile(r"\s*(?:#{1,6}\s|\d+(?:\.\d+)*[.)]?\s+[A-Z]|[A-Z][A-Z \d]{6,}$)")
UNIT = re.compile(r"(?:(?:export|public|private|protected|internal|static|async|abstract|pub(?:\(\w+\))?)\s+)*(?:class|def|func|fn|fun|function|interface|impl|struct|enum|namespace|module|trait|type)\b|(?:///?|#|/\*\*|@\w)")
CLUSTER = re.compile("(?s)\r\n|.[\u0300-\u036f\ufe00-\ufe0f\u20d0-\u20ff]*(?:\u200d.[\u0300-\u036f\ufe00-\ufe0f\u20d0-\u20ff]*)*")


def _lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before) of each line; all kinds of line ends."""
    out = []
    blank, at = True, 0
    for line in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text):
        body = line.strip()
        if not out:
            strength = SECTION
        elif not body:
            strength = LINE
        elif HEADING.match(line) and blank:
            strength = SECTION
        elif blank:
            strength = SECTION if line[:1] not in " \t" and UNIT.match(line) else PARAGRAPH
        elif line[:1] not in " \t" and UNIT.match(line):
            strength = STATEMENT
        else:
            strength = LINE
        out.append((at, at + len(line), strength))
        blank, at = not body, at + len(line)
    return out


def _finer(text: str, start: int, end: int, strength: int, room: int) -> Iterator[tuple[int, int, int]]:
    """The segment cut into ones of at most ``room`` bytes: at sentences, else clauses, words, or characters."""
    if end - start <= room and len(text[start:end].encode("utf-8", "surrogatepass")) <= room:
        yield start, end, strength
        return
    part = text[start:end]
    for level, rule in ((SENTENCE, SENTENCES), (CLAUSE, CLAUSES), (WORD, WORDS)):
        cuts = [c for m in rule.finditer(part) if 0 < (c := m.end()) < len(part)]
        if cuts:
            edges = [0, *cuts, len(part)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if a < b:
                    yield from _finer(text, start + a, start + b, level if k else strength, room)
            return
    size, at = 0, start
    first = strength
    for m in CLUSTER.finditer(text, start, end):
        n = len(m.group().encode("utf-8", "surrogatepass"))
        if size + n > room and size:
            yield at, m.start(), first
            at, size, first = m.start(), 0, CHARACTER
        if n > room:  # one cluster of many marks: cut between its characters
            for k in range(m.start(), m.end()):
                yield k, k + 1, first
                first = CHARACTER
            at, size = m.end(), 0
            continue
        size += n
    if at < end:
        yield at, end, first


def overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the last ``overlap`` bytes of text[start:end] begin, moved on to the next whole character."""
    at, size = end, 0
    while at > start:
        c = ord(text[at - 1])
        size += 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4
        if size > overlap:
            break
        at -= 1
    return at


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece in characters: text[start:own start] repeats the piece before.

    Every piece has at most ``limit`` UTF-8 bytes; the own parts are the text. A text within the limit, empty or not, is
    one piece. The repeated part is the longest end of the piece before, of whole characters, within ``overlap`` bytes:
    it falls short of ``overlap`` by 3 bytes at most, or has all of a shorter piece. A character that alone is larger than the
    limit, which takes a limit below 4, is a piece of its own.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    overlap = max(0, min(overlap, limit - 4))  # room for any character
    if len(text) <= limit and len(text.encode("utf-8", "surrogatepass")) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap
    atoms = [x for a, b, s in _lines(text) for x in _finer(text, a, b, s, room)]
    n = len(atoms)
    end = [b for _, b, _ in atoms]
    strength = [s for _, _, s in atoms]
    ascii_only = text.isascii()
    size = [b - a if ascii_only else len(text[a:b].encode("utf-8", "surrogatepass")) for a, b, _ in atoms]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strength[k], size[k - 1] + size[k], k) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, total, k = heapq.heappop(heap)
        if not alive[k]:
            continue
        j = before[k]
        if total != size[j] + size[k]:  # grown since: its newer entry is in the heap
            continue
        if total + (overlap if j else 0) > limit:
            continue  # pieces only grow
        size[j], end[j], alive[k] = total, end[k], False
        nxt = after[j] = after[k]
        if nxt < n:
            before[nxt] = j
            heapq.heappush(heap, (strength[nxt], size[j] + size[nxt], nxt))
        if j:
            heapq.heappush(heap, (strength[j], size[before[j]] + size[j], j))
    out: list[tuple[int, int, int]] = []
    for k in range(n):
        if alive[k]:
            own = atoms[k][0]
            out.append((overlap_start(text, out[-1][0], own, overlap) if out else own, own, end[k]))
    return out


def pieces(items: DataFrame, keys: list[str], text: str = "text", limit: str = "max_size", overlap: str = "overlap_size") -> DataFrame:
    """(keys, piece_no, piece_start, own_start, piece_end, piece_bytes, piece_text) of the rows above their limit.

    ``limit`` and ``overlap``: columns, in UTF-8 bytes. Positions count characters from 0. Rows of null text or limit and rows
    within their limit give no piece; nulls in the keys are kept. One pass without a shuffle, by the text alone.
    """
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, (body, most, again) in enumerate(zip(batch["_text"], batch["_limit"], batch["_overlap"], strict=True)):
                for no, (start, own, end) in enumerate(split(body, int(most), int(again)), 1):
                    piece = body[start:end]
                    rows.append((at, no, start, own, end, len(piece.encode("utf-8", "surrogatepass")), piece))
            cut = pd.DataFrame(rows, columns=["_at", "piece_no", "piece_start", "own_start", "piece_end", "piece_bytes", "piece_text"])
            own = batch[keys].iloc[cut["_at"]].reset_index(drop=True)
            yield pd.concat([own, cut.drop(columns="_at")], axis=1)

    over = items.where(F.octet_length(text) > F.col(limit))
    given = over.select(*keys, F.col(text).alias("_text"), F.col(limit).alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).alias("_overlap"))
    return spread(given).mapInPandas(run, f"{schema}, piece_no int, piece_start int, own_start int, piece_end int, piece_bytes int, piece_text string")
