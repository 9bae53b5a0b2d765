"""Pairs of paths by the words that they share, made where they are given out: pairs are many times their input, so they are never shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import shared_folder

#: Between the words of a text; no word has it.
MARK = "\0"
#: Definitions that a cell is given, about; uses that it gathers before it makes their pairs; pairs that it makes, and rows that it hands over, at once.
HELD, GATHERED, PAIRS, HANDED = 1 << 18, 1 << 20, 1 << 20, 1 << 14
#: Pairs are sorted as numbers of 31 bits: which run of 2^10 targets of eight, which source of 2^18, which target in the run.
RUN, SOURCES, STEP = 10, 18, 13
#: Bytes of a row group in a block's file.
BLOCK = 1 << 23
OUT = pa.schema([("sources", pa.list_(pa.string())), ("targets", pa.list_(pa.string())), ("codes", pa.list_(pa.int64()))])


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts, with the text that each is from."""
    lists = pc.split_pattern(texts, MARK)
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)


class _Cell:
    """The product of a block of definitions, which is held, and a block of uses, which passes by in the order of paths."""

    def __init__(self) -> None:
        self.given: list[pa.RecordBatch] = []
        self.ready = False

    def take(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kinds = rows.column("kind").to_numpy(zero_copy_only=False)
        first = int(np.searchsorted(kinds, 1))  # definitions come before uses
        if first:
            self.given.append(rows.slice(0, first))
        if first < len(kinds):
            if not self.ready:
                self._prepare()
            if len(self.words):
                yield from self._use(rows.slice(first))

    def _prepare(self) -> None:
        held = pa.Table.from_batches(self.given).combine_chunks() if self.given else None
        self.given, self.ready = [], True
        self.paths: list[str] = held.column("path").to_pylist() if held else []
        self.place = {p: n for n, p in enumerate(self.paths)}
        if held and len(held):
            target, words = _words(held.column("text").chunk(0))
            coded = words.dictionary_encode()
            self.words, name = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        else:
            self.words = pa.array([], pa.string())
            return
        order = np.lexsort((target, name, target >> STEP))
        self.target, self.name = target[order], name[order]
        self.blocks = np.searchsorted(self.target >> STEP, np.arange((len(self.paths) >> STEP) + 2))
        self.sources: list[str] = []
        self.hits: list[np.ndarray] = []  # source and word in one number
        self.n = 0

    def _use(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, words = _words(rows.column("text"))
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        paths = rows.column("path").to_pylist()
        number = np.empty(len(paths), np.int64)
        for n, path in enumerate(paths):
            if not self.sources or self.sources[-1] != path:
                self.sources.append(path)
            number[n] = len(self.sources) - 1
        self.hits.append((number[text] * len(self.words) + known)[known >= 0])
        self.n += len(self.hits[-1])
        if self.n >= GATHERED or len(self.sources) > 1 << SOURCES:
            yield from self._pairs(len(self.sources) - 1)  # rows of the last path may follow

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.ready and len(self.words):
            yield from self._pairs(len(self.sources))

    def _pairs(self, end: int) -> Iterator[pa.RecordBatch]:
        """The pairs of the sources before ``end``; what is left of the others stays."""
        size = len(self.words)
        hits = np.unique(np.concatenate(self.hits)) if self.hits else np.empty(0, np.int64)
        cut = int(np.searchsorted(hits, end * size))
        source, word = np.divmod(hits[:cut], size)
        own = np.array([self.place.get(p, -1) for p in self.sources[:end]], np.int64)
        for block in range(len(self.blocks) - 1):
            low, high = self.blocks[block], self.blocks[block + 1]
            if low < high:
                counts = np.bincount(self.name[low:high], minlength=size)
                begins = low + np.cumsum(counts) - counts
                use = counts[word] > 0
                yield from self._block(block, source[use], counts[word[use]], begins[word[use]], own)
        self.sources = self.sources[end:]
        self.hits, self.n = [hits[cut:] - end * size], len(hits) - cut

    def _block(self, block: int, source: np.ndarray, counts: np.ndarray, begins: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(counts)
        at = 0
        while at < len(source):
            # whole sources, as many as give PAIRS pairs, one at least
            base = ends[at] - counts[at]
            to = max(int(np.searchsorted(ends, base + PAIRS, "right")), at + 1)
            to = int(np.searchsorted(source, source[to], "left")) if to < len(source) else to
            to = int(np.searchsorted(source, source[at], "right")) if to <= at else to
            to = min(to, int(np.searchsorted(source, source[at] + (1 << SOURCES), "left")))
            start, n = int(source[at]), counts[at:to]
            target = self.target[np.repeat(begins[at:to] - (ends[at:to] - n - base), n) + np.arange(ends[to - 1] - base)] - (block << STEP)
            keys = ((target >> RUN << (SOURCES + RUN)) + np.repeat((source[at:to] - start) << RUN, n) + (target & (1 << RUN) - 1)).astype(np.int32)
            keys.sort()
            places = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, weights = keys[places].astype(np.int64), np.diff(places, append=len(keys))
            mine = own[start : int(source[to - 1]) + 1]
            from_ = np.flatnonzero((mine >> STEP) == block)
            same = mine[from_] - (block << STEP)
            same = (same >> RUN << (SOURCES + RUN)) + (from_ << RUN) + (same & (1 << RUN) - 1)
            found = np.minimum(np.searchsorted(keys, same), len(keys) - 1)
            found = found[keys[found] == same]  # a path and itself
            keys, weights = np.delete(keys, found), np.delete(weights, found)
            yield from self._handed(block, start, keys, weights)
            at = to

    def _handed(self, block: int, start: int, keys: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        runs = np.searchsorted(keys >> (SOURCES + RUN), np.arange((1 << (STEP - RUN)) + 1))
        for run in range(len(runs) - 1):
            first = (block << STEP) + (run << RUN)
            targets = pa.array(self.paths[first : first + (1 << RUN)], pa.string()) if runs[run] < runs[run + 1] else None
            for a in range(runs[run], runs[run + 1], HANDED):
                b = min(a + HANDED, runs[run + 1])
                source = (keys[a:b] >> RUN) & (1 << SOURCES) - 1
                low, high = int(source[0]), int(source[-1]) + 1
                codes = pa.array((source - low) << 42 | (keys[a:b] & (1 << RUN) - 1) << 32 | weights[a:b])
                sources = pa.array(self.sources[start + low : start + high], pa.string())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (sources, targets, codes)]
                yield pa.RecordBatch.from_arrays(lists, schema=OUT)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of cells, in a cell definitions before uses, and these in the order of paths."""
    cell, number = _Cell(), None
    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(cells):
            if cells[at] != number:
                yield from cell.rest()
                cell, number = _Cell(), cells[at]
            to = int(np.searchsorted(cells, number, "right"))
            yield from cell.take(batch.slice(at, to - at))
            at = to
    yield from cell.rest()


def _read(file: str, cell: int, kind: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block's file, a row group at once at most."""
    uri = quote(file, safe="%/:?#[]@!$&'()*+,;=")  # Spark leaves letters beyond ASCII as they are
    system, path = pf.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    with system.open_input_file(path) as source:
        for rows in pq.ParquetFile(source).iter_batches(columns=["path", "text"]):
            numbers = [pa.array(np.full(len(rows), n, np.int32)) for n in (cell, kind)]
            yield pa.RecordBatch.from_arrays([*numbers, rows.column("path"), rows.column("text")], names=["cell", "kind", "path", "text"])


def _cells(batches: Iterator[pa.RecordBatch], uses: list[str], definitions: list[str]) -> Iterator[pa.RecordBatch]:
    """The pairs of the blocks that numbers of cells stand for."""
    for batch in batches:
        for cell in batch.column("cell").to_pylist():
            use, given = divmod(cell, len(definitions))
            yield from _products(rows for kind, file in enumerate((definitions[given], uses[use])) for rows in _read(file, cell, kind))


def blocks(df: DataFrame, n: int) -> list[str]:
    """Files of path and text, ``n`` at most, in the folder that executors share; all rows of a path are in one file, in the order of paths.

    ``df``: path, words (an array without nulls). Written once, however often blocks are read; removed as the application ends.
    """
    folder = shared_folder(df.sparkSession, "blocks")
    texts = df.where(F.col("path").isNotNull() & (F.size("words") > 0)).select("path", F.concat_ws(MARK, "words").alias("text"))
    # small row groups, as a reader holds one; a file that ends after some number of rows would split a path
    options = {"compression": "zstd", "parquet.block.size": BLOCK, "maxRecordsPerFile": 0}
    texts.repartition(n, "path").sortWithinPartitions("path").write.mode("append").options(**options).parquet(folder)
    return sorted(df.sparkSession.read.schema("path string, text string").parquet(folder).inputFiles())


def shared_words(uses: DataFrame, definitions: DataFrame, n_definitions: int, held: int = HELD) -> DataFrame:
    """(src, dst, weight): how many words a path of ``uses`` shares with another path of ``definitions``, for all pairs that share any.

    Both have path, words (an array without nulls): ``definitions`` a row a path with distinct words, ``uses`` any rows. ``n_definitions``: the words of
    ``definitions``, about. Pairs are many times the words that they come from, so these are dealt out instead: definitions in blocks by
    target, uses in blocks by source, and each block of the ones meets each of the others in a task, where all of a pair's words are together. Blocks
    are written once, to the folder that executors share, and tasks read them from there: sent to each task, they would take the square of the input. A
    task holds about ``held`` definitions, unless one path has more, makes pairs a million at a time, and hands them on as numbers, which get their paths as they are written.
    """
    spark = definitions.sparkSession
    q = max(1, -(-n_definitions // held))
    p = max(1, -(-4 * spark.sparkContext.defaultParallelism // q), 4 * q)
    given, used = blocks(definitions, q), blocks(uses, p)
    n = len(given) * len(used)
    cells = spark.range(n).select(F.col("id").cast("int").alias("cell")).repartitionById(max(1, n), F.col("cell"))
    made = cells.mapInArrow(partial(_cells, uses=used, definitions=given), "sources array<string>, targets array<string>, codes array<bigint>")
    code = F.col("code")
    source, target = F.shiftright(code, 42).cast("int"), F.shiftright(code, 32).bitwiseAND((1 << RUN) - 1).cast("int")
    pairs = made.select("sources", "targets", F.explode("codes").alias("code"))
    return pairs.select(F.get("sources", source).alias("src"), F.get("targets", target).alias("dst"), code.bitwiseAND((1 << 32) - 1).cast("double").alias("weight"))
