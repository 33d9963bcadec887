"""Splitting oversized items at natural boundaries (problem 5).

An item is worked through in ranges. Each range is read with halos on both sides, detects the boundaries in its view and
tells, for every place at which a piece may end in its first `limit` characters, where the chain of pieces that goes on
from there leaves the range and how many pieces it makes. These small tables are stitched in range order: prefix sums of
the range lengths give the offsets, and the exit of one range is the entry of the next. Then every range emits its own
pieces by offset. No task holds an item longer than a range, and the pieces are those of one pass over the whole text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size limit and overlap of the pieces; code points of one range of a text, bytes of one range of a file.
LIMIT, OVERLAP, RANGE, FILE_RANGE = 3000, 200, 8192, 4 << 20
#: A run of white space is judged by its last RUN characters and the HALO characters before it.
RUN, HALO = 64, 16
#: A text has at most so many ranges; they grow with a text of more than RANGES * RANGE characters.
RANGES = 64
#: A cut fills at least this share of the limit if any boundary of a lower rank allows it.
FILL = 0.5
PARAGRAPH, SENTENCE, WORD = 3, 2, 1

#: The code points of white space.
SPACES = (*range(9, 14), *range(28, 33), 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDS, CLOSERS = frozenset(".!?…"), frozenset("»”\"'’)]")
_IS_SPACE = np.isin(np.arange(0x3002), SPACES)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _ends_sentence(before: str, after: str) -> bool:
    """Whether a sentence ends between the text before and the character after a run of white space.

    A full stop after one or two letters (initials, short abbreviations) ends none, nor does one before a small letter.
    """
    body = before.rstrip("»”\"'’)]")
    if not body or body[-1] not in ENDS or after.islower():
        return False
    if body[-1] != ".":
        return True
    k = len(body) - 1
    while k and body[k - 1].isalpha():
        k -= 1
    return not 0 < len(body) - 1 - k <= 2


def boundary_table(view: str, at_end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(offset, rank) of the boundaries in a view of an item: the end of each run of white space.

    A run that touches the right edge of the view is none unless the item ends there. Runs at the left edge are judged by
    what is seen of them, so a view needs RUN + HALO characters before the first boundary that is asked for.
    """
    codes = _codes(view)
    space = _IS_SPACE[np.minimum(codes, 0x3001)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], space, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not at_end and len(ends) and ends[-1] == len(view):
        starts, ends = starts[:-1], ends[:-1]
    newline = np.concatenate([[0], np.cumsum(codes == 10)])
    newlines = newline[ends] - newline[np.maximum(starts, ends - RUN)]
    sentence = np.zeros(len(ends), dtype=bool)
    for k in np.flatnonzero((ends - starts <= RUN) & (starts > 0)).tolist():
        s, e = int(starts[k]), int(ends[k])
        if view[s - 1] in ENDS or view[s - 1] in CLOSERS:
            sentence[k] = _ends_sentence(view[max(0, s - HALO) : s], view[e : e + 1])
    rank = np.where((newlines >= 2) | (newlines >= 1) & sentence, PARAGRAPH, np.where(sentence, SENTENCE, WORD))
    return ends, rank


class Chain:
    """The chain of pieces over the boundaries of a view. Offsets count from the start of the range; total is None if the
    end of the item is out of sight. A state is where the last piece ended; the state before the first piece is None."""

    def __init__(self, view: str, left: int, at_end: bool, limit: int, overlap: int):
        ends, rank = boundary_table(view, at_end)
        self.at = {r: (ends[rank >= r] - left).tolist() for r in (PARAGRAPH, SENTENCE, WORD)}
        self.total = len(view) - left if at_end else None
        self.limit, self.overlap = limit, overlap

    def piece(self, state: int | None) -> tuple[int, int, bool]:
        """(start, end, whether it is the last) of the piece after a state.

        A piece ends at the last paragraph end within the limit, else sentence end, else word end, else at the limit. A
        rank is passed over if its last boundary leaves the piece less than half full and a lower rank does better. It
        starts `overlap` characters before the end of the piece before it, or at the first word start after that point.
        """
        words = self.at[WORD]
        if state is None:
            start = done = 0
        else:
            done, start = state, state - self.overlap
            k = bisect_left(words, start)
            if k < len(words) and words[k] < done:
                start = words[k]
        if self.total is not None and self.total - start <= self.limit:
            return start, self.total, True
        reach = start + self.limit
        for least in (max(done, start + int(self.limit * FILL)), done):
            for rank in (PARAGRAPH, SENTENCE, WORD):
                own = self.at[rank]
                k = bisect_right(own, reach) - 1
                if k >= 0 and own[k] > least:
                    return start, own[k], False
        return start, reach, False

    def walk(self, state: int | None, n: float) -> Iterator[tuple[int, int]]:
        """Pieces after all states in front of n."""
        while state is None or state < n:
            start, end, last = self.piece(state)
            yield start, end
            if last:
                return
            state = end

    def entries(self) -> list[int]:
        """Places in the first `limit` characters at which a piece may have ended: boundaries, and wherever no boundary
        was near enough, so that the piece was cut at the limit."""
        words = self.at[WORD]
        k = bisect_left(words, 0)
        out, last = [], words[k - 1] if k else None
        free = self.limit - self.overlap
        for b in [*words[k : bisect_left(words, self.limit)], self.limit]:
            # Without a boundary in sight on the left every place may be a cut at the limit.
            out += range(max(0, last + free) if last is not None else 0, b)
            if b < self.limit:
                out.append(b)
            last = b
        return out

    def transitions(self, n: int, first: bool) -> list[tuple[int, int, int]]:
        """(entry, exit, pieces), the least entry of each run of entries with the same exit and number of pieces.

        exit is the first state at or beyond n, -1 if the item's last piece is reached.
        """
        held: dict[int | None, tuple[int, int]] = {}
        rows: list[tuple[int, int, int]] = []
        for entry in [None] if first else self.entries():
            if not first and entry >= n:
                break
            path, state = [], entry
            while state not in held and (state is None or state < n):
                path.append(state)
                _, end, last = self.piece(state)
                state = -1 if last else end
                if last:
                    break
            exit_, count = held.get(state, (state, 0))
            for s in reversed(path):
                count += 1
                held[s] = exit_, count
            if not rows or rows[-1][1:] != held[entry]:
                rows.append((entry or 0, *held[entry]))
        return rows


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of one text as one range. Empty or null: none."""
    return list(Chain(text, 0, True, limit, overlap).walk(None, float("inf"))) if text else []


_SUMMARY = "n long, entries array<long>, exits array<long>, pieces array<long>"


def _summary(chain: Chain, n: int, first: bool) -> tuple[int, list[int], list[int], list[int]]:
    rows = chain.transitions(n, first)
    return n, *([r[k] for r in rows] for k in range(3))


def stitched(summaries: Iterable[tuple[int, int, Sequence[int], Sequence[int], Sequence[int]]]) -> list[tuple[int, int, int, int]]:
    """(range_no, offset, entry, pieces before) of an item's ranges from (range_no, n, entries, exits, pieces) in order.

    Ranges in which no piece starts are left out.
    """
    rows, offset, entry, before = [], 0, 0, 0
    for no, n, entries, exits, pieces in summaries:
        if entry < n:
            rows.append((no, offset, entry, before))
            k = bisect_right(entries, entry) - 1
            before += pieces[k]
            if exits[k] < 0:
                break
            entry = exits[k]
        entry -= n
        offset += n
    return rows


def _entries(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range_no, offset, entry, before) of summaries(keys, range_no, n, entries, exits, pieces): a small row for each range."""

    @F.pandas_udf("array<struct<range_no:int,offset:bigint,entry:bigint,before:bigint>>")
    def stitch(items: pd.Series) -> pd.Series:
        names = ("range_no", "offset", "entry", "before")
        return items.map(lambda ranges: [dict(zip(names, row, strict=True)) for row in stitched((r["range_no"], r["n"], list(r["entries"]), list(r["exits"]), list(r["pieces"])) for r in ranges)])

    gathered = summaries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("range_no", "n", "entries", "exits", "pieces"))).alias("_ranges"))
    return gathered.select(*keys, F.inline(stitch("_ranges")))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _checked(limit: int, overlap: int, size: int) -> None:
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    if size < limit + overlap:
        raise ValueError("a range must hold a piece and its overlap")


def split_column(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of df's text column: keys, n_chars, piece_no (from 1), start, end, piece.

    start and end count code points of the text as stored; a piece starts before the end of the one before it, and dropping
    what lies before that end from each piece gives the text back. Null and empty texts have no piece; texts at or under
    the limit have one and never reach Python. Texts of more than one range are opened into range rows, whose summaries
    are shuffled and stitched; their slices, and no other text, meet the entries in a join. Equal rows give equal pieces,
    once for each row. Only keys and text are read, other columns may have any name.
    """
    _checked(limit, overlap, size)
    names = [f"_k{i}" for i in range(len(keys))]
    picked = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("_text")).withColumn("_n", F.length("_text")).where("_n > 0")

    @F.pandas_udf(SPANS)
    def long_spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in split_text(t, limit, overlap)] if t is not None else None)

    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_n").cast("long").alias("end")))
    spans = F.when(F.col("_n") <= limit, one).otherwise(long_spans(F.when(F.col("_n") > limit, F.col("_text"))))
    within = picked.where(F.col("_n") <= size).select(*names, "_n", F.col("_text").alias("_view"), F.lit(0).cast("long").alias("_from"), F.lit(0).cast("long").alias("_before"), F.posexplode(spans).alias("_no", "_span"))

    # Ranges of the longer texts; equal texts have equal ranges, so their contents are the key.
    left = overlap + RUN + HALO
    wide = F.greatest(F.lit(size), F.ceil(F.col("_n") / RANGES).cast("int"))
    ranged = picked.where(F.col("_n") > size).withColumn("_wide", wide).withColumn("item", F.md5(F.col("_text").cast("binary")))
    ranged = ranged.select(*names, "_n", "_text", "item", "_wide", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1, F.col("_wide"))).alias("range_no", "at"))
    begin = F.greatest(F.col("at") - left, F.lit(0))
    ranged = ranged.select(*names, "_n", "item", "range_no", F.substring("_text", begin + 1, F.col("at") - begin + F.col("_wide") + limit + 1).alias("_view"), (F.col("at") - begin).alias("_left"), F.least("_wide", F.col("_n") - F.col("at")).alias("_own"), (F.col("at") + F.col("_wide") + limit + 1 >= F.col("_n")).alias("_last"))

    @F.pandas_udf(_SUMMARY)
    def measured(views: pd.Series, lefts: pd.Series, own: pd.Series, last: pd.Series, no: pd.Series) -> pd.DataFrame:
        rows = [_summary(Chain(v, int(a), bool(z), limit, overlap), int(n), k == 0) for v, a, n, z, k in zip(views, lefts, own, last, no, strict=True)]
        return pd.DataFrame(rows, columns=["n", "entries", "exits", "pieces"])

    @F.pandas_udf(SPANS)
    def walked(views: pd.Series, lefts: pd.Series, own: pd.Series, last: pd.Series, no: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for v, a, n, z, k, e in zip(views, lefts, own, last, no, entry, strict=True):
            out.append([{"start": s, "end": t} for s, t in Chain(v, int(a), bool(z), limit, overlap).walk(None if k == 0 else int(e), int(n))])
        return pd.Series(out)

    view = ["_view", "_left", "_own", "_last", "range_no"]
    summaries = ranged.select("item", "range_no", measured(*view).alias("s")).select("item", "range_no", "s.*").dropDuplicates(["item", "range_no"])
    placed = ranged.join(_entries(summaries, ["item"]), ["item", "range_no"])
    beyond = placed.select(*names, "_n", "_view", (F.col("offset") - F.col("_left")).alias("_from"), F.col("before").alias("_before"), F.col("_left"), F.posexplode(walked(*view, "entry")).alias("_no", "_s"))
    beyond = beyond.select(*names, "_n", "_view", "_from", "_before", "_no", F.struct((F.col("_s.start") + F.col("_left")).alias("start"), (F.col("_s.end") + F.col("_left")).alias("end")).alias("_span"))
    opened = within.unionByName(beyond)
    return opened.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
        F.col("_n").alias("n_chars"),
        (F.col("_before") + F.col("_no") + 1).cast("int").alias("piece_no"),
        (F.col("_from") + F.col("_span.start")).cast("int").alias("start"),
        (F.col("_from") + F.col("_span.end")).cast("int").alias("end"),
        F.substring("_view", F.col("_span.start").cast("int") + 1, (F.col("_span.end") - F.col("_span.start")).cast("int")).alias("piece"),
    )


def split_files(spark: SparkSession, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """Pieces of UTF-8 files of any size: path, piece_no (from 1), start, end (code points), piece; those of split_text.

    files: (path string, bytes long), on a file system that all executors see as files; equal rows count once. A range is
    `size` bytes; a character that crosses a border belongs to the range in which it begins. Each range is read twice, with
    its halos: once for its summary (its length, and exits for its entries), once to emit its pieces from the entry that
    stitching found. A file's summaries, a small row for each range, are stitched in one task, its text never. Empty files
    have no piece; bytes that are no UTF-8 read as U+FFFD.
    """
    _checked(limit, overlap, (size - 8) // 4)
    borders = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))
    ranges = files.select("path", F.col("bytes").cast("long").alias("bytes")).where("bytes > 0").distinct().select("path", "bytes", F.posexplode(borders).alias("range_no", "at"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, total, no, at in pdf[["path", "bytes", "range_no", "at"]].itertuples(index=False):
                view, left, n, at_end = _read_range(path, at, size, total, limit, overlap)
                yield pd.DataFrame([(path, no, *_summary(Chain(view, left, at_end, limit, overlap), n, no == 0))], columns=["path", "range_no", "n", "entries", "exits", "pieces"])

    summaries = ranges.repartition("path", "range_no").mapInPandas(measure, f"path string, range_no int, {_SUMMARY}")
    placed = ranges.join(_entries(summaries, ["path"]), ["path", "range_no"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, total, no, at, offset, entry, before in pdf[["path", "bytes", "range_no", "at", "offset", "entry", "before"]].itertuples(index=False):
                view, left, n, at_end = _read_range(path, at, size, total, limit, overlap)
                spans = list(Chain(view, left, at_end, limit, overlap).walk(None if no == 0 else entry, n))
                yield pd.DataFrame({"path": path, "piece_no": range(before + 1, before + 1 + len(spans)), "start": [offset + a for a, _ in spans], "end": [offset + b for _, b in spans], "piece": [view[left + a : left + b] for a, b in spans]})

    return placed.repartition("path", "range_no").mapInPandas(emit, "path string, piece_no int, start long, end long, piece string")


def _read_range(path: str, at: int, size: int, total: int, limit: int, overlap: int) -> tuple[str, int, int, bool]:
    """(view, characters of its left halo, characters that begin in [at, at + size), whether the view ends with the file).

    Up to three continuation bytes at a border belong to the character before it; further ones are no UTF-8 and decode
    one by one wherever the border lies.
    """
    before, after = 4 * (overlap + RUN + HALO) + 4, 4 * (limit + 1) + 8
    low, high = max(0, at - before), min(total, at + size + after)
    with open(path, "rb") as f:
        f.seek(low)
        raw = f.read(high - low)

    def border(k: int) -> int:
        stop = min(k + 3, len(raw))
        while k < stop and raw[k] & 0xC0 == 0x80:
            k += 1
        return min(k, len(raw))

    begin, end = border(at - low) if at else 0, border(at + size - low) if at + size < total else len(raw)
    left = raw[:begin].decode("utf-8", "replace")[-(overlap + RUN + HALO) :] if begin else ""
    body = raw[begin:end].decode("utf-8", "replace")
    right = raw[end:].decode("utf-8", "replace")
    at_end = high == total and len(right) <= limit + 1
    return left + body + right[: limit + 1], len(left), len(body), at_end
