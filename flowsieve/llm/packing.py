"""Best-fit packing of documents into token sequences, with a large-item matching.

A bin holds ``capacity`` tokens. Items above a third of it pair at most twice per bin:
going from the longest down, each takes the longest unmatched one that still fits. The
items of a third or less then go, longest first, into the fullest bin with room.

Items of one length are interchangeable, so the packing is decided on the histogram of
lengths alone, which has at most ``capacity`` entries however many documents there are.
Bins are kept as ranges of numbers that share one gap, and a length fills whole ranges
at a time, so the plan has a few entries for each length too. Documents find their
place by their rank among the items of their length; ranks are counted in shares of
bounded size, so a length that most documents have is no single group.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import batch_of, durable, narrow, text_bytes

CAPACITY = 2048
END = 0  # id after the last token of a document
SHARE = 50_000  # items of one length that are ranked together
HELD_BYTES = 200 << 20  # of words a worker remembers
LONGEST_PLAIN = 1000  # bytes of a word that is split here
PLAIN = 0x250  # letters below are the same to every Unicode version
TEXT_BYTES = 4 << 20  # that are split into words at once
WIDTH = 4  # bytes of an id

_LOADED: dict[str, WordCodec] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Learnt(dict):
    """Results of a function, remembered."""

    def __init__(self, learn: Callable) -> None:
        self.learn, self.held = learn, 0

    def __missing__(self, key):
        found = self[key] = self.learn(key)
        self.held += len(key) + len(found) + 150
        return found


class WordCodec:
    """Ids of texts, word by word; words that come again are looked up.

    The vocabulary's own splitting never joins anything across white space, so a text's
    ids are those of its words in a row. Words are cut at ASCII white space only. Words
    of plain Latin letters are split here by the vocabulary's pattern; all others pass
    the library's own normaliser and splitter.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        self.added_start = os.path.commonprefix(added)  # the empty text if they have no common beginning
        byte_level = lambda k: tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))[0][0]
        self.plain = {k: byte_level(k) for k in range(PLAIN) if not chr(k).isspace() and not 0x1C <= k < 0x20}
        self.odd = re.compile(f"[^{re.escape(''.join(map(chr, self.plain)))}]").search
        self.seen, self.parts = _Learnt(self.word), _Learnt(self.part)

    def part(self, part: str) -> bytes:
        """Ids of one part of a word, all of whose letters are plain."""
        shown = part if part.isascii() and part.isprintable() else part.translate(self.plain)
        return _packed([t.id for t in self.model.tokenize(shown)])

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        # below PLAIN nothing composes, so normalising is lower-casing
        normal = word.lower()
        plain = raw.isascii() and word.isprintable() or not (self.odd(word) or self.odd(normal))
        if plain and len(raw) <= LONGEST_PLAIN and self.added_start not in normal:
            return b"".join(map(self.parts.__getitem__, self.split(normal)))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def words(self, text: bytes) -> list[bytes]:
        """A text's words; lower-cased where that cannot bring forth an added token."""
        return (text if self.added_start.encode() in text.lower() else text.lower()).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out = [b"".join(map(self.seen.__getitem__, self.words(text))) for text in texts]
        if self.seen.held + self.parts.held > HELD_BYTES:
            self.seen, self.parts = _Learnt(self.word), _Learnt(self.part)
        return out

    def stream(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Ids of the texts of a batch, a few megabytes at a time."""
        group = (offsets[:-1] // TEXT_BYTES).tolist()
        bounds = offsets.tolist()
        for _, some in groupby(range(len(group)), group.__getitem__):
            yield from self.encode([data[bounds[k] : bounds[k + 1]].tobytes() for k in some])


def _codec(path: str) -> WordCodec:
    if path not in _LOADED:
        _LOADED[path] = WordCodec(path)
    return _LOADED[path]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(id, uid, piece, start, length, ids_crc32[, ids]): each document's ids and an end id, cut where longer than ``capacity``.

    Only documents of more than ``capacity`` ids are cut, into pieces of exactly that
    size and a last one that may be shorter. Null text is empty: the end id alone. Every
    row counts, null and repeated ids included. ``tokenizer_path`` is read where tasks
    run; vocabularies are installed on every machine.
    """
    names = ["id", "uid", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=False)))
    end = END.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows: list[tuple] = []
            for id_, uid, ids in zip(batch.column("id").to_pylist(), batch.column("uid").to_pylist(), codec.stream(data, offsets), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), WIDTH * capacity)):
                    cut = ids[at : at + WIDTH * capacity]
                    rows.append((id_, uid, k, at // WIDTH, len(cut) // WIDTH, zlib.crc32(cut), cut))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield batch_of(schema, dict(zip(names, columns, strict=False)))

    listed = "id long, uid long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return narrow(docs, id=id_col, text=text_col).mapInArrow(run, listed)


@dataclass
class Plan:
    """Where items of each length go: ranks from ``first`` on fill bins from ``bin`` on, ``each`` to a bin, from ``offset`` on."""

    capacity: int
    bins: int = 0
    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # gap: ranges of bins (first, count)
    placed: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, count: int, each: int, bin_: int, offset: int) -> None:
        """``count`` items of one length, ``each`` to a bin."""
        first = self.placed.get(length, 0)
        self.length.append(length)
        self.first.append(first)
        self.each.append(each)
        self.bin.append(bin_)
        self.offset.append(offset)
        self.placed[length] = first + count

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def leave(self, gap: int, bin_: int, count: int) -> None:
        if gap and count:
            self.gaps.setdefault(gap, []).append((bin_, count))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Packs a histogram {length: items}. Its size, not the number of items, bounds the work."""
    if any(not 0 < size <= capacity for size in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan, left = Plan(capacity), {size: n for size, n in counts.items() if n}
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            n = left[size]
            partner = next((s for s in large if s + size <= capacity and left[s] and s <= size and (s < size or n > 1)), None)
            if partner is None:
                first = plan.open(n)
                plan.put(size, n, 1, first, 0)
                plan.leave(capacity - size, first, n)
                left[size] = 0
            elif partner == size:
                first = plan.open(n // 2)
                plan.put(size, n // 2 * 2, 2, first, 0)
                plan.leave(capacity - 2 * size, first, n // 2)
                left[size] -= n // 2 * 2
            else:
                n = min(n, left[partner])
                first = plan.open(n)
                plan.put(size, n, 1, first, 0)
                plan.put(partner, n, 1, first, size)
                plan.leave(capacity - size - partner, first, n)
                left[size] -= n
                left[partner] -= n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            gap = min((g for g in plan.gaps if g >= size), default=None)
            if gap is None:
                each = capacity // size
                bins = max(1, n // each)
                gap, first, have = capacity, plan.open(bins), bins
            else:
                first, have = plan.gaps[gap].pop()
                if not plan.gaps[gap]:
                    del plan.gaps[gap]
                each = gap // size
            # the fullest bin with room stays the fullest until it has none, so it takes all it can
            bins = min(have, n // each)
            if not bins:
                bins, each = 1, n
            plan.put(size, bins * each, each, first, capacity - gap)
            plan.leave(gap - each * size, first, bins)
            plan.leave(gap, first + bins, have - bins)
            n -= bins * each
    return plan


def _placer(plan: Plan):
    length, first = np.array(plan.length, np.int64), np.array(plan.first, np.int64)
    order = np.lexsort((first, length))
    length, first = length[order], first[order]
    each, bins, offset = (np.array(x, np.int64)[order] for x in (plan.each, plan.bin, plan.offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = length << 48 | first
        for batch in batches:
            sizes, ranks = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, sizes << 48 | ranks, side="right") - 1
            k = ranks - first[at]
            rest = batch.drop_columns(["rank"])
            new = [pa.array(bins[at] + k // each[at], pa.int64()), pa.array(offset[at] + k % each[at] * sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], [*rest.schema.names, "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """``pieces`` with (sequence_id, offset): its place in a sequence of at most ``capacity`` tokens.

    ``pieces`` needs (uid, piece, length); uid and piece together name a row and must not
    change when the frame is computed again, so pass a stored one. Sequences are gapless
    from 0 and numbered from 0. The driver sees one row for each length.
    """
    sizes = durable(pieces.groupBy("length").count(), "lengths")
    counts = {r["length"]: r["count"] for r in sizes.collect()}  # at most ``capacity`` rows
    plan = plan_bins(counts, capacity)
    shares = F.ceil(F.col("count") / share).cast("long")
    shared = pieces.join(F.broadcast(sizes.select("length", shares.alias("_shares"))), "length")
    shared = shared.withColumn("_share", F.pmod(F.xxhash64("uid", "piece"), "_shares")).drop("_shares")
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared.groupBy("length", "_share").count()
    starts = durable(starts.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "shares")
    own = F.row_number().over(Window.partitionBy("length", "_share").orderBy("uid", "piece")) - 1
    ranked = shared.withColumn("_own", own).join(starts, ["length", "_share"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col("_start") + F.col("_own")).cast("long").alias("rank"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(_placer(plan), ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """(id_col, uid, piece, start, length, ids_crc32[, ids], sequence_id, offset): documents packed into sequences.

    Documents as in ``token_pieces``. An empty table gives an empty result.
    """
    pieces = durable(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids), "token-pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): whole sequences of what ``pack_documents(..., with_ids=True)`` gives; ids little-endian, 32 bits."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # no more than ``capacity`` tokens
    whole = F.aggregate(rows, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
