"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut one text; where a token of each ends at the same byte, the two are
linked. How often an id pair is linked in the whole corpus is counted with an inverted
index: for each pair and each container of documents a compressed bitmap of the
documents that hold the pair, and multiplicity planes for the documents that hold it
more than once (plane k: bit k of the repeats). Bitmaps of batches are OR-merged into
their container; population counts over the containers of a pair give its documents
and, weighted by plane, its links. The counts then travel back along the postings, so
documents receive their scores without any link being listed twice.

A container numbers at most 65,536 documents and holds a bounded number of postings, so
frequent pairs are many small rows and no task meets a pair or the corpus as a whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import batch_of, durable, narrow, text_bytes

CONTAINER = 65_536  # documents at most
POSTINGS = 2_000_000  # after which a container is closed
TEXT_BYTES = 1 << 20  # that are aligned at once
LONG_RUN = 500  # bytes without a border beyond which the heap-based encoder is used

DOC, LINKS = 0, 1  # kinds of rows that the first pass stores
STORED = "kind byte, container long, ordinal int, id long, n_a long, n_b long, n_groups long, sha string, a int, b int, plane byte, bits binary"

_LOADED: dict[bytes, Pair] = {}


class Pair:
    """The byte-level vocabulary A and the SentencePiece vocabulary B, with the bytes of every id."""

    def __init__(self, ranks: bytes, model: bytes, slow: bytes) -> None:
        import sentencepiece
        import tiktoken

        entries = {base64.b64decode(t): int(k) for t, k in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={})
        self.slow_file, self.slow = slow, None
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(entries.values()) + 2)
        for token, k in entries.items():
            self.a_bytes[k] = token
        names = [self.sp.id_to_piece(k) for k in range(self.sp.get_piece_size())]
        byte = self.sp.is_byte
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode_a(self, text: str, tangled: bool) -> np.ndarray:
        """Ids of a text whose special tokens are plain text."""
        if not tangled:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_buffer(self.slow_file)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(A ids, B ids) of each text; None where it is empty or either's bytes are not a space and the text."""
        shown = [t.decode() for t in texts]
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for raw, text, b in zip(texts, shown, self.sp.encode(shown, num_threads=1), strict=True):
            want = b" " + raw
            if not raw or b"".join(map(self.b_bytes.__getitem__, b)) != want:
                out.append(None)
                continue
            a = self.encode_a(" " + text, _tangled(raw))
            same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else None)
        return out


def _tangled(raw: bytes) -> bool:
    """Whether a text has a very long run without white space, or of nothing else."""
    if len(raw) <= LONG_RUN:
        return False
    blank = np.frombuffer(raw, np.uint8) <= 32
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return bool(np.diff(turns, prepend=-1, append=len(raw) - 1).max() > LONG_RUN)


def _pair(shipped: Broadcast) -> Pair:
    files = shipped.value
    key = hashlib.sha256(b"".join(files)).digest()
    if key not in _LOADED:
        _LOADED[key] = Pair(*files)
    return _LOADED[key]


DIGITS = 5  # of the largest id


def _digit_table(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0, 1, 2, ... laid out from the left, and how many there are."""
    numbers = np.arange(ids)
    sizes = np.ones(ids, np.int64)
    for k in range(1, DIGITS):
        sizes += numbers >= 10**k
    table = np.zeros((ids, DIGITS + 1), np.uint8)
    for at in range(DIGITS):
        power = 10 ** np.maximum(sizes - 1 - at, 0)
        table[:, at] = np.where(at < sizes, 48 + numbers // power % 10, 0)
    return table, sizes


DIGIT, SIZE = _digit_table(1 << 16)


class Aligned:
    """Links and groups of some texts that have tokens, laid end to end."""

    def __init__(self, pair: Pair, coded: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.a, self.b = np.concatenate([a for a, _ in coded]), np.concatenate([b for _, b in coded])
        self.n_a, self.n_b = (np.array([len(x[k]) for x in coded]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        at = np.searchsorted(ends_b, ends_a)  # both end with the last byte, so there is always one
        self.link_a = np.flatnonzero(ends_b[at] == ends_a)
        self.link_b = at[self.link_a]
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.link_a, side="right")
        self.n_links = np.bincount(self.doc, minlength=len(coded))

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        count_a, count_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        of_a, of_b = np.repeat(np.arange(len(count_a)), count_a), np.repeat(np.arange(len(count_b)), count_b)
        before_b = np.concatenate([[0], self.link_b[:-1] + 1])
        ids[np.arange(len(self.a)) + before_b[of_a]] = self.a
        ids[np.arange(len(self.b)) + self.link_a[of_b] + 1] = self.b
        mark[self.link_a + before_b] = ord("|")
        last = self.link_b + self.link_a + 1
        mark[last] = ord(";")
        laid, sizes = DIGIT[ids], SIZE[ids]
        laid[np.arange(n), sizes] = mark
        flat = laid[laid > 0].tobytes()
        # a text's string ends with the mark of its last group, which is left out
        ends = np.cumsum(sizes + 1)[last[np.cumsum(self.n_links) - 1]].tolist()
        return [flat[lo : hi - 1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def compressed(positions: np.ndarray) -> bytes:
    """A set of sorted positions below 65,536: a list of 16-bit numbers, or a bitmap where that is smaller."""
    if 16 * len(positions) <= int(positions[-1]) + 8:
        return b"\0" + positions.astype("<u2").tobytes()
    bits = np.zeros(int(positions[-1]) + 1, np.uint8)
    bits[positions] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def positions_of(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return np.frombuffer(blob, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), bitorder="little"))


def population(blob: bytes) -> int:
    if blob[:1] == b"\0":
        return len(blob) // 2
    return int(np.bitwise_count(np.frombuffer(blob, np.uint8, offset=1)).sum())


class Container:
    """Bitmaps of the documents of one container: batches are OR-merged as they come."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.postings = number, 0, 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, code: np.ndarray, ordinal: np.ndarray) -> None:
        """The links of some documents: pair codes and document positions."""
        key, times = np.unique(code << 16 | ordinal, return_counts=True)
        self.held.append((key, times))
        self.postings += len(key)

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
        """(plane, pair codes, bitmaps): -1 is the bitmap of documents, k the k-th bit of a document's repeats."""
        if not self.held:
            return
        key, times = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(key, kind="stable")
        key, repeats = key[order], times[order] - 1
        yield -1, *_bitmaps(key)
        for plane in range(int(repeats.max()).bit_length()):
            yield plane, *_bitmaps(key[(repeats >> plane & 1).astype(bool)])


def _bitmaps(key: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    code, position = key >> 16, key & 0xFFFF
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(begins, len(code))[1:]
    lists = position.astype("<u2").tobytes()
    blobs = [
        b"\0" + lists[2 * lo : 2 * hi] if hi - lo < 8 else compressed(position[lo:hi])
        for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True)
    ]
    return code[begins], blobs


def index(docs: DataFrame, shipped: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two kinds of rows from one pass: a row for each document and the postings of each container.

    DOC rows: container, ordinal, id, n_a, n_b, n_groups, sha (of the groups). LINKS
    rows: container, a, b, plane, bits. Store the result before use: containers are
    numbered by task.
    """
    schema = pa.schema(
        [
            ("kind", pa.int8()), ("container", pa.int64()), ("ordinal", pa.int32()), ("id", pa.int64()), ("n_a", pa.int64()),
            ("n_b", pa.int64()), ("n_groups", pa.int64()), ("sha", pa.string()), ("a", pa.int32()), ("b", pa.int32()),
            ("plane", pa.int8()), ("bits", pa.binary()),
        ]
    )

    def rows(kind: int, n: int, **columns) -> pa.RecordBatch:
        return batch_of(schema, {f.name: pa.nulls(n, f.type) for f in schema} | {"kind": np.full(n, kind, np.int8)} | columns)

    def closed(container: Container) -> Iterator[pa.RecordBatch]:
        for plane, code, blobs in container.rows():
            n = len(blobs)
            yield rows(
                LINKS, n, container=np.full(n, container.number), a=(code >> 16).astype(np.int32),
                b=(code & 0xFFFF).astype(np.int32), plane=np.full(n, plane, np.int8), bits=pa.array(blobs, pa.binary()),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shipped)
        now = Container(TaskContext.get().partitionId() << 32)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            cuts = np.flatnonzero(np.diff(offsets[:-1] // TEXT_BYTES, prepend=-1)).tolist() if len(offsets) > 1 else []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if now.docs + hi - lo > CONTAINER or now.postings > POSTINGS:
                    yield from closed(now)
                    now = Container(now.number + 1)
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(lo, hi)]
                coded = pair.encode(texts)
                have = np.array([k for k, c in enumerate(coded) if c is not None], np.int64)
                counts, shas = np.zeros((3, hi - lo), np.int64), [""] * (hi - lo)
                if len(have):
                    done = Aligned(pair, [coded[k] for k in have])
                    counts[:, have] = done.n_a, done.n_b, done.n_links
                    for k, text in zip(have.tolist(), done.groups(), strict=True):
                        shas[k] = hashlib.sha256(text).hexdigest()
                    now.merge(done.a[done.link_a] << 16 | done.b[done.link_b], now.docs + have[done.doc])
                yield rows(
                    DOC, hi - lo, container=np.full(hi - lo, now.number), ordinal=np.arange(now.docs, now.docs + hi - lo, dtype=np.int32),
                    id=batch.column("id").slice(lo, hi - lo), n_a=counts[0], n_b=counts[1], n_groups=counts[2], sha=pa.array(shas),
                )
                now.docs += hi - lo
        yield from closed(now)

    return narrow(docs, id=id_col, text=text_col).drop("uid").mapInArrow(run, STORED)


def pair_counts(indexed: DataFrame) -> DataFrame:
    """(a, b, documents, links, best): how many documents hold each pair, its links, and whether no other A id has more with its B id."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("documents", pa.int64()), ("links", pa.int64())])

    def popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.array([population(x) for x in batch.column("bits").to_pylist()], np.int64)
            plane = batch.column("plane").to_numpy().astype(np.int64)
            links = held << np.maximum(plane, 0)
            yield batch_of(schema, {"a": batch.column("a"), "b": batch.column("b"), "documents": np.where(plane < 0, held, 0), "links": links})

    counted = indexed.where(f"kind = {LINKS}").select("a", "b", "plane", "bits").mapInArrow(popcounts, "a int, b int, documents long, links long")
    counted = counted.groupBy("a", "b").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    # a window holds the pairs of one B id: no more than A has ids
    return counted.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _scores(key: tuple, docs: pa.Table, postings: pa.Table) -> pa.Table:
    """The documents of one container with what their postings return."""
    n = int(docs.column("ordinal").to_numpy().max()) + 1 if docs.num_rows else 0
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if postings.num_rows:
        sets = [positions_of(x) for x in postings.column("bits").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        weight = np.int64(1) << np.maximum(postings.column("plane").to_numpy().astype(np.int64), 0)
        at = np.concatenate(sets)
        np.add.at(total, at, np.repeat(weight * postings.column("links").to_numpy(), sizes))
        np.add.at(best, at, np.repeat(weight * postings.column("best").to_numpy(zero_copy_only=False), sizes))
    ordinal = docs.column("ordinal").to_numpy()
    kept = docs.select(["id", "n_a", "n_b", "n_groups", "sha"])
    return kept.append_column("n_best", pa.array(best[ordinal])).append_column("count_sum", pa.array(total[ordinal]))


def ship(docs: DataFrame, ranks_path: str, model_path: str, slow_path: str) -> Broadcast:
    """The vocabulary files' bytes: about four megabytes whatever the data."""
    files = []
    for path in (ranks_path, model_path, slow_path):
        with open(path, "rb") as f:
            files.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(files))


def align(docs: DataFrame, ranks_path: str, model_path: str, slow_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: how its tokens of A and of B align, scored by the corpus.

    A is the byte-level vocabulary of ``ranks_path`` (``slow_path`` holds it for the
    encoder that takes very long words) on a space and the text, B the SentencePiece
    model on the text. Texts that are null or empty, and those whose token bytes are not
    a space and the text, have no tokens: zeros and an empty ``groups_sha256``. Repeated
    rows and null ids keep a row each. Columns: id_col, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256.
    """
    indexed = durable(index(docs, ship(docs, ranks_path, model_path, slow_path), id_col, text_col), "pair-index")
    counts = durable(pair_counts(indexed), "pair-counts")
    postings = indexed.where(f"kind = {LINKS}").select("container", "a", "b", "plane", "bits")
    returned = postings.join(counts.select("a", "b", "links", "best"), ["a", "b"]).drop("a", "b")
    texts = indexed.where(f"kind = {DOC}").select(F.col("container").alias("own"), "ordinal", "id", "n_a", "n_b", "n_groups", "sha")
    kinds = "id long, n_a long, n_b long, n_groups long, sha string, n_best long, count_sum long"
    scored = texts.groupBy("own").cogroup(returned.groupBy("container")).applyInArrow(_scores, kinds)
    return scored.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),  # each common end is one link and ends one group
        "n_best",
        "count_sum",
        F.col("sha").alias("groups_sha256"),
    )
