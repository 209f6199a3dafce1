"""SentencePiece encoding and decoding, with merge-type encoding by backtracking.

A merge-type vocabulary joins, again and again, the neighbouring symbols whose
concatenation has the best score, the leftmost first. A token sequence is what the
merges give exactly when each pair of neighbours, merged on its own, gives that pair
back: within a token merges depend on the token alone, and across a border the two
neighbours meet in the same states whatever stands further away. So an encoder need
not merge the text. It takes the longest vocabulary match at each position (found for
all positions at once by an Aho-Corasick automaton), checks it against the token
before by re-merging the two, tries shorter matches, and steps back where none fits.
A position where nothing fits is marked in a bit field and never tried again: the
encoding of the text before it is unique, so it cannot be a token border.

White space only ever begins a piece, and characters fall into classes that no piece
joins (letters, marks, each digit alone; found from the vocabulary), so texts are cut
there and the encodings of frequent cuts are remembered. Cuts that are new in some texts are encoded side by side:
one search finds the matches of all, and each step tries one token of every cut.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, compress, count, islice, pairwise
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from flowsieve.llm.common import batch_of, narrow

SPACE = "▁"
REMEMBERED = 500_000  # cuts a worker keeps
LONGEST_REMEMBERED = 32  # characters
PORTION = 1 << 20  # characters of the texts whose cuts are looked up together
SIDE_BY_SIDE = 1 << 16  # new cuts that are encoded together
SLOTS = 1 << 20  # answers for pairs of tokens that a table holds; others are in a dictionary
NEVER = float("-inf")  # score of parts that do not merge

_LOADED: dict[str, Codec] = {}


class MergeEncoder:
    """Encodes normalised text over pieces with merge scores."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float]) -> None:
        import ahocorasick

        self.scores = scores
        self.names = list(ids)
        self.given = [ids[p] for p in self.names]  # the model's id of each token; None for strange characters
        self.token = {p: k for k, p in enumerate(self.names)}
        self.sizes = [len(p) for p in self.names]
        self.shorter: list[int] = [-2] * len(self.names)  # -2: not looked up yet, -1: none
        self.pieces = len(self.names)  # strange characters follow
        # single characters need no automaton: they are what stands where nothing longer matches
        self.matches = ahocorasick.Automaton()
        longer = [k for k, piece in enumerate(self.names) if len(piece) > 1]
        for k in longer:
            self.matches.add_word(self.names[k], k)
        if longer:
            self.matches.make_automaton()
        self.fits: dict[int, bool] = {}
        self.past: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.slots = np.full(SLOTS, -1, np.int64)

    def merged(self, text: str) -> list[str]:
        """What merging gives, by definition; encodings are compared with it."""
        parts, scores = list(text), self.scores
        near = [scores.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for k, score in enumerate(near):
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del near[at]
            if at:
                near[at - 1] = scores.get(parts[at - 1] + parts[at])
            if at < len(near):
                near[at] = scores.get(parts[at] + parts[at + 1])

    def history(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """A token's own merges: their scores, and its first and last part before each and at the end.

        None if merging its characters does not give the token.
        """
        if token in self.past:
            return self.past[token]
        parts, scores = list(self.names[token]), []
        firsts, lasts = [parts[0]], [parts[-1]]
        near = [self.scores.get(a + b, NEVER) for a, b in pairwise(parts)]
        while len(parts) > 1 and (best := max(near)) > NEVER:
            at = near.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            near[max(at - 1, 0) : at + 2] = [self.scores.get(a + b, NEVER) for a, b in pairwise(parts[max(at - 1, 0) : at + 2])]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        self.past[token] = ([*scores, NEVER], firsts, lasts) if len(parts) == 1 else None
        return self.past[token]

    def stay(self, left: int, right: int) -> bool:
        """Whether two neighbours, merged again from their characters, never merge across their border.

        As long as they do not, each one's merges are its own; the better score goes
        first, and the leftmost of equal ones.
        """
        after = self.history(right)
        if left < 0 or after is None:
            return after is not None
        before = self.history(left)
        if before is None:
            return False
        (mine, _, lasts), (theirs, firsts, _) = before, after
        i = j = 0
        while True:
            across, a, b = self.scores.get(lasts[i] + firsts[j], NEVER), mine[i], theirs[j]
            if a >= b:
                if across > a:
                    return False
                if a == NEVER:
                    return True
                i += 1
            elif across >= b:
                return False
            else:
                j += 1

    def strange(self, character: str) -> int:
        """Token of a character that is no piece of its own."""
        known = self.token.get(character)
        if known is None:
            known = self.token[character] = len(self.names)
            self.names.append(character)
            self.given.append(None)
            self.sizes.append(1)
            self.shorter.append(-1)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens (or one, after -1), merged again, stay what they are."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self.stay(left, right)
        return known

    def next_shorter(self, token: int) -> int:
        """The longest shorter piece that begins the token, or else its first character; -1 for a single one."""
        known = self.shorter[token]
        if known == -2:
            name = self.names[token]
            known = next((self.token[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.token), -1)
            if known < 0 and len(name) > 1:
                known = self.strange(name[0])
            self.shorter[token] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Tokens of ``text``; a character that no piece covers is a token of its own."""
        n, sizes, fits, shorter = len(text), self.sizes, self.fits, self.shorter
        longest = list(map(self.token.get, text))
        if None in longest:
            longest = [self.strange(c) if t is None else t for t, c in zip(longest, text, strict=True)]
        if len(self.matches):
            for end, token in self.matches.iter(text):  # a later end is a longer match
                longest[end + 1 - sizes[token]] = token
        failed = bytearray(n // 8 + 1)
        any_failed = False
        tokens: list[int] = []
        at, left = 0, -1
        token = longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    fit = fits.get(left << 32 | token)
                    if fit or (fit is None and self.compatible(left, token)):
                        break
                less = shorter[token]
                token = less if less != -2 else self.next_shorter(token)
            if token >= 0:
                tokens.append(token)
                left, at = token, end
                if at < n:
                    token = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                back = tokens.pop()
                at -= sizes[back]
                left = tokens[-1] if tokens else -1
                token = self.next_shorter(back)
        return tokens

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of each single character (-1: none); size and next shorter token (-1: none) of each piece."""
        if self.tables is None:
            single = np.full(sys.maxunicode + 1, -1)
            shorter = []
            for k, name in enumerate(self.names[: self.pieces]):
                if len(name) == 1:
                    single[ord(name)] = k
                found = (self.token.get(name[:n], -1) for n in range(len(name) - 1, 0, -1))
                # a strange first character (a later number) is never asked for here
                shorter.append(next((t for t in found if 0 <= t < self.pieces), -1))
            self.tables = single, np.array(self.sizes[: self.pieces]), np.array(shorter)
        return self.tables

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs; a slot holds a pair and its answer."""
        key = (left + 1) << 32 | right
        slot = (left * 0x9E3779B1 + right * 0x85EBCA77 >> 7) % SLOTS
        held = self.slots[slot]
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            fit = [self.compatible((k >> 32) - 1, k & 0xFFFFFFFF) for k in asked.tolist()]
            held[new] = key[new] << 1 | np.array(fit, np.int64)[back]
            self.slots[slot[new]] = held[new]
        return held & 1 == 1

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Texts encoded side by side, by the steps of ``encode``: (tokens of all, tokens of each, left out).

        Empty texts and texts with a character that is no piece are left out; their
        places are listed and they have no tokens.
        """
        single, size, shorter = self._tables()
        lengths = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        longest = single[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        number = np.repeat(np.arange(len(texts)), lengths)
        starts = np.cumsum(lengths) - lengths
        out = lengths == 0
        out[number[longest < 0]] = True
        if len(self.matches):
            found = np.fromiter(chain.from_iterable(self.matches.iter(whole)), np.int64).reshape(-1, 2)
            last, token = found[:, 0], found[:, 1]
            first = last + 1 - size[token]
            inside = number[first] == number[last]
            longest[first[inside]] = token[inside]  # of one place the last, which is the longest
        stack = np.zeros(len(whole), np.int64)  # tokens of a text from its start on
        failed = np.zeros(len(whole) + int(size.max(initial=1)), bool)
        counts = np.zeros(len(texts), np.int64)
        who = np.flatnonzero(~out)
        at, top = starts[who], starts[who]
        left, token = np.full(len(who), -1), longest[at]
        while len(who):
            some = token >= 0
            end = at + size[token]  # of no use where there is no token
            fit = some & ~failed[end]
            ask = np.flatnonzero(fit)
            fit[ask] = self._compatible(left[ask], token[ask])
            less = np.flatnonzero(~fit & some)
            go, stuck = np.flatnonzero(fit), np.flatnonzero(~some)
            token[less] = shorter[token[less]]
            left[go] = stack[top[go]] = token[go]
            top[go] += 1
            at[go] = end[go]
            if len(stuck):
                failed[at[stuck]] = True
                top[stuck] -= 1
                back = stack[top[stuck]]
                at[stuck] -= size[back]
                left[stuck] = np.where(top[stuck] > starts[who[stuck]], stack[top[stuck] - 1], -1)
                token[stuck] = shorter[back]
            over = np.zeros(len(who), bool)
            over[go] = at[go] == starts[who[go]] + lengths[who[go]]
            more = go[~over[go]]
            token[more] = longest[at[more]]
            if over.any():
                counts[who[over]] = top[over] - starts[who[over]]
                keep = ~over
                who, at, top, left, token = who[keep], at[keep], top[keep], left[keep], token[keep]
        used = np.arange(len(whole)) - starts[number] < counts[number]
        return stack[used], counts, np.flatnonzero(out).tolist()


def joined_classes(pieces: list[str]) -> list[list[str]]:
    """Classes of characters, largest first: neighbours within a piece, white space aside, are of one class."""
    above: dict[str, str] = {c: c for c in chain.from_iterable(pieces) if c != SPACE}

    def top(c: str) -> str:
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    for piece in pieces:
        for a, b in pairwise(piece.lstrip(SPACE)):
            above[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in sorted(above):
        classes.setdefault(top(c), []).append(c)
    return sorted(classes.values(), key=len, reverse=True)


class Codec:
    """A SentencePiece model of the merge type: encodes by backtracking, decodes with the library."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        normal = [k for k in range(len(names)) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
        if any(sp.is_unused(k) for k in normal) or any(re.search(f"[^{SPACE}]{SPACE}", names[k]) for k in normal):
            raise ValueError("the model has unused pieces or pieces with inner white space")
        self.encoder = MergeEncoder({names[k]: k for k in normal}, {names[k]: sp.get_score(k) for k in normal})
        self.bytes = {int(names[k][3:5], 16): k for k in range(len(names)) if sp.is_byte(k)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        # white space only begins a piece, and no piece joins characters of two classes: texts are cut there
        classes = [f"[{''.join(map(re.escape, c))}]+" for c in joined_classes([names[k] for k in normal]) if len(c) > 1]
        self.cuts = re.compile(f"{SPACE}*(?:{'|'.join([*classes, f'[^{SPACE}]'])})|{SPACE}+")
        self.seen: dict[str, bytes] = {}
        self.decimal = [str(k) for k in range(len(names))]
        self.given = np.array(self.encoder.given, np.int32)

    def _learn(self, cut: str) -> bytes:
        """Ids of one cut, as 32-bit numbers."""
        out: list[int] = []
        given = self.encoder.given
        for token in self.encoder.encode(cut):
            known = given[token]
            if known is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in self.encoder.names[token].encode()]
            else:
                out.append(self.unknown)
        found = array("i", out).tobytes()
        if len(cut) <= LONGEST_REMEMBERED:
            self.seen[cut] = found
        return found

    def _learn_all(self, cuts: list[str]) -> None:
        """Remember the ids of new cuts, which are encoded side by side."""
        tokens, counts, left_out = self.encoder.encode_all(cuts)
        numbers = self.given[tokens].tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        self.seen.update(zip(cuts, [numbers[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for k in left_out:
            self._learn(cuts[k])

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, then the end id."""
        seen, learn, end = self.seen, self._learn, self.end.to_bytes(4, sys.byteorder)
        if len(seen) >= REMEMBERED:  # forget the older half
            for old in list(islice(seen, REMEMBERED // 2)):
                del seen[old]
        of_text = [self.cuts.findall(self.sp.normalize(text)) for text in texts]
        cuts = list(chain.from_iterable(of_text))
        found = list(map(seen.get, cuts))
        gaps = list(compress(count(), map(not_, found)))
        fresh = [c for c in {cuts[k] for k in gaps} if len(c) <= LONGEST_REMEMBERED]
        for k in range(0, len(fresh), SIDE_BY_SIDE):
            self._learn_all(fresh[k : k + SIDE_BY_SIDE])
        for k in gaps:
            found[k] = seen.get(cuts[k]) or learn(cuts[k])
        parts = iter(found)
        for some in of_text:
            yield np.frombuffer(b"".join([*islice(parts, len(some)), end]), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, then the end id."""
        return next(self.encode_texts([text]))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def _codec(shipped: Broadcast) -> Codec:
    """The model of a broadcast, loaded once in each worker."""
    model = shipped.value
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Codec(model)
    return _LOADED[key]


def _portions(texts: list[str | None]) -> Iterator[list[str]]:
    """Neighbouring texts, closed once they hold ``PORTION`` characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ship(df: DataFrame, model_path: str) -> Broadcast:
    """The model file's bytes; a vocabulary of fixed size, about half a megabyte."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids",),
) -> DataFrame:
    """(id_col, uid, n_tokens, outputs): each whole text as the model's ids and an end id.

    ``outputs`` names what is wanted: ``ids`` (array), ``ids_text`` (decimal ids joined
    by one space), ``decoded`` (the ids decoded again). Null text is empty; an empty
    text is the end id alone. Every row gives one row, repeated rows and null ids
    included; an empty table gives an empty result. Texts are encoded one after another
    in tasks, nothing is shuffled.
    """
    model = _ship(docs, model_path)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "ids_text": ("string", pa.string()), "decoded": ("string", pa.string())}
    fixed = [("id", pa.int64()), ("uid", pa.int64()), ("n_tokens", pa.int64())]
    schema = pa.schema([*fixed, *[(name, kinds[name][1]) for name in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in ("n_tokens", "ids", "ids_text", "decoded")}
            for ids in chain.from_iterable(map(codec.encode_texts, _portions(batch.column("text").to_pylist()))):
                listed = ids.tolist()
                columns["n_tokens"].append(len(listed))
                if "ids" in outputs:
                    columns["ids"].append(ids)
                if "ids_text" in outputs:
                    columns["ids_text"].append(" ".join(map(codec.decimal.__getitem__, listed)))
                if "decoded" in outputs:
                    columns["decoded"].append(codec.decode(listed))
            yield batch_of(schema, columns | {"id": batch.column("id"), "uid": batch.column("uid")})

    base = narrow(docs, id=id_col, text=text_col)
    listed = ", ".join(f"{name} {kinds[name][0]}" for name in outputs)
    return base.mapInArrow(run, f"id long, uid long, n_tokens long, {listed}").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with its id lists decoded to text in ``text_col``; a null list is an empty text."""
    model = _ship(tokens, model_path)
    columns = [c for c in tokens.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != text_col]
    return tokens.select(*[f"`{c}`" for c in columns]).mapInArrow(run, ", ".join([*kinds, f"`{text_col}` string"]))
