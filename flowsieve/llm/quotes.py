"""Reply-ordered conversations from quoted messages.

Messages are parsed line by line: leading ``>`` marks give the quote level. Lines of
one level that follow each other are a passage. Passages, and their single lines, are
normalised and hashed, and so are a message's own text, paragraphs and lines. A quote
is joined to the message it was taken from: the latest earlier one of the conversation,
or else, for quotes that are not very short, the first one anywhere, if that is earlier. Conversations that quote each other
become one thread, in which every original stands before its replies and quotes are gone.

Joins meet one row for each hash, and a conversation of any length is worked on in
spans of turns, so a line or a conversation that a third of all messages share is
never gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.llm.common import batch_of, durable
from flowsieve.llm.components import components
from flowsieve.operators.ordered import prefix_sums

MARKS = re.compile(r"[ \t]{0,3}>[ \t]?")
FAR = 1_000_000_000  # how far derived replies lie behind what they quote
SPAN = 1024  # turns of a conversation that are ordered together
LEAST_CHARS = 8  # normalised characters a quote needs before it can name an original of another conversation


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, rest of the line) for each line."""
    out = []
    for line in text.split("\n"):
        level, at = 0, 0
        while mark := MARKS.match(line, at):
            level, at = level + 1, mark.end()
        out.append((level, line[at:] if level else line))
    return out


def plain(text: str) -> str:
    """Lower case with white space runs as one blank: what is hashed."""
    return " ".join(text.lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes, quoted passages with their level).

    A line that ends in "wrote:" right above a quote introduces it and goes, too.
    """
    lines = levels(text)
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    for k, (level, rest) in enumerate(lines):
        if level:
            if passages and k and lines[k - 1][0] == level:
                passages[-1][1].append(rest)
            else:
                passages.append((level, [rest]))
        elif not (rest.rstrip().endswith("wrote:") and k + 1 < len(lines) and lines[k + 1][0]):
            own.append(rest)
    if not passages:
        return text, []
    return "\n".join(own).strip("\n"), [(level, "\n".join(some)) for level, some in passages]


def parts(text: str) -> set[str]:
    """Normalised whole, paragraphs and lines of a text."""
    some = {plain(text), *(plain(p) for p in re.split(r"\n[ \t]*\n", text)), *(plain(x) for x in text.split("\n"))}
    return some - {""}


def replies(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Replies to messages, derived from them: rows of the same columns that quote them.

    A rule by CRC-32 of ``conv:turn`` modulo 10 says how: 0 the whole message, 1 its
    first line, 2 the whole message one level deeper, under a line of the reply's own,
    3 the whole message from another conversation; others get no reply. Replies come a
    billion turns later. Messages without conversation, turn or text get none.
    """
    conv, turn, text = F.col(f"`{conv_col}`").cast("long"), F.col(f"`{turn_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = messages.where(conv.isNotNull() & turn.isNotNull() & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    kind = F.crc32(F.concat_ws(":", conv.cast("string"), turn.cast("string")).cast("binary")) % 10
    quoted = F.regexp_replace(text, "(?m)^", "> ")
    own = F.concat(F.lit("Reply to "), conv.cast("string"), F.lit("/"), turn.cast("string"), F.lit("."))
    said = (
        F.when(kind == 1, F.concat(F.lit("> "), F.substring_index(text, "\n", 1)))
        .when(kind == 2, F.concat(F.lit("> as was said:\n"), F.regexp_replace(quoted, "(?m)^", "> ")))
        .otherwise(quoted)
    )
    return rows.where(kind < 4).select(
        F.when(kind == 3, conv + FAR).otherwise(conv).alias(conv_col),
        (turn + FAR).alias(turn_col),
        F.lit("user").alias(role_col),
        F.concat(F.lit("A wrote:\n"), said, F.lit("\n"), own).alias(text_col),
    )


def _hash(text: str) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")), np.int64).tolist())


KEY = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
QUOTE = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("level", pa.int32()), ("size", pa.int32()), ("passage", pa.int32())])
PARSED = (
    "uid long, conv long, turn long, role string, own string, n_quotes int, held array<struct<h1:long,h2:long>>,"
    " quotes array<struct<h1:long,h2:long,level:int,size:int,passage:int>>"
)


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("uid", pa.int64()), ("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("own", pa.string()),
         ("n_quotes", pa.int32()), ("held", pa.list_(KEY)), ("quotes", pa.list_(QUOTE))]
    )
    for batch in batches:
        own_texts, counts, held, quoted = [], [], [], []
        for text in batch.column("text").to_pylist():
            own, passages = parse(text or "")
            own_texts.append(own)
            counts.append(len(passages))
            held.append([dict(zip(("h1", "h2"), _hash(p), strict=True)) for p in sorted(parts(own))])
            quoted.append(
                [
                    dict(zip(("h1", "h2", "level", "size", "passage"), (*_hash(p), level, len(p), k), strict=True))
                    for k, (level, passage) in enumerate(passages)
                    for p in sorted(parts(passage))
                ]
            )
        columns = {n: batch.column(n) for n in ("uid", "conv", "turn", "role")}
        yield batch_of(schema, columns | {"own": own_texts, "n_quotes": counts, "held": held, "quotes": quoted})


def _latest_before(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """(uid, h1, h2, at): for each quote the latest original with its hash before it, in its own conversation.

    Originals and quotes are put in order span by span; the last original of the spans
    before is one row for each span.
    """
    key = ["h1", "h2", "conv"]
    here = originals.join(quotes.select(*key).distinct(), key, "left_semi")
    place = F.struct("turn", "uid")
    span = F.floor(F.col("turn") / SPAN)
    both = here.select(*key, span.alias("span"), place.alias("place"), place.alias("seen")).union(
        quotes.select(*key, span.alias("span"), place.alias("place"), F.lit(None).alias("seen")).distinct()
    )
    spans = both.groupBy(*key, "span").agg(F.max("seen").alias("last"))
    spans = spans.withColumn("last", F.max("last").over(W.partitionBy(*key).orderBy("span").rowsBetween(W.unboundedPreceding, -1)))
    # a message that holds what it quotes is no original of its own: only rows before it count
    before = F.max("seen").over(W.partitionBy(*key, "span").orderBy("place", F.col("seen").desc_nulls_first()).rowsBetween(W.unboundedPreceding, -1))
    asked = both.withColumn("until", before).where(F.col("seen").isNull())
    asked = asked.join(spans, [*key, "span"])
    earlier = F.greatest("until", "last")
    return asked.withColumn("at", earlier).where(F.col("at").isNotNull()).select("h1", "h2", "conv", F.col("place.uid").alias("uid"), "at")


def link_quotes(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for every message: its own text, what it answers, and its place in its thread.

    A message answers the original of its shallowest quote that has one, of equals the
    longest, then the first passage; ``links`` has the originals of all its passages and
    their lines. Quotes without an original still go. Threads follow all links and are
    named by the smallest conversation that quotes reach; within a thread messages are
    ordered by conversation and turn, which puts originals first. Null text is empty;
    a message without conversation or turn keeps its row, is linked to nothing and has
    no thread or place. Repeated messages keep a row each. An empty table gives an
    empty result. Columns: conv_id, turn, role, text, n_quotes, reply_conv, reply_turn,
    quote_level, thread_id, place (from 0), links (array of passage, level, reply_conv,
    reply_turn).
    """
    picked = [F.col(f"`{c}`").cast("long").alias(n) for c, n in ((conv_col, "conv"), (turn_col, "turn"))]
    picked += [F.col(f"`{c}`").cast("string").alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    base = messages.select(*picked).withColumn("uid", F.monotonically_increasing_id())
    parsed = durable(base.mapInArrow(_parser, PARSED), "messages")
    usable = parsed.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    originals = usable.select("conv", "turn", "uid", F.inline("held"))
    quotes = durable(usable.select("conv", "turn", "uid", F.inline("quotes")), "quotes")
    wanted = originals.join(quotes.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    originals = durable(wanted, "originals")

    near = _latest_before(originals, quotes).select("h1", "h2", "uid", F.struct("conv", "at.turn", "at.uid").alias("near"))
    first = originals.groupBy("h1", "h2").agg(F.min(F.struct("conv", "turn", "uid")).alias("first"))
    found = quotes.join(near, ["h1", "h2", "uid"], "left").join(first, ["h1", "h2"], "left")
    self_ = F.struct("conv", "turn", "uid")
    target = F.coalesce("near", F.when((F.col("first") < self_) & (F.col("size") >= LEAST_CHARS), F.col("first")))
    found = durable(found.withColumn("target", target).where(F.col("target").isNotNull()), "found")
    rank = F.struct(-F.col("level"), "size", -F.col("passage"))
    answers = found.groupBy("uid").agg(F.max_by(F.struct("conv", "target", "level"), rank).alias("a"))
    answers = durable(answers.select("uid", "a.conv", F.col("a.target").alias("target"), "a.level"), "answers")

    link = F.struct("passage", "level", F.col("target.conv").alias("reply_conv"), F.col("target.turn").alias("reply_turn"))
    links = found.groupBy("uid").agg(F.sort_array(F.collect_set(link)).alias("links"))

    threads = components(found.select(F.col("conv").alias("a"), F.col("target.conv").alias("b")))
    threads = threads.select(F.col("node").alias("conv"), F.col("root").alias("thread_id"))
    linked = parsed.drop("held", "quotes").join(answers.select("uid", "target", "level"), "uid", "left").join(links, "uid", "left")
    linked = linked.join(threads, "conv", "left")
    linked = linked.withColumn("thread_id", F.coalesce("thread_id", "conv"))

    # places: messages of earlier spans, then the rank inside the span
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    span = F.when(known, F.struct("conv", F.floor(F.col("turn") / SPAN).alias("s")))
    linked = durable(linked.withColumn("span", span), "linked")
    counts = linked.where("span is not null").groupBy("thread_id", "span.conv", "span.s").agg(F.count(F.lit(1)).alias("n"))
    # running sums over spans in order, part by part: a thread of very many conversations is no group
    counts = prefix_sums(counts, ["conv", "s"], ["n"], ["thread_id"])
    counts = counts.select("thread_id", F.struct("conv", "s").alias("span"), (F.col("cum_n") - F.col("n")).alias("before"))
    inner = F.row_number().over(W.partitionBy("thread_id", "span").orderBy("turn", "uid"))
    placed = linked.withColumn("inner", inner).join(counts, ["thread_id", "span"], "left")
    return placed.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("own").alias(text_col),
        "n_quotes",
        F.col("target.conv").alias("reply_conv"),
        F.col("target.turn").alias("reply_turn"),
        F.col("level").alias("quote_level"),
        F.when(F.col("span").isNotNull(), F.col("thread_id")).alias("thread_id"),
        F.when(F.col("span").isNotNull(), F.col("before") + F.col("inner") - 1).cast("long").alias("place"),
        F.coalesce("links", F.array().cast("array<struct<passage:int,level:int,reply_conv:bigint,reply_turn:bigint>>")).alias("links"),
    )
