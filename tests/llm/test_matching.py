"""Benchmark passages and quoted messages against brute force."""

import random
import zlib

import pytest

from flowsieve.llm import decontaminate, quotes
from flowsieve.llm.common import tune
from tests.llm.test_dedup import frame, prose


def least_distance(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out) + 1)
        kind = rng.random()
        if k == len(out):
            out.append(rng.choice("xyzé"))
        elif kind < 0.4:
            out[k] = rng.choice("xyzé")
        elif kind < 0.7:
            out.insert(k, rng.choice("xyzé"))
        else:
            del out[k]
    return "".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_myers(seed):
    rng = random.Random(seed)
    for _ in range(200):
        pattern = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))) + edited(rng, pattern, rng.randint(0, 6)) + "ab"
        masks = {c: sum(1 << k for k, d in enumerate(pattern) if c == d) for c in pattern}
        want = least_distance(pattern, text)
        got = decontaminate.myers(pattern, masks, text, 6)
        assert (got[0] if got else None) == (want if want <= 6 else None)


@pytest.mark.parametrize("slice_chars", [1 << 20, 300])
def test_contamination(spark, slice_chars):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.randint(3, 40))) for k in range(12)] + [(50, None), (51, " "), (52, "a"), (None, prose(rng, 30))]
    rows = [(1, None), (2, ""), (3, "zzz"), (None, items[1][1])]
    for k in range(90):
        item = items[k % 12][1]
        text = edited(rng, item, rng.randint(0, 9)).upper().replace(" ", rng.choice([" ", "\n", "  "]))
        rows.append((10 + k, prose(rng, rng.randint(0, 30)) + " " + text + " " + prose(rng, rng.randint(0, 30))))
    rows += [(200 + k, "x " + items[0][1] + " y") for k in range(50)] + [(200, "x " + items[0][1] + " y")]
    rows += [(300, prose(rng, 3000) + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), bench, slice_chars=slice_chars).collect()
    want = []
    for i, t in rows:
        held = []
        for item_id, text in items:
            pattern = decontaminate.normalised(text or "")
            if pattern:
                d = least_distance(pattern, decontaminate.normalised(t or ""))
                if d <= int(decontaminate.RATE * len(pattern)):
                    held.append((str(item_id), d))
        want.append((str(i), bool(held), sorted(held)))
    assert sorted((str(r.doc_id), r.contaminated, sorted((str(h.item_id), h.distance) for h in r.hits)) for r in got) == sorted(want)
    none = bench.where("item_id < 0")
    assert not any(r.contaminated for r in decontaminate.contamination(frame(spark, rows[:9]), none).collect())
    assert decontaminate.contamination(frame(spark, rows).where("doc_id < 0"), bench).count() == 0


def test_parse():
    own, passages = quotes.parse("Hi\nOn Monday, Bo wrote:\n> > deep one\n> > deep two\n> flat\nmy answer\n>last")
    assert own == "Hi\nmy answer"
    assert passages == [(2, "deep one\ndeep two"), (1, "flat"), (1, "last")]
    assert quotes.parse("no quote\n\n a > b") == ("no quote\n\n a > b", [])


def plain_links(rows):
    """What each message answers, its thread and its place, by looking at all pairs."""
    parsed = [(c, t, k, *quotes.parse(x or "")) for k, (c, t, _, x) in enumerate(rows)]
    usable = [p for p in parsed if p[0] is not None and p[1] is not None]
    answers = {}
    for c, t, k, _, passages in usable:
        best = None
        for number, (level, passage) in enumerate(passages):
            for part in quotes.parts(passage):
                held = [p for p in usable if part in quotes.parts(p[3])]
                near = [p for p in held if p[0] == c and (p[1], p[2]) < (t, k)]
                anywhere = min(((p[0], p[1], p[2]) for p in held), default=None)
                target = max((p[0], p[1], p[2]) for p in near) if near else anywhere if anywhere and anywhere < (c, t, k) else None
                if target is not None:
                    rank = (-level, len(part), -number)
                    if best is None or rank > best[0]:
                        best = (rank, target, level)
        if best:
            answers[k] = best[1:]
    parent = {p[0]: p[0] for p in usable}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (target, _) in answers.items():
        a, b = root(parsed[k][0]), root(target[0])
        parent[max(a, b)] = min(a, b)
    out = []
    for c, t, k, own, passages in parsed:
        thread = root(c) if c is not None and t is not None else None
        place = sum(1 for p in usable if root(p[0]) == thread and (p[0], p[1], p[2]) < (c, t, k)) if thread is not None else None
        target, level = answers.get(k, ((None, None, None), None))
        out.append((c, t, own, len(passages), target[0], target[1], level, thread, place))
    return out


@pytest.mark.parametrize(("seed", "span"), [(1, 1024), (2, 3)])
def test_links(spark, monkeypatch, seed, span):
    monkeypatch.setattr(quotes, "SPAN", span)
    tune(spark)
    rng = random.Random(seed)
    rows = [(None, 1, "user", "> lost words here"), (1, None, "user", "hello there, all"), (2, 0, None, None), (2, 0, None, None)]
    said = {}
    common = "the very same line for all"
    for conv in range(3, 16):
        for turn in range(rng.randint(1, 9) if conv != 7 else 60):
            own = rng.choice([prose(rng, 6), common, prose(rng, 4) + "\n\n" + prose(rng, 5)])
            source = said.get((conv, rng.randint(0, turn))) or said.get((rng.randint(3, 16), 0))
            text = own
            if source and rng.random() < 0.6:
                lines = rng.choice([source.split("\n"), source.split("\n")[:1]])
                text = "A wrote:\n" + "\n".join("> " * rng.randint(1, 2) + x.upper() for x in lines) + "\n" + own
            if rng.random() < 0.2:
                text += "\n> " + common
            said[conv, turn] = quotes.parse(text)[0]
            rows.append((conv, turn, "user", text))
    extra = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, uid string, span string").coalesce(1)
    got = quotes.link_quotes(extra).collect()
    fields = ("conv_id", "turn", "text", "n_quotes", "reply_conv", "reply_turn", "quote_level", "thread_id", "place")
    assert sorted(map(repr, ([r[f] for f in fields] for r in got))) == sorted(map(repr, (list(x) for x in plain_links(rows))))
    assert sum(r.reply_turn is not None for r in got) > 20
    assert quotes.link_quotes(extra.where("turn > 1000")).count() == 0


def test_derived_replies_find_their_originals(spark):
    """Every reply of the registered query is linked to a message that holds what it quotes, the latest before it."""
    tune(spark)
    rng = random.Random(3)
    texts = ["Short one.", "Two lines here.\nand a second.", "Para one is long.\n\nPara two, too.", "  ", None, "same for all of them"]
    rows = [(c, t, "user", rng.choice(texts) if rng.random() < 0.5 else prose(rng, 9)) for c in range(60) for t in range(5)] + [(None, 1, "user", "x"), (1, None, "user", "y")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    derived = quotes.replies(given)
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(given.unionByName(derived)).collect()}
    by_place = {(c, t): x for c, t, _, x in rows}
    kinds = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 10 for c, t in by_place}
    wanted = {k: v for k, v in kinds.items() if v < 4 and None not in k and (by_place[k] or "").strip()}
    assert derived.count() == len(wanted) and set(wanted.values()) == {0, 1, 2, 3}
    for (conv, turn), kind in wanted.items():
        reply = got[conv + (quotes.FAR if kind == 3 else 0), turn + quotes.FAR]
        quoted = by_place[conv, turn].split("\n")[0] if kind == 1 else by_place[conv, turn]
        assert reply.text == f"Reply to {conv}/{turn}." and reply.n_quotes == (2 if kind == 2 else 1)
        held = [k for k, x in by_place.items() if None not in k and quotes.parts(x or "") & {quotes.plain(quoted)}]
        best = max(k for k in held if k[0] == conv) if kind != 3 else min(held)
        links = {(x.reply_conv, x.reply_turn) for x in reply.links if x.level == (2 if kind == 2 else 1)}
        assert best in links, (conv, turn, kind)
        if kind in (0, 1):
            whole = {(x.reply_conv, x.reply_turn) for x in reply.links}
            assert (reply.reply_conv, reply.reply_turn) in whole
    assert sum(len(r.links) for r in got.values()) >= len(wanted)


def test_short_quotes(spark):
    """Fails where quotes under eight characters name nothing; across conversations they still do not."""
    tune(spark)
    rows = [(1, 0, "user", "thanks"), (1, 1, "user", "> thanks\nwelcome"), (1, 2, "user", "> 好的。\nwhat?"), (2, 0, "user", "> thanks\nno")]
    rows += [(3, 0, "user", "好的。"), (3, 1, "user", "> 好的。\n是"), (3, 2, "user", "> \n> 是\nend")]
    schema = "conv_id long, turn long, role string, text string"
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.link_quotes(spark.createDataFrame(rows, schema)).collect()}
    none = (None, None)
    assert got == {(1, 0): none, (1, 1): (1, 0), (1, 2): none, (2, 0): none, (3, 0): none, (3, 1): (3, 0), (3, 2): (3, 1)}


def test_all_links_of_a_message(spark):
    """Fails where a message keeps one link: it quotes two conversations, one of them deeper."""
    tune(spark)
    rows = [(3, 0, "user", "first words of three"), (5, 0, "user", "other words of five"), (8, 0, "user", "words of eight here")]
    rows += [(9, 0, "user", "> words of eight here\n> > first words of three\nyes\n> other words of five\nno"), (9, 1, "user", "alone")]
    schema = "conv_id long, turn long, role string, text string"
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, schema)).collect()}
    assert [tuple(x) for x in got[9, 0].links] == [(0, 1, 8, 0), (1, 2, 3, 0), (2, 1, 5, 0)]
    assert (got[9, 0].reply_conv, got[9, 0].quote_level) == (8, 1) and got[9, 1].links == []
    assert {(k, r.thread_id, r.place) for k, r in got.items()} == {((3, 0), 3, 0), ((5, 0), 3, 1), ((8, 0), 3, 2), ((9, 0), 3, 3), ((9, 1), 3, 4)}
