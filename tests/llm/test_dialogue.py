"""Conversation repair against a plain search over all edits, with short blocks, nulls, ties and repeats."""

import hashlib
import heapq
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tofcube.llm import dialogue, queries

ROWS = "conv_id bigint, turn bigint, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """rows: (role, text, gone, cut). The cheapest edits by search in the order of (cost, letters)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            # insertions cost more than nothing, so the first to arrive is the least
            return cost, audit, out
        put = lambda c, x, j, said, line: heapq.heappush(heap, (cost + c, audit + x, j, said, (*out, line) if line else out))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if (last, role[0]) in STEP:
                put(2, "I", i, role[0], f"{role}:")
                if i < len(rows) and not rows[i][2]:
                    put(2 + rows[i][3], "R", i + 1, role[0], f"{role}:{rows[i][1]}")
        if i < len(rows):
            role, text, gone, cut = rows[i]
            put(3, "D", i + 1, last, None)
            if not gone and role and (last, role[0]) in STEP:
                put(cut, "K", i + 1, role[0], f"{role}:{text}")
    raise AssertionError


def plain(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held[conv].append((turn is not None, turn, role, hashlib.sha256(text.encode()).digest(), text))
    out = Counter()
    for conv, own in held.items():
        own.sort()
        seen, now, tally = set(), [], Counter()
        for _, _, role, _, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            blank, dup = not bare, bool(bare) and (role, text) in seen
            cut = bool(bare) and not dup and bare[-1] not in ".!?"
            seen.add((role, text))
            tally += Counter(blank=blank, dup=dup, cut=cut)
            now.append((role, text, blank or dup, cut))
        turns = [t for _, t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:], strict=False))
        cost, audit, lines = cheapest(now)
        out[(conv, gaps, tally["blank"], tally["dup"], tally["cut"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())] += 1
    return out


def talks(seed, n=40, most=14):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", "", None])
            text = rnd.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", None, f"turn {t}.", f"turn {t}", "löwe…", "x.\t"])
            out.append((c if c else None, rnd.choice([t, t, t, t + 3, None]), role, text))
    return out + [out[5], out[5], (77, None, "system", "Only this."), (78, 4, "user", " ")]


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(3).withColumns({c: F.lit(7) for c in ("conv", "kind", "digest", "at", "code", "block", "row", "copy", "d", "first", "cost")})


@pytest.mark.parametrize("log2", [12, 1])
def test_repair(spark, monkeypatch, log2):
    monkeypatch.setattr(dialogue, "BLOCK", log2)
    rows = talks(log2)
    got = dialogue.repair(frame(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", 3)
    rows = [(5, t, random.Random(t).choice(["user", "assistant", "system"]), random.Random(t + 1).choice(["a.", "b?", "c", "d!", "e e.", ""]) + f" {t % 90}.") for t in range(400)]
    rows += [(9, t, "user", "again.") for t in range(50)]
    assert Counter(map(tuple, dialogue.repair(frame(spark, rows)).collect())) == plain(rows)


def test_sets_of_states_over_blocks():
    """Any cut of a conversation's rows into blocks gives the letters of the search over all of them."""
    import numpy as np

    rnd = random.Random(4)
    for _ in range(200):
        codes = [rnd.randrange(12) for _ in range(rnd.randint(1, 12))]
        cuts = sorted({0, len(codes), *(rnd.randint(0, len(codes)) for _ in range(3))})
        blocks = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        ends, total, _ = dialogue._scan_costs([{"block": i, "m": dialogue.block_matrix(b).ravel().tolist(), "inner": 0, "head": "-", "tail": "-"} for i, b in enumerate(blocks)])
        at, letters = 1, ""
        for b, e in zip(blocks, ends, strict=True):
            found = dialogue.trace(b, np.array(e["arrive"]), np.array(e["leave"]), total, e["last"], [1] if e["first"] else None)
            x, at = found[at]
            letters += x
        roles = ["system", "user", "assistant", "tool"]
        cost, audit, _ = cheapest([(roles[c // 3], "t", c % 3 == 2, c % 3 == 1) for c in codes])
        assert (total, letters) == (cost, audit)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "First."), (3, 0, "user", "")]
    got = sorted(map(tuple, dialogue.repaired_rows(frame(spark, rows)).collect()))
    assert got == [(1, 0, "system", "Be brief.", "K"), (1, 1, "user", "Hello?", "K"), (1, 2, "assistant", "Yes.", "K"), (2, 0, "user", "", "I"), (2, 1, "assistant", "First.", "K")]
    assert dialogue.repaired_rows(spark.createDataFrame([], ROWS)).count() == 0
    assert dialogue.repair(spark.createDataFrame([], ROWS)).count() == 0


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 1_000_000 + "?"), (1, 1, "assistant", " " * 1_000_000 + "x"), (1, 2, "user", " " * 100_000)]
    assert Counter(map(tuple, dialogue.repair(frame(spark, rows)).collect())) == plain(rows)


def test_query_with_nulls_and_lost_conversations(spark, tmp_path):
    import zlib

    rows = [(c, t, r, x) for c, t, r, x in talks(9, 60, 6)] + [(1000 + k, 0, "user", "One.") for k in range(60)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt, lost = [], set()
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            lost.add(conv)
            continue
        text = "" if d == 1 else text.translate({ord(c): None for c in ".!?"}) if d == 2 else text
        hurt += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    want = plain(hurt) + Counter((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost - {r[0] for r in hurt})
    assert lost - {r[0] for r in hurt}
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want
