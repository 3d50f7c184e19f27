"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from promospark.llm.chat_repair import auction_prices, damaged, distances, repair_report, repaired_rows

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """One conversation: least (cost, audit) by a search that pops paths in that order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen
                      else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    n, best = len(rows), None
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ("", "a"):
            best = (cost, audit, lines)
            break
        want = "a" if state == "u" else "u"
        role = {"u": "user", "a": "assistant"}[want]
        heapq.heappush(queue, (cost + 5, audit + "I", i, want, lines + ((role, ""),)))
        if i < n:
            _, _, own, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, want, lines + ((role, text),)))
                if own[:1] == want or (own[:1] == "s" and state == ""):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, own[0], lines + ((own, text),)))
    cost, audit, lines = best
    assert PATTERN.fullmatch("".join(r[0] for r, _ in lines))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "x" for r in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()), lines


def chats(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        role = rng.choice(["user", "system"])
        for turn in range(rng.randint(1, longest)):
            if rng.random() < .75:
                role = {"user": "assistant"}.get(role, "user")
            else:
                role = rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Cut off", "What? ", "", None, " \n", f"Word {rng.randrange(9)}.", "a.\x85", "q.\xa0"])
            at = rng.choice([turn] * 8 + [turn + 2, turn - 1, None])
            rows.append((conv if conv else None, at, role, text))
    return rows


def check(spark, rows, planted, segment):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'c' AS code", "2 AS cost").repartition(5)
    given = damaged(df) if planted else df
    got = {r.conv_id: tuple(r)[1:] for r in repair_report(given, df, segment).collect()}
    plain = brute_damage(rows) if planted else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want, _ = brute([r for r in plain if r[0] == conv])
        assert got[conv] == want, conv
    return got


@pytest.mark.parametrize("planted, segment", [(True, 4096), (False, 2), (True, 3)])
def test_equal_to_a_plain_search(spark, planted, segment):
    got = check(spark, chats(5, 150, 9), planted, segment)
    assert sum("R" in r[6] for r in got.values()) > 20


def test_a_long_conversation_over_many_segments_and_tasks(spark):
    got = check(spark, [(7 if r[0] else 8, k, *r[2:]) for k, r in enumerate(chats(6, 120, 9))], True, 16)
    assert max(len(r[6]) for r in got.values()) > 300


def test_repaired_rows(spark):
    rows = chats(9, 60, 7)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = {}
    for r in sorted(repaired_rows(spark.createDataFrame(rows, SCHEMA), 4).collect(), key=lambda r: (r.place, r.line)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in {r[0] for r in rows}:
        assert got.get(conv, []) == list(brute([r for r in plain if r[0] == conv])[1])


def test_prices_are_distances():
    rng = random.Random(3)
    for _ in range(100):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(1, 12)))
        k = rng.randint(0, len(codes))
        exits = auction_prices(codes[k:], [0, 10, 5, 0])[0] if k < len(codes) else [0, 10, 5, 0]
        whole = auction_prices(codes, [0, 10, 5, 0])[0]
        if k:
            d = distances(codes[:k])
            assert whole == [min(d[4 * s + e] + exits[e] for e in range(4)) for s in range(4)]
            assert auction_prices(codes[:k], exits)[0] == whole


def test_empty_tables_and_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged(empty), empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello."), (gone, 0, "user", "Hello.")], SCHEMA)
    row = repair_report(damaged(df), df).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
