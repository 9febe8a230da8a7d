"""Conversation repair against a sequential search over (cost, letters)."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies string, part int"
NEXT, FULL = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def put(best, state, value):
    if state not in best or value[:2] < best[state][:2]:
        best[state] = value


def with_inserts(best):
    best = dict(best)
    for _ in range(3):
        for state, (cost, letters, out) in list(best.items()):
            put(best, NEXT[state], (cost + 3, letters + "I", (*out, FULL[NEXT[state]] + ":")))
    return best


def cheapest(rows, faults):
    """(cost, letters, repaired turns) of one conversation, by the least (cost, letters) that reaches each state."""
    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        before, best = with_inserts(best), {}
        for state, (cost, letters, out) in before.items():
            put(best, state, (cost + 4, letters + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra, initial = 3 * (fault == "truncated"), role[:1]
            if (initial == "s" and state == "") or (initial == "u" and state != "u") or (initial == "a" and state == "u"):
                put(best, initial, (cost + extra, letters + "K", (*out, f"{role}:{text}")))
            put(best, NEXT[state], (cost + 3 + extra, letters + "R", (*out, f"{FULL[NEXT[state]]}:{text}")))
    best = with_inserts(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_s, turn_s, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        convs[conv] += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = {}
    for conv, members in convs.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {r[0] for r in members if r[0] is not None}
        seen, faults = set(), []
        for _, role, text in members:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(members, members[1:]))
        cost, letters, repaired = cheapest(members, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def table(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for t in range(r.randint(0, 12)):
            role = r.choice(["user", "assistant", "system", "tool", None, ""]) if r.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((conv, r.choice([t, t, t, None]), role, r.choice(["hi.", "ok", "  ", None, "what?\n", "été!", "x" * r.randint(0, 5) + "." * r.randint(0, 1)])))
    rows += [(77, t, r.choice(["tool", "user", "assistant"]), f"t{t}.") for t in range(500)]  # a third of all rows
    rows += [(78, t, "tool", f"t{t}.") for t in range(200)]  # costs never forget their end
    rows += [(79, 5, "user", "same")] * 50 + rows[:10] + [(80, t, "user", "again and again.") for t in range(60)]
    return rows + [(81, 0, "user", "y" * 300_000), (81, 1, "assistant", "z " * 200_000 + "."), (82, 2**40, "user", "late."), (82, 1, "user", "early.")]


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"chunk_rows": 7, "passes": 2}), (2, {"chunk_rows": 5, "passes": 60}), (3, {"chunk_bytes": 100, "passes": 1})])
def test_repair_equals_search(spark, seed, limits):
    from tidewarden.llm.turns import repair_conversations

    rows = table(seed)
    got = repair_conversations(spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).repartition(3), **limits).collect()
    expected = brute(rows)
    assert len(got) == len(expected)
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected


def test_repaired_turns_and_empty(spark):
    from tidewarden.llm.turns import damage, repair, repair_conversations, repaired_turns

    rows = [(k, t, r, x, "", "", 1) for k in range(60) for t, (r, x) in enumerate([("user", "a."), ("user", "b."), ("tool", "c"), ("system", "d.")])]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = repaired_turns(repair(damage(df), chunk_rows=2)).collect()
    convs = defaultdict(list)
    for x in sorted(turns, key=lambda x: (x.part, x.no, x.place)):
        convs[x.conv].append(x)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in c)) for c in convs.values())
    hashes = {r.conv_id: r.repaired_sha256 for r in repair_conversations(df).collect()}
    assert all(hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in convs[k]).encode()).hexdigest() == h for k, h in hashes.items())
    empty = repair_conversations(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_fix_up_stops_where_vectors_agree():
    from tidewarden.llm.turns import END, backward, fix_up, matrix, normal, symbol

    r = random.Random(1)
    for _ in range(50):
        syms = bytes(r.choice([symbol(c, t) for c in "suax" for t in (False, True)] + [99]) for _ in range(30))
        right = normal((r.randint(0, 6), r.randint(0, 6), r.randint(0, 6), r.randint(0, 6)))
        assert fix_up(syms, backward(syms, normal(END)), right) == backward(syms, right)
        assert normal(tuple(min(c + x for c, x in zip(line, right)) for line in matrix(syms))) == backward(syms, right)[0]
