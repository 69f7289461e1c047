import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from corpus import table
from pyspark.sql import functions as F

from slotwise.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
BARE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def every_edit(rows, most_inserts=2):
    """(cost, audit, repaired) of every edit sequence that gives the grammar; rows: (role, text, must go, truncated)."""
    gap = [p for n in range(most_inserts + 1) for p in product("ua", repeat=n)]

    def go(i, cost, audit, out):
        for put in gap:
            now = out + [(NAMES[x], "") for x in put]
            paid, said = cost + 5 * len(put), audit + "I" * len(put)
            if i == len(rows):
                if GRAMMAR.fullmatch("".join(r[:1] for r, _ in now)):
                    yield paid, said, now
                continue
            role, text, must_go, cut = rows[i]
            yield from go(i + 1, paid + 2, said + "D", now)
            if not must_go:
                yield from go(i + 1, paid + 5 * cut, said + "K", now + [(role, text)])
                for x in "ua":
                    yield from go(i + 1, paid + 1 + 5 * cut, said + "R", now + [(NAMES[x], text)])

    return go(0, 0, "", [])


def least(rows):
    """Least (cost, audit, repaired) by places of the grammar, for longer conversations."""
    best = {"o": (0, "", [])}

    def put(to, place, found):
        if place not in to or found[:2] < to[place][:2]:
            to[place] = found

    def inserted(to):
        for _ in range(3):
            for place, (cost, audit, out) in list(to.items()):
                x = "a" if place == "u" else "u"
                put(to, x, (cost + 5, audit + "I", out + [(NAMES[x], "")]))
        return to

    for role, text, must_go, cut in rows:
        after = {}
        for place, (cost, audit, out) in inserted(best).items():
            put(after, place, (cost + 2, audit + "D", out))
            if must_go:
                continue
            x = "a" if place == "u" else "u"
            if role[:1] == x or (role[:1] == "s" and place == "o"):
                put(after, role[:1], (cost + 5 * cut, audit + "K", out + [(role, text)]))
            if role[:1] != x:
                put(after, x, (cost + 1 + 5 * cut, audit + "R", out + [(NAMES[x], text)]))
        best = after
    return min(found for place, found in inserted(best).items() if place in "oa")


def damage(rows):
    """Rows after damage in order, by conversation; every conversation has an entry."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        own += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def expected(rows, search=least):
    out = []
    for conv, own in damage(rows).items():
        seen, faults, ready = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            bare = text.strip(BARE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            ready.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        places = {t for t, *_ in own if t is not None}
        gaps = max(places) - min(places) + 1 - len(places) if places else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = search(ready)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(spark, rows, block=turns.BLOCK):
    df = turns.digests(turns.repaired(turns.damaged(table(spark, rows, SCHEMA)), F.col("times"), block))
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(n, seed, lengths=(0, 9)):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(*lengths)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "ua"[turn % 2].replace("u", "user").replace("a", "assistant")
            role = rng.choice(["system", "tool", "", None, "umpire"]) if rng.random() < 0.1 else role
            text = rng.choice(["Fine. ", "No", "what?", " \t", None, "Ä.", f"turn {turn}.", f"turn {turn}", "é!\n"])
            out.append((seed * 1000 + conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, text))
    return out


def test_alignment_is_the_least_of_every_edit_sequence():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(25):
            rows = [(rng.choice(["system", "user", "user", "assistant", "tool"]), f"{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]
            faults = turns.Faults()
            for role, text, must_go, cut in rows:
                faults.add(role, text + ("" if cut else "."), 1, must_go)
            cost, audit = faults.repair()
            want = min(every_edit(rows, 2 if n < 4 else 1))
            assert (cost, audit) == want[:2] == least(rows)[:2]
            assert [(t["role"], t["text"]) for t in turns.replayed([(r, t, 1) for r, t, *_ in rows], audit)] == want[2]


def test_bands_and_lengths_lose_no_least_alignment():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "x"]), f"{i}", rng.random() < 0.1, rng.random() < 0.2) for i in range(rng.randint(5, 60))]
        faults = turns.Faults()
        for role, text, must_go, cut in rows:
            faults.add(role, text + ("" if cut else "."), 1, must_go)
        assert faults.repair() == least(rows)[:2]


def test_conversations_match_brute_force(spark):
    rows = conversations(150, 1)
    rows += [(None, t, r, x) for t, r, x in [(0, "user", "a."), (None, "assistant", "b"), (0, "user", "a."), (3, "assistant", "c!")]]
    rows += [(7, 1, "user", "twice.")] * 3 + [(8, None, None, None)] * 2 + [(9, 0, "user", "long " * 50000 + ".")]
    assert found(spark, rows) == expected(rows)
    assert {r[0] for r in found(spark, rows)} == {r[0] for r in rows}


@pytest.mark.parametrize("block", [3, 8])
def test_long_conversations_in_blocks_give_the_same(spark, block):
    """One conversation holds most rows, many of them equal; a null id too."""
    rows = conversations(8, 2, (0, 14))
    rng = random.Random(9)
    hot = [(555, i, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"{i}.", f"{i}", ""])) for i in range(90)]
    hot += [(555, 40, "user", "the same")] * 60 + [(555, None, "assistant", "first.")]
    null = [(None, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"{i}?") for i in range(40)]
    rows += hot + null
    assert found(spark, rows, block) == expected(rows)


def test_repaired_turns_come_out_and_empty_tables_work(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello there."), (2, 0, "assistant", "No"), (3, 0, "user", None)]
    got = {r.conv_id: r for r in turns.repaired(table(spark, rows, SCHEMA)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "Hi."), ("assistant", "Hello there.")]
    assert (got[1].audit, got[1].cost, got[2].audit, got[2].turns, got[3].audit) == ("KR", 1, "D", [], "D")
    assert turns.digests(turns.repaired(table(spark, [], SCHEMA))).collect() == []
    gone = turns.digests(turns.repaired(table(spark, rows[:2], SCHEMA), F.lit(0))).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
