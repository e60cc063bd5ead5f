"""Conversation repair against a search over all edit sequences."""

import hashlib
import random
import zlib
from heapq import heappop, heappush

import pytest

from tarnlight.llm import turns

WHITE = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """Cheapest first and least audit next, by Dijkstra's search over (turn, state) with the audit in the key."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    fault, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(WHITE)
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    todo, done = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, t, state, said = heappop(todo)
        if t == len(rows) and state in (0, 3):
            break
        if (t, state) in done:
            continue
        done.add((t, state))
        name = {"u": "user", "a": "assistant"}
        for letter in "ua":
            if (state, letter) in STEP:
                heappush(todo, (cost + 3, audit + "I", t, STEP[state, letter], (*said, (name[letter], ""))))
        if t < len(rows):
            _, _, role, text = rows[t]
            heappush(todo, (cost + 4, audit + "D", t + 1, state, said))
            if fault[t] in ("", "truncated"):
                more = 3 if fault[t] else 0
                if (state, role[:1]) in STEP:
                    heappush(todo, (cost + more, audit + "K", t + 1, STEP[state, role[:1]], (*said, (role, text))))
                for letter in "ua":
                    if (state, letter) in STEP:
                        heappush(todo, (cost + more + 3, audit + "R", t + 1, STEP[state, letter], (*said, (name[letter], text))))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, digest)


def conversations(seed, n=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool", "", None, "umbrella"])
            text = rng.choice(["Fine.", "Really?", "cut off", "Ends with space. \n", "", " \t", None, "A. b", f"own {turn}!", "ünï…", "\xa0"])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.9 else turn + 50, role, text))
    seen, out = set(), []
    for r in rows:  # one row a turn: the order of others is the operator's own
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, at long, fault string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def expected(rows):
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    return {c: brute(by.get(c, [])) for c in {r[0] for r in rows}}


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in (*turns.COUNTED, "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("bits", [turns.CHUNK_BITS, 1, 0])
def test_query_equals_search(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(turns, "CHUNK_BITS", bits)
    rows = conversations(bits) + [(None, 0, "user", "Hi."), (None, None, "assistant", "cut"), (777, None, None, None), (778, None, "user", "x"), (778, 4, "assistant", "y.")]
    random.Random(1).shuffle(rows)
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert results(turns.op13_repair(spark, str(tmp_path))) == expected(rows)


def test_layers_equal_search_for_all_short_chunks():
    import itertools

    for n in (1, 2, 3):
        for rows in itertools.product([("s", ""), ("u", ""), ("a", "cut"), ("t", ""), ("u", "cut"), ("a", ""), ("u", "gone")], repeat=n):
            initials = [r for r, _ in rows]
            fault = [{"": turns.FINE, "cut": turns.CUT_OFF, "gone": turns.BLANK}[f] for _, f in rows]
            costs, audits = turns.layers(initials, fault)
            least = min((c + turns.TO_END[e][0], audits[e] + turns.TO_END[e][1]) for e, c in enumerate(costs[:4]) if c >= 0)
            made = [(1, k, i, " " if f == turns.BLANK else f"{k}." if f == turns.FINE else f"{k}") for k, (i, f) in enumerate(zip(initials, fault, strict=True))]
            found = brute(made)
            assert least == (found[5], found[6])


def test_a_long_conversation_of_repeats(spark):
    rows = [(1, k // 3, "user" if k % 2 else "assistant", "Same." if k % 5 else f"Other {k}") for k in range(3000)]
    done = turns.edited(frame(spark, rows))
    got = turns.summary(done).collect()[0]
    said = turns.repaired(done).orderBy("at", "place").collect()
    assert [r["role"][:1] for r in said] == list("ua") * (len(said) // 2)
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in said).encode()).hexdigest() == got["repaired_sha256"]
    ordered = [(1, k, r["role"], r["text"]) for k, r in enumerate(sorted(done.collect(), key=lambda r: r["at"]))]
    assert brute(ordered)[5:7] == (got["cost"], got["audit"])


def test_no_rows(spark):
    none = frame(spark, []).select("conv_id", "turn", "role", "text")
    assert turns.repair(none, none).collect() == []
    empty = turns.repair(none, frame(spark, [(5, 0, "user", "x")])).collect()
    assert [(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in empty] == [(5, 0, "", hashlib.sha256(b"").hexdigest())]
