"""Repairs against a plain search over all edits, with pieces, ropes and rules of every size."""

import hashlib
import heapq
import random
import zlib

import pytest

from obsframe.llm import queries, turn_grammar
from obsframe.llm.turn_grammar import SYMBOLS, Grammar, Settings, cheapest, joined, leaves, less, product, symbol_matrix

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def slow_repair(rows):
    """Cheapest edits by Dijkstra over (turns done, state), least audit first; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if initial in NEXT[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state][initial], (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state][role[0]], (*out, f"{role}:{text}")))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in NEXT[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[state][initial], (*out, f"{name}:{text}")))


def slow_report(rows):
    """Conversation id to the whole report, from (turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, turns in convs.items():
        faulty, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in sorted(turns):
            core = text.strip(SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                counts[fault] += 1
        known = {t for k, t, *_ in turns if k}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = slow_repair(faulty)
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def random_rows(seed, convs=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why? ", f"t{turn}.", f"u{turn}", "a\nb."])
            turn = rng.choice([turn, turn, turn, None, turn * 3])
            rows.append((conv, turn, role, text))
            rows += [rows[-1]] * (rng.random() < 0.15)
    return rows


def repaired(spark, rows, cfg):
    frame = spark.createDataFrame(rows, SCHEMA)
    report, turns = turn_grammar.repair_conversations(frame, cfg)
    digests = {r["conv"]: r["sha256"] for r in turn_grammar.digests(turns).collect()}
    rows = report.collect()
    assert len(rows) == len(digests)
    return {r["conv"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), digests[r["conv"]]) for r in rows}


@pytest.mark.parametrize("cfg", [Settings(), Settings(piece_rows=3, rules=2, rounds=2), Settings(piece_bytes=1), Settings(rounds=0)])
def test_repairs_match_a_plain_search(spark, cfg):
    rows = random_rows(5)
    assert repaired(spark, rows, cfg) == slow_report(rows)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {t} {rng.choice('.,')}") for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in (1, 9)] + [(7, 5, "user", "again.")] * 40
    assert repaired(spark, rows, Settings(piece_rows=64)) == slow_report(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "A."), (None, None, "assistant", "B."), (1, None, "user", "x" * 3_000_000), (2, 4, "user", " ")]
    assert repaired(spark, rows, Settings()) == slow_report(rows)
    nulls = spark.createDataFrame([(3, None, None, None), (3, 2, "user", None)], SCHEMA)
    report, turns = turn_grammar.repair_conversations(nulls)
    assert [(r["conv"], r["blank"], r["audit"]) for r in report.collect()] == [(3, 2, "DD")]
    report, turns = turn_grammar.repair_conversations(nulls.limit(0))
    assert report.count() == 0 and turn_grammar.digests(turns).count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.", 5, "x"), (1, 1, "assistant", "B.", 6, "y")], SCHEMA + ", conv int, symbols string")
    report, turns = turn_grammar.repair_conversations(rows)
    assert [(r["conv"], r["audit"], r["cost"]) for r in report.collect()] == [(1, "KK", 0)]
    assert [[(t["role"], t["text"], t["edit"]) for t in r["turns"]] for r in turns.collect()] == [[("user", "A.", "K"), ("assistant", "B.", "K")]]


def test_damaged_conversations_without_rows(spark):
    rows = [(c, t, role, text) for c in range(150) for t, (role, text) in enumerate([("user", "How so?"), ("assistant", "So.")][: 1 + c % 2])]
    rows += [(None, None, None, None), (100, None, "user", "A. B")]
    frame = spark.createDataFrame(rows, SCHEMA)
    damaged = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = slow_report(damaged)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = queries.repaired_conversations(frame.select("conv_id").distinct(), queries.damaged_conversations(frame)).collect()
    assert {tuple(r)[0]: tuple(r)[1:] for r in got} == {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert len(want) < len(got)


def test_rules_do_not_change_matrices():
    rng, cfg = random.Random(4), Settings()
    grammar, plain = Grammar(cfg), Grammar(cfg)
    for _ in range(40):
        n = len(grammar.matrices)
        grammar.add([p for p in [(rng.randrange(n), rng.randrange(n))] if p not in grammar.rules])
    for _ in range(60):
        symbols = "".join(rng.choices(SYMBOLS, k=rng.randrange(1, 30)))
        ways = [[[e and (e[0], "".join(leaves(e[1]))) for e in row] for row in g.matrix(symbols)] for g in (grammar, plain)]
        assert ways[0] == ways[1]
        single = [symbol_matrix(s, cfg) for s in symbols]
        cost, edits = cheapest(single, cfg)
        assert (cost, "".join(e for _, e in edits)) == (cheapest([grammar.matrix(symbols)], cfg)[0], cheapest([grammar.matrix(symbols)], cfg)[1][0][1])


def test_ropes_compare_like_strings():
    rng = random.Random(6)
    parts = [("K" * rng.randrange(1, 400)) + rng.choice("DIKR") for _ in range(12)]
    ropes = []
    for _ in range(80):
        rope, text = "", ""
        for p in rng.choices(parts, k=rng.randrange(1, 6)):
            rope, text = joined(rope, p), text + p
        ropes.append((joined(rope, rope), text + text))
    for a, s in ropes:
        assert "".join(leaves(a)) == s and len(a) == len(s)
        for b, t in ropes:
            assert less(a, b) == (s < t)


def test_product_is_associative():
    cfg = Settings()
    a, b, c = (symbol_matrix(s, cfg) for s in "uXs".replace("X", "x"))
    flat = [[[e and (e[0], "".join(leaves(e[1]))) for e in row] for row in m] for m in (product(product(a, b), c), product(a, product(b, c)))]
    assert flat[0] == flat[1]
