import hashlib
import random
import zlib
from itertools import product

from papershed.llm import conversation_repair as C
from papershed.llm.queries import ORACLE_SQL, QUERIES

TURNS = "conv_id long, turn long, role string, text string, row int, edit long, initial string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_faults(rows):
    """Sorted (turn, role, text) rows, nulls as one space, and the first fault of each."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return rows, found


def plain_edits(rows, fault):
    """All cheapest paths' least (cost, letters, lines), state by state, without pruning."""
    def inserts(best):
        for _ in range(2):
            for state, (cost, letters, lines) in list(best.items()):
                for i in set(NEXT[state]) & {"u", "a"}:
                    new = (cost + 2, letters + "I", [*lines, ("user" if i == "u" else "assistant") + ":"])
                    if i not in best or new[:2] < best[i][:2]:
                        best[i] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), f in zip(rows, fault):
        after = {}
        for state, (cost, letters, lines) in [(s, b) for start in list(best) for s, b in inserts({start: best[start]}).items()]:
            options = [(state, cost + 3, letters + "D", lines)]
            if f not in ("blank", "duplicate"):
                options += [(i, cost + (f == "truncated"), letters + "K", [*lines, f"{role}:{text}"]) for i in NEXT[state] if i == role[:1]]
                options += [(i, cost + 2 + (f == "truncated"), letters + "R", [*lines, f"{'user' if i == 'u' else 'assistant'}:{text}"]) for i in NEXT[state] if i in "ua"]
            for to, *new in options:
                if to not in after or tuple(new[:2]) < after[to][:2]:
                    after[to] = tuple(new)
        best = after
    return min((b for s, b in inserts(best).items() if s in ("", "a")), key=lambda b: b[:2])


def plain(rows):
    rows, fault = plain_faults(rows)
    cost, audit, lines = plain_edits(rows, fault)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [fault.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_moves_against_every_edit_string():
    """Tiny conversations: the search finds the least of all strings of edits that are legal."""
    def run(kinds, letters):
        state, cost, k = "", 0, 0
        for letter in letters:
            if letter == "I":
                to = [i for i in NEXT[state] if i in "ua"]
                state, cost = to[0], cost + 2
                continue
            role, fault = kinds[k]
            k += 1
            if letter == "D":
                cost += 3
                continue
            if fault == "blank" or letter == "K" and role not in NEXT[state]:
                return None
            state = role if letter == "K" else [i for i in NEXT[state] if i in "ua"][0]
            cost += (2 if letter == "R" else 0) + (fault == "truncated")
        return cost if state in ("", "a") else None

    strings = {n: [s for length in range(n, n + 3) for s in product("DIKR", repeat=length) if sum(c != "I" for c in s) == n] for n in (1, 2, 3)}
    for n, size in ((1, 1), (2, 2), (3, 3)):
        for kinds in product(product("suax", (None, "truncated", "blank")), repeat=size):
            if n == 3 and hash(str(kinds)) % 9:
                continue
            expect = min((run(kinds, s), "".join(s)) for s in strings[n] if run(kinds, s) is not None)
            tree = C.Survivors()
            got = [e for role, fault in kinds for e in tree.feed(0, role, fault)] + tree.finish()
            assert (min(c for c, *_ in tree.now.values()) <= expect[0]) and "".join(e[1] for e in got) == expect[1], kinds


def test_long_conversations_equal_a_search_that_keeps_all_strings():
    draw = random.Random(7)
    for _ in range(300):
        roles = draw.choice(["ua", "uuua", "suax", "u", "a", "ssua"])
        kinds = [(draw.choice(roles), draw.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(draw.randint(0, 60))]
        tree = C.Survivors()
        got = [e for k, (role, fault) in enumerate(kinds) for e in tree.feed(k, role, fault)] + tree.finish()
        cost, audit, _ = plain_edits([(k, r, "") for k, (r, _) in enumerate(kinds)], [f for _, f in kinds])
        assert "".join(e[1] for e in got) == audit
        assert [e[0] for e in got if e[0] is not None] == list(range(len(kinds)))
        assert not tree.levels and not tree.refs and not tree.parent


def test_edits_leave_once_survivors_share_an_ancestor():
    tree, most = C.Survivors(), 0
    for k in range(20_000):
        tree.feed(k, "ua"[k % 2] if k % 50 else "x", None if k % 7 else "truncated")
        most = max(most, len(tree.levels))
    assert most < 200
    tree = C.Survivors()
    for k in range(20_000):  # one role: two survivors never meet, but a row costs at most two nodes
        tree.feed(k, "u", None)
    assert len(tree.refs) <= 2 * len(tree.levels) <= 40_002
    assert len(tree.finish()) >= 19_000


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], TURNS)
    columns = ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in C.digests(C.repaired(df)).select(columns).collect()}


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "user", "So"), (1, None, "system", "Be kind."),
        (2, None, None, None), (2, None, None, None), (2, 5, "", ""), (3, 9, "user", "漢字 ñ"), (3, 9, "assistant", "x" * 300_000 + "!"),
        (None, 2, "user", "No number."), (None, 1, "umpire", "Out!"), (None, 4, "assistant", "\x0b\x0c"), (4, 0, "system", "Only."),
        *[(5, k, "user", f"line {k}.") for k in range(200)], *[(6, 0, "user", "Same.")] * 30,
    ]
    got = found(spark, rows)
    for conv in {r[0] for r in rows}:
        assert got.pop(conv) == plain([r[1:] for r in rows if r[0] == conv]), conv
    assert not got and found(spark, []) == {}


def test_whole_table_against_plain_search(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    by = {r["conv_id"]: [] for r in turns}
    for r in turns:
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if kind == 1 else r["text"].translate(str.maketrans("", "", ".!?")) if kind == 2 else r["text"]
        by[r["conv_id"]] += [(r["turn"], "user" if kind == 4 else r["role"], text)] * {0: 0, 3: 2}.get(kind, 1)
    rows = QUERIES["op11_conversation_repair"](spark, sf_dir).collect()
    got = {r["conv_id"]: tuple(r[c] for c in (*C.COUNTS, "audit", "repaired_sha256")) for r in rows}
    assert len(rows) == len(got) and got == {k: plain(v) for k, v in by.items()}
    assert "op11_conversation_repair" in ORACLE_SQL


def test_conversations_of_which_nothing_is_left(spark):
    lost = [(k, 0) for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(*k, "user", "Hi.", 1, 2, "c") for k in lost], TURNS)
    assert {tuple(r)[1:] for r in C.damaged_and_repaired(df).collect()} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
