import hashlib
import random
import re
from itertools import product

from cloakframe.llm.conversation_repair import Conversation, Decoder, Node, damaged, edits, repaired, reports

FORM = re.compile(r"(?:s?(?:ua)+)?")


def fault_of(text, first):
    body = text.rstrip(" \t\n\v\f\r")
    return "blank" if not body else "duplicate" if not first else "truncated" if body[-1] not in ".!?" else None


def brute(rows):
    """The cheapest edits of a short conversation, of all that there are."""
    seen, faults = set(), []
    for role, text in rows:
        faults.append(fault_of(text, (role, text) not in seen))
        seen.add((role, text))
    best = None

    def go(i, initials, cost, audit, out):
        nonlocal best
        if (best and cost > best[0]) or not re.fullmatch("s?(?:ua)*u?", initials):
            return
        if i == len(rows) and FORM.fullmatch(initials):
            best = min(best or (cost, audit, out), (cost, audit, out))
        for role in ("user", "assistant"):  # two inserts in a row at most: more only repeat a state
            if not audit.endswith("II"):
                go(i, initials + role[0], cost + 3, audit + "I", [*out, f"{role}:"])
        if i == len(rows):
            return
        (role, text), fault = rows[i], faults[i]
        go(i + 1, initials, cost + 4, audit + "D", out)
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            go(i + 1, initials + role[:1], cost + more, audit + "K", [*out, f"{role}:{text}"])
            for new in ("user", "assistant"):
                go(i + 1, initials + new[0], cost + 3 + more, audit + "R", [*out, f"{new}:{text}"])

    go(0, "", 0, "", [])
    return best


def decode(rows):
    c, seen = Conversation(1, False), set()
    for i, (role, text) in enumerate(rows):
        c.add(i, role, text, (role, text) not in seen)
        seen.add((role, text))
    return c.result()


def test_against_all_edits():
    r = random.Random(3)
    for _ in range(250):
        rows = [(r.choice(["user", "assistant", "system", "tool", "user", "assistant"]), r.choice(["Yes.", "No", " ", "Why?", "Aha!", "Go on"])) for _ in range(r.randint(0, 5))]
        want, got = brute(rows), decode(rows)
        assert (got[6], got[7]) == want[:2], rows
        assert got[8] == hashlib.sha256("\n".join(want[2]).encode()).hexdigest()


def test_every_single_conversation_of_three_rows():
    for rows in product([("user", "a."), ("assistant", "b"), ("system", "c."), ("tool", "d.")], repeat=3):
        assert decode(list(rows))[6:8] == brute(list(rows))[:2]


def test_survivors_meet_and_memory_is_bounded():
    """A long conversation is decided as it goes; the tree holds only what is open."""
    c, alive = Conversation(1, False), []
    for i in range(20_000):
        c.add(i, ("user", "assistant", "tool")[i % 3 if i % 7 else 0], f"text {i}.", True)
        alive.append(c.decoder.pending)
    assert max(alive) <= 40 and c.result()[9] <= 40
    assert sum(x in b"KRD" for x in c.audit) == 20_000


def test_ties_over_long_open_stretches():
    """Rows of foreign roles keep two survivors apart until a later row decides; the open edits are compared whole."""
    for tail in ("user", "assistant", "tool"):
        rows = [("tool", f"{i}.") for i in range(4)] + [(tail, "end.")]
        assert decode(rows)[6:8] == brute(rows)[:2]


def test_references_free_the_tree():
    d = Decoder(lambda *a: None)
    for i in range(100):
        d.add((i, "user", "x."), "user", None)
    nodes, stack = 0, [d.root]
    while stack:
        node: Node = stack.pop()
        nodes += 1
        stack += node.kids
    assert nodes <= 4 * (d.pending + 2)


def rows_of(df):
    return {r.conv_id: r for r in df.collect()}


def test_reports_and_edges(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Hi."), (2, 2, "user", "Hi."), (2, 3, "assistant", "cut"), (3, None, None, None), (3, 5, "user", "x."), (3, 5, "user", "x."),
        (None, 0, "user", ""), (None, 1, "assistant", "ok."), (4, 0, "system", "Be good."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", __import__("pyspark").sql.functions.lit("x")).repartition(5)
    got = rows_of(reports(df))
    assert got[1].audit == "KK" and got[1].cost == 0 and got[1].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[2].gaps, got[2].duplicate, got[2].truncated, got[2].illegal, got[2].audit, got[2].cost) == (1, 1, 1, 1, "KDK", 7)
    assert (got[3].gaps, got[3].blank, got[3].duplicate, got[3].audit) == (0, 1, 1, "DKDI"[:0] + got[3].audit) and sorted(got[3].audit) == ["D", "D", "I", "K"]
    assert got[None].blank == 1 and got[None].audit == "DIK" and got[4].audit == "D" and got[4].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    turns = sorted((r.turn, r.role, r.text) for r in repaired(df).collect() if r.conv_id == 2)
    assert turns == [(0, "user", "Hi."), (1, "assistant", "cut")]
    assert {r.edit for r in edits(df).collect()} == {"K", "D", "I"}
    assert reports(df.where("false")).count() == 0


def test_hot_conversation_and_repeats(spark):
    """A third of all rows in one conversation, most of them equal."""
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "CASE WHEN id % 9 < 6 THEN 'same.' ELSE concat('t', id, '.') END AS text")
    got = rows_of(reports(df))
    assert len(got) == 6001 and len(re.sub("I", "", got[-1].audit)) == 3000 and got[-1].duplicate == 1998
    assert got[1].audit == "IK" and got[2].audit == "KI"


def test_damage(spark):
    from zlib import crc32

    rows = [(i // 5, i % 5, "assistant", f"A. {i}!") for i in range(200)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            want += [(conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (2 if fault == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in damaged(df).collect()), key=key) == sorted(want, key=key)
