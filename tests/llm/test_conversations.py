import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillspark.llm import conversations as C
from quillspark.llm.queries import op11_conversation_repair

RIGHT = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(turns):
    """turns: (role, text) in order."""
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """cost, audit and repaired turns, by trying every edit of every turn with every insertion around it (up to two in a place)."""
    flaw = faults(turns)
    best = None
    per_turn = []
    for (role, text), f in zip(turns, flaw, strict=True):
        late = 3 if f == "t" else 0
        some = [(4, "D", [])]
        if f not in ("b", "d"):
            some += [(late, "K", [(role, text)]), (3 + late, "R", [("user", text)]), (3 + late, "R", [("assistant", text)])]
        per_turn.append(some)
    extra = [(0, "", [])] + [(3 * n, "I" * n, [(r, "") for r in rs]) for n in (1, 2) for rs in itertools.product(("user", "assistant"), repeat=n)]
    places = [extra]
    for some in per_turn:
        places += [some, extra]
    for way in itertools.product(*places):
        said = [x for _, _, part in way for x in part]
        if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in said)):
            key = (sum(c for c, _, _ in way), "".join(a for _, a, _ in way))
            if best is None or key < best[0]:
                best = (key, said)
    return best[0][0], best[0][1], best[1]


def dynamic(turns):
    """The same by a plain loop over the four states, for long conversations."""
    now = {"e": (0, "", ())}

    def put(into, state, path):
        if state not in into or path[:2] < into[state][:2]:
            into[state] = path

    def insert(states):
        for s in ("e", "s", "a"):
            if s in states:
                c, a, x = states[s]
                put(states, "u", (c + 3, a + "I", (x, ("user", ""))))
        if "u" in states:
            c, a, x = states["u"]
            put(states, "a", (c + 3, a + "I", (x, ("assistant", ""))))

    insert(now)
    for (role, text), f in zip(turns, faults(turns), strict=True):
        then = {}
        for s, (c, a, x) in now.items():
            put(then, s, (c + 4, a + "D", x))
            if f in ("b", "d"):
                continue
            late = 3 if f == "t" else 0
            if s == "e" and role[:1] == "s":
                put(then, "s", (c + late, a + "K", (x, (role, text))))
            to = "assistant" if s == "u" else "user"
            kept = role[:1] == to[0]
            put(then, to[0], (c + late + (0 if kept else 3), a + ("K" if kept else "R"), (x, (role if kept else to, text))))
        insert(then)
        now = then
    c, a, x = min((now[s] for s in ("e", "a") if s in now), key=lambda p: p[:2])
    said = []
    while x:
        x, one = x
        said.append(one)
    return c, a, said[::-1]


def digest(said):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def report(spark, rows):
    return {r.conv_id: r for r in C.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_all_edits(spark):
    rnd = random.Random(3)
    talks = {}
    for i in range(120):
        n = rnd.randint(1, 3)
        talks[i] = [(rnd.choice(["system", "user", "assistant", "tool", "", "user", "assistant"]), rnd.choice(["Yes.", "No!", "so", " \n", "Yes. ", ""])) for _ in range(n)]
    found = report(spark, [(i, t, role, text) for i, turns in talks.items() for t, (role, text) in enumerate(turns)])
    for i, turns in talks.items():
        cost, audit, said = cheapest(turns)
        assert (found[i].cost, found[i].audit, found[i].repaired_sha256) == (cost, audit, digest(said)), turns
        assert dynamic(turns) == (cost, audit, said)
        assert [found[i][k] for k in ("blank", "duplicate", "truncated")] == [faults(turns).count(x) for x in "bdt"]
        assert found[i].illegal == sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(turns))


@pytest.mark.parametrize("block,group", [(2, 2), (7, 3), (256, 64)])
def test_long_conversations_in_blocks(spark, monkeypatch, block, group):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "GROUP", group)
    rnd = random.Random(block)
    talks = {i: [(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice([f"t{rnd.randint(0, 300)}.", "open", ""])) for _ in range(n)] for i, n in enumerate((1, 5, 64, 300, 700))}
    found = report(spark, [(i, t, role, text) for i, turns in talks.items() for t, (role, text) in enumerate(turns)])
    for i, turns in talks.items():
        cost, audit, said = dynamic(turns)
        assert (found[i].cost, found[i].audit, found[i].repaired_sha256) == (cost, audit, digest(said))


def test_odd_rows(spark):
    """Nulls, repeated rows, ties, gaps, a very long text; extra columns with the names used inside; an empty table."""
    long = "word " * 400_000 + "end."
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, 7, "user", long), (1, 4, "user", "Hi."), (1, 4, "user", "Hi."), (1, None, "assistant", "Oh.")]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA + ", _conv string, n string, audit string")
    found = {r.conv_id: r for r in C.repair_report(df).collect()}
    assert (found[None].gaps, found[None].blank, found[None].audit) == (0, 1, "DKI")
    one = found[1]
    cost, audit, said = dynamic([("assistant", "Oh."), ("user", "Hi."), ("user", "Hi."), ("user", long)])
    assert (one.gaps, one.duplicate, one.cost, one.audit, one.repaired_sha256) == (2, 1, cost, audit, digest(said))
    audits = C.repairs(df)
    turns = [(r.role, r.text) for r in C.repaired_turns(df, audits).where("conv_id = 1").orderBy("place").collect()]
    assert turns == said
    assert C.repair_report(df.limit(0)).collect() == []


def test_query_against_plain_python(spark, sf_dir):
    talks = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        some = talks.setdefault(r.conv_id, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        some += [] if kind == 0 else [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    found = {r.conv_id: r for r in op11_conversation_repair(spark, sf_dir).collect()}
    assert set(found) == set(talks)
    for i, rows in talks.items():
        turns = [r[1:] for r in rows]
        cost, audit, said = dynamic(turns)
        numbers = {r[0] for r in rows}
        assert (found[i].cost, found[i].audit, found[i].repaired_sha256) == (cost, audit, digest(said))
        assert found[i].gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
