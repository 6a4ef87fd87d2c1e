import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from corpuscope.llm import conversations as operator
from corpuscope.llm.queries import op11_conversation_repair


def fits(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def cheapest(rows):
    """Least (cost, audit, output), by trying every edit; rows are (must be deleted, truncated, role, text)."""

    def step(initials, c):
        """The initials so far, cut to what the pattern can still depend on; None when it is lost."""
        grown = initials + c
        for rest in ("", "a", "ua"):
            if fits(grown + rest):
                return grown if len(grown) < 3 else ("sua" if grown.startswith("s") else "ua")[: 3] + ("u" if grown[-1] == "u" else "")
        return None

    @lru_cache(None)
    def best(i, so_far, inserted):
        found = [(0, "", ())] if i == len(rows) and fits(so_far) else []

        def go(cost, letter, role, text, i, inserted):
            if role is None:
                after = so_far
            else:
                after = step(so_far, role[:1]) if role[:1] else None
            if after is None:
                return
            rest = best(i, after, inserted)
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((() if role is None else (f"{role}:{text}",)) + rest[2])))

        if inserted < 2:  # three insertions in a row only put a pair where none is needed
            for role in ("user", "assistant"):
                go(5, "I", role, "", i, inserted + 1)
        if i < len(rows):
            must, cut, role, text = rows[i]
            go(2, "D", None, None, i + 1, 0)
            if not must:
                go(5 * cut, "K", role, text, i + 1, 0)
                for other in ("user", "assistant"):
                    go(1 + 5 * cut, "R", other, text, i + 1, 0)
        return min(found) if found else None

    return best(0, "", 0)


def brute(table):
    fill = lambda v: " " if v is None else str(v)
    convs = {}
    for conv_id, turn, role, text in table:
        role, text = fill(role), fill(text)
        code = zlib.crc32(f"{fill(conv_id)}:{fill(turn)}".encode()) % 20
        rows = convs.setdefault(conv_id, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv_id, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), {"B": 0, "D": 0, "T": 0}, []
        for turn, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "B" if not body else "D" if (role, text) in seen else "T" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((fault in ("B", "D") and fault != "", fault == "T", role, text))
        letters = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(tuple(marked))
        out.append((conv_id, gaps, faults["B"], faults["D"], faults["T"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def invented(seed, convs, longest=12):
    rng = np.random.default_rng(seed)
    texts = ["Hello.", "What?", "cut off", "", " \t", "Well. ", "Yes!\n", "no", None, "a.b", "été."]
    rows = []
    for c in range(convs):
        for t in range(rng.integers(1, longest)):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", "", "unknown"])
            rows.append((None if c == 5 else c, None if rng.random() < 0.05 else int(t * (1 + (rng.random() < 0.1))),
                         None if rng.random() < 0.03 else str(role), None if rng.random() < 0.02 else texts[rng.integers(len(texts))]))
    return rows


SCHEMA = "conv_id long, turn int, role string, text string, dropped_ string, symbol string, fault string, again string, copy int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "s", "f", "g", 1) for r in rows], SCHEMA)


def report(docs):
    return sorted((tuple(r) for r in operator.conversation_report(operator.damage(docs)).collect()), key=repr)


@pytest.mark.parametrize("block", [256, 3])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(operator, "BLOCK", block)
    rows = invented(block, 250)
    assert report(frame(spark, rows)) == brute(rows)


def test_whole_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op11_conversation_repair(spark, folder).collect()), key=repr) == brute(rows)


def test_every_short_conversation():
    symbols = "suaxUX-"
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for n in range(5):
        for rows in itertools.product(symbols, repeat=n):
            marked = tuple((c == "-", c.isupper(), roles[c.lower()], "t") for c in rows)
            want = cheapest(marked)
            assert operator.derive("".join(rows), operator.FINAL, operator.BEGIN)[operator.BEGIN] == want[:2]


def test_blocks_give_the_same_as_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(300):
        rows = [(str(rng.choice(list("suaxUAX-"))), "", "t") for _ in range(rng.integers(0, 40))]
        rows = [(c, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), t) for c, _, t in rows]
        found = []
        for block in (1000, 1, 7):
            monkeypatch.setattr(operator, "BLOCK", block)
            repair = operator.Repair()
            edits = [e for row in rows for e in repair.add(*row)]
            cost, rest = repair.finish()
            found.append((cost, edits + rest))
        assert found[0] == found[1] == found[2]


def test_repaired_rows_are_well_formed(spark):
    rows = invented(4, 60)
    edits = operator.repair_conversations(operator.damage(frame(spark, rows))).orderBy("conv_id", "position").collect()
    lines = {}
    for r in edits:
        lines.setdefault(r.conv_id, []).append(r)
    for conv in report(frame(spark, rows)):
        own = lines.get(conv[0], [])
        assert "".join(r.edit for r in own) == conv[7] and [r.position for r in own] == list(range(len(own)))
        kept = [r for r in own if r.edit != "D"]
        assert fits("".join(r.role[0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == conv[8]


def test_a_long_conversation_is_repaired_in_blocks(spark):
    rows = [(1, t, ["user", "assistant"][t % 2] if t % 11 else "tool", f"Line {t}.") for t in range(20000)]
    (found,) = report(frame(spark, rows))
    assert found[6] > 0 and len(found[7]) > 18000


def test_empty_table(spark):
    assert operator.conversation_report(operator.damage(frame(spark, []))).count() == 0
