"""Prefix trie and structure repair against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from strandline.llm import prefix_trie, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, rep string, digest int, depth int, words string, mark int, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("r", 1, 2, "w", 3, "p")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def awkward() -> list[tuple]:
    """NULLs in every column, empty and long texts, ties, repeated rows, long conversations, copies, gaps, a missing family head."""
    rng = random.Random(3)
    rows = []
    for c in [0, 1, 2, 3, 5, 8, 19, 20, 21, 22, 25, 39, 41, 42, 60, 61, 63, 77, 4096, 4100, 5000, -7, -40]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 17, 40])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Hi there.", "yes", "", " \n", None, "no!", f"w{rng.randint(0, 3)} x.", "long " * 300, "ß é ?", "a "])
            rows.append((c, t + (5 if t > 7 else 0), role, text))
    rows += [(9, None, "user", "null turn."), (9, None, None, None), (9, 4, "user", "x"), (9, 4, "user", "x"), (9, 4, "assistant", "tie."), (9, 1 << 40, "user", "far.")]
    rows += [(None, 1, "user", "nobody."), (None, None, None, None), (7, 0, "user", "only.")]
    for c in (100, 101, 102, 103):  # copies of one conversation
        rows += [(c, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(12)]
    return [r + CLASH for r in rows]


def ordered(rows, key):
    found = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            found[r[0]].append(r)
    return {c: sorted(rs, key=key) for c, rs in found.items()}


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_trie(rows):
    turns = ordered(rows, lambda r: (r[1] is not None, r[1] or 0, md5(r[2] or "", r[3] or "")))
    turns = {c: [(r[2] or "", r[3] or "") for r in rs] for c, rs in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = turns.get(base, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    inner = {k[:-1] for k in nodes if k}
    for k, members in nodes.items():
        if k:
            children[k[:-1]] += 1
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in inner
            saved[k[:d]] += (len(members) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1 << 70, len(m), children[k], leaves[k], saved[k],
                   sha(",".join(str(c) for c in sorted(m) if len(made[c]) == len(k)))) for k, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def spark_trie(df):
    rows = prefix_trie.family_trie(df).select(COLUMNS).collect()
    return sorted(tuple(-1 << 70 if v is None else v for v in r) for r in rows)


@pytest.mark.parametrize("slices", [None, 2])
def test_trie(spark, monkeypatch, slices):
    if slices:  # several slices in every conversation
        monkeypatch.setattr(prefix_trie, "RANK_SLICE", slices)
        monkeypatch.setattr(prefix_trie, "BLOCK_SLICE", 1)
        monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = awkward()
    want = brute_trie(rows)
    assert len(want) > 200 and spark_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_trie_of_no_conversations(spark):
    assert spark_trie(spark.createDataFrame([], SCHEMA)) == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plain_trie_counts_every_conversation(spark):
    rows = awkward()
    root = [r for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect() if r.depth == 0]
    assert len(root) == 1 and root[0].n_convs == len({r[0] for r in rows} - {None})


def damage(rows):
    out = []
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest audit, least text first, by backward search over (row, roles so far)."""
    found = ordered(damage(rows), lambda r: (r[1] is not None, r[1] or 0, md5(r[2], r[3])))
    result = {}
    for c in {r[0] for r in rows} - {None}:
        rs = found.get(c, [])
        faults, seen = [], set()
        for _, _, role, text in rs:
            marks = WORD.findall(text)
            faults.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        n = len(rs)
        due = {"": "u", "s": "u", "u": "a", "a": "u"}
        least = {}
        for i in range(n, -1, -1):
            level = {q: (0, "", ()) for q in ("", "a")} if i == n else {}
            if i < n:
                role, late = rs[i][2], 3 * (faults[i] == "t")
                for q in due:
                    ways = [(least[i + 1, q][0] + 4, "D" + least[i + 1, q][1], least[i + 1, q][2])]
                    if faults[i] not in ("b", "d"):
                        to = role[:1]
                        if to == due[q] or (to == "s" and q == ""):
                            m = least[i + 1, to]
                            ways.append((m[0] + late, "K" + m[1], (f"{role}:{rs[i][3]}",) + m[2]))
                        m = least[i + 1, due[q]]
                        ways.append((m[0] + 3 + late, "R" + m[1], (("user:" if due[q] == "u" else "assistant:") + rs[i][3],) + m[2]))
                    level[q] = min(ways)
            for _ in range(4):
                for q in due:
                    if due[q] in level:
                        m = level[due[q]]
                        way = (m[0] + 3, "I" + m[1], ("user:" if due[q] == "u" else "assistant:",) + m[2])
                        if q not in level or way[:2] < level[q][:2]:
                            level[q] = way
            least.update({(i, q): v for q, v in level.items()})
        turns = [r[1] for r in rs if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rs, rs[1:])]
        cost, audit, lines = least[0, ""]
        result[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))
    return result


REPAIRED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spark_repair(df):
    return {r.conv_id: tuple(r[c] for c in REPAIRED) for r in structure_repair.structure_repair(df).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_repair(spark, seed):
    rows = awkward()
    rng = random.Random(seed)
    for c in range(300, 420):
        rows += [(c, t // rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant"]), rng.choice(["a.", "b.", "c", "d!", ""])) + CLASH
                 for t in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert spark_repair(df) == brute_repair(rows)


def test_repair_in_pieces(spark):
    """Slices of few turns make many pieces of a conversation."""
    rng = random.Random(8)
    rows = [(c, t * (300 if c % 2 else 7), rng.choice(["system", "user", "assistant", "user"]), rng.choice(["a.", "b", "c!", f"t{t}.", f"t{t}."])) + CLASH
            for c in range(30) for t in range(rng.randint(1, 60))]
    rows += [(50, None, rng.choice(["user", "assistant"]), f"null {i}.") + CLASH for i in range(2300)]  # one slice of several pieces
    rows += [(51, 3, "user", "same.") + CLASH for i in range(1500)]
    assert spark_repair(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute_repair(rows)


def test_repair_of_no_conversations(spark):
    assert structure_repair.structure_repair(spark.createDataFrame([], SCHEMA)).count() == 0
