from collections import defaultdict

from quarrymill.llm.chat import CLOSE, OPEN, format_chats


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].add((t is not None, t or 0, r or "", x or ""))
    whole = {c: tuple((r, x) for _, _, r, x in sorted(s)) for c, s in convs.items()}
    kept = []
    for c, a in whole.items():
        longer = any(len(b) > len(a) and b[: len(a)] == a for b in whole.values())
        first = min(d for d, b in whole.items() if b == a) == c
        if first and not longer:
            kept.append((c, len(a), "".join(f"{OPEN}{r}\n{x}{CLOSE}\n" for r, x in a)))
    return sorted(kept)


def test_matches_brute_force(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    got = format_chats(turns).collect()
    assert sorted((r.conv_id, r.n_turns, r.text) for r in got) == brute(rows)
    said = {c: [x for d, _, r, x in sorted(rows, key=str) if d == c and r == "assistant"] for c in {r[0] for r in rows}}
    for r in got:
        assert sorted(r.text[s.start : s.start + s.length] for s in r.spans) == sorted(said[r.conv_id])


def test_edges(spark):
    u, a = "user", "assistant"
    rows = [(1, 0, u, "hi"), (2, 0, u, "hi"), (2, 1, a, "yo"), (3, 5, u, "hi"), (3, 6, a, "yo"), (3, 7, u, "more"), (4, 0, u, "hi"), (4, 1, a, "other")]
    rows += [(5, 0, u, "hi"), (5, 0, u, "hi"), (6, 0, None, None), (6, None, a, ""), (None, 0, u, "lost"), (7, 0, a, "z" * 300_000), (8, 3, u, "same"), (9, 4, u, "same")]
    rows += [(10, 0, u, "tie"), (10, 0, a, "tie"), (11, 0, "hi", u)]
    turns = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, N_turns int, spans string")
    got = format_chats(turns)
    assert got.columns == ["conv_id", "n_turns", "text", "spans"]
    assert sorted((r.conv_id, r.n_turns, r.text) for r in got.collect()) == brute(rows)
    assert format_chats(turns.limit(0)).count() == 0


def test_ties_of_a_turn_number(spark):
    """A turn number that both roles share: whether one log continues another is decided by role and text, as rendered."""
    rows = []
    for i in range(12):
        rows += [(2 * i, 0, "user", f"question {i}"), (2 * i + 1, 0, "user", f"question {i}"), (2 * i + 1, 0, "assistant", f"answer {i}")]
    rows += [(100, 0, "tool", "a"), (101, 0, "tool", "a"), (101, 0, "tool", "b"), (102, 0, "tool", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.n_turns, r.text) for r in format_chats(turns).collect())
    assert got == brute(rows)
    assert len(got) == 26
