from tallyframe.llm import chat

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob b", "hé"), (1, 3, "ann", None), (1, 3, "ann", None),
        (2, 0, "system", "alone"), (None, 4, "cid", "solo"), (None, None, "system", "x"), (3, None, None, "who"), (3, 600, "dan", ""),
        (4, 0, "ann", "w " * 20_000)]


def rendered(turns, who):
    text, masks = "", []
    for _, role, body in turns:
        name = "".join(c if c.isalnum() or c in "_.-" else "_" for c in role)
        head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={name}|>\n"
        body = body.replace("<|", "<\\|").replace("|>", "|\\>") + "<|end|>\n"
        text += head
        if role == who:
            masks.append((len(text), len(text) + len(body)))
        text += body
    return text, masks


def brute(rows, size=256):
    groups = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault(("alone", k) if conv is None else conv, []).append((turn, role or "unknown", text or ""))
    out = set()
    for conv, turns in groups.items():
        people = {r for _, r, _ in turns if r != "system"}
        blocks = {}
        for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
            blocks.setdefault((t[0] or 0) // size, []).append(t)
        for block, part in blocks.items():
            for who in people:
                text, masks = rendered(part, who)
                out.add((None if isinstance(conv, tuple) else conv, block, who, len(part), text, tuple(masks)))
    return out


def test_matches_python(spark):
    chats = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "conv_id long, turn long, role string, text string, block string, perspective string")
    got = chat.rotate(chats).collect()
    mine = {(r.conv_id, r.block, r.perspective, r.n_turns, r.text, tuple(map(tuple, r.masks))) for r in got}
    assert mine == brute(ROWS) and len(got) == len(mine)


def test_masks_cover_own_turns_only(spark):
    chats = spark.createDataFrame([(1, k, "ab"[k % 2], f"turn {k}") for k in range(9)], "conv_id long, turn long, role string, text string")
    for r in chat.rotate(chats, chat.ChatFormat(block_turns=4)).collect():
        spans = [r.text[m.begin : m.end] for m in r.masks]
        want = [f"turn {k}<|end|>\n" for k in range(4 * r.block, min(9, 4 * r.block + 4)) if "ab"[k % 2] == r.perspective]
        assert spans == want


def test_empty_table(spark):
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(chats).collect() == []
