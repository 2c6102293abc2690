"""Turns of mixed parts against plain Python."""

import math

from tidemark.llm import chat


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


ROWS = [
    (1, 2, "assistant", [part("text", 'a<b\\"é'), None, part("image", ref="r1", width=100, height=30), part("text", "end"), part("document", ref="r2", pages=3),
                         part("audio", ref="r3", seconds=1.01), part("video", ref="r4"), part(None, "n")]),
    (1, None, None, [part("image", ref="r0")]),
    (1, 3, 'us"er', None),
    (2, 0, "assistant", [part("text"), part("audio"), None]),
]


def esc(t):
    return (t or "").replace("\\", "\\b").replace("<", "\\l").replace('"', "\\q")


def plain(turn, role, parts):
    piece, loss, files = f'<turn role="{esc(role)}">', [], []
    for i, (kind, text, ref, width, height, seconds, pages) in enumerate(p for p in parts or [] if p):
        if kind in (None, "text"):
            out = esc(text)
            if role == "assistant":
                loss.append((len(piece), len(out)))
        else:
            out = f"<{esc(kind)} {'' if turn is None else turn}.{i}>"
            tokens = {"image": math.ceil((width or 1) / 14) * math.ceil((height or 1) / 14), "audio": math.ceil((seconds or 0) * 25), "document": (pages or 1) * 256}
            files.append((i, kind, ref, len(piece), tokens.get(kind, 0)))
        piece += out
    return piece + "</turn>\n", loss, files


def test_mixed_and_null_parts(spark):
    messages = spark.createDataFrame(ROWS, f"conv_id int, turn long, role string, parts array<{chat.PART}>").repartition(3)
    got = {(r.conv_id, r.turn): (r.piece, [tuple(x) for x in r.loss], [tuple(x) for x in r.attachments]) for r in chat.formatted_turns(messages).collect()}
    assert got == {(c, t): plain(t, role, parts) for c, t, role, parts in ROWS}
    back = {r.conv_id: r for r in chat.read_back(chat.formatted_chats(messages)).collect()}
    for c in (1, 2):
        rows = sorted((r for r in ROWS if r[0] == c), key=lambda r: -1 if r[1] is None else r[1])
        made = [plain(t, role, parts) for _, t, role, parts in rows]
        assert back[c].formatted == "".join(m[0] for m in made)
        assert [tuple(x) for x in back[c].attachments] == [x for m in made for x in m[2]]
        assert [t.role for t in back[c].turns] == [role or "" for _, _, role, _ in rows]
    assert back[1].loss_text == 'a<b\\"éendn' and back[2].loss_text == ""
    assert [t.text for t in back[1].turns] == ["<image .0>", 'a<b\\"é<image 2.1>end<document 2.3><audio 2.4><video 2.5>n', ""]
