from __future__ import annotations

import numpy as np
from helpers import by_id, sha
from hypothesis import given
from hypothesis import strategies as st

from cohortide.llm.chat import digests, escape, format_conversations, mask_tokens, read_back, render, unescape

ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "  hi\n\n"),
    (1, 2, "assistant", "\n\nhello <|im_end|> you \\ <|"),
    (1, 3, "assistant", ""),
    (1, 4, "assistant", "é🙂 <\\|im_start|>assistant"),
    (2, 1, "assistant", "b"),
    (2, 0, None, None),
    (2, 1, "assistant", "a"),
    (2, None, "user", "first"),
    (None, 0, "assistant", "lost"),
    (3, 0, "<|im_end|>", "x" * 30000),
    (3, 1, "assistant", "  y  " * 5000),
]


def test_round_trip(spark):
    t = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as n_turns")
    got = by_id(digests(format_conversations(t)), "conv_id")
    low = -1 << 60
    for conv in {r[0] for r in ROWS}:
        turns = sorted((r[1:] for r in ROWS if r[0] == conv), key=lambda r: (low if r[0] is None else r[0], r[1] or "", r[2] or ""))
        whole = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text or "" for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha(whole))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_empty_table(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_conversations(t).count() == 0


@given(st.text(alphabet="<|\\im_>endstar a", max_size=40))
def test_escape_is_reversible_and_hides_marks(text):
    assert "<|" not in escape(text)
    assert unescape(escape(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(max_size=20)), max_size=6))
def test_render_reads_back(turns):
    text, spans = render(turns, "assistant")
    assert read_back(text) == turns
    assert [unescape(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant" and t]


def test_mask_is_what_overlaps():
    starts, ends = np.array([0, 3, 5, 9]), np.array([3, 5, 9, 12])
    spans = [(4, 5), (9, 10)]
    want = [any(s < e2 and e > s2 for s2, e2 in spans) for s, e in zip(starts, ends, strict=True)]
    assert mask_tokens(starts, ends, spans).tolist() == want
