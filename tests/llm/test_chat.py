import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stacklight.llm import chat

NASTY = [*chat.CONTROL, "&ctl:0;", "&ct", "l:3;", "\n", " ", "é", "[", "/INST]", "<", "/s>"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<|text|>"]), st.lists(st.sampled_from(NASTY), max_size=8).map("".join)), max_size=6))
def test_round_trip_of_whole_conversations(turns):
    assert chat.parse_all("".join(chat.round_trip(*t)[0] for t in turns)) == turns


def test_plain_text_stays_plain():
    assert chat.round_trip("user", "hi")[0] == "[INST] hi [/INST]"
    with pytest.raises(ValueError):
        chat.parse("no turn")


def test_digests(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, None, "user", None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb</s>\nassistant\n\n") and got[1].loss_sha256 == sha("b</s>") and got[1].loss_chars == 5
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[2].turns_sha256 == sha("\nx\n\nx\n")
    assert got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []
