"""Chat formatting with a grammar round trip.

A turn is rendered as its role's opening mark, the text, and the closing mark. A deterministic parser reads the rendered text
back; where the recovered turn differs from the source, because its text holds a mark or an escape, the conflicting content is
escaped and the turn rendered again, until both are identical.

Grammar (a conversation is turns one after another; no mark is a border of itself or begins inside another, so the leftmost
closing mark ends a turn whatever stands around it):
    turn := open(role) text close(role)
Escaped text writes each control string as `&ctl:N;`, N being its place in CONTROL, the string `&ctl:` itself included.

Cases: null text is empty; a null role is the empty role, rendered like any unknown role with its name in the opening mark; rows
of a conversation go by turn (null first), then role, then text, so ties and repeated rows have one order; rows with a null
conv_id are one conversation; an empty table gives no rows; further columns are ignored. Rows stream through a task in the
order of conversations, so a conversation of any length needs memory for its current turn only.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
#: Any other role: its name, escaped, stands in the opening mark.
OTHER = ("<|role|>", "<|text|>", "<|end|>")
CONTROL = ["&ctl:", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", *OTHER]
_control = re.compile("|".join(map(re.escape, CONTROL)))
_escape = re.compile("&ctl:([0-9]);")


def escape(text: str) -> str:
    return _control.sub(lambda m: f"&ctl:{CONTROL.index(m[0])};", text)


def unescape(text: str) -> str:
    return _escape.sub(lambda m: CONTROL[int(m[1])], text)


def render(role: str, text: str) -> tuple[str, int]:
    """The rendered turn, and where its text starts."""
    if role in MARKS:
        start, end = MARKS[role]
    else:
        start, end = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    return start + text + end, len(start)


def parse(s: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that starts at `at`: role, text, where its raw text starts and ends, where the turn ends."""
    for role, (start, end) in MARKS.items():
        if s.startswith(start, at):
            break
    else:
        if not s.startswith(OTHER[0], at):
            raise ValueError(f"no turn starts at {at}")
        name_end = s.index(OTHER[1], at)
        role, start, end = unescape(s[at + len(OTHER[0]) : name_end]), s[at : name_end + len(OTHER[1])], OTHER[2]
    begin = at + len(start)
    stop = s.find(end, begin)
    if stop < 0:
        raise ValueError(f"the turn at {at} has no end")
    return role, unescape(s[begin:stop]), begin, stop, stop + len(end)


def parse_all(s: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(s):
        role, text, _, _, at = parse(s, at)
        out.append((role, text))
    return out


def round_trip(role: str, text: str) -> tuple[str, tuple[str, str, int, int, int]]:
    """The turn's rendering whose parse gives the turn back, and that parse."""
    for body in (text, escape(text)):
        s, _ = render(role, body)
        try:
            got = parse(s)
        except ValueError:
            continue
        # conflicts end where no raw control string is left to meet a neighbour's marks
        if got[:2] == (role, text) and got[4] == len(s) and (body is not text or not _control.search(text)):
            return s, got
    raise ValueError("the grammar can't carry this turn")


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted (the rendered turn), loss_start, loss_end (the loss mask in it; null: none)."""

    def run(batches):
        for b in batches:
            got = [round_trip(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            mask = [(g[2], g[3]) if g[0] == "assistant" else (None, None) for _, g in got]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([s for s, _ in got], pa.string()), pa.array([a for a, _ in mask], pa.int64()), pa.array([z for _, z in mask], pa.int64())], names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    return rows.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of each conversation, from its formatted turns alone."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        out, now, state = [], None, None
        for b in batches:
            for conv, s, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv != now:
                    if state:
                        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(s):
                    role, text, _, _, at = parse(s, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    loss = unescape(s[lo:hi])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(s)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if state:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
