"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns (role, text) to one string. Successive turn prefixes are rendered and
consecutive outputs compared: what a prefix adds is its last turn's span. A second rendering, with the last text replaced
by a probe, shows where in the span the text lies, escapes included. If an output does not begin with the one before it,
the template rewrites history: the turn is marked and its piece replaces what came after ``start``.

Turns arrive sorted by conversation. A template declared ``turn_local`` is held in a window, so that a conversation of any
length streams through bounded memory: when the window is full it restarts from its last turns. For every other template
the whole prefix is rendered at each turn, which is exact but grows with the conversation.

Null texts and roles are empty. Turns are ordered by turn number (null first), then role and text, so ties have one
order; repeated rows are repeated turns. Rows without a conversation id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.words import rows

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

WINDOW_TURNS = 32
CONTEXT_TURNS = 2
LOSS_ROLE = "assistant"
PROBE = "probe"

#: Control strings of common chat formats, escaped inside texts.
CONTROL_STRINGS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"

_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL_STRINGS))
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash after the first character of every control string, also of overlapping ones."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_local(template: Template) -> Template:
    """Declare that a template writes each turn alone, whatever the turns around it, and nothing else."""
    template.turn_local = True
    return template


@turn_local
def marked_template(turns: list[Turn]) -> str:
    """The production template: each turn between markers that no escaped text contains."""
    return "".join(f"{TURN}{escape(role)}{BODY}{escape(text)}{END}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """Turns of a text that ``marked_template`` made."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class Prefixes:
    """Renders a growing conversation and says what each turn added."""

    def __init__(self, template: Template, window: int = WINDOW_TURNS, context: int = CONTEXT_TURNS):
        self.template, self.window, self.context = template, window, context
        self.turns: list[Turn] = []
        self.output = template([])
        self.before = 0  # characters that lie before the window's own output
        self.local = getattr(template, "turn_local", False)

    def add(self, turn: Turn) -> tuple[str, int, int, int, bool]:
        """(piece, start, first, end, rewrites): the piece replaces the output from ``start`` on, the text is at
        [first, end)."""
        if self.local and len(self.turns) >= self.window:
            self._restart()
        lead, self.turns = self.output, [*self.turns, turn]
        self.output = self.template(self.turns)
        rewrites = not self.output.startswith(lead)
        keep = len(os.path.commonprefix([lead, self.output])) if rewrites else len(lead)
        if len(self.turns) == 1 and not rewrites:
            keep = 0  # what a template writes before the first turn belongs to it
        probed = self.template([*self.turns[:-1], (turn[0], PROBE)])
        at = probed.rfind(PROBE)
        if at < 0:  # the template leaves this text out
            first = end = len(self.output)
        else:
            first, end = at, len(self.output) - (len(probed) - at - len(PROBE))
        return self.output[keep:], self.before + keep, self.before + first, self.before + end, rewrites

    def _restart(self) -> None:
        tail = self.turns[-self.context :]
        whole = self.template(tail)
        if not self.output.endswith(whole):
            raise ValueError("the template is declared turn_local but its turns depend on those before")
        self.before += len(self.output) - len(whole)
        self.turns, self.output = tail, whole


_PIECES = (
    "conv_id long, nth long, role string, piece string, start long, text_first long, text_end long, "
    "in_loss boolean, rewrites boolean"
)


def format_chats(
    turns: DataFrame, template: Template = marked_template, loss_role: str = LOSS_ROLE,
    window: int = WINDOW_TURNS, context: int = CONTEXT_TURNS,
) -> DataFrame:
    """One row for each turn, in order within its partition: the piece of formatted text that the turn adds, its place
    in the conversation's text, the place of the turn's own text, and whether that is under the loss mask.

    turns: conv_id, turn, role, text. A conversation lies in one partition; its pieces, joined, are its text, except
    where ``rewrites`` says that a piece replaces text from ``start`` on.
    """
    chosen = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prefixes, nth = object(), None, 0
        names = [part.split()[0] for part in _PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for conv, _, role, text in rows(iter([batch.slice(at, 1024)])):
                    if conv != current:
                        current, prefixes, nth = conv, Prefixes(template, window, context), 0
                    piece, start, first, end, rewrites = prefixes.add((role, text))
                    out.append((conv, nth, role, piece, start, first, end, role == loss_role, rewrites))
                    nth += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return ordered.mapInArrow(run, _PIECES)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """Read conversations back from the pieces of ``marked_template`` and digest them.

    Pieces must come as ``format_chats`` gives them: whole conversations, in order. Digests are fed turn by turn.
    """
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None

        def done(found: list[list]) -> pa.RecordBatch:
            made = [(c, n, a.hexdigest(), k, b.hexdigest(), f) for c, n, a, k, b, f in found]
            columns = zip(*made, strict=True) if made else ((),) * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            found = []
            for conv, nth, _, piece, start, first, end, in_loss, _ in rows(iter([batch])):
                if nth == 0:
                    if state:
                        found.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    masked = unescape(piece[first - start : end - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
            yield done(found)
        if state:
            yield done([state])

    return pieces.mapInArrow(run, schema)
