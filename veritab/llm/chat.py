"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import partitions_for, slices, stage, texts_of
from veritab.llm.encode import encoder_for

#: Tokens of a window, and of the earlier turns that it may repeat.
BUDGET = 1024
HISTORY = 256

#: Control strings. The template uses the first four; all six are escaped inside texts and roles.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, ROLE, TEXT, CLOSE, "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\:])")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)

WINDOW_SCHEMA = "conv_id long, window long, text string, n_tokens long, repeated int, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """Break every control string, reversibly: backslashes are doubled, and \\: follows a control string's first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\:" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def _turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends in it."""
    head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


class _Windows:
    """Windows of one conversation, fed turn by turn in order; holds one window's turns at most."""

    def __init__(self, conv_id, budget: int, history: int, target: str):
        self.conv_id, self.budget, self.history, self.target = conv_id, budget, history, target
        self.system: tuple | None = None
        self.past: deque = deque()
        self.past_tokens = 0
        self.number = self.seen = 0
        self.new: list[tuple] = []
        self.before: list[tuple] = []
        self.tokens = 0

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        turn, out = (role, *_turn_text(role, text), tokens), None
        if self.new and self.tokens + tokens > self.budget:
            out = self.close()
        if not self.new and self.seen:
            self._repeat(self.budget - tokens)
        self.new.append(turn)
        self.tokens += tokens
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        return out

    def _repeat(self, room: int) -> None:
        """The system turn, and the latest turns within the history and the room that it and the next turn leave."""
        keep = [self.system] if self.system else []
        room -= sum(t[4] for t in keep)
        room, late = min(room, self.history), []
        for t in reversed(self.past):
            if t[4] > room:
                break
            room -= t[4]
            late.append(t)
        self.before = keep + late[::-1]
        self.tokens = sum(t[4] for t in self.before)

    def close(self) -> tuple:
        text, spans = [OPEN], []
        at = len(OPEN)
        for i, (role, body, start, end, _) in enumerate([*self.before, *self.new]):
            if i >= len(self.before) and role == self.target:
                spans.append({"start": at + start, "end": at + end})
            text.append(body)
            at += len(body)
        out = (self.conv_id, self.number, "".join(text), self.tokens, len(self.before), spans)
        for t in self.new:
            if t is not self.system:
                self.past.append(t)
                self.past_tokens += t[4]
        while self.past and self.past_tokens - self.past[0][4] >= self.history:
            self.past_tokens -= self.past.popleft()[4]
        self.number += 1
        self.new, self.before, self.tokens = [], [], 0
        return out


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, target: str = "assistant") -> DataFrame:
    """Format conversations (conv_id, turn, role, text) as rows of WINDOW_SCHEMA.

    The running sum of turn tokens decides where a window ends: it takes whole turns while they fit the budget; a turn
    longer than the budget has a window of its own. Each later window first repeats the system turn (a conversation's
    first turn, if its role is system) and then the latest turns within the history and the budget. The system turn is
    always kept, so a window exceeds the budget where that turn and the next one do together. loss_spans are the escaped target
    texts as code-point ranges of text; repeated turns are never in them. Turns are ordered by turn (null first), then
    role and text, so ties and repeated rows have one order; null role and text count as empty; a null conv_id is a
    conversation. Rows stream through sorted partitions: no conversation is held whole.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = own.repartition(partitions_for(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, True)
        names = ["conv_id", "window", "text", "n_tokens", "repeated", "loss_spans"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        out: list[tuple] = []
        state: _Windows | None = None

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            ids, roles, texts = batch.column("conv_id").to_pylist(), texts_of(batch.column("role")), texts_of(batch.column("text"))
            for a, b in slices(texts):
                sizes = [len(x) // 4 for x in encoder.encode([_turn_text(r, t)[0] for r, t in zip(roles[a:b], texts[a:b], strict=True)])]
                for conv_id, role, text, n in zip(ids[a:b], roles[a:b], texts[a:b], sizes, strict=True):
                    if state is None or state.conv_id != conv_id:
                        if state:
                            out.append(state.close())
                        state = _Windows(conv_id, budget, history, target)
                    if made := state.add(role, text, n):
                        out.append(made)
                if out:
                    yield flush()
        if state:
            out.append(state.close())
            yield flush()

    return sorted_.mapInArrow(run, WINDOW_SCHEMA)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text, len(OPEN))]


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back: each conversation's turns once, and the text under its loss mask."""
    sorted_ = formatted.repartition(partitions_for(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        conv, state = None, None

        def end() -> None:
            n, turns, loss_n, loss, chars, count = state
            out.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, count))

        for batch in batches:
            for row in range(batch.num_rows):
                conv_id, text, repeated, spans = (batch.column(c)[row].as_py() for c in ("conv_id", "text", "repeated", "loss_spans"))
                if state is None or conv != conv_id:
                    if state:
                        end()
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        if state:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return sorted_.mapInArrow(run, DIGEST_SCHEMA)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(stage(windows(turns.unionByName(more)), "windows"))
