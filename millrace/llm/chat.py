"""Chat transcripts: recover the speakers' roles with a hidden Markov model and render canonical turns.

A transcript's lines are the observations. Each line gives features: the speaker marker at its start ("User:", "### Assistant",
"Q." ...), whether it begins a message, its length, its marks, and at a message's first line the message's lines and size. The states are the roles, at the first line of a turn or
later. Probabilities are counted from labelled turns; roles are recovered by Viterbi.

Messages lie in partitions by ranges of (conversation, turn), so a long conversation is cut into stretches. Viterbi is a
product of matrices in the (max, +) semiring: the stretches at the borders of partitions are reduced to their matrices,
these are chained, and each stretch is traced back between its known ends. The result is that of one pass.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import scratch_root

#: What a speaker marker may say for each role.
MARKERS = {
    "system": "system sys instruction instructions context",
    "user": "user human customer client question q prompt me you",
    "assistant": "assistant ai bot gpt model agent answer a response reply",
}
_WORD = {word: role for role, words in MARKERS.items() for word in words.split()}
_MARKER = re.compile(r"\s*(?:<\|(?:im_start\|>)?\s*|\[|#{1,6}\s*|\*{1,2}|>\s*)?([A-Za-z]{1,12})\s*(?:\|>|\]|\*{1,2})?\s*(?:[:.>\-]|$)\s*(?:\*{1,2})?")
_LINE = re.compile(r"\r\n|\r|\n")
ROLES = ("assistant", "system", "user")
_FEATURES = ("marker", "first", "length", "end", "start", "lines", "size")
#: Added to each count.
SMOOTHING = 1.0


def features(line: str, first: bool, count: int = 1, size: int = 0) -> tuple[str, ...]:
    """One value of each feature. count and size are the lines and characters of the message, which its first line stands for."""
    m = _MARKER.match(line)
    role = _WORD.get(m[1].lower()) if m and m[1] else None
    text = line.strip()
    return (role or "none", str(first), str(len(text).bit_length()), "?" if text.endswith("?") else "." if text.endswith((".", "!")) else "-", "U" if text[:1].isupper() else "d" if text[:1].isdigit() else "o", str(min(count, 12)) if first else "-", str(int(3 * math.log2(size + 1))) if first else "-")


def lines(text: str | None) -> list[str]:
    return _LINE.split(text or "")


@dataclass
class Model:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: dict[tuple[int, str], np.ndarray]  # (feature, value) -> states
    rare: list[np.ndarray]  # of each feature, for values never counted

    def emission(self, line: str, first: bool, count: int = 1, size: int = 0) -> np.ndarray:
        return sum(self.emit.get((i, v), self.rare[i]) for i, v in enumerate(features(line, first, count, size)))


#: State 2r: the first line of a turn of role r; 2r + 1: a later one.
STATES = 2 * len(ROLES)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, held_out) by ranges of (conversation, turn), written to the shared folder with its partitions:
    a conversation lies in one partition or in neighbouring ones. The role is null where it isn't one of ROLES."""
    scratch_root(turns.sparkSession)
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    own = own.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role"))).withColumn("held_out", held_out)
    key = ["conv_id", "turn", F.xxhash64("text"), F.xxhash64("role")]
    if turns.sparkSession.sparkContext.getCheckpointDir() is None:
        turns.sparkSession.sparkContext.setCheckpointDir(scratch_root(turns.sparkSession))
    return own.repartitionByRange(*key).sortWithinPartitions(*key).checkpoint()


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def train(messages: DataFrame) -> Model:
    """Counts over what ordered() gave, but for held-out conversations and unknown roles.

    A task counts for itself, so that a few hundred sums are shuffled; what follows what across the border of two
    partitions is counted on the driver, from the two ends of each partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        part, before, opened = TaskContext.get().partitionId(), None, False
        for conv, _, role, text, held in _messages(batches):
            own, r = lines(text), None if role is None or held else ROLES.index(role)
            if not opened:
                n["head", -1 if r is None else 2 * r, f"{part}:{conv}"] = 1
            elif r is not None:
                if before[0] != conv:
                    n["start", 2 * r, ""] += 1
                elif before[1] is not None:
                    n["step", before[1], str(2 * r)] += 1
            opened, before = True, (conv, None if r is None else 2 * r + (len(own) > 1))
            for i, line in enumerate(own if r is not None else ()):
                for k, v in enumerate(features(line, i == 0, len(own), len(text or ""))):
                    n["emit", 2 * r + (i > 0), f"{k}:{v}"] += 1
                if i:
                    n["step", 2 * r + (i > 1), str(2 * r + 1)] += 1
        if opened:
            n["tail", -1 if before[1] is None else before[1], f"{part}:{before[0]}"] = 1
        yield pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array([k[2] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["kind", "a", "b", "n"])

    start, step = np.full(STATES, SMOOTHING), np.full((STATES, STATES), SMOOTHING)
    emit: dict[tuple[int, str], np.ndarray] = {}
    ends: dict[int, dict[str, tuple[int, str]]] = {}
    for r in messages.mapInArrow(run, "kind string, a int, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        first, _, rest = r["b"].partition(":")
        if r["kind"] == "start":
            start[r["a"]] += r["n"]
        elif r["kind"] == "step":
            step[r["a"], int(r["b"])] += r["n"]
        elif r["kind"] == "emit":
            emit.setdefault((int(first), rest), np.full(STATES, SMOOTHING))[r["a"]] += r["n"]
        else:
            ends.setdefault(int(first), {})[r["kind"]] = (r["a"], rest)
    before = None
    for _, end in sorted(ends.items()):
        a, conv = end["head"]
        if a >= 0 and before is not None and before[1] == conv:
            step[before[0], a] += before[0] >= 0
        elif a >= 0:
            start[a] += 1
        before = end["tail"]
    totals = [sum((x for (f, _), x in emit.items() if f == k), np.full(STATES, SMOOTHING)) for k in range(len(_FEATURES))]
    for a in range(STATES):  # a turn's first line is state 2r, later ones are 2r + 1 of the same role
        step[a, [b for b in range(1, STATES, 2) if a // 2 != b // 2]] = 0
    start[1::2] = 0
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), {k: np.log(x / totals[k[0]]) for k, x in emit.items()}, [np.log(SMOOTHING / t) for t in totals])


def chain(model: Model, emissions: list[np.ndarray]) -> np.ndarray:
    """What a stretch of lines does: from the state before it, or (last row) the start, the best score of each last state."""
    m = np.vstack([model.step, model.start]) + emissions[0]
    for e in emissions[1:]:
        m = (m[:, :, None] + model.step[None]).max(axis=1) + e
    return m


def trace(model: Model, emissions: list[np.ndarray], entry: np.ndarray | None, last: int | None) -> list[int]:
    """The states of a stretch of lines. entry: scores of the states before it, None at the start; last: its last state, if known."""
    score = (model.start if entry is None else (entry[:, None] + model.step).max(axis=0)) + emissions[0]
    back = []
    for e in emissions[1:]:
        m = score[:, None] + model.step
        back.append(m.argmax(axis=0))
        score = m.max(axis=0) + e
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """The conversations of a partition, each with its messages there."""
    for conv, rows in itertools.groupby(_messages(batches), key=lambda r: r[0]):
        yield conv, list(rows)


def _emissions(model: Model, rows: list[tuple]) -> list[np.ndarray]:
    out = []
    for row in rows:
        own = lines(row[3])
        out += [model.emission(line, i == 0, len(own), len(row[3] or "")) for i, line in enumerate(own)]
    return out


def _borders(messages: DataFrame, model: Model) -> dict[tuple[int, str], tuple[np.ndarray | None, int | None]]:
    """(partition, conversation) -> scores before it and its last state, for conversations in several partitions.

    Only the first and the last conversation of a partition can be such: two matrices a partition are gathered.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), None, 0
        for conv, rows in _stretches(batches):
            if n == 0:
                yield pa.record_batch([pa.array([part], pa.int64()), pa.array([str(conv)]), pa.array([chain(model, _emissions(model, rows)).ravel().tolist()], pa.list_(pa.float64()))], ["part", "conv", "matrix"])
            held, n = (conv, rows), n + 1
        if n > 1:
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([str(held[0])]), pa.array([chain(model, _emissions(model, held[1])).ravel().tolist()], pa.list_(pa.float64()))], ["part", "conv", "matrix"])

    runs: dict[str, list[tuple[int, np.ndarray]]] = {}
    for r in messages.mapInArrow(run, "part long, conv string, matrix array<double>").collect():
        runs.setdefault(r["conv"], []).append((r["part"], np.array(r["matrix"]).reshape(STATES + 1, STATES)))
    out = {}
    for conv, parts in runs.items():
        if len(parts) > 1:
            parts.sort(key=lambda x: x[0])
            scores: list[np.ndarray | None] = [None]
            for i, (_, m) in enumerate(parts):
                scores.append(m[-1] if i == 0 else (scores[-1][:, None] + m[:-1]).max(axis=0))
            last = int(scores[-1].argmax())
            for i in reversed(range(len(parts))):
                out[parts[i][0], conv] = scores[i], last
                if i:
                    # the state before the stretch through which the best path to its last state runs
                    last = int((scores[i] + parts[i][1][:-1, last]).argmax())
    return out


def render(role_lines: list[tuple[str, str]]) -> str:
    """Turns in canonical form from (role of a new turn or "", line); a known speaker marker goes."""
    out: list[str] = []
    for role, line in role_lines:
        if role:
            m = _MARKER.match(line)
            if m and m[1] and m[1].lower() in _WORD:
                line = line[m.end() :].lstrip()
            out.append(f"{'<|im_end|>' + chr(10) if out else ''}<|im_start|>{role}")
        out.append(line)
    return "\n".join(out) + "<|im_end|>"


def recover(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """(conv_id, turn, held_out, role_pred, rendered, role) for each message of turns (conv_id, turn, role, text).

    role_pred is the role of the message's first line on the likeliest path of its conversation; rendered is the message as
    canonical turns. role is what the input says, in lower case, null if it isn't one of ROLES; it isn't used for predictions,
    but without a model one is trained on the conversations that aren't held out. Messages of equal turn are in the order of
    hashes of text and role. A null text is one empty line; rows with a null conv_id are one conversation; repeated rows
    are repeated messages. No rows give no rows.
    """
    messages = ordered(turns)
    known = model or train(messages)
    borders = _borders(messages, known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = (("conv_id", pa.int64()), ("turn", pa.int64()), ("held_out", pa.bool_()), ("role_pred", pa.string()), ("rendered", pa.string()), ("role", pa.string()))
            return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

        for conv, rows in _stretches(batches):
            entry, last = borders.get((part, str(conv)), (None, None))
            path = trace(known, _emissions(known, rows), entry, last)
            at = 0
            for _, turn, role, text, held in rows:
                own = lines(text)
                states = path[at : at + len(own)]
                at += len(own)
                marked = [(ROLES[s // 2] if i == 0 or s % 2 == 0 else "", line) for i, (s, line) in enumerate(zip(states, own, strict=True))]
                out.append((conv, turn, held, marked[0][0], render(marked), role))
                if len(out) == 5_000:
                    yield packed()
                    out.clear()
        if out:
            yield packed()

    return messages.mapInArrow(run, "conv_id long, turn long, held_out boolean, role_pred string, rendered string, role string")
